"""Personal data: detection and keyed surrogates of the same kind and format.

Entities are found by one pattern per text: mail addresses, IPv4 addresses,
phone numbers, payment cards (with an issuer's first digit and a valid check
digit; other long numbers are left alone), social security numbers, quoted
secrets, and names of any number of words behind one or more titles.  The
surrogate of a value comes from a hash of the key, the kind and the normalized
value (cards, phones and social security numbers by their digits): the same value
gets the same surrogate in every document (a name is replaced part by part, so
"Mr A B" and "Mr B" stay one person), letters stay letters and digits digits,
cards keep a valid check digit, phones behind a plus their country code, names
keep script and the gender of the title; initials are shifted by a keyed step.
Words of a name that stand alone elsewhere in its text, spelled alike, get the
surrogate of the name; names without a title anywhere in the text stay.

All distinct values are checked against one another: a surrogate that two
values share, or that is itself a value of the corpus, is drawn again until
every value has one of its own.  Texts without entities are never shuffled;
the others are written once, their distinct values joined with the surrogates
and gathered per text.  A value that a third of all rows hold is one row of the
table of values, and its occurrences carry no text.  Only DataFrame functions
are used.

Defined results: a null text stays null; repeated rows change alike; other
columns pass through (names that begin with two underscores are reserved); an
empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan.llm.columns import let
from boxscan.session import stage

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPACE = "[ \u00a0]{1,2}"
TITLE = (
    "(?:Mrs|Mr|Ms|Miss|Mx|Dr|Doctor|Prof|Professor|Sir|Lady|Lord|Dame|Rev|Herrn|Herr|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle"
    f"|Señorita|Señora|Señor|Srta|Sra|Sr|Don|Doña|Господин|Госпожа)\\.?{SPACE}")
#: Words between the parts of a name; they stay.
PARTICLE = f"(?:van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|las|los|el|al|bin|ibn|ben|ter|ten|zu|zur|af|av){SPACE}"
#: Not a third or later word of a name, and not taken for a name where it stands alone.
OTHER = (
    "(?!(?:The|This|That|These|Those|And|But|Or|He|She|It|They|We|You|His|Her|Its|Their|If|Of|For|From|With|By|Is|Was|Are|Has|Had"
    "|When|Then|There|Who|What|Why|How|Not|After|Before|Der|Das|Und|Sie|Wir|Ich|Ist|Hat|Et|Il|Elle|Une|El|Это|Он|Она|И|В|На|Но)"
    "(?![\\p{L}.'’-]))")
#: A part of a name: inner capitals and apostrophes belong to it, a possessive ending does not.
PART = (
    "\\p{Lu}[\\p{L}\\p{M}]*+"
    "(?:['’](?!(?:s|d|ll|re|ve|t|m)(?!\\p{L}))\\p{L}[\\p{L}\\p{M}]*+)*+")
#: Parts joined by hyphens, or an initial with its full stop.
WORD = f"(?:\\p{{Lu}}\\.(?:-?\\p{{Lu}}\\.)*+|{PART}(?:-{PART})*+)"
#: kind: pattern.  The first kind whose pattern matches a place wins.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\\.){1,8}[A-Za-z]{2,24}",
    "secret": "(?i:token|secret|api_?key|password|passwd)\\s{0,3}[=:]\\s{0,3}\"[^\"\\s]{8,512}\"",
    "phone": "\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9]|[ .-][0-9]{2}(?![0-9]))"
             "|\\+[0-9]{1,3}[ .-]?(?:\\(0\\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
             "|\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
             "|\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             "|(?<![0-9]|[0-9][.-])(?:1[ .-])?(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\\.[0-9]{3}\\.[0-9]{4}"
             "|[0-9]{3} [0-9]{3} [0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4})(?![0-9]|[.-][0-9])",
    "ip": f"(?<![0-9.]){OCTET}(?:\\.{OCTET}){{3}}(?!\\.?[0-9])",
    "ssn": "(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9-])",
    "card": "(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "name": f"(?<!\\p{{L}})(?=[A-ZА-Я])(?:{TITLE}){{1,4}}(?:{PARTICLE})*{WORD}"
            f"(?:{SPACE}(?:{PARTICLE})*{WORD}(?:{SPACE}(?:{PARTICLE})*{OTHER}{WORD})*)?",
}
FEMALE = "^(?:Mrs|Ms|Miss|Lady|Dame|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Госпожа)(?!\\p{L})"
#: Where the country code of a phone ends.
COUNTRY = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ANY = "|".join(PATTERNS.values())
TITLES = f"^(?:{TITLE})+"
#: Kind of a single letter of a name.  There are too few to give each one of its own by trial.
INITIAL = "initial"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝ")
#: Syllables of made-up names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te va ve",
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те ва ве",
}


@dataclass(frozen=True)
class Pseudonyms:
    key: str = "surrogates"
    #: Rounds of drawing again before the job fails.
    rounds: int = 20


def kind_of(match: Column) -> Column:
    """The kind of a matched string; null for a number without a valid check digit."""
    out = F.when(match.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in ("secret", "phone", "ip", "ssn"):
        out = out.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    out = out.when(match.rlike("^[0-9 -]+$"), F.when(check_sum(match, 0) % 10 == 0, "card"))
    return out.when(match.rlike("\\p{L}"), "name")


def check_sum(number: Column, first: int) -> Column:
    """Sum of the digits from the right, every second one doubled, from place ``first`` (0 or 1)."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")

    def term(c: Column, i: Column) -> Column:
        d = F.when(c == "", 0).otherwise(c).cast("int")
        double = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((i + first) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(digits, term), F.lit(0), lambda a, x: a + x)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))


def _rebuilt(text: Column, pattern: str, new: Column) -> Column:
    """``text`` with ``new``, an array, in place of the matches of ``pattern``."""
    return let(new, lambda n: F.array_join(F.transform(
        F.split(text, pattern, -1), lambda x, i: F.concat(x, F.coalesce(F.get(n, i), F.lit("")))), ""))


def atoms(match: Column, kind: Column) -> Column:
    """array<struct(kind, value)>: what has a surrogate of its own in a matched string."""
    def atom(k: Column | str, value: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), value.alias("value"))

    given = F.when(match.rlike(FEMALE), "given_f").otherwise("given_m")

    def parts(words: Column) -> Column:
        def of(word: Column, i: Column) -> Column:
            place = F.when(i == F.size(words) - 1, "surname").otherwise(given)
            return F.transform(_all(word, PART), lambda p: atom(F.when(F.length(p) == 1, INITIAL).otherwise(place), p))

        return F.flatten(F.transform(words, of))

    names = let(_all(F.regexp_replace(match, TITLES, ""), WORD), parts)
    digits = F.regexp_replace(match, "[^0-9]", "")
    secret = F.regexp_extract(match, "\"([^\"]*)\"", 1)
    return (
        F.when(kind.isNull(), F.array().cast("array<struct<kind:string,value:string>>"))
        .when(kind == "name", names)
        .when(kind == "secret", F.array(atom("secret", secret)))
        .when(kind == "email", F.array(atom("email", F.lower(match))))
        .when(kind == "phone", F.array(atom("phone", F.concat(F.regexp_extract(match, "^\\+?", 0), digits))))
        .when(kind.isin("card", "ssn"), F.array(atom(kind, digits)))
        .otherwise(F.array(atom(kind, match)))
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Hex digits, two per character of the value and some to spare."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    return F.array_join(F.transform(
        F.sequence(F.lit(0), (F.length(value) / 63).cast("int") + 1),
        lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")).cast("binary"), 512)), "")


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(value: Column, stream: Column, keep: Column) -> Column:
    """Each digit and letter replaced within its class, the first ``keep`` characters kept."""
    def one(alphabet: str, n: Column) -> Column:
        return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))

    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexes = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & value.rlike("[0-9]")

    def swap(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), one("0123456789", n))
            .when(c.rlike("[a-z]"), F.when(hexes, one("abcdef", n)).otherwise(one(low, n)))
            .when(c.rlike("[A-Z]"), F.when(hexes, one("ABCDEF", n)).otherwise(one(high, n)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _made_up(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A name of the value's script; given names end by gender; another try adds a syllable."""
    def name(script: str, ends: tuple[str, str, str]) -> Column:
        syllables = F.split(F.lit(SYLLABLES[script]), " ")
        body = F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(2) + attempt),
            lambda i: F.get(syllables, _number(stream, i) % len(SYLLABLES[script].split()))), "")
        end = F.when(kind == "given_f", ends[0]).when(kind == "given_m", ends[1]).otherwise(ends[2])
        return F.initcap(F.concat(body, end))

    return F.when(value.rlike("\\p{IsCyrillic}"), name("cyrillic", ("на", "н", "нов"))).otherwise(
        name("latin", ("na", "n", "son")))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    def of(stream: Column) -> Column:
        local = F.substring_index(value, "@", 1)
        domain = F.substring_index(value, "@", -1)
        site = F.substring(F.translate(
            F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain, attempt.cast("string")).cast("binary"), 256),
            "0123456789", "ghijkmnpqr"), 1, 8)
        body = F.substring(_alike(value, stream, F.lit(1)), F.lit(1), F.length(value) - 1)
        digit = ((F.lit(10) - check_sum(body, 1) % 10) % 10).cast("string")
        octet = lambda i: _number(stream, F.lit(i)).cast("string")
        lead = F.length(F.regexp_extract(value, COUNTRY, 0))
        return (
            F.when(kind == "email", F.concat(_alike(local, stream, F.lit(0)), F.lit("@"), site, F.lit(".example")))
            .when(kind == "ip", F.concat_ws(".", F.lit("10"), octet(0), octet(1), octet(2)))
            .when(kind == "card", F.concat(body, digit))
            .when(kind == "phone", _alike(value, stream, lead))
            .when(kind.isin("given_f", "given_m", "surname"), _made_up(kind, value, stream, attempt))
            .otherwise(_alike(value, stream, F.lit(0)))
        )

    return let(_stream(key, kind, value, attempt), of)


def assign(values: DataFrame, how: Pseudonyms) -> DataFrame:
    """(kind, value, given): one surrogate per distinct (kind, value), no two alike within a kind.

    A value keeps its surrogate if it is the least of those that drew it and no
    value of the corpus is spelled like it; the others draw again.
    """
    open_rows = stage(values.distinct().withColumn("attempt", F.lit(0)), "values")
    spelled = open_rows.select(F.col("kind").alias("s_kind"), F.col("value").alias("given"))
    taken = None
    for _ in range(how.rounds):
        drawn = open_rows.withColumn("given", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), how.key))
        drawn = stage(drawn.withColumn("group", F.regexp_replace("kind", "_[fm]$", "")), "drawn")
        first = drawn.groupBy("group", "given").agg(F.min(F.struct("kind", "value")).alias("first"))
        judged = (
            drawn.join(first, ["group", "given"]).join(spelled.withColumn("known", F.lit(True)), "given", "left")
            .groupBy("kind", "value", "attempt", "group", "given", "first").agg(F.max("known").alias("known"))
        )
        good = (F.struct("kind", "value") == F.col("first")) & F.col("known").isNull()
        if taken is not None:
            before = taken.select("group", "given", F.lit(True).alias("before"))
            judged = judged.join(before, ["group", "given"], "left")
            good = good & F.col("before").isNull()
        judged = stage(judged.withColumn("good", good), "judged")
        won = judged.where("good").select("kind", "value", "group", "given")
        taken = won if taken is None else taken.union(won)
        open_rows = judged.where("NOT good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_rows.isEmpty():
            return taken.select("kind", "value", "given")
    raise ValueError("values are left without a surrogate of their own")


def _shifted(letter: Column, key: str) -> Column:
    """Another letter of the same alphabet; X for one of none of them."""
    step = int.from_bytes(sha256(f"{key}|{INITIAL}".encode()).digest()[:4], "big")
    turned = [a[1 + step % (len(a) - 1):] + a[:1 + step % (len(a) - 1)] for a in LETTERS]
    alphabet = "".join(LETTERS)
    return F.when(F.lit(alphabet).contains(letter), F.translate(letter, alphabet, "".join(turned))).otherwise("X")


def _swapped(match: Column, kind: Column, parts: Column, swap: Column, key: str) -> Column:
    """The matched string with the surrogates of its atoms, in its own format."""
    def given(a: Column) -> Column:
        return F.when(a.kind == INITIAL, _shifted(a.value, key)).otherwise(
            F.try_element_at(swap, F.concat_ws("|", a.kind, a.value)))

    def number(one: Column) -> Column:
        return let(F.regexp_replace(one, "[^0-9]", ""), lambda plain: F.array_join(F.transform(
            F.split(match, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(
                plain, F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), ""))

    def of(one: Column) -> Column:
        name = _rebuilt(F.regexp_replace(match, TITLES, ""), PART, F.transform(parts, given))
        return (
            F.when(kind.isNull(), match)
            .when(kind == "name", F.concat(F.regexp_extract(match, TITLES, 0), name))
            .when(kind == "secret", F.concat(F.regexp_extract(match, "^[^\"]*\"", 0), one, F.lit("\"")))
            .when(kind.isin("card", "phone", "ssn"), number(one))
            .otherwise(one)
        )

    return let(given(F.get(parts, 0)), of)


def _alone(piece: Column, swap: Column) -> Column:
    """Text between entities, the words of its document's names replaced."""
    def of(word: Column) -> Column:
        return F.coalesce(*(
            F.try_element_at(swap, F.concat(F.lit(f"{k}|"), word)) for k in ("surname", "given_m", "given_f")), word)

    pattern = f"(?<!\\p{{L}}){OTHER}{PART}"
    return _rebuilt(piece, pattern, F.transform(_all(piece, pattern), of))


def pseudonymize(docs: DataFrame, how: Pseudonyms | None = None) -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text``; all other columns as they are."""
    how = how or Pseudonyms()
    names = docs.columns
    suspect = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    found = F.transform(
        F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0)),
        lambda m: let(kind_of(m), lambda k: F.struct(m.alias("text"), k.alias("kind"), atoms(m, k).alias("parts"))))
    held = stage(
        docs.where(suspect).withColumn("__found", found).withColumn("__row", F.monotonically_increasing_id()), "held")
    parts = held.select("__row", F.explode(F.array_distinct(F.flatten(F.transform("__found", lambda x: x.parts)))).alias("__a"))
    parts = parts.where(F.col("__a.kind") != INITIAL)
    parts = parts.select("__row", "__a.kind", "__a.value")
    given = stage(assign(parts.select("kind", "value"), how), "surrogates")
    swaps = (
        parts.join(given, ["kind", "value"]).groupBy("__row")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "given"))).alias("__swap"))
    )
    none = F.create_map().cast("map<string,string>")
    joined = held.join(swaps, "__row", "left").withColumn("__swap", F.coalesce("__swap", none))
    swap = F.col("__swap")
    new = F.transform("__found", lambda x: _swapped(x.text, x.kind, x.parts, swap, how.key))
    named = F.exists("__found", lambda x: x.kind == "name")
    pieces = let(F.split("text", ANY, -1), lambda p: F.when(named, F.transform(p, lambda x: _alone(x, swap))).otherwise(p))
    text = let(pieces, lambda p: let(new, lambda n: F.array_join(
        F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(n, i), F.lit("")))), "")))
    changed = joined.withColumn("text", text).select(*names)
    return docs.where(~suspect).select(*names).unionByName(changed)
