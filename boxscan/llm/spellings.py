"""Groups of spelling variants: one-edit neighbourhoods over a reduced alphabet.

Words are counted by plain aggregates.  Each letter is hashed to one of a few
symbols; two words that differ by one letter have reduced words that are equal
or differ by one symbol, as a symbol may hide the change.  So the whole one-edit
neighbourhood of a reduced word (itself, every symbol left out, every symbol
replaced, every symbol put in anywhere) holds the reduced word of every near
word.  It has some (2 * symbols) * length members, where full letters would have
120 * length.  Neighbourhoods are joined with the reduced words of the
vocabulary, and the original words decide inside the join, so that no list of
candidates is written.

Reduced words travel as 64-bit hashes; equal hashes of different reduced words
are further candidates only.  A neighbourhood is a set, so no pair comes twice.

Forms point at a word of five times the count, so a chain has fewer than 27
links, and pointer doubling ends after five rounds at most.

Neighbourhoods and pointers are joined by key, never by broadcast: Spark sizes
them by the files of the words they come from, which says little of their rows.

Defined results: null or empty texts have no words; a null doc_id hashes as an
empty one; every occurrence in repeated rows counts; ties go to the least word
in code-point order; other columns are not read, so names cannot clash; an empty
table gives an empty result.  A long word has as many neighbours per letter as a
short one, made slice by slice.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan.llm.hashing import mix, powers
from boxscan.session import stage

#: Letters that words are made of.
LETTERS = "A-Za-z\\u00C0-\\u00FF"


@dataclass(frozen=True)
class Spelling:
    """``typo_every``: one occurrence in so many loses a letter, by hash (0: none)."""

    least_letters: int = 6
    least_count: int = 5
    factor: int = 5
    symbols: int = 5
    typo_every: int = 199


def occurrences(docs: DataFrame, how: Spelling, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word: every maximal run of letters that may reach the least length, A-Z lower-cased."""
    pattern = f"[{LETTERS}]{{{how.least_letters},}}"
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("owner"), run.alias("run"))
    runs = runs.select("owner", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    if not how.typo_every:
        return runs.select(F.col("run").alias("word"))
    return runs.withColumn("h", F.crc32(F.encode(F.concat("owner", F.lit(":"), "run"), "UTF-8"))).select(
        F.when(F.col("h") % how.typo_every == 0, _without(F.col("run"), F.col("h") % F.length("run")))
        .otherwise(F.col("run")).alias("word")
    )


def _without(word: Column, at: Column) -> Column:
    """The word without its letter number ``at``, from 0."""
    place = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def vocabulary(docs: DataFrame, how: Spelling, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of the least length and count."""
    return (
        occurrences(docs, how, doc_id, text).where(F.length("word") >= how.least_letters)
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= how.least_count)
    )


def symbols_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """1 to ``symbols`` for each letter, by hash."""
    return mix(letters.astype(np.uint64) + np.uint64(0x51)) % np.uint64(symbols) + np.uint64(1)


def own_code(reduced: np.ndarray) -> np.ndarray:
    """Hash of each reduced word; the rows of ``reduced`` are words of one length."""
    up, _ = powers(reduced.shape[1] + 1)
    return _sealed((reduced * up[:reduced.shape[1]]).sum(axis=1, dtype=np.uint64), reduced.shape[1])


def _sealed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def neighbour_codes(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of all words within one edit of each reduced word, a row each; members come twice at times."""
    n, length = reduced.shape
    up, down = powers(length + 2)
    terms = reduced * up[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    choices = np.arange(1, symbols + 1, dtype=np.uint64)
    shorter = before[:, :-1] + after[:, 1:] * down[1]
    other = whole[:, :, None] + (choices - reduced[:, :, None]) * up[:length, None]
    longer = before[:, :, None] + choices * up[:length + 1, None] + (after * up[1])[:, :, None]
    return np.concatenate([
        _sealed(whole, length), _sealed(shorter, length - 1),
        _sealed(other.reshape(n, -1), length), _sealed(longer.reshape(n, -1), length + 1),
    ], axis=1)


def _by_length(words: pa.Array, symbols: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, reduced words) of words of one length, at most so many cells at once, but one word at least."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, cells // max(1, length))
        for at in range(0, len(places), step):
            part = places[at:at + step]
            letters = "".join([texts[i] for i in part.tolist()]).encode("utf-32-le")
            yield part, symbols_of(np.frombuffer(letters, "<u4").reshape(len(part), length), symbols)


def _own(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.empty(batch.num_rows, np.int64)
            for places, reduced in _by_length(batch.column(0), symbols, 1 << 20):
                code[places] = own_code(reduced)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["code", *batch.schema.names])

    return run


def _near(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, reduced in _by_length(batch.column(0), symbols, 1 << 13):
                codes = np.sort(neighbour_codes(reduced, symbols), axis=1)
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                owner = np.repeat(places, first.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[first]), batch.column(0).take(pa.array(owner))], names=["code", "word"])

    return run


def near_pairs(words: DataFrame, how: Spelling) -> DataFrame:
    """word, near, near_n: all pairs of words, both ways round, that differ by one letter."""
    around = words.select("word").mapInArrow(_near(how.symbols), "code long, word string")
    known = words.select("word", "n").mapInArrow(_own(how.symbols), "code long, word string, n long")
    known = known.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    return around.join(known.hint("merge"), (around.code == known.code) & one_edit).select("word", "near", "near_n")


def with_forms(words: DataFrame, how: Spelling) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = near_pairs(words, how).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    )
    form_n = -F.col("best.less")
    found = form_n >= how.factor * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(found, F.col("best.form")).alias("form"), F.when(found, form_n).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: pointers are doubled until every one is at its end."""
    at = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = at.join(onward.hint("merge"), "root", "left")
        at = stage(step.select("word", F.coalesce("beyond", "root").alias("root"), "beyond"), "spelling-roots")
        if at.where(F.col("beyond").isNotNull()).isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group(docs: DataFrame, how: Spelling = Spelling(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = stage(vocabulary(docs, how, doc_id, text), "spelling-words")
    formed = stage(with_forms(words, how), "spelling-forms")
    return formed.join(roots(formed).hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
