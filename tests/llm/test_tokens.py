"""Byte-level BPE and rANS token files against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxscan.llm import bpe, rans
from boxscan.llm.columns import let
from boxscan.llm.queries import LLM_QUERIES
from boxscan.session import new_folder
from helpers import FOLDER, empty, odd, odd_rows, prose

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_odd_texts(spark, plain):
    out = bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN).withColumn("back", bpe.decode(F.col("ids"), RANKS))
    got = sorted((r.node, r.ids, bytes(r.ids_le), bytes(r.back), r.found) for r in out.collect())
    assert len(got) == len(odd_rows())
    for node, ids, raw, back, clash in got:
        text = odd_rows()[node][1] or ""
        want = plain.encode_ordinary(text)
        assert ids == want and back == text.encode() and clash == "clash"
        assert raw == np.array(want, "<u4").tobytes()


def test_bpe_words_of_earlier_blocks(plain, monkeypatch):
    """Small blocks and a short memory: words come back, are forgotten and are learnt again."""
    rows = [(k, " ".join(prose(k % 5, 30).split()[k % 3:]) + f" own{k}") for k in range(120)]
    docs = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]})
    pieces = {i: piece for piece, i in RANKS.items()}
    for chars, remembered in ((200, 1 << 20), (200, 60), (1 << 20, 1)):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        blocks = [b for b in bpe._blocks(iter([docs]), RANKS, public_tokenizers.PATTERN, "text")]
        bases = [b.column("base")[0].as_py() for b in blocks]
        assert (len(blocks) > 20) == (chars == 200) and (sum(x == 0 for x in bases) > 1) == (remembered == 60)
        done = [pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([[plain._encode_single_piece(b"".join(pieces[i] for i in w))
                                    for w in b.column("words")[0].as_py()]], pa.list_(pa.list_(pa.int32())))],
            names=[*b.schema.names, "word_ids"]) for b in blocks]
        got = {d: ids for out in bpe._assembled(iter(done)) for d, ids in zip(
            out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True)}
        assert got == {d: plain.encode_ordinary(t) for d, t in rows}


def test_bpe_words_in_rows(plain, monkeypatch):
    """The JVM gets a block in rows of few words; only its last row has the texts."""
    rows = [(k, f"{prose(k, 30)}\nown{k}") for k in range(40)] + [(40, "a  b "), (41, ""), (42, None)]
    docs = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": pa.array([t for _, t in rows])})
    pieces = {i: piece for piece, i in RANKS.items()}
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 4000)
    monkeypatch.setattr(bpe, "ROW_WORDS", 16)
    blocks = list(bpe._blocks(iter([docs]), RANKS, public_tokenizers.PATTERN, "text"))
    cut = list(bpe._in_rows(iter(blocks)))
    sizes = [len(b.column("words")[0]) for b in cut]
    assert max(sizes) == 16 and sum(sizes) == sum(len(b.column("words")[0]) for b in blocks)
    assert sum(b.column("rows")[0].is_valid for b in cut) == len(blocks) < len(cut) / 10
    done = [pa.RecordBatch.from_arrays(
        [*b.columns, pa.array([[plain._encode_single_piece(b"".join(pieces[i] for i in w))
                                for w in b.column("words")[0].as_py()]], pa.list_(pa.list_(pa.int32())))],
        names=[*b.schema.names, "word_ids"]) for b in cut]
    got = {d: ids for out in bpe._assembled(iter(done)) for d, ids in zip(
        out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True)}
    assert got == {d: plain.encode_ordinary(t or "") for d, t in rows}


def test_bpe_decodes_in_the_same_pass(spark):
    """The bytes of every text, in place of a column of that name."""
    out = bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN, decoded="found")
    got = {r.node: (bytes(r.found), bytes(r.back)) for r in out.withColumn("back", bpe.decode(F.col("ids"), RANKS)).collect()}
    assert got == {row[-2]: ((row[1] or "").encode(),) * 2 for row in odd_rows()}


def test_bpe_odd_white_space():
    """Every character that the pattern takes for white space is seen, alone between words or not."""
    other = [chr(c) for c in range(0x3100) if bpe.OTHER_SPACE.match(chr(c))]
    assert len(other) == 23 and not set(other) & {" ", "\n", "\x1c", "\x1d", "\x1e", "\x1f"}
    assert all(bpe._odd_space(f"a{c}b") for c in [*other, "  ", "\n\n", " \n", "\n "])
    assert all(bpe._odd_space(x) for x in (" a", "a ", "\na", "a\n", " "))
    assert not any(bpe._odd_space(x) for x in ("a", "a b", "a\nb c", "a\x1cb", "日 本"))


def test_bpe_half_partitions(spark):
    docs = spark.range(400, numPartitions=8 * spark.sparkContext.defaultParallelism)
    half = bpe.half_partitions(docs)
    assert half.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and half.distinct().count() == 400
    assert bpe.half_partitions(spark.range(9, numPartitions=3)).rdd.getNumPartitions() == 3


def test_bpe_small_arrow_batches(spark):
    """A table of 12 MB in one partition comes in small batches, unless the session has its own limit."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', 2000)").alias("text"))

    def sizes():
        found = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        return [r.n for r in found.collect()]

    before = spark.conf.get(bpe.BATCH_LIMIT, None)
    try:
        spark.conf.unset(bpe.BATCH_LIMIT)
        assert len(sizes()) == 1
        bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
        assert len(sizes()) > 4 and max(sizes()) < 2 * bpe.BATCH_BYTES
        spark.conf.set(bpe.BATCH_LIMIT, "1m")
        bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
        assert max(sizes()) < bpe.BATCH_BYTES
    finally:
        spark.conf.unset(bpe.BATCH_LIMIT)
        if before is not None:
            spark.conf.set(bpe.BATCH_LIMIT, before)


def test_bpe_empty_table(spark):
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in LLM_QUERIES["op10_byte_bpe"](spark, FOLDER).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_fold_of_odd_words(spark, plain):
    """The fold itself, over the items of each word: up to as many bytes as are folded, runs of one letter, none."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrst ß漢\n"), rng.integers(1, 17))) for _ in range(400)]
    words = sorted({w for w in words if len(w.encode()) <= bpe.FOLD_BYTES}) + ["a" * n for n in range(1, bpe.FOLD_BYTES + 1)]
    block = pa.RecordBatch.from_pydict({"words": pa.array(
        [[[RANKS[bytes([b])] for b in w.encode()] for w in words], []], pa.list_(pa.list_(pa.int32())))})
    items = [next(bpe._with_items(iter([block.slice(k, 1)]), RANKS)).column("words")[0].as_py() for k in range(2)]
    folded = spark.createDataFrame([(x,) for x in items], "words array<array<bigint>>").select(let(
        bpe.rank_literals(RANKS), lambda t: let(t.base, lambda base: let(t.cells, lambda cells: F.transform(
            "words", lambda w: bpe.fold_merges(w, base, cells))))).alias("word_ids")).toArrow()
    got = [x for b in bpe._without_items(iter(folded.to_batches())) for x in b.column("word_ids").to_pylist()]
    assert sorted(got, key=len) == [[], [plain._encode_single_piece(w.encode()) for w in words]]


def test_pair_table_holds_every_merge():
    base, cells = bpe.pair_table(RANKS)
    for piece, rank in list(RANKS.items())[256::97]:
        for cut in range(1, len(piece)):
            a, b = RANKS.get(piece[:cut]), RANKS.get(piece[cut:])
            if a is not None and b is not None:
                assert cells[base[a] + b] == (a + 1) << 32 | rank


def test_rans_odd_texts(spark):
    path = new_folder(spark, "odd_tokens")
    rans.write_tokens(odd(spark), path, WORD_BPE, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids_le)) for r in rans.read_tokens(spark, path).collect()),
                 key=lambda r: r[0])
    coder, start = Tokenizer.from_file(WORD_BPE), 0
    texts = {}
    for row in odd_rows():
        texts.setdefault(row[0], set()).add(
            np.array([*coder.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert [r[1] for r in got] == sorted([r[0] for r in odd_rows()], key=lambda i: (i is not None, i))
    for at, doc, n, raw in got:
        assert at == start and n * 4 == len(raw) and raw in texts[doc]
        start += n


def test_rans_empty_table(spark):
    path = new_folder(spark, "no_tokens")
    rans.write_tokens(empty(spark), path, WORD_BPE, 2)
    assert rans.read_tokens(spark, path).count() == 0


def test_rans_query(spark):
    coder, start = Tokenizer.from_file(WORD_BPE), 0
    got = {r.doc_id: r for r in LLM_QUERIES["op2_rans_tokens"](spark, FOLDER).collect()}
    for r in sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = got[r.doc_id]
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 200_000])
def test_rans_block_and_its_inside(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.int64)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    freq = rans.quantize(counts)[used]
    assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1
    tables = rans.tables(used, freq)
    lanes, words, places, states = rans.encode_block(ids, *tables[:2])
    for begin, end in ((0, n), (n // 3, n // 2), (n - 1, n), (n // 2, n)):
        assert (rans.decode_block(words, lanes, places, states, *tables, begin, end) == ids[begin:end]).all()


DAMAGE = {
    "crc": "crc + 1", "first": "first + 1", "doc_sizes": "reverse(doc_sizes)", "doc_ids": "transform(doc_ids, x -> x + 1)",
    "check_places": "transform(check_places, x -> x + 1)", "check_states": "cast(repeat(' ', length(check_states)) as binary)",
    "words": "unhex(reverse(hex(words)))",
}


def test_damaged_blocks_are_refused(spark):
    path = new_folder(spark, "damaged")
    rans.write_tokens(odd(spark), path, WORD_BPE, 2)
    for name, value in DAMAGE.items():
        blocks = spark.read.parquet(f"{path}/blocks").withColumn(name, F.expr(value))
        blocks.write.parquet(f"{path}-{name}/blocks")
        spark.read.parquet(f"{path}/table").write.parquet(f"{path}-{name}/table")
        with pytest.raises(Exception, match="is damaged"):
            rans.read_tokens(spark, f"{path}-{name}").collect()


def test_another_table_is_refused(spark):
    """The shared table has no checksum of its own; the last states tell."""
    path = new_folder(spark, "othertable")
    rans.write_tokens(odd(spark), path, WORD_BPE, 2)
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{path}-bad/blocks")
    table = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()
    turned = [(a.symbol, b.freq) for a, b in zip(table, [*table[1:], table[0]], strict=True)]
    spark.createDataFrame(turned, "symbol bigint, freq bigint").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="does not end|out of bounds"):
        rans.read_tokens(spark, f"{path}-bad").collect()


def test_rans_ids_of_random_texts():
    """Letters that change in lower case, marks that join signs, and every kind of white space."""
    plain = Tokenizer.from_file(WORD_BPE)
    rng = np.random.default_rng(8)
    letters = list("aZéİIıßŞşΣςªº١2日́̇.,;:!?#$%&*|()\"' \n\t\u00a0\u2028'-_<>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(20_000)]
    texts += ["İ.", "HERŞEYİ,", "İKİ!", "i̇.", "aİ)\"", "İ"]
    coder = rans._chunk_ids(WORD_BPE)
    ids, ends = coder.encode(texts, 2)
    got = np.split(ids, ends[:-1])
    for text, own, want in zip(texts, got, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == [*want.ids, 2], text
