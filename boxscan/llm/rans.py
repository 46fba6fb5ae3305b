"""Token files: static range asymmetric numeral system (rANS) over shared frequency tables.

``write_tokens`` deals the documents out by ranges of doc_id, tokenizes them in
order and writes three Parquet tables into one folder: ``ids`` (plain ids, the
staging of the first pass, removed at the end), ``table`` (symbol, frequency;
one for all blocks) and ``blocks``.  A block is a run of whole documents, coded
on its own: its ids are laid row by row over interleaved lanes, one rANS state
per lane, all lanes renormalizing into one stream of 32-bit words.  A block
carries a CRC-32 of its stream and checkpoints (place in the stream and all
states, every ``CHECK_STEPS`` rows), so blocks are decoded in parallel and the
inside of a block from its nearest checkpoint.  ``read_tokens`` checks and
decodes the blocks and adds the documents' places among all ids.

Nothing but counts by symbol and by partition passes the driver.  Both tables of
a block come from written tables, so a lost executor repeats single blocks.

Defined results: null text is empty and holds the end id alone; rows are ordered
by (doc_id, hash of the text), null ids first, repeated rows kept; other columns
are ignored; an empty table gives no documents; a document longer than a block
makes a block of its own.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frequencies sum to 2 ** SCALE; states stay in [2 ** 31, 2 ** 63).
SCALE = 20
LOW = np.uint64(1 << 31)
#: Ids in a block, at least (unless the partition ends), and lanes at most.
BLOCK_IDS = 1 << 18
LANES = 1024
CHECK_STEPS = 64
#: Distinct chunks of text whose ids a Python worker remembers.
REMEMBERED = 400_000
#: Signs that end a word on their own: ids of "word" + signs are ids of both, one after the other.
TAIL = ".,;:!?#$%&*|()\""


class ChunkIds:
    """Ids of chunks of text without blanks, each given to the tokenizer once.

    The tokenizer drops white space and splits at it before anything else, so
    the ids of a text are those of its chunks; a chunk is a word and its tail of
    signs.  New words of letters alone go to the tokenizer in one text: each
    yields one run of ids, which its end-of-word id closes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.word, self.tail = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has."""
        if all(map(str.isalpha, words)):
            found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
            ids = np.array(found, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        rows = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in rows for i in x], np.uint32), np.fromiter(map(len, rows), np.int64, len(rows))

    def learn(self, chunks: list[str]) -> None:
        words, known = self.words, len(self.words)
        word, tail = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        letters, others = [], []
        for k, chunk in enumerate(chunks):
            core = chunk.rstrip(TAIL)
            # as the tokenizer sees it: some letters become a letter and a mark, which signs may join
            end = core[-1:].lower()
            if len(end) != 1 or not end.isalnum():
                core, rest = chunk, ""
            else:
                rest = chunk[len(core):]
            if core.isascii():
                core = core.lower()
            for part, out in ((core, word), (rest, tail)):
                at = words.get(part)
                if at is None:
                    at = words[part] = len(words)
                    (letters if part.isalpha() and part.lower().isalpha() else others).append(part)
                out[k] = at
        groups = [letters[i:i + 2000] for i in range(0, len(letters), 2000)] + ([others] if others else [])
        if groups:
            ids, sizes = zip(*map(self.coded, groups), strict=True)
            # from the order of coding to the order of the numbers
            at = np.fromiter((words[x] for g in groups for x in g), np.int64) - known
            size = np.concatenate(sizes)
            starts = np.cumsum(size) - size
            order = np.argsort(at)
            length = size[order]
            upto = np.cumsum(length)
            take = np.repeat(starts[order] - (upto - length), length) + np.arange(upto[-1])
            self.flat = np.concatenate([self.flat, np.concatenate(ids)[take]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + upto])
        self.word, self.tail = np.concatenate([self.word, word]), np.concatenate([self.tail, tail])

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, one after another, and where each text ends."""
        if len(self.number) > REMEMBERED:
            self.clear()
        number, rows, new = self.number, [], []
        for text in texts:
            chunks = (text or "").replace("\n", " ").split(" ")
            for chunk in chunks:
                if chunk not in number:
                    number[chunk] = len(number)
                    new.append(chunk)
            rows.append(np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks)))
        if not rows:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if new:
            self.learn(new)
        picked = np.concatenate(rows)
        picked = np.stack([self.word[picked], self.tail[picked]], 1).reshape(-1)
        length = np.diff(self.ends, prepend=0)[picked]
        upto = np.cumsum(length)
        take = np.repeat(self.ends[picked] - upto, length) + np.arange(upto[-1])
        text_ends = upto[2 * np.cumsum([len(r) for r in rows]) - 1]
        return np.insert(self.flat[take], text_ends, end_id), text_ends + np.arange(1, len(text_ends) + 1)


@lru_cache(2)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition in order: part, block, first, doc_ids, doc_sizes, ids."""
    coder = _chunk_ids(path)
    part, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
    docs: list = []
    sizes: list[int] = []
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        ids = np.concatenate(held).astype("<u4")
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
            "first": pa.array([first], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
            "doc_sizes": pa.array([sizes], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
        })

    for batch in batches:
        names, step = batch.column(0).to_pylist(), 256
        for at in range(0, batch.num_rows, step):
            ids, ends = coder.encode(batch.column(1).slice(at, step).to_pylist(), end_id)
            begin = 0
            for name, end in zip(names[at:at + step], ends.tolist(), strict=True):
                docs.append(name)
                sizes.append(end - begin)
                held.append(ids[begin:end])
                begin = end
                size += sizes[-1]
                if size >= BLOCK_IDS:
                    yield flush()
                    first, block, size = first + size, block + 1, 0
                    docs, sizes, held = [], [], []
    if docs:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for cell in batch.column(0):
            more = np.bincount(np.frombuffer(cell.as_buffer(), "<u4"))
            if len(more) > len(counts):
                counts, more = more.astype(np.int64), counts
            counts[:len(more)] += more
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"symbol": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts, at least 1 where a count is, with sum 2 ** SCALE."""
    used = np.flatnonzero(counts)
    whole = 1 << SCALE
    if len(used) > whole:
        raise ValueError(f"{len(used)} symbols need a larger SCALE than {SCALE}")
    share = np.maximum(1, (counts[used] * (whole / counts.sum())).astype(np.int64))
    order = np.argsort(-share, kind="stable")
    spare = whole - int(share.sum())
    while spare:  # the largest give or take, at most half of what they have at a time
        for k in order:
            move = max(spare, -(int(share[k]) // 2)) if spare < 0 else spare
            share[k] += move
            spare -= move
            if not spare:
                break
    out = np.zeros(len(counts), np.int64)
    out[used] = share
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, words, checkpoint places, checkpoint states) of one block."""
    lanes = 1
    while lanes < LANES and lanes * 64 < len(ids):
        lanes *= 2
    steps = -(-len(ids) // lanes)
    laid = np.full(steps * lanes, ids[-1] if len(ids) else 0, np.int64)
    laid[:len(ids)] = ids
    laid = laid.reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    out, mask = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), bool)
    states = {}
    for t in range(steps - 1, -1, -1):
        f, c = freq[laid[t]], start[laid[t]]
        full = state >= (f << np.uint64(63 - SCALE))
        out[t], mask[t] = state.astype(np.uint32), full
        state = np.where(full, state >> np.uint64(32), state)
        high, low = np.divmod(state, f)
        state = (high << np.uint64(SCALE)) + low + c
        if t % CHECK_STEPS == 0:
            states[t] = state
    before = np.concatenate([[0], np.cumsum(mask.sum(1))])
    checks = range(0, steps, CHECK_STEPS)
    kept = np.array([states[t] for t in checks], "<u8").reshape(len(checks), lanes)
    return lanes, out[mask].astype("<u4"), before[list(checks)].astype(np.int64), kept


def decode_block(
    words: np.ndarray, lanes: int, places: np.ndarray, states: np.ndarray,
    freq: np.ndarray, start: np.ndarray, symbol: np.ndarray, begin: int, end: int, whole: bool = False,
) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block, from the checkpoint before ``begin``.

    ``whole``: ``end`` is the end of the block, whose stream must then be used up
    and leave the state that it was begun with.
    """
    if begin >= end:
        return np.empty(0, np.uint32)
    check = begin // lanes // CHECK_STEPS
    step, at = check * CHECK_STEPS, int(places[check])
    state = states[check].astype(np.uint64)
    last = -(-end // lanes)
    laid = np.empty((last - step, lanes), np.uint32)
    cut = np.uint64((1 << SCALE) - 1)
    for t in range(last - step):
        slot = state & cut
        found = symbol[slot]
        laid[t] = found
        state = freq[found] * (state >> np.uint64(SCALE)) + slot - start[found]
        small = np.flatnonzero(state < LOW)
        if len(small):
            more = words[at:at + len(small)]
            if len(more) < len(small):
                raise ValueError("the stream does not end where its block does")
            state[small] = (state[small] << np.uint64(32)) | more
            at += len(small)
    if whole and (at != len(words) or (state != LOW).any()):
        raise ValueError("the stream does not end in the state that it was begun with")
    return laid.reshape(-1)[begin - step * lanes:end - step * lanes]


def tables(symbols: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, first slot) by symbol and the symbol by slot."""
    size = int(symbols.max()) + 1 if len(symbols) else 1
    freq = np.zeros(size, np.uint64)
    freq[symbols] = freqs
    start = np.concatenate([[np.uint64(0)], np.cumsum(freq)[:-1]]).astype(np.uint64)
    return freq, start, np.repeat(np.arange(size, dtype=np.uint32), freq.astype(np.int64))


#: Columns of a block that its checksum covers besides the stream, its checkpoints and their states.
CHECKED = ["part", "block", "first", "doc_ids", "doc_sizes", "n_ids"]


def checksum(cells: dict, lanes: int, words: np.ndarray, places: np.ndarray, states: np.ndarray) -> int:
    """CRC of everything that a block is decoded from."""
    head = json.dumps([*(cells[name] for name in CHECKED), lanes, [int(p) for p in places]])
    return zlib.crc32(states.astype("<u8").tobytes(), zlib.crc32(words.astype("<u4").tobytes(), zlib.crc32(head.encode())))


def _encoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    freq, start, _ = tables(*shared.value)
    for batch in batches:
        keep = [batch.column(i) for i in range(batch.num_columns - 1)]
        cells = [encode_block(np.frombuffer(c.as_buffer(), "<u4").astype(np.int64), freq, start) for c in batch.column("ids")]
        yield pa.RecordBatch.from_arrays(
            [
                *keep, pa.array([c[0] for c in cells], pa.int32()),
                pa.array([c[1].tobytes() for c in cells], pa.binary()),
                pa.array([
                    checksum({name: batch.column(name)[k].as_py() for name in CHECKED}, *c)
                    for k, c in enumerate(cells)
                ], pa.int64()),
                pa.array([c[2].tolist() for c in cells], pa.list_(pa.int64())),
                pa.array([c[3].tobytes() for c in cells], pa.binary()),
            ],
            names=[*batch.schema.names[:-1], "lanes", "words", "crc", "check_places", "check_states"],
        )


BLOCK = "part int, block int, first bigint, doc_ids array<bigint>, doc_sizes array<bigint>, n_ids bigint"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Token files of ``docs`` (doc_id, text) in the folder ``path``."""
    spark = docs.sparkSession
    ordered = (
        docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    )
    ordered.mapInArrow(lambda b: _tokenized(b, tokenizer, end_id), f"{BLOCK}, ids binary").write.parquet(f"{path}/ids")
    plain = spark.read.parquet(f"{path}/ids")
    counts = (
        plain.select("ids").mapInArrow(_counted, "symbol bigint, n bigint")
        .groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()  # one row per symbol at most
    )
    symbols = np.array([r.symbol for r in counts], np.int64)
    freqs = quantize(np.array([r.n for r in counts], np.int64)) if counts else np.empty(0, np.int64)
    spark.createDataFrame(
        list(zip(symbols.tolist(), freqs.tolist(), strict=True)), "symbol bigint, freq bigint"
    ).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((symbols, freqs))
    plain.mapInArrow(
        lambda b: _encoded(b, shared),
        f"{BLOCK}, lanes int, words binary, crc bigint, check_places array<bigint>, check_states binary",
    ).write.parquet(f"{path}/blocks")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    freq, start, symbol = tables(*shared.value)
    for batch in batches:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            cell = {name: get[name][k].as_py() for name in (*CHECKED, "lanes", "words", "crc", "check_places", "check_states")}
            lanes, n = cell["lanes"], cell["n_ids"]
            words, places = np.frombuffer(cell["words"], "<u4"), np.array(cell["check_places"], np.int64)
            states = np.frombuffer(cell["check_states"], "<u8")
            if checksum(cell, lanes, words, places, states) != cell["crc"]:
                raise ValueError(f"block {cell['part']}/{cell['block']} is damaged")
            ids = decode_block(
                words, lanes, places, states.reshape(-1, lanes), freq, start, symbol, 0, n, whole=True).astype("<u4")
            sizes = np.array(get["doc_sizes"][k].as_py(), np.int64)
            ends = np.cumsum(sizes)
            for at in range(0, len(sizes), 2048):
                own, upto = sizes[at:at + 2048], ends[at:at + 2048]
                begin = int(upto[0] - own[0])
                offsets = np.concatenate([[0], np.cumsum(own)]) * 4
                data = pa.py_buffer(ids[begin:int(upto[-1])].tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), get["part"][k].as_py()), pa.int32()),
                    get["doc_ids"][k].values.slice(at, len(own)),
                    pa.array(get["first"][k].as_py() + upto - own, pa.int64()), pa.array(own, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data]),
                ], names=["part", "doc_id", "place", "n_tokens", "ids_le"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_le (32-bit little-endian) of every document in the files."""
    table = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()  # one row per symbol
    shared = spark.sparkContext.broadcast(
        (np.array([r.symbol for r in table], np.int64), np.array([r.freq for r in table], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))  # one row per partition that wrote
    bases = sizes.select(
        "part",
        (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("base"),
    )
    docs = blocks.mapInArrow(
        lambda b: _decoded(b, shared), "part int, doc_id bigint, place bigint, n_tokens bigint, ids_le binary"
    )
    return docs.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_le"
    )
