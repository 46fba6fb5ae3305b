"""Byte-level BPE: Spark higher-order functions fold the merges of distinct words.

Documents are taken in blocks (four million characters of one partition).
A first Arrow pass splits the texts of a block and numbers its distinct words;
the JVM then encodes each word that is new to the partition, ``ROW_WORDS`` of them
in a row, so that few are held at a time: an ``aggregate``
over the items of its bytes (``_with_items``, ``fold_merges``) merges the adjacent pair of lowest rank until none is
left, looking ranks up in a literal map of the vocabulary (laid out as arrays, as
a lookup in a Spark map walks through its keys).  A second Arrow pass, which sees
the blocks of the partition in the same order, keeps the ids of its words and
puts them in the order of the texts.  Both passes forget all words together once
there are ``REMEMBERED`` of them.  Arrow batches on the way to a pass are small (``small_batches``).  Nothing is shuffled and no dictionary of the
corpus exists: a lost task makes its partition again.

A word of more than ``FOLD_BYTES`` bytes would need as many copies of its pieces
as it has bytes; those few are merged by the tiktoken library, and words that
are in the vocabulary whole need no merge.

Decoding maps ids to pieces and concatenates them: on whole Arrow batches where
``encode`` is asked for it, else by a literal array (``decode``).

Defined results: a null or empty text has no ids and decodes to nothing;
repeated rows are encoded alike; other columns pass through (``ids`` and
``ids_le`` are reserved names, as is that of the decoded bytes, and replace columns so called); an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxscan.llm.columns import let

#: White space as the Unicode property defines it (Python's own \s has four more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same but the blank and the line feed.
OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Words above so many bytes are not folded.
FOLD_BYTES = 48
#: Characters of text in a block.
BLOCK_CHARS = 4 << 20
#: Words after which a partition begins anew to number them.
REMEMBERED = 1 << 20
#: New words of a block that the JVM folds in one row.
ROW_WORDS = 2048
#: Bytes in an Arrow batch on its way to a pass; Spark's own 64 MB are held by the JVM and by Python, twice a core.
BATCH_BYTES = 2 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(base, cells): the pair (a, b) has its merge at cells[base[a] + b], if a is named there.

    A cell holds (a + 1) << 32 | rank.  Rows of the sparse pair table are laid
    over one another, the long ones first, each at a place where all its cells
    are free; three cells in four stay empty, so such places are soon found.
    """
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    base = [0] * (max(ranks.values(), default=-1) + 1)
    room = 4 * sum(map(len, rows.values()))
    cells = np.zeros(room + len(base) + 1, np.int64)
    random = np.random.default_rng(1)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.fromiter(row, np.int64, len(row))
        at = 0
        while cells[at + rights].any():
            at = int(random.integers(room))
        base[a] = at
        cells[at + rights] = (a + 1 << 32) | np.fromiter(row.values(), np.int64, len(row))
    return base, cells.tolist()


#: Bits of an id in the fold, where ids count from 1, and of the place of a piece in its word.
ID_BITS, PLACE_BITS = 19, 6
#: From here on an item has no merge.
NONE = 1 << 2 * ID_BITS + PLACE_BITS
#: Times an id: the item of a piece without a merge, but for its place.
OWN = NONE + 1
#: Marks the first element of a word, which has a bit for every place that is left.
PLACES = 1 << 62


def rank_literals(ranks: dict[bytes, int]) -> Column:
    """struct(base, cells) of the pair table for ids from 1, a literal once the plan is optimized.

    The cell of a pair (a, b) holds a above the id that they make, so that
    a * OWN ^ cell is an item with that merge where the cell belongs to a, and
    NONE or more elsewhere.
    """
    base, cells = pair_table(ranks)
    if len(base) + 1 >= 1 << ID_BITS:
        raise ValueError(f"ids must be below {(1 << ID_BITS) - 2}")
    base = [0, *[at - 1 for at in base], 0]  # the last row is that of the ends of words
    cells = [cell and (cell >> 32) * NONE | ((cell & 0xFFFFFFFF) + 1) << ID_BITS + PLACE_BITS for cell in cells]
    text = json.dumps({"base": base, "cells": cells}, separators=(",", ":"))
    return F.from_json(F.lit(text), "base array<bigint>, cells array<bigint>")


def fold_merges(items: Column, base: Column, cells: Column) -> Column:
    """array<bigint>: the items of one word after all merges, from those of its bytes.

    An item is the id of a piece, above it the place of its first byte, and above
    that the id that it makes with the next piece, which is the rank of that merge.
    Both ends of a word are items that merge with nothing; before them stands the
    set of the places that are left.  The least item is the leftmost pair of lowest
    rank; a round merges it and looks up the two pairs that this makes.  The
    number of places left before an item is its index: ``array_position`` would
    take longer than the rest of the round.
    """
    def whole(n: int) -> Column:
        return F.lit(n).cast("bigint")

    ids, places = whole((1 << ID_BITS) - 1), whole((1 << PLACE_BITS) - 1 << ID_BITS)

    def bit(item: Column) -> Column:
        """The bit of the place of an item."""
        return F.call_function("shiftleft", whole(1), F.shiftright(item.bitwiseAND(places), ID_BITS).cast("int"))

    def item(a: Column, b: Column, at: Column) -> Column:
        cell = F.get(cells, F.get(base, a) + b)
        return cell.bitwiseXOR(a * OWN).bitwiseXOR(at.bitwiseAND(places))

    def step(acc: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            made = F.shiftright(least, ID_BITS + PLACE_BITS)
            left = F.get(acc, F.lit(0))

            def around(at: Column) -> Column:
                before, taken, behind = F.get(acc, at), F.get(acc, at + 2), F.get(acc, at + 3)
                # "flatten" copies arrays; "concat" of arrays goes through a lazy list
                return F.flatten(F.array(
                    F.array(left.bitwiseXOR(bit(taken))), F.slice(acc, F.lit(2), at - 1),
                    F.array(item(before.bitwiseAND(ids), made, before), item(made, behind.bitwiseAND(ids), least)),
                    F.slice(acc, at + 4, F.lit(1 << 30))))

            before = F.bit_count(left.bitwiseAND(bit(least) - 1))
            return F.when(least >= whole(NONE), acc).otherwise(let(before, around))

        return let(F.array_min(acc), merge)

    # a word of n bytes has three elements more and at most n - 1 merges
    return F.aggregate(F.sequence(F.lit(5), F.greatest(F.size(items), F.lit(5))), items, step)


@lru_cache(4)
def _splitter(pattern: str) -> regex.Pattern:
    """The pattern with its white space spelled out."""
    return regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]"))


def _odd_space(value: str) -> bool:
    """Has a text (not an empty one) other white space than single blanks and line feeds between its words?"""
    return (
        value[0] in " \n" or value[-1] in " \n" or "  " in value or " \n" in value or "\n " in value or "\n\n" in value
        or OTHER_SPACE.search(value) is not None
    )


def _first_pieces(words: list[str], ranks: dict[bytes, int]) -> pa.Array:
    """list<int>: the ids of the bytes of each word; of words that need no fold, their own ids."""
    by_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
    data = [word.encode() for word in words]
    sizes = [0, *map(len, data)]
    parts, begin, slow = [], 0, None
    for k in [k for k, word in enumerate(data) if len(word) > FOLD_BYTES or word in ranks]:
        own = ranks.get(data[k])
        if own is None and slow is None:
            import tiktoken

            slow = tiktoken.Encoding("own", pat_str="x", mergeable_ranks=ranks, special_tokens={})
        parts.append(by_byte[np.frombuffer(b"".join(data[begin:k]), np.uint8)])
        parts.append(np.array([own] if own is not None else slow._encode_single_piece(data[k]), np.int32))
        sizes[k + 1] = len(parts[-1])
        begin = k + 1
    parts.append(by_byte[np.frombuffer(b"".join(data[begin:]), np.uint8)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(parts)))


def _with_items(blocks: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Blocks whose words are the items that ``fold_merges`` begins with."""
    last = max(ranks.values(), default=-1)
    byte = np.full(last + 3, 256, np.int64)  # of an id from 1; 256: not one byte, and never merged at first
    made = np.zeros((257, 257), np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 1:
            byte[rank + 1] = piece[0]
        elif len(piece) == 2:
            made[piece[0], piece[1]] = rank + 1
    for block in blocks:
        at = block.schema.names.index("words")
        words = block.column(at).flatten()
        size = np.asarray(words.value_lengths()).astype(np.int64)
        ends = np.cumsum(size + 3)
        begin = ends - size - 3
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begin + 1, size + 3)
        ids = np.full(len(place), last + 2, np.int64)
        inner = (place > 0) & (place <= np.repeat(size, size + 3))
        ids[inner] = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1
        pair = np.zeros(len(ids), np.int64)
        pair[:-1] = made[byte[ids[:-1]], byte[ids[1:]]]
        items = np.where(pair > 0, pair << ID_BITS + PLACE_BITS | ids, ids * OWN)
        # words of more places are not folded
        items += np.clip(place, 0, (1 << PLACE_BITS) - 1) << ID_BITS
        items[begin] = PLACES | (np.int64(2) << np.minimum(size, FOLD_BYTES)) - 1
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        folded = pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(items)))
        yield block.set_column(at, "words", folded)


def _without_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose ``word_ids`` are ids again."""
    for batch in batches:
        at = batch.schema.names.index("word_ids")
        column = batch.column(at)
        words = column.flatten()
        size = np.asarray(words.value_lengths()).astype(np.int64)
        flat = words.flatten().to_numpy(zero_copy_only=False)
        inner = np.ones(len(flat), bool)
        ends = np.cumsum(size)
        inner[ends - 1] = inner[ends - size] = inner[ends - size + 1] = False
        ids = ((flat[inner] & (1 << ID_BITS) - 1) - 1).astype(np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size - 3)]).astype(np.int32))
        counts = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int32)
        yield batch.set_column(at, "word_ids", pa.ListArray.from_arrays(
            pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids))))


def _blocks(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str, text: str) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: the rows but their texts, their words by number, and the words new to the partition.

    ``base`` is the number of the first new word; 0 where numbering begins.

    Where single blanks and line feeds are the only white space, a word begins
    at each of them, so a text can be cut there and each distinct chunk needs
    the pattern only once.  Other texts are taken whole by the pattern.
    """
    find = _splitter(pattern).findall

    def number(found: list[str]) -> None:
        flat.extend([words[word] for word in found])

    def flush() -> pa.RecordBatch:
        # a word begins at each of the blanks and line feeds, so all chunks are split at once
        found = find("".join([chunk if chunk[:1] == "\n" else " " + chunk for chunk in chunks]))
        chunk_ends = [k for k, word in enumerate(found) if word[0] in " \n"][1:] + [len(found)] * bool(found)
        number(found)
        for first in firsts:
            number(find(first))
            chunk_ends.append(len(flat))
        for numbers in seen:
            numbers[0] += len(chunks)
        new = list(islice(words, base, None))
        rows = pa.Table.from_batches(kept).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_pydict({
            "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            "seen": pa.array([np.concatenate(seen).astype("<u4").tobytes() if seen else b""], pa.binary()),
            "ends": pa.array([np.asarray(ends, "<u8").tobytes()], pa.binary()),
            "chunks": pa.array([np.asarray(flat, "<u4").tobytes()], pa.binary()),
            "chunk_ends": pa.array([np.asarray(chunk_ends, "<u8").tobytes()], pa.binary()),
            "base": pa.array([base], pa.int64()),
            "words": pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), _first_pieces(new, ranks)),
        })

    def counted() -> defaultdict[str, int]:
        """Numbers its keys as they come."""
        return defaultdict(count().__next__)

    def fresh() -> None:
        nonlocal kept, seen, ends, flat, chunks, firsts, words, size, total, base
        kept, seen, ends, flat, chunks, firsts = [], [], [], [], counted(), counted()
        size = total = 0
        if len(words) >= REMEMBERED:
            words = counted()
        base = len(words)

    kept = seen = ends = flat = chunks = firsts = None
    words = counted()
    size = total = base = 0
    fresh()
    for batch in batches:
        at = batch.schema.names.index(text)
        begin = 0
        column = batch.column(at)
        rest = batch.remove_column(at)
        for i in range(batch.num_rows):
            value = column[i].as_py()
            if value:
                # the first chunk has no blank before it; its number goes on from those of the others
                if _odd_space(value):
                    first, parts = value, []
                else:
                    first, *parts = value.replace("\n", " \n").split(" ")
                numbers = np.empty(len(parts) + 1, np.uint32)
                numbers[0] = firsts[first]
                numbers[1:] = np.fromiter(map(chunks.__getitem__, parts), np.uint32, len(parts))
                seen.append(numbers)
                total += len(numbers)
                size += len(value)
            ends.append(total)
            if size >= BLOCK_CHARS:
                kept.append(rest.slice(begin, i + 1 - begin))
                begin = i + 1
                block = flush()
                fresh()
                pa.default_memory_pool().release_unused()
                yield block
                del block
        if begin < batch.num_rows:
            kept.append(rest.slice(begin))
    if kept:
        yield flush()


def _in_rows(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with some words of their block each; the last of a block has its other columns, too."""
    for block in blocks:
        at = block.schema.names.index("words")
        words = block.column(at).flatten()
        for begin in range(0, max(len(words), 1), ROW_WORDS):
            part = words.slice(begin, ROW_WORDS)
            last = begin + ROW_WORDS >= len(words)
            row = pa.RecordBatch.from_arrays(
                [c if last else pa.nulls(1, c.type) for c in block.columns], names=block.schema.names)
            yield row.set_column(at, "words", pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part))


def ragged(starts: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of the picked lists, and where each list ends among them."""
    length = (ends - starts)[pick]
    upto = np.cumsum(length)
    return np.repeat(starts[pick] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0), upto


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block with the ids of their texts."""
    known, known_sizes = np.empty(0, np.int32), np.empty(0, np.int64)
    parts = []
    for batch in batches:
        for k in range(batch.num_rows):
            cell = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            ids = cell["word_ids"].values
            parts.append((ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
                          np.asarray(ids.value_lengths()).astype(np.int64)))
            if not cell["base"].is_valid:  # more words of the block follow
                continue
            if cell["base"].as_py():
                parts.insert(0, (known, known_sizes))
            known, known_sizes = flat, size = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts = []
            word_ends = np.cumsum(size)
            words = np.frombuffer(cell["chunks"].as_py(), "<u4")
            chunk_ends = np.frombuffer(cell["chunk_ends"].as_py(), "<u8").astype(np.int64)
            # ids of each distinct chunk, one after another
            take, upto = ragged(word_ends - size, word_ends, words)
            by_chunk = flat[take]
            upto = np.concatenate([[0], upto])
            id_ends = upto[chunk_ends]
            id_starts = np.concatenate([[0], id_ends[:-1]])
            seen = np.frombuffer(cell["seen"].as_py(), "<u4")
            take, upto = ragged(id_starts, id_ends, seen)
            out = by_chunk[take]
            row_ends = np.concatenate([[0], upto])[np.frombuffer(cell["ends"].as_py(), "<u8").astype(np.int64)]
            offsets = np.concatenate([[0], row_ends])
            rows = pa.ipc.open_stream(cell["rows"].as_buffer()).read_all()
            for first in range(0, rows.num_rows, 1024):
                last = min(first + 1024, rows.num_rows)
                own = offsets[first:last + 1]
                part = out[own[0]:own[-1]].astype("<i4")
                arrays = [c.combine_chunks() for c in rows.slice(first, last - first).columns]
                arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
                local = (own - own[0]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(local), pa.array(part)))
                data = pa.py_buffer(part.tobytes())
                arrays.append(pa.Array.from_buffers(
                    pa.binary(), last - first, [None, pa.py_buffer((local * 4).astype(np.int32).tobytes()), data]))
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "ids", "ids_le"])
            del cell, ids, flat, by_chunk, take, out, rows
        pa.default_memory_pool().release_unused()


def _decoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], name: str) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes that their ids stand for."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = pa.array(pieces, pa.binary())
    for batch in batches:
        ids = batch.column("ids")
        found = table.take(ids.flatten())
        places = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1]
        upto = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
        yield batch.append_column(name, pa.Array.from_buffers(
            pa.binary(), len(ids), [None, pa.py_buffer(places[upto].tobytes()), found.buffers()[2]]))


def half_partitions(docs: DataFrame) -> DataFrame:
    """A table read by half as many tasks, but two a core: words that the halves share are folded once.

    The plan must be a scan: counting the partitions of a shuffle would run it.
    """
    spark = docs.sparkSession
    now = docs.rdd.getNumPartitions()
    wanted = max(now // 2, 2 * spark.sparkContext.defaultParallelism)
    return docs.coalesce(wanted) if wanted < now else docs


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` from now on in a session that has no limit of its own; a row is never cut.

    Spark looks at the setting when the result is computed, so it stays.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, plus ids array<int> and ids_le (32-bit little-endian).

    With a name ``decoded`` also a column of the bytes that the ids are decoded to,
    as ``decode`` gives them; here it costs no lambda per id.
    """
    small_batches(docs.sparkSession)
    own = ("ids", "ids_le", decoded)
    keep = [c for c in docs.columns if c not in own]
    docs = docs.select(*keep)
    rest = [f for f in docs.schema if f.name != text]
    blocks = docs.mapInArrow(
        lambda batches: _with_items(_in_rows(_blocks(batches, ranks, pattern, text)), ranks),
        "rows binary, seen binary, ends binary, chunks binary, chunk_ends binary, base bigint, words array<array<bigint>>",
    )
    word_ids = let(rank_literals(ranks), lambda table: let(table.base, lambda base: let(
        table.cells, lambda cells: F.transform("words", lambda w: fold_merges(w, base, cells)))))
    types = (T.ArrayType(T.IntegerType()), T.BinaryType(), T.BinaryType())
    schema = T.StructType([*rest, *[T.StructField(name, kind) for name, kind in zip(own, types, strict=True) if name]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _assembled(_without_items(batches))
        return _decoded(out, ranks, decoded) if decoded else out

    return blocks.withColumn("word_ids", word_ids).drop("words").mapInArrow(finish, schema)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for (binary); ids outside the vocabulary add nothing."""
    names = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(names, separators=(",", ":"))), "array<string>")
    return let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))
