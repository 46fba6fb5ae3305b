"""Near duplicates by HyperMinHash: compressed registers, bands, estimate, exact check.

A document is its set of word shingles, hashed to 64 bits.  Its sketch has 128
registers: the shingle of least hash in each bucket leaves its count of leading
zeros and 26 mantissa bits.  Bands of four registers name the buckets in which
documents become candidates (at a similarity of 0.85 a pair misses all bands
once in 10 ** 10).  Candidates are compared by the estimate from the registers,
corrected for collisions, and then on their full sets.

Groups of copies of any size are handled without listing pairs:

1. Documents with equal sets are one node.
2. Nodes count how crowded their buckets are; the pivot of a bucket is its most
   crowded node (the original among its variants).  Every node is compared with
   the pivots of its buckets: a star, linear in the nodes.
3. Only where a pivot's neighbourhood still holds several components, its nodes
   outside the pivot's component (even a single one) are compared with all of
   it.  Two candidates are then in one component or were compared, so no link
   between components is lost.
4. A neighbourhood of more than a few nodes (often documents that share little
   but a common passage) is first cut by rare shingles: of two sets that are
   alike enough each holds their rarest common shingle among its rarest
   ``size - least overlap + 1``, so nodes meet in the groups of those alone.
   Shingles of the same nodes count once.  Where such a shingle is still held by
   many, as in a large group of copies, or one of its nodes would meet in many
   groups, its nodes meet in the pivot's neighbourhood instead.

Groups are compared block by block; many small ones share a call.
All tables between the steps are written to the shared folder.

Defined results: lower case is A-Z only; a text with fewer words than a shingle
is one shingle of all its words; null, empty and blank texts have no shingle,
are linked with nothing and kept; repeated rows fall into one component; a null
doc_id takes part, but gives its component a name only if all its ids are null;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxscan.llm.hashing import mix, slices, word_hashes
from boxscan.session import stage, task_count

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 26
BAND = 4
EMPTY = np.uint32(0xFFFFFFFF)
#: Nodes in a block of a comparison, and rows of a call of it, about.
BLOCK = 512
CALL = 512
#: Nodes of a neighbourhood that all meet, or that meet for a rare shingle's sake, at most.
FEW = 32
#: Groups by rare shingles that a node is in, at most.
MEETINGS = 16
#: Pairs whose registers are compared at once.
PAIRS = 1 << 14
#: The estimate may fall short of the bound by so many standard deviations.
SLACK = 5.5


@dataclass(frozen=True)
class Likeness:
    """Words per shingle, and 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and how many each has."""
    words, ends = word_hashes(column, lower=True)
    counts = np.diff(ends, prepend=0)
    short = (counts > 0) & (counts < size)
    doc = np.repeat(np.arange(len(ends)), counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    # one chain of hashes serves full windows and, for short texts, the whole sequence
    chain = np.zeros(len(words), np.uint64)
    n = np.where(short, counts, size)[doc] if len(doc) else doc
    for k in range(size):
        use = np.flatnonzero((k < n) & (place + n <= counts[doc])) if len(doc) else doc
        chain[use] = mix(chain[use] * np.uint64(5) + words[use + k] + np.uint64(k + 1))
    whole = np.flatnonzero(place + n <= counts[doc]) if len(doc) else doc
    owner, value = doc[whole], mix(chain[whole] + n[whole].astype(np.uint64))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.bincount(owner, minlength=len(ends))


def registers(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS): leading zeros and mantissa of the least hash of each bucket."""
    out = np.full((len(counts), REGISTERS), EMPTY, np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    bucket = (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = owner * REGISTERS + bucket
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # ascending, so the first is the least
    rest = (value[first] << np.uint64(BUCKET_BITS)) >> np.uint64(12)  # 52 bits
    _, length = np.frexp(rest.astype(np.float64))
    zeros = (52 - length).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) & np.uint64((1 << 52) - 1)
    tail = np.where(length > 0, tail, 0) >> np.uint64(52 - MANTISSA)
    out.reshape(-1)[cell[first]] = ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint32)
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands with a value, and how many each text has."""
    bands = regs.reshape(len(regs), REGISTERS // BAND, BAND)
    key = np.broadcast_to(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(BAND):
        key = mix(key * np.uint64(7) + bands[:, :, k])
    used = (bands != EMPTY).any(2)
    return key[used].view(np.int64), used.sum(1)


def estimate(regs: np.ndarray, one: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Jaccard similarities of texts with one text, corrected for registers that agree by chance.

    Two different hashes agree in leading zeros and mantissa with a chance of
    about 2 ** -MANTISSA / 3 in a bucket that both sets reach.
    """
    either = ((regs != EMPTY) | (one != EMPTY)).sum(1)
    both = ((regs != EMPTY) & (one != EMPTY)).sum(1)
    same = ((regs == one) & (regs != EMPTY)).sum(1)
    chance = both * 2.0**-MANTISSA / 3
    return np.maximum(same - chance, 0) / np.maximum(either, 1)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _cells(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells of ``counts`` numbers each."""
    ends = (np.concatenate([[0], np.cumsum(counts)]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            value, counts = shingle_sets(part.column(1), size)
            prints = set_prints(value, counts)
            regs = registers(value, counts)
            keys, used = band_keys(regs)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(counts, pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                _lists(keys, used, pa.int64()), _cells(regs.astype("<u4").reshape(-1), np.full(len(counts), REGISTERS)),
            ], names=["doc_id", "n_shingles", "print1", "print2", "bands", "regs"])


def set_prints(value: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value + np.uint64(s)))]) for s in (1, 2)]
    return [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]


def _with_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The full set of each node, from the texts of its id that have the node's print."""
    for batch in batches:
        for part in slices(batch, "text"):
            value, counts = shingle_sets(part.column(1), size)
            own = np.ones(part.num_rows, bool)
            for k, p in enumerate(set_prints(value, counts)):
                own &= p == np.asarray(part.column(3 + k))
            out = pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), _cells(value.astype("<u8"), counts)], names=["node", "regs", "members"])
            yield out.filter(pa.array(own))


def _column(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary cells, one after another, and how many each has."""
    cells = table.column(name).to_pylist()
    flat = np.frombuffer(b"".join(cells), kind)
    return flat, np.fromiter(map(len, cells), np.int64, len(cells)) // flat.itemsize


def _cell_numbers(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.stack([np.asarray(t.column(c)).astype(np.int64) for c in ("pivot", "i", "j")], axis=1) for t in (left, right)]
    number = np.unique(np.concatenate(keys), axis=0, return_inverse=True)[1].reshape(-1)
    return number[:len(left)], number[len(left):]


def _compared(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between nodes of the two sides of each cell that belong to different components.

    A link between components that other links of the call join is left out.
    """
    found: tuple[list[int], list[int]] = ([], [])
    if len(left) and len(right):
        cell, r_cell = _cell_numbers(left, right)
        right = right.take(pa.array(np.argsort(r_cell, kind="stable")))
        r_cell = np.sort(r_cell)
        node, r_node = (np.asarray(t.column("node")) for t in (left, right))
        _, comp = np.unique(np.concatenate([np.asarray(t.column("comp")) for t in (left, right)]), return_inverse=True)
        comp, r_comp = comp[:len(left)], comp[len(left):]
        label = np.arange(max(comp.max(), r_comp.max()) + 1)
        (value, size), (r_value, r_size) = (_column(t, "members", "<u8") for t in (left, right))
        regs, r_regs = (_column(t, "regs", "<u4")[0].reshape(-1, REGISTERS) for t in (left, right))
        begin, r_begin = (np.cumsum(x) - x for x in (size, r_size))
        bound = percent / 100
        floor = bound - SLACK * (bound * (1 - bound) / REGISTERS) ** 0.5
        lo = np.searchsorted(r_cell, cell, "left")
        width = np.searchsorted(r_cell, cell, "right") - lo
        upto = np.cumsum(width)
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] - width[at] + PAIRS, "right")))
            a = np.repeat(np.arange(at, stop), width[at:stop])
            b = np.arange(len(a)) + np.repeat(lo[at:stop] - (upto[at:stop] - width[at:stop] - (upto[at] - width[at])), width[at:stop])
            at = stop
            fit = np.flatnonzero(
                (label[comp[a]] != label[r_comp[b]]) & (node[a] != r_node[b])
                & (np.minimum(size[a], r_size[b]) * 100 >= percent * np.maximum(size[a], r_size[b])))
            a, b = a[fit], b[fit]
            one, other = regs[a], r_regs[b]
            # few registers tell little, so small sets go straight to the exact check
            fit = ((one & other) != EMPTY).sum(1) < REGISTERS // 2
            fit |= estimate(other, one, r_size, 0) >= floor
            a, b = a[fit], b[fit]
            for k in np.flatnonzero(np.diff(a, prepend=-1)):
                own = a[k]
                near = b[k:np.searchsorted(a, own, "right")]
                near = near[label[r_comp[near]] != label[comp[own]]]
                if not len(near):
                    continue
                mine = value[begin[own]:begin[own] + size[own]]
                sizes = r_size[near]
                ends = np.cumsum(sizes)
                theirs = r_value[np.repeat(r_begin[near] - (ends - sizes), sizes) + np.arange(ends[-1])]
                place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                shared = np.add.reduceat((mine[place] == theirs).astype(np.int64), ends - sizes)
                for x in near[100 * shared >= percent * (sizes + len(mine) - shared)]:
                    ends_at = label[comp[own]], label[r_comp[x]]
                    if ends_at[0] != ends_at[1]:
                        label[label == max(ends_at)] = min(ends_at)
                        found[0].append(int(node[own]))
                        found[1].append(int(r_node[x]))
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _links(left: DataFrame, right: DataFrame, rows: int, sets: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """Links found in the cells (pivot, i, j), each holding a block of either side; some ``rows`` in all."""
    calls = max(-(-rows // CALL), task_count(sets.sparkSession))

    def full(side: DataFrame) -> DataFrame:
        rows = side.join(sets.hint("merge"), "node")  # Spark sizes a side without the copies that it holds
        label = F.col("node")
        if comps is not None:
            rows, label = rows.join(comps, "node", "left"), F.coalesce("label", "node")
        call = F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(calls)).alias("call")
        rows = rows.select("pivot", "i", "j", "node", "regs", "members", label.alias("comp"), call)
        return rows.toDF(*rows.columns)  # columns of its own, as both sides come from the same tables

    return full(left).groupBy("call").cogroup(full(right).groupBy("call")).applyInArrow(
        lambda a, b: _compared(a, b, percent), "a bigint, b bigint")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, counts = _column(pa.Table.from_batches([batch]), "members", "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(value), pa.array(np.repeat(np.asarray(batch.column(0)), counts)), pa.array(np.repeat(counts, counts))],
            names=["shingle", "node", "size"])


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, node: two of the sets (node, members) that are alike enough have one of these in common.

    Shingles are ordered by the sets that hold them, the rarest first.  A set of n shingles shares
    at least ``ceil(n * percent / 100)`` with another, so its first shingle that both hold is among
    its first ``n - that + 1``; those that no other set holds need no row.
    """
    rows = sets.select("node", "members").mapInArrow(_shingles, "shingle bigint, node bigint, size bigint")
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("shingle"))).where("n > 1")
    rank = F.row_number().over(W.partitionBy("node").orderBy("n", "shingle"))
    shared = F.count("*").over(W.partitionBy("node"))
    least = F.expr(f"(size * {percent} + 99) div 100")
    return rows.withColumn("rank", rank).withColumn("spare", shared - least + 1).where("rank <= spare").select("shingle", "node")


def _open(around: DataFrame, nodes: int) -> DataFrame:
    """The groups of (pivot, node, apart) that hold nodes apart and so many nodes at least, and their blocks."""
    return around.groupBy("pivot").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(F.col("apart"), 1)) / BLOCK).cast("int").alias("sides"),
        F.count(F.when(F.col("apart"), 1)).alias("n_apart"), F.count("*").alias("n_nodes"),
    ).where((F.col("n_apart") > 0) & (F.col("n_nodes") >= nodes))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that is reachable, for every node with a link.

    Rounds of taking the least label around, followed by jumps from label to
    label, until nothing changes; two small aggregates a round reach the driver.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = stage(least.select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(
            nearer.join(jump, "label", "left")
            .select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, how: Likeness | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept, one row per document."""
    how = how or Likeness()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = stage(
        texts.mapInArrow(
            lambda b: _sketched(b, how.words),
            "doc_id bigint, n_shingles bigint, print1 bigint, print2 bigint, bands array<bigint>, regs binary",
        ), "sketches")
    prints = ["print1", "print2"]
    nodes = stage(
        sketched.where("n_shingles > 0").groupBy(*prints)
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    crowded = stage(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stage(entries.join(crowded, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = stage(
        members.join(stage(weights, "weights"), "node").groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("top"))
        .select("key", (-F.col("top.least")).alias("pivot")), "pivots")
    pairs = stage(members.join(pivots, "key").select("node", "pivot").distinct(), "pairs")  # pivots pair with themselves
    wanted = nodes.join(members.select("node").distinct(), "node").select(
        "node", "regs", *prints, F.col("rep").alias("doc"))
    source = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")))
    sets = stage(
        source.select("node", "text", "regs", *prints).mapInArrow(
            lambda b: _with_sets(b, how.words), "node bigint, regs binary, members binary"), "sets")

    # every node against the pivots of its buckets
    crowd = stage(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "crowds")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    star_right = pairs.join(crowd, "pivot").select("pivot", F.lit(0).alias("i"), block.alias("j"), "node")
    star_left = crowd.select(
        "pivot", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("pivot").alias("node"))
    links = stage(_links(star_left, star_right, 2 * pairs.count(), sets, None, how.percent), "links")
    labels = components(links)

    # what a pivot's neighbourhood still holds apart from the pivot's component
    found = pairs.join(labels, "node", "left").select("node", "pivot", F.coalesce("label", "node").alias("comp"))
    of_pivot = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    around = stage(
        found.join(of_pivot, "pivot", "left")
        .select("node", "pivot", (F.col("comp") != F.coalesce("pivot_label", "pivot")).alias("apart")), "around")
    open_pivots = stage(_open(around, 3), "open")  # a single node apart meets the others too
    rest = around.join(open_pivots.where(F.col("n_nodes") <= FEW), "pivot")
    crowds = open_pivots.where(F.col("n_nodes") > FEW)
    if not crowds.isEmpty():
        nearby = around.join(crowds.select("pivot"), "pivot").select("node").distinct()
        rare = stage(rare_shingles(sets.join(nearby, "node"), how.percent), "rare")
        once = rare.groupBy("shingle").agg(
            F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"print{k}") for k in (1, 2))
        ).where("n > 1").groupBy("n", *prints).agg(F.min("shingle").alias("shingle")).select("shingle")
        found = rare.join(once, "shingle").join(labels, "node", "left").select(
            "node", F.col("shingle").alias("pivot"), F.coalesce("label", "node").alias("comp"))
        main = found.groupBy("pivot", "comp").agg(F.count("*").alias("n")).groupBy("pivot").agg(
            F.max(F.struct("n", (-F.col("comp")).alias("least"))).alias("main")).select("pivot", (-F.col("main.least")).alias("main"))
        holders = stage(found.join(main, "pivot").select("node", "pivot", (F.col("comp") != F.col("main")).alias("apart")), "holders")
        held = stage(_open(holders, 2), "held")
        few = holders.join(held.where(F.col("n_nodes") <= FEW), "pivot")
        busy = few.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > MEETINGS).select("node")
        many = held.where(F.col("n_nodes") > FEW).select("pivot")
        dense = stage(few.join(busy, "node").select("pivot").union(many).distinct(), "dense")
        rest = rest.unionByName(few.join(dense, "pivot", "left_anti"))
        common = holders.join(dense, "pivot").select("node").distinct()
        crowd = stage(around.join(crowds.select("pivot"), "pivot").join(common, "node").select("node", "pivot", "apart"), "crowd")
        rest = rest.unionByName(crowd.join(stage(_open(crowd, 2), "open"), "pivot"))
    rest = stage(rest, "rest")
    rows = rest.agg(F.coalesce(F.sum(F.col("sides") + F.when(F.col("apart"), F.col("blocks")).otherwise(0)), F.lit(0)).alias("n")).first().n
    side = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    left = rest.where("apart").select(
        "pivot", side.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node")
    right = rest.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("i"), block.alias("j"), "node")
    more = stage(_links(left, right, rows, sets, labels, how.percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = nodes.select("node", "rep", "copies", *prints).join(labels, "node", "left")
    named = stage(named.withColumn("label", F.coalesce("label", "node")), "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
    classes = stage(named.join(stage(least, "least"), "label").select(
        F.col("print1").alias("p1"), F.col("print2").alias("p2"), "component_id"), "classes")
    met = (F.col("print1") == F.col("p1")) & (F.col("print2") == F.col("p2")) & (F.col("n_shingles") > 0)
    return (
        sketched.select("doc_id", "n_shingles", *prints).join(classes, met, "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("p1").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame, how: Likeness | None = None) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns.

    Rows go by their id: those without an id stay, and repeated rows with the id
    that names the component stay together.
    """
    gone = stage(near_duplicates(docs, how).where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_anti")
