"""Exact top-k search: tiled matrix products, selection per tile, merging in a tree.

Vectors are packed into tiles (one row holds some thousand vectors as one
matrix, in the narrowest cells that hold its numbers).  Tiles of candidates are
dealt evenly over columns, a few for each core, and every tile of queries goes
to each column once, by key: Spark sizes the copies like the tiles they come
from, so it may not broadcast them.  A task multiplies a tile of queries with
the tiles of its column and keeps the k best of each query so far; one list for
each query and column is left, and those are merged by group of columns and then
by query.  A column holds at most 64 tiles, a task a few tiles and their scores
at a time.

Defined results: components become floor(scale * x) of x as double; vectors that
are null, hold null or non-finite components, or have a null id take no part;
vectors of different length are compared as if the shorter ended in zeros;
scores that leave the range of long are cut to it; ties go to the smaller id;
rows that share the query's id count as its own; an id repeated among the
queries is asked once, with its least vector, and repeated candidates are
candidates each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxscan.session import stage

#: Vectors in a tile, at most, and numbers in a tile.
TILE = 4096
TILE_CELLS = 1 << 20
#: Columns for each core, and tiles of a column at most.
COLUMNS = 4
COLUMN_TILES = 64


def _narrowest(cells: np.ndarray) -> np.ndarray:
    """Whole numbers in 1, 2 or 4 bytes each where they fit, else in 8 as doubles."""
    top = np.abs(cells).max(initial=0)
    return cells.astype(next((f"<i{w}" for w in (1, 2, 4) if top < 2.0 ** (8 * w - 1)), "<f8"))


def _tiles(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(ids, cells, dim): the vectors of each batch as matrices, in order of id."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        dim = int(sizes.max()) if len(sizes) else 0
        cells = np.zeros((len(ids), dim))
        cells[np.arange(dim) < sizes[:, None]] = np.floor(np.asarray(lists.flatten()).astype(np.float64) * scale)
        order = np.argsort(ids, kind="stable")
        step = max(1, min(TILE, TILE_CELLS // max(dim, 1)))
        step = max(1, -(-len(ids) // max(1, -(-len(ids) // step))))  # tiles of one size
        for at in range(0, len(ids), step):
            own = order[at:at + step]
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([ids[own].astype("<i8").tobytes()], pa.binary()),
                "cells": pa.array([_narrowest(cells[own]).tobytes()], pa.binary()),
                "dim": pa.array([dim], pa.int32()),
            })


def valid(vectors: DataFrame) -> DataFrame:
    """The (id, vector) rows that take part."""
    return vectors.where(
        "id IS NOT NULL AND vector IS NOT NULL AND "
        "NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(cast(x AS double)) = double('infinity'))"
    )


def tiles(vectors: DataFrame, scale: int) -> DataFrame:
    """Tiles of (id, vector) rows; rows that take no part are left out."""
    return valid(vectors).mapInArrow(lambda b: _tiles(b, scale), "ids binary, cells binary, dim int")


def _matrix(ids: bytes, cells: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    if not cells:
        return names, np.zeros((len(names), 0))
    width = len(cells) // (len(names) * dim)
    return names, np.frombuffer(cells, f"<{'f' if width == 8 else 'i'}{width}").reshape(len(names), dim).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; exact, in the first of float, double and int64 that holds them."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    top = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(dim, 1)
    if top < 2.0**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if top < 2.0**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T) if dim else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller column; in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if np.abs(scores.astype(np.float64)).max(initial=0) < 2.0**61 / n:
        keys = scores * n + np.arange(n - 1, -1, -1)
        return np.argpartition(keys, n - k, axis=1)[:, n - k:]
    return np.argsort(~scores, axis=1, kind="stable")[:, :k]


class Lists:
    """The k best of each query of one tile among the candidates met so far, ties to the smaller id."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.line, self.name, self.score = (np.empty(0, np.int64) for _ in range(3))
        #: The worst score of each full list.
        self.bar: np.ndarray | None = None

    def meet(self, a: np.ndarray, names: np.ndarray, b: np.ndarray) -> None:
        """The rows of ``a`` are those of the queries; ``names`` ascend."""
        found = [(self.line, self.name, self.score)]
        own = np.searchsorted(names, self.asked, "right") - np.searchsorted(names, self.asked, "left")
        step = max(1, (4 << 20) // max(len(names), 1))
        for at in range(0, len(a), step):
            scores = products(a[at:at + step], b)
            # one more for each row of its own that may stand among the best
            most = self.k + int(own[at:at + step].max(initial=0))
            line, column = _above(scores, most, None if self.bar is None else self.bar[at:at + step])
            score = scores[line, column].astype(np.int64)
            line = line + at
            keep = names[column] != self.asked[line]
            found.append((line[keep], names[column[keep]], score[keep]))
        line, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((name, ~score, line))
        line, name, score = line[order], name[order], score[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line, "left")
        full, keep = rank == self.k - 1, rank < self.k
        self.bar = np.full(len(a), np.iinfo(np.int64).min)
        self.bar[line[full]] = score[full]
        self.line, self.name, self.score = line[keep], name[keep], score[keep]


def _above(scores: np.ndarray, k: int, bar: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest scores of each row that reach its bar, and of some more; ties to the smaller column."""
    n = scores.shape[1]
    if bar is None and n > k:
        bar = np.partition(scores, n - k, axis=1)[:, n - k]
    high = np.ones(scores.shape, bool) if bar is None else scores >= bar.astype(scores.dtype)[:, None]
    if n <= k or np.count_nonzero(high) <= 4 * k * len(scores):
        return np.divmod(np.flatnonzero(high), max(n, 1))
    top = best(scores.astype(np.int64), k)  # many ties
    return np.repeat(np.arange(len(scores)), k), top.reshape(-1)


def _listed(lists: Lists, column: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "query_id": pa.array(lists.asked[lists.line]), "vec_id": pa.array(lists.name), "score": pa.array(lists.score),
        "column": pa.array(np.full(len(lists.line), column), pa.int32()),
    })


def _selected(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The lists of each tile of queries and column; its rows come one after another, else it has more than one list."""
    lists, held = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {x: batch.column(x)[i] for x in batch.schema.names}
            key = cell["column"].as_py(), cell["q_tile"].as_py()
            if lists is None or held != key:
                if lists is not None:
                    yield _listed(lists, held[0])
                asked, a = _matrix(*(cell[x].as_py() for x in ("q_ids", "q_cells", "q_dim")))
                lists, held = Lists(asked, k), key
            lists.meet(a, *_matrix(*(cell[x].as_py() for x in ("ids", "cells", "dim"))))
    if lists is not None:
        yield _listed(lists, held[0])


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each of ``queries`` (id, vector)."""
    asked = valid(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    q = stage(tiles(asked, scale).withColumn("tile", F.monotonically_increasing_id()), "query_tiles")
    c = stage(tiles(vectors.select("id", "vector"), scale).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    n = c.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    columns = max(1, min(n, max(COLUMNS * cores, -(-n // COLUMN_TILES))))
    left = q.select(
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), F.col("tile").alias("q_tile"),
        F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("dim").alias("q_dim"),
    )
    # a row for each tile, so small
    dealt = c.select("tile", ((F.row_number().over(W.orderBy("tile")) - 1) % columns).cast("int").alias("column"))
    right = c.join(F.broadcast(dealt), "tile").drop("tile")
    found = left.join(right.hint("merge"), "column").mapInArrow(
        lambda b: _selected(b, k), "query_id bigint, vec_id bigint, score bigint, column int"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    group = F.pmod(F.col("column"), F.lit(max(1, int(columns**0.5))))
    some = (
        found.withColumn("group", group)
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id", "group").orderBy(*order)))
        .where(F.col("rank") <= k)
    )
    return (
        some.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
