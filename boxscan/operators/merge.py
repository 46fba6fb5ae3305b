"""Greedy merge of neighbouring blocks that overlap each other by half.

The fold goes through the blocks of a (contig, strand) in order; a block
joins the current one when their overlap is at least half of the longer of
the two, and the joined block ends where the second one ended.  The outcome
depends on the order, so the fold is kept, but it need not run over a whole
contig: a row whose overlap with everything before it is below half of its
own length cannot join, whatever the state is.  It opens a new chain.

Rows are spread by (contig, strand, bucket of the start), sorted there, and
folded as a stream.  A bucket also sees the blocks that reach into it and the
first ``halo`` nt of the next bucket.  It emits the chains that open in it.
A chain that is still open at the end of the halo is carried on: each later
bucket works out, for every row at which a block may begin in it, the blocks
that follow and where the fold enters the next bucket, and following these
hops from the chain's opening bucket picks the real ones.  So neither a hot
contig nor an endless chain ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators.islands import BUCKET, KEYS
from boxscan.session import stage

MIN_OVERLAP = 0.5
HALO = 4096

CONTEXT, OWN, AHEAD = -1, 0, 1
BLOCK, TAIL, ENTRY, THROUGH = 0, 1, 2, 3
_COLUMNS = [*KEYS, "start", "end", "score", "n_windows", "bucket", "kind", "at", "to", "blocks"]


def reciprocal(a_start, a_end, b_start, b_end, min_overlap=MIN_OVERLAP) -> Column:
    """Do two intervals overlap by that share of the longer one?"""
    overlap = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return overlap >= min_overlap * F.greatest(a_end - a_start, b_end - b_start)


def _joins(s, e, start, end, share):
    return max(min(e, end) - max(s, start), 0) >= share * max(e - s, end - start)


class _Bucket:
    """Streaming fold over the sorted rows of one bucket."""

    def __init__(self, key, size, halo, share, out):
        self.key, self.share, self.out = key, share, out
        self.begin, self.stop = key[2] * size, (key[2] + 1) * size
        self.halo = halo
        self.reach = None        # largest end so far
        self.before = None       # end of the row before
        self.cur = None          # open block of the chain that opened here
        self.ahead = []          # closed blocks that start beyond this bucket
        self.carried = []        # rows that go on with a chain opened earlier
        self.owner = False       # has a chain opened here?
        self.exit = None         # where an unfinished chain enters the next bucket
        self.over = False        # the last chain has ended inside the halo
        self.carry_open = True   # are we still in the earlier chain?
        self.carry_heavy = None  # did the earlier bucket leave it to us?

    def _close(self):
        if self.cur is not None:
            if self.cur[0] < self.stop:
                self._emit(self.cur)
            else:
                self.ahead.append(self.cur)
                if self.exit is None:
                    self.exit = self.cur[0]
            self.cur = None

    def _emit(self, block):
        self.out.append((*self.key[:2], *block, self.key[2], BLOCK, None, None, None))

    def _settle_carry(self, start):
        """Decide, as the earlier bucket did, whether its chain outlived its halo."""
        edge = self.begin + self.halo
        if self.carry_heavy is None and (start is None or start >= edge):
            self.carry_heavy = self.reach is not None and self.reach > edge

    def row(self, start, end, score, n, role):
        if self.over:
            return
        if self.before is not None and self.before - start > self.halo:
            raise ValueError(
                f"blocks at {start} of {self.key[0]} overlap by {self.before - start} nt: halo {self.halo} is too small")
        self.before = end
        if role == CONTEXT:
            self.reach = end if self.reach is None else max(self.reach, end)
            return
        if self.carry_open:
            self._settle_carry(start)
        opens = self.reach is None or self.reach - start < self.share * (end - start)
        self.reach = end if self.reach is None else max(self.reach, end)
        if opens:
            if role == AHEAD:
                self.over = True
                return
            if self.carry_open:
                self._end_carry(resolved=True)
            self._close()
            self.ahead, self.exit, self.owner = [], None, True
            self.cur = (start, end, score, n)
        elif self.carry_open:
            self.carried.append((start, end, score, n))
        elif self.cur is not None and _joins(*self.cur[:2], start, end, self.share):
            self.cur = (self.cur[0], end, (self.cur[2] + score) / 2, self.cur[3] + n)
        else:
            self._close()
            self.cur = (start, end, score, n)

    def finish(self):
        done = self.over or self.reach is None or self.reach <= self.stop + self.halo
        if self.carry_open:
            self._settle_carry(None)
            self._end_carry(resolved=done)
        elif self.owner:
            self._close()
            if done:
                for block in self.ahead:
                    self._emit(block)
            else:
                to = self.stop + self.halo if self.exit is None else self.exit
                self.out.append((*self.key[:2], None, None, None, None, self.key[2], TAIL, None, to, None))

    def _end_carry(self, resolved):
        self.carry_open = False
        if self.carry_heavy is None:
            self.carry_heavy = False      # ended inside the halo of the earlier bucket
        if not self.carry_heavy:
            return
        rows, hop = self.carried, {}

        def block_from(i):
            if i not in hop:
                start, end, score, n = rows[i]
                j = i + 1
                while j < len(rows) and _joins(start, end, rows[j][0], rows[j][1], self.share):
                    end, score, n = rows[j][1], (score + rows[j][2]) / 2, n + rows[j][3]
                    j += 1
                hop[i] = (start, end, score, n), j
            return hop[i]

        for i, row in enumerate(rows):
            if row[0] >= self.stop:
                break
            blocks, j = [], i
            while j < len(rows) and (resolved or rows[j][0] < self.stop):
                block, j = block_from(j)
                blocks.append(block)
            to = None if resolved else rows[j][0] if j < len(rows) else self.stop + self.halo
            self.out.append((*self.key[:2], None, None, None, None, self.key[2], ENTRY, row[0], to, blocks))
            if row[0] > self.begin + self.halo:
                break           # an entry lies in the halo or is the first row after it
        if not resolved:
            self.out.append((*self.key[:2], None, None, None, None, self.key[2], THROUGH, None, None, None))


def _fold(size: int, halo: int, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = None, []
        for pdf in batches:
            columns = [pdf[c].tolist() for c in
                       [*KEYS, "bucket", "start", "end", "score", "n_windows", "role"]]
            for contig, strand, bucket, start, end, score, n, role in zip(*columns):
                key = (contig, strand, bucket)
                if state is None or state.key != key:
                    if state is not None:
                        state.finish()
                    state = _Bucket(key, size, halo, share, out)
                state.row(start, end, score, n, role)
            if len(out) > 50_000:
                yield _frame(out)
                out.clear()
        if state is not None:
            state.finish()
        yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS)
    for name in ("start", "end", "n_windows", "at", "to"):
        pdf[name] = pdf[name].astype("Int64")
    pdf["score"] = pdf["score"].astype("float64")
    return pdf


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which entry of each bucket the unfinished chains of a contig really take.

    Sees a few numbers per bucket of such chains, never their rows.
    """
    picked = []
    where, active = None, None       # entry into bucket ``active``
    for bucket, part in pdf.sort_values(["bucket", "kind", "at"]).groupby("bucket"):
        if active == bucket:
            entries = part[(part["kind"] == ENTRY) & (part["at"] >= where)]
            if len(entries):
                first = entries.iloc[0]
                picked.append((bucket, int(first["at"])))
                active, where = (None, None) if pd.isna(first["to"]) else (bucket + 1, int(first["to"]))
            else:
                active = bucket + 1 if (part["kind"] == THROUGH).any() else None
        else:
            active = None
        tail = part[part["kind"] == TAIL]
        if len(tail):
            active, where = bucket + 1, int(tail.iloc[0]["to"])
    out = pd.DataFrame(picked, columns=["bucket", "at"])
    return out.assign(contig=pdf["contig"].iloc[0], strand=pdf["strand"].iloc[0])[
        [*KEYS, "bucket", "at"]
    ]


def merge_reciprocal(
    blocks: DataFrame,
    min_overlap: float = MIN_OVERLAP,
    bucket: int = BUCKET,
    halo: int = HALO,
) -> DataFrame:
    """Merged ``(contig, strand, start, end, score, n_windows)``.

    ``halo`` must be at least twice the largest overlap of two neighbouring
    blocks (islands of windows share less than a window); an overlap beyond the
    halo itself raises.
    """
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*KEYS).schema)
    own = F.floor(F.col("start") / bucket)
    last = F.floor((F.col("end") - 1) / bucket)

    def goes_to(to, role):
        return F.struct(to.alias("bucket"), F.lit(role).alias("role"))

    reached = F.transform(
        F.filter(F.sequence(own, F.greatest(last, own)), lambda b: b > own),
        lambda b: goes_to(b, CONTEXT),
    )
    back = F.when(
        (F.col("start") < own * bucket + halo) & (own > 0), F.array(goes_to(own - 1, AHEAD))
    ).otherwise(F.array().cast("array<struct<bucket:bigint,role:int>>"))
    folded = (
        blocks.select(
            *KEYS, "start", "end", "score", "n_windows",
            F.inline(F.concat(F.array(goes_to(own, OWN)), reached, back)),
        )
        .repartition(*KEYS, "bucket")
        .sortWithinPartitions(*KEYS, "bucket", "start", "end")
        .mapInPandas(
            _fold(bucket, halo, min_overlap),
            f"{key}, start bigint, `end` bigint, score double, n_windows bigint, bucket bigint, "
            "kind int, at bigint, to bigint, "
            "blocks array<struct<start:bigint,end:bigint,score:double,n_windows:bigint>>",
        )
    )
    # read three times below; few rows by now, and a written table keeps the
    # fold (and all that lies before it) from running again
    folded = stage(folded, "merge")
    hops = folded.filter(F.col("kind") != BLOCK)
    picked = (
        hops.select(*KEYS, "bucket", "kind", "at", "to")
        .groupBy(*KEYS)
        .applyInPandas(_follow, f"{key}, bucket bigint, at bigint")
    )
    carried = hops.join(picked, [*KEYS, "bucket", "at"]).select(*KEYS, F.inline("blocks"))
    return (
        folded.filter(F.col("kind") == BLOCK)
        .select(*KEYS, "start", "end", "score", "n_windows")
        .unionByName(carried)
    )


def keep_long(
    blocks: DataFrame,
    min_windows: int = K.CONSECUTIVE_WINDOWS,
    width: int = K.WINDOW,
    min_count: int | None = None,
) -> DataFrame:
    """Blocks of at least ``width + min_windows - 1`` nt, and of ``min_count`` windows if given."""
    kept = blocks.filter(F.col("end") - F.col("start") >= width + min_windows - 1)
    return kept if min_count is None else kept.filter(F.col("n_windows") >= min_count)
