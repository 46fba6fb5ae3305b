"""FASTA read by byte ranges: a data source whose partitions cut lines.

The line reader of ``sources.fasta`` takes a line as a row, so an entry without
line breaks is one row of one task.  Here a file is cut at multiples of
``rangeBytes``, wherever that falls.  A range is read by itself, so it bounds the
memory of a task; where there are many, a partition reads neighbouring ranges one
after another, so that their number does not set the number of tasks.

First-byte rule: a header belongs to the range that holds its ``>``; that range
reads on to the end of the header's line.  What a range holds before its first
line break (its lead) is sequence or the rest of a header, and the range cannot
know which.  So it reports both: its counts with the lead apart, and whether its
last line is a header, if it saw that line begin.  These reports compose: a range
without a line break hands on the state it got.  One window over the reports, a
row per range of a file, settles every lead and carries the open entry and its
offset; the pieces of the second pass are joined to it by (file, range).

White space anywhere in a sequence line is dropped, bases are upper-cased.
Compressed files have no byte ranges; they stay with the line reader.  Files are
opened by pyarrow (local or mounted paths, and the schemes it knows); where only
Spark can open a store, use the line reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boxscan.session import broadcast_if_small, stage
from boxscan.sources.fasta import PIECE, carried_entries, joined_pieces

NAME = "fasta_ranges"
RANGE_BYTES = 32 << 20
#: Each range is a partition up to this number of them; more ranges share partitions of about ``PART_BYTES``.
PARTS = 256
PART_BYTES = 32 << 20
#: A header line longer than this is refused.
HEADER_BYTES = 1 << 20
GLOBS = "*.fa,*.fasta"

_PIECES = "file string, block bigint, lead boolean, name string, offset bigint, bases string"
_REPORTS = ("file string, block bigint, lead_len bigint, ends_in_header boolean, has_header boolean, "
            "last_name string, head_len bigint, tail_len bigint")
_BLANKS = b" \t\r\n\x0b\x0c"


def _open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class Range:
    def __init__(self, file: str, begin: int, end: int) -> None:
        self.file, self.begin, self.end = file, begin, end


class Run(InputPartition):
    """Bytes of one partition: ``(file, begin, end)``, each to be cut at multiples of the range size."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.spans = spans

    def ranges(self, size: int) -> Iterator[Range]:
        for file, begin, end in self.spans:
            for at in range(begin, end, size):
                yield Range(file, at, min(at + size, end))


def _runs(files: list[tuple[str, int]], size: int) -> list[Run]:
    """Neighbouring ranges of ``files(path, size)`` dealt to partitions; each a run of at least one range."""
    count = sum(-(-length // size) for _, length in files)
    total = sum(length for _, length in files)
    parts = min(count, max(PARTS, -(-total // PART_BYTES)))
    runs: list[list[tuple[str, int, int]]] = [[] for _ in range(parts)]
    before = 0  # ranges of the files before
    for path, length in files:
        own = -(-length // size)
        at = 0
        while at < own:
            part = (before + at) * parts // count
            stop = min(own, -(-(part + 1) * count // parts) - before)  # the first range of the next partition
            runs[part].append((path, at * size, min(stop * size, length)))
            at = stop
        before += own
    return [Run(spans) for spans in runs]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.globs = [g for g in options.get("globs", "").split(",") if g]
        self.kind = options.get("kind", "pieces")
        if self.size <= 0:
            raise ValueError("rangeBytes must be > 0")

    def partitions(self) -> list[Run]:
        store, root = _open_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        hidden = (f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        files = [f for f in hidden if not self.globs or any(fnmatch(f.base_name, g) for g in self.globs)]
        return _runs(sorted((f.path, f.size) for f in files), self.size)

    def read(self, part: Run | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files, no ranges
            return
        store, _ = _open_store(self.path)
        for file, ranges in groupby(part.ranges(self.size), key=lambda r: r.file):
            with store.open_input_file(file) as source:
                for one in ranges:
                    yield from _KINDS[self.kind][1](one, *_range_of(source, one))


def _range_of(source, part: Range) -> tuple[bytes, bool, bytes]:
    """The bytes of a range, whether it begins a line, and the rest of a header cut off at its end."""
    before = source.read_at(1, part.begin - 1) if part.begin else b"\n"
    data = source.read_at(part.end - part.begin, part.begin)
    starts_line = before == b"\n"
    last = data.rfind(b"\n") + 1
    rest = b""
    if data[last:last + 1] == b">" and (last or starts_line):
        rest = source.read_at(HEADER_BYTES, part.end).partition(b"\n")[0]
        if len(rest) == HEADER_BYTES:
            raise ValueError(f"a header of {part.file} is longer than {HEADER_BYTES} bytes")
    return data, starts_line, rest


def _sections(data: bytes, starts_line: bool, rest: bytes) -> Iterator[tuple[bool, str | None, bytes]]:
    """(is lead, header line that opens here or None, sequence) in order, the lead first."""
    at = 0
    if not starts_line:
        at = data.find(b"\n") + 1 or len(data)
        yield True, None, data[:at]
    if data[at:at + 1] != b">":
        mark = data.find(b"\n>", at)
        stop = len(data) if mark < 0 else mark + 1
        yield False, None, data[at:stop]
        at = stop
    while at < len(data):
        line = data.find(b"\n", at)
        header = data[at + 1:line] if line >= 0 else data[at + 1:] + rest
        at = len(data) if line < 0 else line + 1
        mark = at - 1 if data[at:at + 1] == b">" else data.find(b"\n>", at)
        stop = len(data) if mark < 0 else mark + 1
        yield False, header.decode("utf-8", "replace").rstrip("\r"), data[at:stop]
        at = stop


def _name(header: str | None) -> str | None:
    return None if header is None else next(iter(header.split()), "")


def _bases(raw: bytes) -> bytes:
    return raw.translate(None, _BLANKS)


def _reports(part: Range, data: bytes, starts_line: bool, rest: bytes) -> Iterator[pa.RecordBatch]:
    lead = head = tail = 0
    last_name = None
    for is_lead, header, raw in _sections(data, starts_line, rest):
        size = len(_bases(raw))
        if is_lead:
            lead = size
        elif header is not None:
            last_name, tail = _name(header), size
        else:
            head = size
    line = data.rfind(b"\n") + 1
    known = line > 0 or starts_line
    yield pa.RecordBatch.from_pydict({
        "file": [part.file], "block": [part.begin], "lead_len": [lead],
        "ends_in_header": pa.array([data[line:line + 1] == b">" if known else None], pa.bool_()),
        "has_header": [last_name is not None], "last_name": pa.array([last_name], pa.string()),
        "head_len": [head], "tail_len": [tail],
    })


def _pieces(part: Range, data: bytes, starts_line: bool, rest: bytes) -> Iterator[pa.RecordBatch]:
    for is_lead, header, raw in _sections(data, starts_line, rest):
        name, bases = _name(header), _bases(raw).upper()
        cuts = range(0, len(bases), PIECE)
        for first in range(0, len(cuts), 64):
            some = cuts[first:first + 64]
            n = len(some)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.file] * n), pa.array([part.begin] * n), pa.array([is_lead] * n),
                pa.array([name] * n, pa.string()), pa.array(list(some), pa.int64()),
                pa.array([bases[c:c + PIECE].decode("ascii", "replace") for c in some]),
            ], names=["file", "block", "lead", "name", "offset", "bases"])


def _headers(part: Range, data: bytes, starts_line: bool, rest: bytes) -> Iterator[pa.RecordBatch]:
    found = [h for _, h, _ in _sections(data, starts_line, rest) if h is not None]
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([part.file] * len(found), pa.string()),
        "header": pa.array([">" + h for h in found], pa.string()),
        "contig": pa.array([_name(h) for h in found], pa.string()),
    })


_KINDS = {
    "pieces": (_PIECES, _pieces), "reports": (_REPORTS, _reports),
    "headers": ("file string, header string, contig string", _headers),
}


class FastaRanges(DataSource):
    """``spark.read.format("fasta_ranges")``; options path, rangeBytes, globs, kind (pieces, reports or headers)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _KINDS[self.options.get("kind", "pieces")][0]

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def _load(spark: SparkSession, path: str, size: int, globs: str, kind: str) -> DataFrame:
    spark.dataSource.register(FastaRanges)
    return (
        spark.read.format(NAME).option("rangeBytes", size).option("globs", globs)
        .option("kind", kind).load(path)
    )


def read_fasta_ranges(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, globs: str = GLOBS
) -> DataFrame:
    """``lines(contig, pos, bases)`` as ``read_fasta`` gives them, whatever the lengths of the lines."""
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    reports = _load(spark, path, range_bytes, globs, "reports").withColumn(
        # the lead is the rest of a header if the last line that began before it is one
        "lead_is_header", F.coalesce(F.last("ends_in_header", ignorenulls=True).over(before), F.lit(False))
    ).withColumn("own_lead", F.when(F.col("lead_is_header"), 0).otherwise(F.col("lead_len")))
    # written once: the files are not read again for every use of the pieces
    known = stage(reports, "ranges")
    summary = known.withColumn("head_len", F.col("head_len") + F.col("own_lead"))
    carried = carried_entries(summary).join(
        known.select("file", "block", "lead_is_header", "own_lead"), ["file", "block"])
    carried = broadcast_if_small(stage(carried, "splits").withColumn("known", F.lit(True)))
    pieces = _load(spark, path, range_bytes, globs, "pieces")
    # sequence lines behind the lead go on where it ends
    behind = F.when(F.col("name").isNull() & ~F.col("lead"), F.col("own_lead")).otherwise(0)
    joined = joined_pieces(pieces, carried, "the FASTA files changed while they were read", behind)
    return joined.where(~(F.col("lead") & F.col("lead_is_header"))).select("contig", "pos", "bases")


def range_headers(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, globs: str = GLOBS) -> DataFrame:
    """``headers(file, header, contig)`` as ``fasta_headers`` gives them."""
    return _load(spark, path, range_bytes, globs, "headers")
