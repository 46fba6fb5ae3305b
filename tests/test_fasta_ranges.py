"""FASTA by byte ranges: every cut of small files, one long line, and agreement with the line reader."""

import numpy as np
import pytest

from boxscan.plans.genome import Params, run_files
from boxscan.sources import fasta_ranges as R
from boxscan.sources.fasta import fasta_headers, read_fasta

TEXT = (b">a first\nACGT\nAC\r\nGTN\n>b\n\nacgtacgtacgtacgt\n>c an extraordinarily long header line, longer than a range\n"
        b"TT\nTT\n>empty\n>last\nG G\nC")
WANT = {"a": "ACGTACGTN", "b": "ACGTACGTACGTACGT", "c": "TTTT", "last": "GGC"}


def whole(rows):
    out = {}
    for contig, pos, bases in sorted(rows, key=lambda r: (r[0], r[1])):
        assert len(out.get(contig, "")) == pos or not bases, (contig, pos)
        out[contig] = out.get(contig, "") + bases
    return {k: v for k, v in out.items() if v}


def read(spark, path, size):
    return whole((r.contig, r.pos, r.bases) for r in R.read_fasta_ranges(spark, str(path), size).collect())


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 1000])
def test_ranges_of_any_size(spark, tmp_path, size):
    (tmp_path / "x.fa").write_bytes(TEXT)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "y.fasta").write_bytes(TEXT.replace(b">", b">y_") + b"\n")
    (tmp_path / "notes.txt").write_bytes(b"not read")
    assert read(spark, tmp_path, size) == WANT | {"y_" + k: v for k, v in WANT.items()}


def test_one_long_line(spark, tmp_path):
    bases = np.random.default_rng(1).choice(np.frombuffer(b"ACGT", np.uint8), 5 << 20).tobytes()
    (tmp_path / "x.fa").write_bytes(b">one\n" + bases + b"\n>two\nAC\n")
    df = R.read_fasta_ranges(spark, str(tmp_path), 64 << 10)
    assert df.rdd.getNumPartitions() == -(-(len(bases) + 14) // (64 << 10))
    rows = df.collect()
    assert max(len(r.bases) for r in rows) <= R.PIECE
    assert whole((r.contig, r.pos, r.bases) for r in rows) == {"one": bases.decode(), "two": "AC"}


def test_as_the_line_reader(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k in range(3):
        lines = [f">c{k}_{i} x\n" + "\n".join("".join(rng.choice(list("ACGT"), 60)) for _ in range(rng.integers(0, 9)))
                 for i in range(20)]
        (tmp_path / f"f{k}.fa").write_text("\n".join(lines))
    want = whole((r.contig, r.pos, r.bases) for r in read_fasta(spark, str(tmp_path)).collect())
    assert read(spark, tmp_path, 333) == want


def test_headers_and_a_whole_run_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    genes = "".join(rng.choice(list("ACGT"), 3000)) + "ATGATGA" + "".join(rng.choice(list("ACGT"), 90)) + "CTGA" + "".join(
        rng.choice(list("ACGT"), 3000))
    (tmp_path / "x.fa").write_text(f">chr one\n{genes}\n>other\n{genes[::-1]}\n")
    headers = {tuple(r) for r in R.range_headers(spark, str(tmp_path), 9).select("header", "contig").collect()}
    assert headers == {tuple(r) for r in fasta_headers(spark, str(tmp_path)).select("header", "contig").collect()}
    runs = [run_files(spark, str(tmp_path), params=Params(prob_first_model=0.9, range_bytes=size)) for size in (None, 500)]
    lines, ranges = (sorted(map(tuple, df.collect())) for df in runs)
    assert lines == ranges


def test_bases_without_a_header_and_long_headers_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "x.fa").write_bytes(b"ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        read(spark, tmp_path, 3)
    with pytest.raises(Exception, match="rangeBytes"):
        read(spark, tmp_path, 0)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b"")
    assert read(spark, tmp_path, 10) == {}


@pytest.mark.parametrize("size", [1, 2, 7])
def test_many_ranges_share_partitions(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(R, "PARTS", 5)
    files = [("a", 23), ("b", 1), ("c", 9)]
    runs = R._runs(files, size)
    assert len(runs) == 5 and all(run.spans for run in runs)
    got = [(r.file, r.begin, r.end) for run in runs for r in run.ranges(size)]
    assert got == [(f, at, min(at + size, n)) for f, n in files for at in range(0, n, size)]
    monkeypatch.setattr(R, "PART_BYTES", 4)
    assert len(R._runs(files, size)) == min(9, sum(-(-n // size) for _, n in files))


def test_the_number_of_tasks_does_not_grow_with_the_ranges(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(TEXT * 40)
    df = R.read_fasta_ranges(spark, str(tmp_path), 3)
    assert df.rdd.getNumPartitions() == R.PARTS
    ids = {(r.file, r.block): r.lead_len for r in R._load(spark, str(tmp_path), 3, "", "reports").collect()}
    assert len(ids) == -(-len(TEXT * 40) // 3)
