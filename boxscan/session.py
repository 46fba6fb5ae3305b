"""Session settings and lineage cuts."""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the jobs are written for.  AQE does the coalescing, the skew
#: splitting and the switch to a broadcast once a side is measured to be small.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else own_folder(spark)


def own_folder(spark: SparkSession) -> str:
    """Where the setting is missing (tests, notebooks): a folder under the warehouse.

    A path on a local disk is refused unless the executors run in this machine's
    own JVM: they would not see it.
    """
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/boxscan-shared"
    if spark.sparkContext.master.split("[")[0] != "local" and _scheme(spark, folder) == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def _scheme(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()


#: Folders made by this process and not removed yet.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/boxscan-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_folders(spark: SparkSession, since: int = 0) -> int:
    """Deletes the folders made by ``new_folder`` after the first ``since``; returns how many.

    To be called when the results that read them have been written.
    """
    gone, _made[since:] = _made[since:], []
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


@contextmanager
def own_folders(spark: SparkSession):
    """Removes, at its end, every staged table made inside the block."""
    since = len(_made)
    try:
        yield
    finally:
        remove_folders(spark, since)


class Steps:
    """The staged tables of one run, kept so that a later run need not make them again.

    ``key`` names all that decides the tables: inputs, parameters, models.  It is
    digested into the name of the run's folder and written there as ``_key.json``.
    Step ``i`` is the folder ``i-name`` and, once the table is whole, the mark
    ``i-name.done`` beside it, which holds the schema.  A table without a readable
    mark, or with another schema, is made again from its start.
    """

    def __init__(self, spark: SparkSession, folder: str, key: dict):
        text = json.dumps(key, sort_keys=True)
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"
        self.count = 0
        self.made: list[str] = []
        self.reused: list[str] = []
        self._put(f"{self.root}/_key.json", text)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _put(self, path: str, text: str) -> None:
        """The file appears whole: it is written under another name first."""
        system, at = self._at(path)
        draft = self._at(path + ".draft")[1]
        out = system.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        system.delete(at, False)
        if not system.rename(draft, at):
            raise OSError(f"{path} could not be written")

    def _marked(self, path: str) -> str | None:
        system, at = self._at(path)
        if not system.exists(at):
            return None
        return self.spark.read.text(path, wholetext=True).first().value

    def table(self, df: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
        """The table of the next step: the finished one of an earlier run, or made now."""
        path = f"{self.root}/{self.count:02d}-{name}"
        self.count += 1
        schema = df.schema.json()
        if self._marked(path + ".done") == schema:
            self.reused.append(name)
        else:
            df.write.options(**options).mode("overwrite").parquet(path)
            self._put(path + ".done", schema)
            self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(path)


_steps: ContextVar[Steps | None] = ContextVar("steps", default=None)


@contextmanager
def resumable(spark: SparkSession, folder: str, key: dict):
    """Inside the block, ``stage`` keeps its tables in ``folder`` and takes up finished ones.

    The steps of a run must come in the same order each time.  Two runs with one
    key must not write at the same time.
    """
    steps = Steps(spark, folder, key)
    token = _steps.set(steps)
    try:
        yield steps
    finally:
        _steps.reset(token)


def files_key(spark: SparkSession, path: str, glob: str | None = None) -> list[str]:
    """Number of files and the sum of the hashes of their names, sizes and times; no file is opened."""
    files = spark.read.format("binaryFile").options(**({"pathGlobFilter": glob} if glob else {})).load(path)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    found = files.agg(F.count("*").cast("string").alias("n"), F.sum(one).cast("string").alias("digest")).first()
    return [found.n, found.digest or ""]


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage before a table is read several times (scored windows
    above all), survives lost executors, and gives the later reads column
    pruning and filter pushdown.  Inside ``resumable`` a finished table is reused.
    """
    spark = df.sparkSession
    steps = _steps.get()
    if steps is not None:
        return steps.table(df, name, options or {})
    path = new_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all tasks when a table has fewer splits than there are cores.

    Only for plain table reads, whose split count is known without running
    anything.  A large table is left as it is: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of the values of ``df``, summed by Spark: string lengths, 8 per other cell."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    width = 8 * (len(df.columns) - len(texts)) + 16 * len(texts)
    cells = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in texts]
    row = reduce(lambda a, b: a + b, cells, F.lit(width).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first().n


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast only when its measured size allows it."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df
