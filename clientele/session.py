"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Settings the library depends on for correct results (timezone, ANSI)
# and for scale (AQE, skew join, partition sizing).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# SQL settings the results depend on; applied to any session the library runs in.
REQUIRED_SQL_CONF = {
    # JSON objects with a repeated key keep the last value (as Python's json.loads
    # does) instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's required SQL settings to a session."""
    for k, v in REQUIRED_SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "clientele", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    Master, partition count and memory come from the submit configuration
    unless they are passed; without any master it is ``local[*]``."""
    builder = SparkSession.builder.appName(app_name)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    if spark.sparkContext.master.startswith("local["):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it (a shared file system); it is an
    error when it does not.  Only a local master, where one machine is the whole
    cluster, gets a scratch folder, which is deleted when Python ends."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="clientele-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


_SCRATCH: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; deleted when the driver's Python ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clientele-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH[root] = spark
        atexit.register(_drop_scratch, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a reliable checkpoint in compressed columns, of
    which a reader takes those it needs.  What Parquet cannot hold is checkpointed row by row."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch(df.sparkSession, name)
    _stage(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark packs files into read tasks by their bytes, and staged rows take few (10 a mention): with files of so
# many rows, each counted with the cost of opening it, a task of 128 MB gets two million rows at most.
FILE_ROWS = 1 << 16


def _stage(df: DataFrame, path: str) -> None:
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


@contextlib.contextmanager
def staged_while(parts: Iterable[DataFrame], name: str) -> Iterator[DataFrame]:
    """The union of ``parts`` (of one schema) staged one after the other, for the time of the block:
    the shuffles of a part are gone when the next begins.  What leaves the block must be staged itself."""
    path = None
    for df in parts:
        path = path or scratch(df.sparkSession, name)
        _stage(df, path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside are deleted when it ends; else they stay on the
    executors' disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def slices(df: DataFrame, most: int) -> int:
    """How many parts of at most ``most`` bytes the files behind ``df`` make (one if their size is not known)."""
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(1, -(-size // most)) if size < 1 << 60 else 1


def sliced(df: DataFrame, column: str, part: tuple[int, int]) -> DataFrame:
    """Part k of n of the rows, dealt by the hash of a whole-number column."""
    k, n = part
    return df if n == 1 else df.where(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(n)) == k)


def _drop_scratch(root: str) -> None:
    spark = _SCRATCH.pop(root, None)
    if spark is None or spark.sparkContext._jsc is None:  # the session has ended before
        return
    _delete(spark, root)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
