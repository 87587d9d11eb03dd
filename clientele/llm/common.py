"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.session import ensure_checkpoint_dir

_SCRATCH: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, file or folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(col: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the
    driver's Python ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH[root] = spark
        atexit.register(_drop, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _drop(root: str) -> None:
    spark = _SCRATCH.pop(root, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs one task of the write, not the plan above it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, for values that every
    task would compute anew (the package travels by value, so its module
    globals do not outlive a task).  A worker holds one operator's cache at a
    time: asking for another name empties those before."""
    import sys
    import types
    home = sys.modules.setdefault("clientele_worker_cache", types.ModuleType("clientele_worker_cache"))
    for other, held in home.__dict__.items():
        if other != name and isinstance(held, dict) and not other.startswith("__"):
            held.clear()
    return home.__dict__.setdefault(name, {})


def give_back() -> None:
    """Hands memory that this Python worker has freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A task function over batches that gives its memory back when it ends: a worker lives on
    for a minute beside those of the next stage, and its allocators keep what they once had."""
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def release_caches() -> None:
    """Give back what an operator that ran before in this worker has kept."""
    worker_cache("")


def ship(spark: SparkSession, value):
    """Broadcast a value whose class travels by value too; ``shipped`` opens it."""
    from pyspark import cloudpickle
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent):
    import pickle
    return pickle.loads(sent.value)
