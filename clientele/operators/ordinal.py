"""Skew-safe dense row numbering: ``row_number() OVER (PARTITION BY by ORDER BY order)``.

A plain window sends a whole partition key to one task; with one company
holding a third of all rows that task becomes the job.  Here instead:

1. range-partition on ``(by, order)`` -- the sampled bounds cut a hot key
   across many partitions -- and sort within each partition;
2. number rows per key inside each partition (``mapInArrow``: one pass
   over Arrow batches reading only the key columns; the partition is
   already sorted, so this is a run-length count);
3. count rows per ``(partition, key)`` on the JVM side (partial
   aggregation, tiny output) and turn the counts into the number of rows
   of the same key in *earlier* partitions with a window over that small
   table;
4. only the first key of a partition can have rows in an earlier
   partition, so the offset table has at most one row per partition: its
   broadcast is bounded by the partition count, never by the data.

One exchange (the range shuffle) for the data itself; the numbered rows
are staged once and both the summary and the final join read them,
so the result never depends on two samplings agreeing.  Everything else
moves per-partition summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import staged

_PID = "_ord_pid"
_LRANK = "_ord_lrank"


def _local_rank(by: Sequence[str], weight: str | None = None):
    """Per-partition run-length numbering (or running sum of ``weight``) over Arrow batches.

    Only the key columns are read (vectorised equality of each row with the
    previous one); every other column passes through as Arrow arrays, never
    converted to Python objects."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        prev_key = None     # key of the last row of the previous batch
        prev_count = 0      # its running count inside this partition
        for b in batches:
            n = b.num_rows
            if n == 0:
                yield b.append_column(_LRANK, pa.array(np.zeros(0, dtype="int64")))
                continue
            same = np.ones(n, dtype=bool)
            for c in by:
                col = b.column(c)
                cur, prev = col.slice(1), col.slice(0, n - 1)
                eq = pc.fill_null(pc.equal(cur, prev), False)
                both_null = pc.and_(pc.is_null(cur), pc.is_null(prev))
                same[1:] &= pc.or_(eq, both_null).to_numpy(zero_copy_only=False)
            first = tuple(b.column(c)[0].as_py() for c in by)
            same[0] = prev_key is not None and first == prev_key
            idx = np.arange(n, dtype="int64")
            run_start = np.maximum.accumulate(np.where(~same, idx, 0))
            w = np.ones(n, dtype="int64") if weight is None else b.column(weight).to_numpy(zero_copy_only=False).astype("int64")
            total = np.cumsum(w)
            rank = total - total[run_start] + w[run_start]
            if same[0]:
                # rows continuing the previous batch's key, up to the first new key
                rank = np.where(run_start == 0, rank + prev_count, rank)
            prev_key = tuple(b.column(c)[n - 1].as_py() for c in by)
            prev_count = int(rank[n - 1])
            yield b.append_column(_LRANK, pa.array(rank))
    return run


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos",
            num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``by`` group, or with
    ``weight`` (a non-negative integer column) the running sum up to and with the row.

    ``order`` must be a total order inside each group (ties would make the
    numbering depend on the shuffle).  The result is not sorted.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = (df.repartitionByRange(n, *keys, *order)
                .sortWithinPartitions(*keys, *order)
                .withColumn(_PID, F.spark_partition_id()))

    out_schema = T.StructType(ranged.schema.fields + [T.StructField(_LRANK, T.LongType(), False)])
    # Materialise the numbered rows once (in the shared spark.checkpoint.dir).  The per-partition counts and the final rows
    # must come from ONE range partitioning: two executions of the range
    # exchange each sample their own bounds, and on a cluster (randomised
    # shuffle-fetch order) the samples -- hence the partitions -- can
    # differ.  Reading both from the staged rows makes the result
    # independent of exchange reuse and cuts the lineage for lost executors.
    local = staged(ranged.mapInArrow(_local_rank(list(by), weight), out_schema), "ordinal")

    # rows per (partition, key), then rows of the same key in earlier partitions
    counts = local.groupBy(_PID, *by).agg(F.max(_LRANK).alias("_ord_cnt"))
    w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_ord_prior", F.sum("_ord_cnt").over(w))
                     .filter(F.col("_ord_prior") > 0)
                     .select(*[F.col(c).alias(f"_ord_k_{i}") for i, c in enumerate(by)],
                             F.col(_PID).alias("_ord_opid"), "_ord_prior"))
    cond = F.col(_PID) == F.col("_ord_opid")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_ord_k_{i}"))
    # <= one offset row per partition: bounded broadcast
    joined = local.join(F.broadcast(offsets), cond, "left")
    return (joined.withColumn(name, (F.coalesce(F.col("_ord_prior"), F.lit(0)) + F.col(_LRANK)).cast("long"))
                  .drop(_PID, _LRANK, "_ord_opid", "_ord_prior", *[f"_ord_k_{i}" for i in range(len(by))]))
