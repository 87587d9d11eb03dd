"""Structured Streaming forms of the write path (ST1), dedupe (ST2) and the reply join.

They read a file source incrementally, keep their progress in a
checkpoint folder under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster) and run with ``availableNow`` here; with a
processing-time trigger they run continuously.  A lost executor only
re-runs its tasks; a restarted query resumes from the checkpoint and a
replayed micro-batch is skipped by its batch id.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.dedupe import keep_first
from ..session import scratch
from ..sources import fixtures
from ..sources.store import append_log, apply_log, fold_log, read_log


def events_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """An ``events`` table as a file stream, whether it is one file or a folder
    (schema taken from the batch table)."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if folder:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent().toString()))


def stream_upsert(log_stream: DataFrame, path: str, checkpoint: str) -> None:
    """ST1: every micro-batch is appended to the log (O(batch) work); reads
    resolve last write wins (``updated_at``, then ``seq``) and deletes.  A
    replayed batch id replaces its own folder, so the sink is idempotent."""
    q = (log_stream.writeStream.foreachBatch(lambda batch, batch_id: append_log(batch, path, batch_id))
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def admit(stream: DataFrame, keys: list[str], ts_col: str, tie: str, delay: str, folder: str, checkpoint: str) -> None:
    """ST2, first step: splits every micro-batch into ``folder/admitted`` and ``folder/late``.

    A row is late if its time is not after the latest time of all earlier micro-batches minus
    ``delay``; late rows are kept, not dropped.  Of the rows of one key in a batch the first by
    (``ts_col``, ``tie``) is admitted.  Each batch writes folders of its own number, its latest time
    too, so a replayed batch writes the same again."""
    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = [r.top for r in spark.read.schema("top timestamp, batch long").option("basePath", f"{folder}/tops").parquet(f"{folder}/tops")
                .where(F.col("batch") < batch_id).groupBy().agg(F.max("top").alias("top")).collect()] if batch_id else [None]
        at = F.col(ts_col).cast("timestamp")
        limit = F.lit(seen[0]).cast("timestamp") - F.expr(f"interval {delay}") if seen[0] is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(at <= limit, F.lit(False))
        batch.groupBy().agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{folder}/tops/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        first = keep_first(batch.where(~late), keys, F.struct(ts_col, tie))
        first.write.mode("overwrite").parquet(f"{folder}/admitted/batch={batch_id}")
    q = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_dedupe(stream: DataFrame, keys: list[str], ts_col: str,
                  watermark: str, out_dir: str, checkpoint: str) -> list[dict]:
    """ST2: drop repeats of ``keys`` seen within the watermark.  The
    watermark bounds the state; it rejects ``timestamp_ntz``, so the
    event time is cast to ``timestamp`` (session zone UTC).  Returns the state's figures per
    micro-batch (keys held, evicted, rows too late for it)."""
    s = (stream.withColumn("_event_time", F.col(ts_col).cast("timestamp"))
               .withWatermark("_event_time", watermark)
               .dropDuplicatesWithinWatermark(keys)
               .drop("_event_time"))
    q = (s.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
          .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return _state_figures(q)


def _state_figures(q) -> list[dict]:
    return [{"held": o.numRowsTotal, "evicted": o.numRowsRemoved, "late": o.numRowsDroppedByWatermark}
            for p in q.recentProgress for o in p.stateOperators]


def dedupe_arrivals(arrived: Iterable[str], schema: T.StructType, keys: list[str], ts_col: str, tie: str, delay: str, folder: str) -> list[dict]:
    """ST2 over arrivals (an iterable that writes the next files and gives their folder): each is admitted,
    then deduplicated, by two queries that resume from their checkpoints, as a restarted job would.
    Unique rows are in ``folder/unique``, late ones in ``folder/late``."""
    spark = SparkSession.active()
    figures = []
    for path in arrived:
        admit(spark.readStream.schema(schema).parquet(path), keys, ts_col, tie, delay, folder, f"{folder}/_admit")
        admitted = spark.readStream.schema(schema).parquet(f"{folder}/admitted/*")
        figures += stream_dedupe(admitted, keys, ts_col, delay, f"{folder}/unique", f"{folder}/_unique")
    return figures


STATE_BYTES = 64 << 20  # of both sides, for each partition of the state


@contextmanager
def shuffled_into(spark: SparkSession, n: int | None):
    """Streams started inside deal their state into ``n`` partitions (default: as the session says)."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if n:
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def state_partitions(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for a state of ``n_bytes`` at most: each micro-batch opens and commits the stores of
    every one, so there are only as many as the bytes need, or the cores can use."""
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-n_bytes // STATE_BYTES))


def stream_replies(requests: DataFrame, replies: DataFrame, patience: str, out_dir: str, checkpoint: str, partitions: int | None = None) -> None:
    """J6 as a stream: requests (``request_id, asked_at``) joined with the replies (``reply_id,
    http_status, body, answered_at``) that come within ``patience``.  A request whose reply never comes, or
    comes later, becomes a row without one as soon as the watermarks pass its time;
    until then Spark holds both sides as state, in ``partitions`` (fixed by the first run of a checkpoint)."""
    asked = requests.withWatermark("asked_at", "0 seconds")
    said = replies.withWatermark("answered_at", "0 seconds")
    in_time = F.expr(f"request_id = reply_id AND answered_at >= asked_at AND answered_at <= asked_at + interval {patience}")
    out = asked.join(said, in_time, "leftOuter").select(
        "request_id", "asked_at", F.coalesce("http_status", F.lit(0)).alias("http_status"), F.coalesce("body", F.lit("no reply")).alias("reply_body"),
        F.col("reply_id").isNotNull().alias("has_reply"))
    with shuffled_into(out.sparkSession, partitions):
        q = (out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


ARRIVALS = 4  # micro-batches of the registered query


def arrivals(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The events as they arrive: dealt into files by a hash of the event id, so
    every micro-batch holds events of the whole period and late ones are common."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    part = F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)).cast("int")
    for i in range(ARRIVALS):  # one write after another: arrival order is file order
        events.where(part == i).write.mode("append").parquet(folder)
    return folder


def run_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "repo")
    stream = fixtures.as_upsert_log(events_stream(spark, arrivals(spark, sf_dir, f"{base}/arrivals"), max_files=1))
    stream_upsert(stream, f"{base}/log", f"{base}/_checkpoint")
    keys, order = ["email", "company_key"], ["updated_at", "seq"]
    fold_log(spark, f"{base}/log", stream.schema, keys, order)
    return apply_log(read_log(spark, f"{base}/log", stream.schema).drop("bucket"), keys, order)


DELAY = "4 days"


def timed_arrivals(spark: SparkSession, sf_dir: str, folder: str):
    """The events in four arrivals by time, but every 50th one arrives as late as any; one file each."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    span = F.unix_micros(F.lit(hi).cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp")) + 1
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) * ARRIVALS
    part = F.when(F.col("event_id") % 50 == 0, F.lit(ARRIVALS - 1)).otherwise(F.floor(at / span)).cast("int")
    for i in range(ARRIVALS):
        events.where(part == i).write.mode("append").parquet(folder)
        yield folder


def run_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, ts, late): the unique rows, and the late ones."""
    base = scratch(spark, "dedupe")
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    dedupe_arrivals(timed_arrivals(spark, sf_dir, f"{base}/arrivals"), schema, ["user_id", "event_type"], "ts", "event_id", DELAY, base)
    unique = spark.read.schema(schema).parquet(f"{base}/unique")
    late = spark.read.schema(schema).parquet(f"{base}/late/*")
    return unique.withColumn("is_late", F.lit(False)).unionByName(late.withColumn("is_late", F.lit(True)))


PATIENCE = "10 minutes"
ROW_BYTES = 200  # of a row in the state, besides its body
_DAY0 = "2024-01-01 00:00:00"


def reply_times(request_id: Column, reply_id: Column) -> tuple[Column, Column]:
    """When a stand-in request was asked and its reply came: a request a minute, replies after
    up to twelve minutes, so that some come too late."""
    asked = F.lit(_DAY0).cast("timestamp") + F.make_dt_interval(mins=request_id.cast("int"))
    said = F.lit(_DAY0).cast("timestamp") + F.make_dt_interval(mins=(reply_id + reply_id % 13).cast("int"))
    return asked, said


def run_stream_replies(spark: SparkSession, requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests and replies in four arrivals by their times, then one of a later time that
    closes the stream (its row is left out)."""
    base = scratch(spark, "replies")
    asked, said = reply_times(F.col("request_id"), F.col("reply_id"))
    req = requests.select("request_id", asked.alias("asked_at"))
    rep = replies.select("reply_id", "http_status", "body", said.alias("answered_at"))
    last, n_asked = req.agg(F.max("asked_at"), F.count(F.lit(1))).first()
    top = F.lit(last).cast("timestamp")
    said_bytes = rep.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    partitions = state_partitions(spark, n_asked * ROW_BYTES + said_bytes)
    start = F.unix_micros(F.lit(_DAY0).cast("timestamp"))

    def part(at: Column) -> Column:
        return F.least(F.floor((F.unix_micros(at) - start) * ARRIVALS / (F.unix_micros(top) - start + 1)), F.lit(ARRIVALS - 1)).cast("int")
    later = F.make_dt_interval(days=F.lit(1))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), (top + later).alias("at"))
    for i in range(ARRIVALS + 1):
        if i < ARRIVALS:
            req.where(part(F.col("asked_at")) == i).write.mode("append").parquet(f"{base}/requests")
            rep.where(part(F.col("answered_at")) == i).write.mode("append").parquet(f"{base}/replies")
        else:
            end.select(F.col("id").alias("request_id"), F.col("at").alias("asked_at")).write.mode("append").parquet(f"{base}/requests")
            end.select((F.col("id") - 1).alias("reply_id"), F.lit(0).alias("http_status"), F.lit("").alias("body"), F.col("at").alias("answered_at")) \
                .write.mode("append").parquet(f"{base}/replies")
        stream_replies(spark.readStream.schema(req.schema).parquet(f"{base}/requests"), spark.readStream.schema(rep.schema).parquet(f"{base}/replies"),
                       PATIENCE, f"{base}/out", f"{base}/_checkpoint", partitions)
    out = "request_id long, asked_at timestamp, http_status int, reply_body string, has_reply boolean"
    return spark.read.schema(out).parquet(f"{base}/out").where("request_id >= 0")
