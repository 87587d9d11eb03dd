"""Repository store: keyed upsert / delete over an append-only log.

The reference keeps one row per ``(email, company_key)`` in a SQL table and
replaces it on every scrape.  Here writes append to a log of plain Parquet files
partitioned by a hash bucket of the tenant, and a read resolves the last write per
key with one aggregation.  A tenant scan or point lookup reads one bucket
(partition pruning) and pushes the equality filters into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .. import schemas
from ..operators.dedupe import keep_first

DEFAULT_BUCKETS = 64


def bucket_of(col: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------------------
# Keyed-state operators (pure DataFrame -> DataFrame)
# ---------------------------------------------------------------------------

def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key by ``order`` (e.g. ``updated_at, seq``).

    ``max_by`` is a declarative aggregate: combined map-side, so a hot key
    ships one row per map task."""
    rest = [c for c in log.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    g = log.groupBy(*keys).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_l"))
    # keys from the grouping (not the packed row): filters on them push below
    return g.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_l.`{c}`").alias(c) for c in log.columns])


def apply_log(log: DataFrame, keys: Sequence[str], order: Sequence[str], target: DataFrame | None = None,
              op_col: str = "op", delete_op: str = "delete") -> DataFrame:
    """S5 + S7: the state after applying a log of upserts and deletes.

    Last write wins per key across the existing ``target`` and the log; a
    key whose last operation is a delete is absent.  Target rows take part
    with their own order values, so a late, older write loses."""
    entries = log
    if target is not None:
        t = target
        for c in log.columns:
            if c not in t.columns:
                t = t.withColumn(c, F.lit("upsert") if c == op_col else F.lit(None).cast(log.schema[c].dataType))
        entries = t.select(*log.columns).unionByName(log)
    last = latest_per_key(entries, keys, order)
    return last.filter(F.col(op_col) != delete_op).drop(op_col)


def upsert_latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """S5 without deletes: latest upsert per key."""
    return latest_per_key(log, keys, order)


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: Sequence[str],
                     order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Unique-key insert.  Among new rows the first per key is the
    candidate; it is accepted when the key is not stored yet.  Returns
    ``(accepted, rejected)``."""
    first = keep_first(rows, list(keys), F.struct(*[F.col(c) for c in order]))
    accepted = first.join(existing.select(*keys), list(keys), "left_anti")
    won = accepted.select(*[F.col(c).alias(f"_won_{c}") for c in [*keys, *order]])
    same = [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*keys, *order]]
    rejected = rows.join(won, same, "left_anti")
    return accepted, rejected


def tenant_scan(repo: DataFrame, email: str, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """One tenant's rows; with a ``bucket`` column the bucket
    predicate prunes partitions before the equality filter."""
    f = F.col("email") == F.lit(email)
    if buckets and "bucket" in repo.columns:
        f = (F.col("bucket") == bucket_of(F.lit(email), buckets)) & f
    return repo.filter(f)


def point_lookup(table: DataFrame, lookups: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Batch of key lookups; NULL value when the key is absent."""
    return lookups.join(table.select(*keys, value), list(keys), "left")


def contract_violations(df: DataFrame, not_null: Sequence[str], pk: Sequence[str]) -> DataFrame:
    """One row per check -- NULLs in required columns, duplicate keys."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null]
    nulls = df.agg(*checks) if checks else None
    dups = (df.groupBy(*pk).count().filter(F.col("count") > 1)
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_key")))
    parts = []
    if nulls is not None:
        for c in not_null:
            parts.append(nulls.select(F.lit(f"null_{c}").alias("check"), F.col(f"null_{c}").cast("long").alias("n")))
    parts.append(dups.select(F.lit("duplicate_key").alias("check"), F.col("duplicate_key").cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# The stored form: an append-only log as plain bucketed Parquet
# ---------------------------------------------------------------------------

def append_log(batch: DataFrame, path: str, batch_id: int, buckets: int = DEFAULT_BUCKETS) -> None:
    """Append one batch of upserts and deletes under ``path``, partitioned by batch
    and tenant bucket.  Rows are gathered by bucket first, so a batch writes one
    file per bucket (Spark may split a hot one); a replayed batch replaces its own
    folder.  Nothing is resolved at write time: deletes stay in the log with their
    order values, so a late, older upsert can never bring a key back."""
    (batch.withColumn("bucket", bucket_of(F.col("email"), buckets))
          .hint("rebalance", "bucket")
          .write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}"))


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number of the newest whole base (-1: none) and the numbers of the batches after it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    whole = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}/_SUCCESS"))
    base = max((int(n[5:]) for n in names if n.startswith("base=") and whole(n)), default=-1)
    return base, sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > base)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log: its newest base and the batches after it; a filter on ``bucket`` prunes folders."""
    base, batches = _folders(spark, path)
    root = path.rstrip("/")
    kind = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    out = spark.read.schema(kind).parquet(f"{root}/base={base}") if base >= 0 else spark.createDataFrame([], kind)
    if batches:
        numbered = T.StructType([*kind.fields, T.StructField("batch", T.LongType())])
        log = spark.read.schema(numbered).option("basePath", root).parquet(*(f"{root}/batch={n}" for n in batches)).drop("batch")
        out = out.unionByName(log) if base >= 0 else log
    return out


def fold_log(spark: SparkSession, path: str, schema, keys: Sequence[str], order: Sequence[str], buckets: int = DEFAULT_BUCKETS) -> int:
    """Fold the base and all batches into a new base: the last write of every key, deletes kept as
    rows with their order values, so a late, older upsert still cannot bring a key back.  Returns
    the base's number.  A base counts once it is written whole; what it replaces stays on
    disk, unread, for readers that began before, until ``drop_folded``."""
    base, batches = _folders(spark, path)
    if not batches:
        return base
    last = latest_per_key(read_log(spark, path, schema).drop("bucket"), keys, order)
    (last.withColumn("bucket", bucket_of(F.col("email"), buckets)).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/base={batches[-1]}"))
    return batches[-1]


def drop_folded(spark: SparkSession, path: str) -> None:
    """Delete the batches and bases that the newest base replaces."""
    base, _ = _folders(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(hadoop):
        kind, _, n = status.getPath().getName().partition("=")
        if (kind == "batch" and int(n) <= base) or (kind == "base" and int(n) < base):
            fs.delete(status.getPath(), True)


# ---------------------------------------------------------------------------
# Contracts enforced in the writing pass
# ---------------------------------------------------------------------------

def conform(df: DataFrame, contract: str, now: str | None = None) -> DataFrame:
    """``df`` with the columns of a stored table (``schemas.CONTRACTS``) in its types, its defaults
    for missing columns and nulls (``now``: the time that the default ``now`` stands for, else the
    current one), and ``reason``: the first required column that is null or cannot be read as its
    type, null for a row that fits.  Columns the table does not have are dropped."""
    schema, _, defaults = schemas.CONTRACTS[contract]
    cols, reasons = [], []
    for f in schema.fields:
        given = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        value = given.try_cast(f.dataType)
        if f.name in defaults:
            d = defaults[f.name]
            default = (F.lit(now) if now else F.current_timestamp()) if d == "now" else F.lit(d)
            value = F.when(given.isNull(), default.cast(f.dataType)).otherwise(value)
        cols.append(value.alias(f.name))
        if f.name in df.columns or f.name in defaults or not f.nullable:
            unread = given.isNotNull() & value.isNull()
            reasons.append(F.when(unread, F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
        if not f.nullable:
            reasons.append(F.when(value.isNull(), F.lit(f"{f.name} is missing")))
    return df.select(*cols, F.coalesce(*reasons, F.lit(None).cast("string")).alias("reason"))


def write_checked(df: DataFrame, contract: str, path: str, now: str | None = None) -> dict:
    """One pass that conforms, counts and writes: rows that fit below ``path/rejected=false``, the
    others with their reason below ``path/rejected=true``.  Returns the counts that the pass
    observed (``rows``, ``rejected``, and ``defaulted_<column>``)."""
    _, _, defaults = schemas.CONTRACTS[contract]
    given, seen = Observation(), Observation()
    gaps = [F.count_if(F.col(f"`{c}`").isNull() if c in df.columns else F.lit(True)).alias(f"defaulted_{c}") for c in defaults]
    counted = df.observe(given, F.count(F.lit(1)).alias("rows"), *gaps)
    checked = conform(counted, contract, now).withColumn("rejected", F.col("reason").isNotNull())
    checked = checked.observe(seen, F.count_if("rejected").alias("rejected"))
    checked.write.mode("overwrite").partitionBy("rejected").parquet(path)
    return {**given.get, **seen.get}


def read_checked(spark: SparkSession, contract: str, path: str) -> DataFrame:
    """The rows of a checked table and its rejects (``rejected``, ``reason``)."""
    schema, _, _ = schemas.CONTRACTS[contract]
    fields = [T.StructField(f.name, f.dataType) for f in schema.fields]
    return spark.read.schema(T.StructType([*fields, T.StructField("reason", T.StringType()), T.StructField("rejected", T.BooleanType())])).parquet(path)


# ---------------------------------------------------------------------------
# Documents parsed once, stored as VARIANT
# ---------------------------------------------------------------------------

def write_documents(rows: DataFrame, path: str, data: str = "data") -> None:
    """Stores JSON documents parsed, as VARIANT; text that is no JSON object goes
    unchanged to the quarantine (``path/quarantined=true``) in the same pass."""
    doc = F.try_parse_json(F.col(data))
    bad = ~F.coalesce(F.startswith(F.ltrim(F.col(data)), F.lit("{")), F.lit(False)) | doc.isNull()
    rest = [c for c in rows.columns if c != data]
    out = rows.select(*rest, F.when(~bad, doc).alias("document"), F.when(bad, F.col(data)).alias("raw"), bad.alias("quarantined"))
    out.write.mode("overwrite").partitionBy("quarantined").parquet(path)


def read_documents(spark: SparkSession, path: str, quarantined: bool = False) -> DataFrame:
    """The stored documents (column ``document``), or the quarantine (column ``raw``)."""
    return spark.read.parquet(path).where(F.col("quarantined") == quarantined).drop("quarantined", "document" if quarantined else "raw")


def field_state(document: Column, name: str) -> Column:
    """``set``, ``null`` or ``missing``: VARIANT keeps an explicit null apart from a missing key."""
    value = F.variant_get(document, f"$.{name}", "variant")
    return F.when(value.isNull(), F.lit("missing")).when(F.is_variant_null(value), F.lit("null")).otherwise(F.lit("set"))


def typed(document: Column, schema: T.StructType = schemas.COMPANY_DOCUMENT) -> Column:
    """A document as a struct; fields it lacks, or holds in another type, are null."""
    return F.struct(*(F.try_variant_get(document, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields))
