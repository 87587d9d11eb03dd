"""a trigram index for substring search over distinct texts.

``write_index`` stores every distinct lower-cased text under its hash, and for each of its
trigrams a posting (trigram, hash), in folders by a hash of the trigram.  ``find`` reads the folders of the
query's trigrams only, keeps the texts that hold all of them, and verifies each by
``contains``, so it returns exactly what a scan returns.  A frequent trigram's postings are many
files (Spark rebalances them while writing), and the intersection is a count per text, combined
before its shuffle.  Queries of fewer than three characters have no trigram and scan the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3
BUCKETS = 64


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM))))) \
            .otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(texts: DataFrame, path: str, column: str = "text", buckets: int = BUCKETS) -> None:
    """Index the distinct non-null values of ``column`` under ``path``."""
    t = texts.select(F.lower(F.col(column)).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("text_id", F.unhex(F.sha2("text", 256)))
    t.write.mode("overwrite").parquet(f"{path}/texts")
    stored = texts.sparkSession.read.parquet(f"{path}/texts")
    postings = stored.select("text_id", F.explode(trigrams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    postings.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, q: str, buckets: int = BUCKETS) -> DataFrame:
    """text_id of the texts that hold every trigram of ``q``; reads the buckets of these trigrams."""
    grams = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(_bucket(F.col("g"), buckets).alias("b")).distinct().collect()
    p = spark.read.schema("text_id binary, gram string, bucket int").parquet(f"{path}/postings")
    p = p.where(F.col("bucket").isin([r.b for r in wanted])).where(F.col("gram").isin(grams))
    return p.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("text_id")


def find(spark: SparkSession, path: str, q: str, buckets: int = BUCKETS) -> DataFrame:
    """The indexed texts (lower-cased) that contain ``q``, whatever its case."""
    q = q.lower()
    texts = spark.read.schema("text string, text_id binary").parquet(f"{path}/texts")
    if len(q) >= GRAM:
        texts = texts.join(candidates(spark, path, q, buckets), "text_id", "left_semi")
    return texts.where(F.contains("text", F.lit(q))).select("text")
