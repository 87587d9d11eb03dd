"""What the client step carries through its shuffles, and how its rows are staged."""

import datetime

from pyspark.sql import functions as F

from clientele.operators import analytics, clients
from clientele.operators.ordinal import ordinal
from clientele.plans import jobs
from clientele.session import staged
from clientele.sources import fixtures as fx

OLD = ("l_extendedprice", "l_discount", "l_tax", "l_shipdate")
AT = datetime.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_stands_for_the_last_order_fields(spark, tmp_path):
    line = [(1, 5, 9, 1, 2.0, p, d, t, a) for p, d, t, a in (
        (3.0, 0.1, 0.2, AT), (2.0, 0.1, 0.2, AT), (None, 0.1, 0.2, AT), (2.0, 0.0, 0.2, AT), (2.0, 0.1, 0.2, AT), (2.0, 0.1, 0.2, None))]
    line += [(1, 5, 9, None, 2.0, 1.0, 0.0, 0.0, AT), (1, 6, 9, 1, 2.0, 1.0, 0.0, 0.0, AT), (None, 5, 9, 1, 2.0, 1.0, 0.0, 0.0, AT), (2, 5, 9, 7, 2.0, 1.0, 0.0, 0.0, AT)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    df = spark.createDataFrame(line, kinds)
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = fx._ranked_lines(spark, str(tmp_path))
    assert not set(OLD) & set(out.columns)
    assert sorted(r.l_rank for r in out.where("l_orderkey = 1 and l_partkey = 5 and l_linenumber = 1").collect()) == [1, 2, 3, 4, 4, 6]
    assert out.count() == len(line) - 1 and {r.l_rank for r in out.where("l_partkey = 6 or l_linenumber is null or l_orderkey = 2").collect()} == {1}


def test_rows_after_the_orders_carry_no_price_or_date(spark, sf):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(clients.clean_clients(fx.client_rows(spark, sf), ("industry",)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    lines = text.splitlines()
    top = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in x)
    assert not any(c in x for c in OLD for x in lines[:top] if "Window" not in x and "Sort [" not in x and "Project [l_orderkey" not in x)


def test_staged_rows_are_compressed_columns(spark):
    df = spark.range(10).select("id", F.struct("id", F.lit("x").alias("t")).alias("s"))
    out = staged(df, "test")
    assert out.schema.names == df.schema.names and out.exceptAll(df).isEmpty() and out.count() == 10
    assert all(f.endswith(".zstd.parquet") for f in out.inputFiles())
    odd = df.select(F.lit(None).alias("none"), F.col("id").alias("a"), F.col("id").alias("A"))
    assert staged(odd, "test").count() == 10


def test_numbered_rows_read_staged_columns(spark):
    n = ordinal(spark.range(50).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id")], "n")
    assert "FileScan parquet" in plan(n) and {(r.k, r.n) for r in n.where("id < 6").collect()} == {(0, 1), (1, 1), (2, 1), (0, 2), (1, 2), (2, 2)}


def test_a_search_stages_the_rows_it_leaves(spark):
    row = ("a@x", "c", False, (0, 1), "Name", "i", "co", "blog", "note of it")
    c = spark.createDataFrame([row], "email string, company_key string, is_partner boolean, ord struct<a:int,b:int>, name string, industry string, country string, source string, ai_note string")
    kept, plain = [], analytics.staged
    analytics.staged = lambda df, name: kept.append(name) or plain(df, name)
    try:
        assert analytics.client_table(c, q="name").count() == 1 and kept == ["client-table"]
        assert analytics.client_table(c, q="none").count() == 0 and analytics.client_table(c).count() == 1 and len(kept) == 2
    finally:
        analytics.staged = plain


def test_the_repository_stages_its_pages_and_replies(spark):
    pages = spark.createDataFrame([("http://a.si/", "<html><body><p>Text</p></body></html>")], "url string, html string")
    cands = spark.createDataFrame([("a.si", "http://a.si/", "homepage", "", 0)], "company_key string, url string, type string, description string, seq long")
    kept, plain = [], jobs.staged
    jobs.staged = lambda df, name: kept.append(name) or plain(df, name)
    try:
        out = jobs.build_repository(spark.createDataFrame([("http://a.si/",)], "input_url string"), cands, pages, None, "now")
        assert kept == ["fetched", "replies"] and [r.document.sources_checked for r in out.collect()] == [["http://a.si/"]]
    finally:
        jobs.staged = plain
