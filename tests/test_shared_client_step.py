"""The client step that the repository queries share: what it moves, and how often it runs."""

import pytest
from pyspark.sql import functions as F

from clientele.operators import analytics, clients
from clientele.operators.dedupe import keep_first
from clientele.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def exchanges_above(text: str, what: str) -> int:
    """Shuffles between the scan that names ``what`` and the result."""
    lines = text[text.index("== Physical Plan =="):].splitlines()
    at = next(i for i, x in enumerate(lines) if "Scan parquet" in x and what in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    n, own = 0, depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < own:
            own = depth(x)
            n += "Exchange hashpartitioning" in x
    return n


def test_line_items_move_once_for_orders_and_customers(spark, sf):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_above(plan(fx.client_names(spark, sf)), "l_linenumber") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_keep_first_carries_the_order_once_and_decides_ties(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "n"), ("b", 5, "m"), ("c", None, "n"), (None, 3, "w")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    for order in (F.col("o"), F.col("o") + 1):
        out = keep_first(df.repartition(3), ["k"], order)
        assert "min_by" not in plan(out)
        assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, "y"), ("b", 5, "m"), ("c", None, None), (None, 3, "w")], key=str)
    both = keep_first(df, [F.upper("k")], F.struct("o", "v"))
    assert {(r.k, r.v) for r in both.collect()} == {("a", "y"), ("b", "n"), ("c", "n"), (None, "w")}


def test_keep_first_of_rows_that_cannot_be_ordered(spark):
    df = spark.createDataFrame([("a", 2, {"x": 1}), ("a", 1, {"y": 2})], "k string, o int, m map<string,int>")
    assert [r.m for r in keep_first(df, ["k"], F.col("o")).collect()] == [{"y": 2}]


def test_numbered_rows_carry_only_what_is_read(spark, sf):
    few, all_ = fx.client_rows(spark, sf, with_pos=True, fields=()), fx.client_rows(spark, sf, with_pos=True)
    assert not {"evidence", "industry"} & set(few.columns)
    same = few.select("company_id", "pos", "name", "source_type", "ord")
    assert same.exceptAll(all_.select(*same.columns)).isEmpty() and few.count() == all_.count()


def test_clean_clients_without_texts(spark, sf):
    rows = fx.client_rows(spark, sf)
    hit = analytics.client_hit("building").alias("hit")
    lean = clients.clean_clients(rows, ("industry", "country", hit), names=("source",))
    full = clients.clean_clients(rows)
    assert not {"name", "ai_note"} & set(lean.columns)
    want = full.select("email", "company_key", "name_key", "is_partner", "industry", "country", hit)
    assert lean.select(*want.columns).exceptAll(want).isEmpty() and lean.count() == full.count()


def test_sketches_and_exact_counts_read_stored_clients(spark, sf):
    from clientele.plans.catalog import QUERIES
    out = QUERIES["tenant_sketches"](spark, sf)
    assert "lineitem" not in plan(out) and "l_orderkey" not in plan(out)
    assert out.count() > 0


@pytest.mark.parametrize("q", ["", "building"])
def test_detail_from_clients_that_carry_hit(spark, sf, q):
    rows, companies = fx.client_rows(spark, sf), clients.companies(fx.company_rows(spark, sf))
    lean = clients.clean_clients(rows, ("industry", "country", analytics.client_hit(q).alias("hit")), names=("source",))
    a = analytics.company_detail(lean, companies, q)
    b = analytics.company_detail(clients.clean_clients(rows), companies, q)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_equal_mentions_keep_the_highest_position(spark, sf, monkeypatch):
    from clientele.plans import catalog
    real = fx.table
    twice = lambda s, d, name: real(s, d, name).unionByName(real(s, d, name)) if name == "lineitem" else real(s, d, name)
    monkeypatch.setattr(fx, "table", twice)
    ranked = catalog._recs(spark, sf, fields=()).select("email", "company_key", F.lower("name").alias("k"), "pos", "ord")
    first = ranked.groupBy("email", "company_key", "k").agg(F.min(F.struct("ord", (-F.col("pos")).alias("later"))).alias("f"))
    want = first.select("email", "company_key", "k", (-F.col("f.later")).alias("pos"))
    got = catalog._clean_pos(spark, sf).select("email", "company_key", F.lower("name").alias("k"), "pos")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
