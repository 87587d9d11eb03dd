"""What the client step leaves on disk: shuffles that go with their query, parts staged one by one, documents from positions."""

import json
import os
import time

from pyspark.sql import functions as F

from clientele import session
from clientele.operators import analytics
from clientele.plans import catalog
from clientele.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffles_of_staged_rows_are_freed(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(spark), spark.conf.get(key)
    out = session.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6 and spark.conf.get(key) == was


def test_parts_are_staged_for_the_time_of_the_block(spark):
    rows = spark.range(100).repartition(3)
    parts = [session.sliced(rows, "id", (k, 4)) for k in range(4)]
    with session.staged_while(iter(parts), "test") as df:
        files = [f.removeprefix("file:").replace("///", "/") for f in df.inputFiles()]
        assert {r.id for r in df.collect()} == set(range(100)) and df.count() == 100 and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "id int")
    assert sum(session.sliced(nulls, "id", (k, 3)).count() for k in range(3)) == 3


def test_staged_files_hold_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 10)
    out = session.staged(spark.range(95).coalesce(1), "test")
    assert len(out.inputFiles()) == 10 and sorted(r.id for r in out.collect()) == list(range(95))


def test_slices_follow_the_files(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    size = os.path.getsize(f"{sf}/lineitem.parquet")
    assert [session.slices(lines, n) for n in (size, size - 1, size // 4)] == [1, 2, 5 if size % 4 else 4]
    assert session.slices(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int"), 10) == 1


def test_numbering_in_parts_gives_the_same_rows(spark, sf, monkeypatch):
    whole = fx.client_rows(spark, sf, with_pos=True)
    documents = catalog.QUERIES["company_documents"](spark, sf)
    monkeypatch.setattr(fx, "JOIN_BYTES", 50_000)
    monkeypatch.setattr(fx, "NUMBER_BYTES", 70_000)
    numbered, plain = [], fx.ordinal
    monkeypatch.setattr(fx, "ordinal", lambda *a: numbered.append(a[0]) or plain(*a))
    parts = fx.client_rows(spark, sf, with_pos=True)
    assert len(numbered) == 2 and whole.exceptAll(parts).isEmpty() and parts.count() == whole.count()
    again = catalog.QUERIES["company_documents"](spark, sf)
    assert documents.exceptAll(again).isEmpty() and again.count() == documents.count() > 0


def test_clients_travel_once_to_their_documents(spark, sf):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.QUERIES["company_documents"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert "hashpartitioning(company_id" in moved[0] and "name_key" not in text
    assert all("l_suppkey" in x.partition("hashpartitioning")[2] for x in moved[1:])  # counts of the numbering


def test_documents_of_kept_positions(spark):
    record = "company_id long, email string, netloc string, pos long, name string, industry string, country string, source string, ai_note string, confidence long"
    rows = [(1, "a@x", "www.one.si", p, f'N"{p}', "i", "", "blog", "a\\b é\n", None if p == 2 else 50 + p) for p in (3, 1, 2, 5, 4)]
    rows += [(None, None, None, 1, "Null", "i", "c", "logo", "", 80), (None, None, None, 2, "Gone", "i", "c", "logo", "", 80), (2, "b@x", "www.two.si", 7, "Gone", "", "", "", "", 1)]
    clients = spark.createDataFrame(rows, record).repartition(3)
    kept = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 4), (None, 1)], "company_id long, pos long")
    out = analytics.company_documents(clients, kept, chunk_size=2).collect()
    assert {(r.email, r.company_key, r.chunk, r.n_clients) for r in out} == {("a@x", "one.si", 0, 2), ("a@x", "one.si", 1, 1), ("a@x", "one.si", 2, 1), (None, None, 0, 1)}

    def said(*p):
        return [{"name": f'N"{x}', "industry": "i", "country": "", "source": "blog", "ai_note": "a\\b é\n"} | ({} if x == 2 else {"confidence": 50 + x}) for x in p]
    docs = {(r.company_key, r.chunk): r.document for r in out}
    for k, chunk in enumerate(((1, 2), (4,), (5,))):
        want = {"key": "one.si", "chunk": k, "clients": said(*chunk)}
        assert docs["one.si", k] == json.dumps(want, separators=(",", ":"), ensure_ascii=False)
    assert docs[None, 0] == '{"chunk":0,"clients":[{"name":"Null","industry":"i","country":"c","source":"logo","ai_note":"","confidence":80}]}'
