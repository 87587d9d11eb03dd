"""Streaming final state equals batch; E1/E2 invariants."""

from pyspark.sql import functions as F

from clientele.plans import catalog as C
from clientele.plans import jobs as J
from clientele.sources import fixtures as fx
from clientele.sources import store as S
from clientele.streaming import jobs as ST


def test_stream_upsert_equals_batch(spark, sf):
    stream = {tuple(r) for r in ST.run_stream_upsert(spark, sf).select("email", "company_key", "data", "seq").collect()}
    batch = {tuple(r) for r in S.apply_log(fx.upsert_log(spark, sf), ["email", "company_key"],
                                             ["updated_at", "seq"]).select("email", "company_key", "data", "seq").collect()}
    assert stream == batch and stream


def test_stream_reads_files_and_folders(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    events.repartition(3).write.parquet(folder)
    for path in (f"{sf}/events.parquet", folder):
        out = str(tmp_path / f"out{len(path)}")
        q = (ST.events_stream(spark, path).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        assert spark.read.parquet(out).count() == events.count()


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def test_stream_dedupe_with_late_rows_and_eviction(spark, tmp_path):
    from datetime import datetime
    day = lambda d, h=0: datetime(2024, 1, d, h)
    arrivals = [[(1, day(1), 7, "a"), (2, day(1, 1), 7, "a"), (3, day(2), 8, "a")],
                [(4, day(3), 7, "a"), (5, day(9), 9, "a")],                           # 4: repeat within the watermark
                [(6, day(4), 7, "b"), (7, day(12), 9, "b")],                          # 6: behind the watermark of day 9 - 4
                [(8, day(14), 7, "a"), (9, day(14), 9, "b"), (10, day(20), 1, "c")]]  # 8: the first one's state is gone; 9: not yet

    def arrived():
        for rows in arrivals:
            spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
            yield str(tmp_path / "in")
    schema = spark.createDataFrame([], EVENTS).schema
    figures = ST.dedupe_arrivals(arrived(), schema, ["user_id", "event_type"], "ts", "event_id", "4 days", str(tmp_path))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "unique")).collect()) == [1, 3, 5, 7, 8, 10]
    assert [r.event_id for r in spark.read.schema(schema).parquet(str(tmp_path / "late/*")).collect()] == [6]
    assert sum(f["evicted"] for f in figures) >= 2 and all(f["late"] == 0 for f in figures) and max(f["held"] for f in figures) < 6


def test_replies_that_come_late_or_never(spark, tmp_path):
    from datetime import datetime
    at = lambda m: datetime(2024, 1, 1, 0, m)
    requests, replies = str(tmp_path / "requests"), str(tmp_path / "replies")
    req, rep = "request_id long, asked_at timestamp", "reply_id long, http_status int, body string, answered_at timestamp"
    turns = [([(1, at(0)), (2, at(1)), (3, at(2))], [(1, 200, "x", at(3))]), ([], [(2, 200, "late", at(12))]), ([(9, at(59))], [(8, 200, "end", at(59))])]
    seen = []
    for asked, said in turns:
        spark.createDataFrame(asked, req).write.mode("append").parquet(requests)
        spark.createDataFrame(said, rep).write.mode("append").parquet(replies)
        ST.stream_replies(spark.readStream.schema(req).parquet(requests), spark.readStream.schema(rep).parquet(replies), "10 minutes", str(tmp_path / "out"), str(tmp_path / "ck"))
        seen.append({r.request_id: (r.has_reply, r.http_status) for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert seen[0] == {1: (True, 200)} and seen[-1] == {1: (True, 200), 2: (False, 0), 3: (False, 0)}


def test_build_repository_invariants(spark, sf):
    docs = C._e1(spark, sf).select("company_key", "part", "document.*").collect()
    assert docs
    assert len({(d.company_key, d.part) for d in docs}) == len(docs)
    for d in docs:
        names = [c.name.lower() for c in d.clients]
        assert len(names) == len(set(names))                    # A2
        assert all(n.strip() for n in names)                    # F2
        kinds = [c.source == "technology_partner" for c in d.clients]
        assert kinds == sorted(kinds)                           # clients before partners
        if not d.sources_checked:
            assert d.error is None                              # Q6


def test_analysis_context_is_whole_and_in_parts(spark, sf):
    inputs, _, cands = C._e1_inputs(spark, sf)
    comps = J.company_inputs(inputs)
    fetched = J.fetched_pages(comps, cands, spark.read.parquet(f"{sf}/pages.parquet"))
    ok, blocks = J.page_parts(fetched)
    reqs = J.analysis_requests(comps, fetched)
    from clientele.operators import context
    ctx = context.context_text(ok, blocks)
    assert ctx.agg(F.max("context_chars")).first()[0] <= 35000
    assert reqs.count() == ctx.count()
    text = {}
    for r in ctx.orderBy("company_key", "part").collect():
        text[r.company_key] = text.get(r.company_key, "") + r.context
    pages = {}
    for r in ok.orderBy("company_key", "seq").collect():
        pages.setdefault(r.company_key, []).append(r)
    for key, rows in pages.items():     # nothing is lost, cut or reordered
        want = "".join(f"\n\n{'=' * 60}\nPAGE {n} | {r.url} | type: {r.type}\n{'=' * 60}\n{r.text}" for n, r in enumerate(rows, 1))
        assert text[key] == want


def test_context_parts_of_a_hot_company(spark):
    from clientele.operators import context
    rows = [("big", i, f"https://b/{i}", None if i % 5 == 0 else "blog", "x" * (i * 37 % 900)) for i in range(400)] + [("s", 1, None, "t", None)]
    df = spark.createDataFrame(rows, "company_key string, seq long, url string, type string, text string")
    ctx = context.context_text(df, context.context_blocks(df, budget=1000)).orderBy("company_key", "part").collect()
    big = [r.context for r in ctx if r.company_key == "big"]
    assert all(len(x) == 1000 for x in big[:-1]) and len(ctx) == len(big) + 1
    assert "".join(big) == "".join(f"\n\n{'=' * 60}\nPAGE {i + 1} | https://b/{i} | type: {t or 'unknown'}\n{'=' * 60}\n{x}" for _, i, _, t, x in rows[:-1])


def test_two_urls_of_one_company(spark):
    inputs = spark.createDataFrame([("http://www.x.si",), ("https://x.si",)], "input_url string")
    cands = spark.createDataFrame([("x.si", "https://x.si/a", None, None, 1)], "company_key string, url string, type string, description string, seq long")
    pages = spark.createDataFrame([("https://x.si/a", "<ul><li>Acme Corp</li></ul>")], "url string, html string")
    docs = J.build_repository(inputs, cands, pages, None, "2024-01-01").collect()
    assert len(docs) == 1 and [c.name for c in docs[0].document.clients] == ["Acme Corp"]


def test_discovery_reaches_the_documents(spark):
    replies = spark.createDataFrame([
        ("x.si", 0, '```json\n{"company_name":"X Group","company_description":"Tools","pages":[{"url":"https://x.si/a"}]}\n```'),
        ("y.si", 0, "no json at all")], "company_key string, chunk long, reply string")
    said, cands = J.discovery_results(replies)
    inputs = spark.createDataFrame([("x.si",), ("y.si",)], "input_url string")
    pages = spark.createDataFrame([("https://x.si/a", "<p>a</p>"), ("https://y.si", "<ul><li>Acme Corp</li></ul>")], "url string, html string")
    docs = {d.company_key: d.document for d in J.build_repository(inputs, cands, pages, None, "2024-01-01", said=said).collect()}
    assert (docs["x.si"].company_name, docs["x.si"].company_description) == ("X Group", "Tools")
    assert (docs["y.si"].company_name, docs["y.si"].company_description) == ("Y", "")
    assert docs["y.si"].sources_checked == ["https://y.si"] and [c.name for c in docs["y.si"].clients] == ["Acme Corp"]


def test_error_policy(spark):
    repo = spark.createDataFrame([("u", "k", '{"ok":1}', None, None)],
                                 "email string, company_key string, data string, updated_at timestamp_ntz, seq long")
    repo = repo.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    res = spark.createDataFrame([("u", "k")], "email string, company_key string").withColumn(
        "document", F.struct(F.lit("k").alias("key"), F.lit("boom").alias("error")))
    over = J.apply_results(repo, res, "2024-02-01 00:00:00").first()
    keep = J.apply_results(repo, res, "2024-02-01 00:00:00", on_error="keep").first()
    assert '"error":"boom"' in over.data                      # Q7 compat: overwritten
    assert keep.data == '{"ok":1}'


def test_null_names_dropped_and_counted(spark):  # Q8
    import json
    reply = {"clients": [{"name": "Acme"}, {"name": None}, {"name": 7}, {"industry": "x"}, {"name": " acme "}],
             "technology_partners": [{"name": "SAP", "role": "ERP"}, {"name": "acme"}]}
    env = json.dumps({"content": [{"type": "text", "text": json.dumps(reply)}]})
    df = spark.createDataFrame([(1, 200, env)], "request_id long, http_status int, reply_body string")
    clean, errors = J.decode_results(df)
    names = sorted((r.name, r.source) for r in clean.collect())
    assert names == [("Acme", "reference_list"), ("SAP", "technology_partner")]   # dedupe keeps the client
    e = errors.first()
    assert e.error is None and e.n_bad_names == 2
    clean_s, errors_s = J.decode_results(df, strict_null=True)
    assert clean_s.count() == 0 and errors_s.first().error == "client name is not a string"


def test_reply_state_has_partitions_by_its_size(spark, tmp_path, monkeypatch):
    import os
    monkeypatch.setattr(ST, "scratch", lambda spark, name: str(tmp_path))
    requests = spark.range(40).select(F.col("id").alias("request_id"))
    replies = spark.range(40).select(F.col("id").alias("reply_id"), F.lit(200).alias("http_status"), F.lit("x").alias("body"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r.request_id: r.has_reply for r in ST.run_stream_replies(spark, requests, replies).collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
        cores = spark.sparkContext.defaultParallelism
        assert len([x for x in os.listdir(tmp_path / "_checkpoint/state/0") if x.isdigit()]) == cores < 60
        assert ST.state_partitions(spark, 1000 * ST.STATE_BYTES) == 1000    # a larger state has more
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert ST.state_partitions(spark, 1) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: k % 13 <= 10 for k in range(40)}
