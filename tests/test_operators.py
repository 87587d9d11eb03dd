"""Ordinal, keep-first dedupe and keyed state against plain-Python models,
with a hot key holding a third of the rows; invariance under reshuffling."""

import random

from pyspark.sql import Window, functions as F

from clientele.operators.dedupe import keep_first
from clientele.operators.ordinal import ordinal
from clientele.sources import store as S


def skewed_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"k{rnd.randrange(40)}")
        rows.append((k, rnd.randrange(10_000), i))
    return rows


def test_ordinal_matches_row_number_with_hot_key(spark):
    df = spark.createDataFrame(skewed_rows(), "k string, o int, id int")
    got = ordinal(df, ["k"], [F.col("o"), F.col("id")], "pos", num_partitions=7)
    w = Window.partitionBy("k").orderBy("o", "id")
    chk = got.withColumn("rn", F.row_number().over(w))
    assert chk.filter(F.col("pos") != F.col("rn")).count() == 0
    assert got.count() == 3000
    # the hot key really was spread over several partitions
    spread = (df.repartitionByRange(7, "k", "o", "id").withColumn("p", F.spark_partition_id())
                .filter(F.col("k") == "hot").select("p").distinct().count())
    assert spread > 1


def test_ordinal_descending_and_multi_key(spark):
    rows = [(i % 2, i % 5, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = ordinal(df, ["a", "b"], [F.col("c").desc()], "pos", num_partitions=5)
    w = Window.partitionBy("a", "b").orderBy(F.col("c").desc())
    assert got.withColumn("rn", F.row_number().over(w)).filter("pos != rn").count() == 0


def test_keep_first_matches_model_and_is_order_invariant(spark):
    rows = skewed_rows(1200)
    df = spark.createDataFrame(rows, "k string, o int, id int")
    model = {}
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        model.setdefault(k, (k, o, i))
    for d in (df, df.repartition(5), df.orderBy(F.rand(3))):
        got = {r.k: tuple(r) for r in keep_first(d, ["k"], F.struct("o", "id")).collect()}
        assert got == model
    once = keep_first(df, ["k"], F.struct("o", "id"))
    assert sorted(map(repr, keep_first(once, ["k"], F.struct("o", "id")).collect())) == sorted(map(repr, once.collect()))


def replay(log):
    """One row at a time, in (ts, seq) order: the reference's behaviour."""
    state = {}
    for email, key, op, data, ts, seq in sorted(log, key=lambda r: (r[4], r[5])):
        if op == "delete":
            state.pop((email, key), None)
        else:
            state[(email, key)] = (data, ts, seq)
    return state


def test_apply_log_equals_replay(spark):
    rnd = random.Random(3)
    log = [(f"u{rnd.randrange(3)}", f"c{rnd.randrange(6)}", "delete" if rnd.random() < 0.2 else "upsert",
            f"d{i}", rnd.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(log, "email string, company_key string, op string, data string, updated_at int, seq int")
    got = {(r.email, r.company_key): (r.data, r.updated_at, r.seq)
           for r in S.apply_log(df, ["email", "company_key"], ["updated_at", "seq"]).collect()}
    assert got == replay(log)


def test_late_older_write_loses(spark):
    target = spark.createDataFrame([("u", "c", "new", 10, 1)], "email string, company_key string, data string, updated_at int, seq int")
    log = spark.createDataFrame([("u", "c", "upsert", "old", 5, 2)],
                                "email string, company_key string, op string, data string, updated_at int, seq int")
    got = S.apply_log(log, ["email", "company_key"], ["updated_at", "seq"], target).collect()
    assert [r.data for r in got] == ["new"]


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("u", "a")], "email string, company_key string")
    rows = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "b", 3)], "email string, company_key string, seq int")
    acc, rej = S.insert_if_absent(existing, rows, ["email", "company_key"], ["seq"])
    assert sorted(tuple(r) for r in acc.collect()) == [("u", "b", 2)]
    assert sorted(tuple(r) for r in rej.collect()) == [("u", "a", 1), ("u", "b", 3)]


LOG = "seq long, email string, company_key string, op string, data string, updated_at int"


def test_insert_if_absent_null_order(spark):
    existing = spark.createDataFrame([], "email string, company_key string")
    rows = spark.createDataFrame([("u", "b", None)], "email string, company_key string, seq int")
    acc, rej = S.insert_if_absent(existing, rows, ["email", "company_key"], ["seq"])
    assert acc.count() == 1 and rej.count() == 0


def test_log_keeps_deletes_and_replays(spark, tmp_path):
    path, keys, order = str(tmp_path / "log"), ["email", "company_key"], ["updated_at", "seq"]
    batches = [[(1, "a@x", "k1", "upsert", "v1", 1), (2, "b@x", "k2", "upsert", "v2", 1)],
               [(3, "a@x", "k1", "upsert", "v3", 2), (4, "b@x", "k2", "delete", None, 5)],
               [(5, "a@x", "k9", "upsert", "v9", 3), (6, "a@x", "k1", "upsert", "old", 0), (7, "b@x", "k2", "upsert", "late", 3)]]
    schema = spark.createDataFrame([], LOG).schema

    def state():
        log = S.read_log(spark, path, spark.createDataFrame([], LOG).schema)
        return log, {(r.email, r.company_key): r.data for r in S.apply_log(log.drop("bucket", "batch"), keys, order).collect()}
    for i, rows in enumerate(batches):
        S.append_log(spark.createDataFrame(rows, schema), path, i, buckets=4)
    want = {("a@x", "k1"): "v3", ("a@x", "k9"): "v9"}     # the late upsert does not bring k2 back
    assert state()[1] == want
    S.append_log(spark.createDataFrame(batches[1], schema), path, 1, buckets=4)   # replay
    log, got = state()
    assert got == want and log.count() == 7
    scan = S.tenant_scan(log, "b@x", 4)
    assert scan.count() == 3
    assert "PartitionFilters: [isnotnull(bucket" in scan._jdf.queryExecution().executedPlan().toString()
    # folded after two batches, the third one late; a half-written base does not count
    again = str(tmp_path / "folded")
    for i in (0, 1):
        S.append_log(spark.createDataFrame(batches[i], schema), again, i, buckets=4)
    assert S.fold_log(spark, again, schema, keys, order, buckets=4) == 1
    (tmp_path / "folded" / "base=7").mkdir()
    S.append_log(spark.createDataFrame(batches[2], schema), again, 2, buckets=4)
    for _ in range(2):
        log = S.read_log(spark, again, schema)
        assert log.count() == 5 and {(r.email, r.company_key): r.data for r in S.apply_log(log.drop("bucket"), keys, order).collect()} == want
        S.drop_folded(spark, again)
    assert not (tmp_path / "folded" / "batch=0").exists() and (tmp_path / "folded" / "batch=2").exists()
    assert S.fold_log(spark, again, schema, keys, order, buckets=4) == 2 == S.fold_log(spark, again, schema, keys, order, buckets=4)
    assert S.read_log(spark, again, schema).count() == 3 and S.read_log(spark, str(tmp_path / "none"), schema).count() == 0


