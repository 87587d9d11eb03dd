"""Contracts in the writing pass, VARIANT documents, the trigram index and mergeable sketches."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from clientele import schemas
from clientele.operators import analytics as A, search_index as X
from clientele.sources import store as S


def test_contract_in_one_pass(spark, tmp_path):
    rows = [("u", "a", "1", 5), (None, "b", "2", 5), ("u", "c", None, 5), ("u", None, None, 5)]
    df = spark.createDataFrame(rows, "email string, name string, value string, other int")
    seen = S.write_checked(df, "settings", str(tmp_path / "s"))
    assert seen == {"rows": 4, "rejected": 2, "defaulted_value": 2}
    got = sorted(map(tuple, S.read_checked(spark, "settings", str(tmp_path / "s")).select("email", "name", "value", "reason", "rejected").collect()), key=repr)
    assert got == sorted([("u", "a", "1", None, False), (None, "b", "2", "email is missing", True), ("u", "c", "", None, False), ("u", None, "", "name is missing", True)], key=repr)
    narrow = spark.createDataFrame([("u", "k", "{}")], "email string, company_key string, data string")
    assert S.write_checked(narrow, "repos", str(tmp_path / "r"), "2024-02-01 00:00:00") == {"rows": 1, "rejected": 0, "defaulted_updated_at": 1}
    assert str(S.read_checked(spark, "repos", str(tmp_path / "r")).first().updated_at) == "2024-02-01 00:00:00"
    plan = S.conform(spark.read.parquet(str(tmp_path / "r")), "repos")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1  # checks and defaults need no second scan


def test_documents_round_trip_as_variant(spark, tmp_path):
    whole = {"key": "k", "company_name": "Ü \"x\"", "company_domain": "k.si", "company_description": "", "detected_language": "slovenian", "detected_country": "Slovenia",
             "clients": [{"name": "Acme", "industry": "", "country": "", "source": "logo", "ai_note": "a\nb", "confidence": 95}], "sources_checked": ["https://k.si"],
             "scraped_at": "2024", "ai_cleaned": True, "error": None}
    rows = [(1, json.dumps(whole)), (2, '{"key":"m","error":null}'), (3, '{"key":'), (4, "[1]"), (5, None), (6, ""), (7, '  {"clients":"no list","extra":{"x":1.5}}')]
    path = str(tmp_path / "d")
    S.write_documents(spark.createDataFrame(rows, "id int, data string"), path)
    docs = S.read_documents(spark, path)
    got = {r.id: r for r in docs.select("id", S.typed(F.col("document")).alias("t"), *(S.field_state(F.col("document"), c).alias(c) for c in ("error", "key", "clients"))).collect()}
    assert json.loads(json.dumps(got[1].t.asDict(recursive=True))) == whole
    assert (got[1].error, got[2].error, got[7].error) == ("null", "null", "missing") and got[2].clients == "missing" and got[7].t.clients is None
    assert {r.id: r.raw for r in S.read_documents(spark, path, quarantined=True).collect()} == {3: '{"key":', 4: "[1]", 5: None, 6: ""}
    back = {r.id: r.j for r in docs.select("id", F.to_json("document").alias("j")).collect()}
    assert json.loads(back[1]) == whole and json.loads(back[7]) == {"clients": "no list", "extra": {"x": 1.5}}
    assert schemas.COMPANY_DOCUMENT == docs.select(S.typed(F.col("document")).alias("t")).schema["t"].dataType


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(3)
    texts = ["".join(r.choice("abÉ %_") for _ in range(r.randrange(0, 12))) for _ in range(400)] + ["Customer#1", "CUSTOMER#12", None, "", "ab", "x" * 5000]
    path = str(tmp_path / "i")
    X.write_index(spark.createDataFrame([(t,) for t in texts], "text string"), path, buckets=8)
    low = {t.lower() for t in texts if t is not None}
    for q in ["customer#1", "AbA", "é %", "%_a", "a", "", "ab", "nothing here", "x" * 40, "aaa"] + [t[2:6] for t in texts[:12] if t]:
        assert {x.text for x in X.find(spark, path, q, buckets=8).collect()} == {t for t in low if q.lower() in t}, q
    plan = X.candidates(spark, path, "abc", buckets=8)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)


@pytest.mark.parametrize("parts", [1, 5])
def test_sketches_merge_to_the_count_of_all(spark, parts):
    n = 20_000
    df = spark.range(n * 2).select(F.lit("u").alias("email"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("company_key"), (F.col("id") % 50 == 0).alias("is_partner"),
                                   F.concat(F.lit("Name "), (F.col("id") % n).cast("string")).alias("name"), (F.col("id") % 13).cast("string").alias("industry"), F.lit("").alias("country"))
    batches = [A.company_sketches(df.where(F.crc32(F.col("name").cast("binary")) % parts == i)) for i in range(parts)]
    got = A.sketch_counts(A.merge_sketches(*batches)).first()
    exact = df.where("NOT is_partner").select(F.count_distinct(F.lower("name"))).first()[0]
    assert abs(got.n_names - exact) < 0.03 * exact and got.n_industries == 13 and got.n_countries == 0
