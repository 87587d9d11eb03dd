"""Operators 2 and 7 against brute force."""

import brute
import pytest
from pyspark.sql import types as T

from clientele.llm import catalog, license_scan, topk


def test_license_base_columns(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in catalog.QUERIES["op2_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    hits = 0
    for doc_id, text in docs:
        n, places = brute.base_places(text)
        r = got[doc_id]
        hits += bool(places)
        assert (r.n_words, r.n_base) == (n, len(places))
        at = [i for _, i in places]
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places}))
        assert {x for x, _ in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0 or not r.labels)
    assert hits


def test_templates():
    def places(markup, text):
        return license_scan.find_places(text.encode(), [license_scan.compile_template("t", markup)])[1]
    t = "copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=3>> all rights reserved"
    assert places(t, "Copyright (c) 2020 Some Body. All rights reserved") == [("t", 0, 8)]
    assert places(t, "copyright acme all rights reserved") == [("t", 0, 5)]
    assert places(t, "copyright all rights reserved") == []
    assert places(t, "copyright c all rights reserved") == [("t", 0, 5)]  # c is the replaceable word
    assert places(t, "copyright a b c d all rights reserved") == []
    assert places(t, "copyright acme all right reserved") == []
    nested = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e"
    assert [len(places(nested, x)) for x in ("a e", "a b d e", "a b c d e", "a b e", "a c d e")] == [1, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        license_scan.compile_template("t", "<<var;max=2>> license").first()
    text = ("word " * 300000) + "all rights reserved " + ("Ünit " * 300000)
    n, found, covered = license_scan.find_places(text.encode(), [license_scan.compile_template("r", "all rights reserved")])
    assert (n, found, covered) == (600003, [("r", 300000, 300003)], 3)


def test_scan_of_blocks_without_words():
    automata = [license_scan.compile_template("cc", "cc by")]
    blank = b" " * license_scan.BLOCK
    assert license_scan.find_places(blank + b" cc by", automata) == (2, [("cc", 0, 2)], 2)
    assert license_scan.find_places(b"cc" + b"-" * 3 * license_scan.BLOCK + b"by" + blank + b"x", automata) == (3, [("cc", 0, 2)], 2)
    assert license_scan.find_places(b"x " + 2 * blank + b"y", []) == (2, [], 0)
    assert license_scan.find_places(blank, automata) == license_scan.find_places(b"", automata) == (0, [], 0)


def test_scan_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "CC-BY", 3)], "doc_id long, text string, places int")
    rows = sorted(license_scan.scan(df, license_scan.BASE).collect(), key=lambda r: (r.n_words, r.doc_id or 0))
    assert [(r.doc_id, r.n_words, len(r.places), r.score) for r in rows] == [(None, 0, 0, 0.0), (1, 0, 0, 0.0), (1, 2, 1, 1.0)]
    assert license_scan.scan(df.limit(0), license_scan.BASE).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("w", T.StringType())])


def test_top_k(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    nan, inf = float("nan"), float("inf")
    rows = rows[:200] + [(None, [1.0]), (20, None), (40, [nan, 1.0]), (60, [inf]), (1000, []), (1001, [0.0] * 3), (1002, [1.0, None]),
                         (1003, rows[20][1]), (1003, rows[20][1]), (1040, rows[40][1]), (1040, rows[41][1])] + [(2000 + i, [0.5] * 8) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    usable = topk.usable(df)
    for blocks in ({}, {"q_block": 3, "c_block": 17}):
        got = topk.top_k(usable, usable.where("vec_id % 20 = 0"), **blocks).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(brute.top_k(rows))
    assert topk.top_k(usable.limit(0), usable.limit(0)).count() == 0
