"""Operators 1, 3 and 5 against brute force, with the defined edge cases."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.llm import line_dedup, simhash, substring_dedup
from clientele.llm.cuckoo import CuckooFilter

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("k1", T.StringType()), T.StructField("fp", T.IntegerType()), T.StructField("shard", T.IntegerType())])


def frame(spark, docs):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA)


def edge_docs():
    rng = random.Random(3)
    words = ["the", "of", "Ünder", "licht", "été", "stone", "River", "añoran", "blue", "and", "Quick", "zebra"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n))
    common = "This line is common to MANY documents of the fixture, ünïcode too"
    passage = prose(30)
    docs = [(None, common), (1, None), (2, ""), (3, "  \t "), (4, "x" * 500), (5, "x" * 700), (6, "ab" * 300), (7, "short"), (8, "short")]
    docs += [(10 + i, prose(20) + "\n" + (common.upper() if i % 2 else "  " + common + "\t") + "\n" + prose(5) + "\n" + common) for i in range(7)]
    docs += [(30 + i, prose(40) + " " + passage[i:] + " " + prose(10)) for i in range(6)]
    base = prose(400)
    docs += [(50 + i, base if i < 4 else base.replace("zebra", "zebr" + "a" * i, 1)) for i in range(9)]
    docs += [(70, prose(60)), (70, prose(60)), (71, base), (71, base), (72, (common + "\n") * 400 + prose(3000))]
    docs += [(None, base), (90, "\n\n" + passage), (91, passage)]
    return docs


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("which", ["edge", "given", "empty"])
def test_brute_force(spark, sample, which):
    docs = {"edge": edge_docs(), "given": sample, "empty": []}[which]
    df = frame(spark, docs)
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.lines(docs)))
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.near_duplicates(docs)))
    for limit in (substring_dedup.GROUP_LIMIT, *([2] if which == "edge" else [])):  # 2 sends most groups the exact way for large ones
        got = substring_dedup.dedup_substrings(df, bitmap_bits=20, group_limit=limit) \
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.substrings(docs)))


def test_passage_of_many_documents_and_long_text(spark):
    # one passage in every document: few contents, many places; texts longer than a segment
    rng = np.random.default_rng(5)
    passage = "the same passage of well over fifty bytes that each of the documents holds, word by word"
    docs = [(i, f"{rng.integers(1 << 60):x} {passage} {rng.integers(1 << 60):x}") for i in range(300)]
    long = "".join(map(chr, rng.integers(97, 123, substring_dedup.SEGMENT + 1000)))
    docs += [(300, long), (301, long[:200] + passage), (302, "x" + long[-700:]), (303, "y" + long[substring_dedup.SEGMENT - 300:][:600])]
    df = frame(spark, docs)
    for limit in (substring_dedup.GROUP_LIMIT, 20):
        got = substring_dedup.dedup_substrings(df, bitmap_bits=20, group_limit=limit) \
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.substrings(docs)))


def test_minimizers_fill_shards_evenly():
    buf = np.random.default_rng(1).integers(97, 123, 1 << 20).astype(np.uint8)
    h = substring_dedup.runs(buf, np.array([0, len(buf)]), 50)[2]
    n = np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=64)
    assert n.max() < 1.2 * n.mean() and n.min() > 0.8 * n.mean()


def test_places_are_expanded_in_slices(monkeypatch):
    flat = np.array([(d, 0, 10 * d) for d in range(40)], substring_dedup.PLACE)
    content = np.repeat([0, 1], 20)
    args = np.array([0] * 5 + [30] * 3), np.array([0, 5]), np.array([5, 3]), content, flat, 50

    def spans():
        return [tuple(map(int, x)) for part in substring_dedup._gone(*args) for x in zip(*part)]
    whole = spans()
    assert whole == [(d, 0, 10 * d, 10 * d + (54 if d < 20 else 52)) for d in range(40) if d and not 20 <= d <= 30]
    monkeypatch.setattr(substring_dedup, "SLICE", 7)
    assert spans() == whole


def test_line_index_is_reversible(spark):
    docs = [d for d in edge_docs() if d[0] is not None]
    df = frame(spark, docs)
    first, second = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0")
    alone = line_dedup.build(line_dedup.postings(first)).decide(first)
    both = line_dedup.build(line_dedup.postings(first)).insert(second)
    back = both.delete(second.select("doc_id"))

    def rows(x):
        return sorted(map(repr, x.select("doc_id", "n_lines", "n_dropped", "kept").collect()))
    assert rows(both.decide(df)) == rows(line_dedup.dedup_lines(df))
    assert rows(back.decide(first)) == rows(alone)
    held = {r.shard: CuckooFilter.from_bytes(r.data) for r in back.filters.collect()}
    n = sum(int((f.table > 0).sum()) + len(f.stash) for f in held.values())
    assert n == back.counts.where("n_docs >= 5").count()
    assert rows(back.rebuild(3).decide(first)) == rows(alone)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k = rng.integers(0, 1 << 63, (2, 20000), dtype=np.uint64) * np.uint64(2)
    f = CuckooFilter.sized(12000)  # overfull: the rest is stashed
    f.insert(k[0], k[1])
    assert f.contains(k[0], k[1]).all()
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.remove(k[0, :10000], k[1, :10000])
    assert f.contains(k[0, 10000:], k[1, 10000:]).all()
    f.remove(k[0, 10000:], k[1, 10000:])
    assert not f.table.any() and not f.stash


def test_covering_masks_and_large_buckets(spark):
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        for i in range(64):
            for j in range(64 if radius == 2 else 0):
                assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) * (rng.random() < .6)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for radius in (1, 2):
        want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
        for limit in (1000, 3):
            got = {r.node: r.root for r in simhash.components(simhash.links(df, radius, limit)).collect()}
            groups = {}
            for f in fps:
                s = f - (1 << 64) if f >> 63 else f
                groups.setdefault(got.get(s, s), []).append(f)
            assert sorted(map(sorted, groups.values())) == sorted(sorted(f for f, w in zip(fps, want) if w == x) for x in set(want))
    # the numpy way for larger buckets gives the forest of the pairwise way
    arr = np.array(fps, np.uint64)
    for radius in (1, 2):
        small, simhash.BRUTE = simhash.BRUTE, 10 ** 6
        one = simhash._forest(arr, radius)
        simhash.BRUTE = 0
        two = simhash._forest(arr, radius)
        simhash.BRUTE = small
        assert (one == two).all()


def test_deduplicate_keeps_columns(spark):
    docs = edge_docs()
    out = simhash.deduplicate(frame(spark, docs))
    assert out.columns == SCHEMA.names
    ids = [r.doc_id for r in out.collect()]
    want = {d for d, _, c in brute.near_duplicates(docs) if d == c and d is not None}
    assert {i for i in ids if i is not None} == want and ids.count(None) == 2
    # an id with texts of several components stays once in each
    components = simhash.near_duplicates(frame(spark, docs)).where("doc_id IS NOT NULL").select("component").distinct().count()
    assert len(ids) == components + 2


def test_deduplicate_keeps_a_text_that_shares_its_id(spark):
    a, b = "one two three four five", "quite another text about nothing at all"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (7, b, "z"), (9, None, "n"), (9, "", "m"), (None, a, "x"), (11, "same words here", "q"), (11, "same words here", "p"), (11, "same words here", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 3, 7):
        got = simhash.deduplicate(df.repartition(parts))
        assert got.columns == df.columns
        kept = sorted(map(tuple, got.collect()), key=repr)
        assert kept == sorted([(1, a, "x"), (5, b, "y"), (9, None, "n"), (None, a, "x"), (11, "same words here", "p")], key=repr)
