"""Operator 11 against a trie of plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clientele.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, shard int"


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(c / 5) * 5
        paths[c] = turns.get(c - base, [])[:h] + own[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def walk(p):
        below = [walk(k) for k in kids.get(p, [])]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(paths[c]) == len(p))))
        out[min(nodes[p]), len(p)] = (min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves,
                                      saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved
    if nodes:
        walk(())
    return sorted(out.values())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def result(df):
    return sorted(tuple(r[c.split()[0]] for c in P.NODE.split(", ")) for r in df.collect())


def made(seed, n, deep=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "é"])) for c in range(n) for t in range(r.randrange(1, deep))]


@pytest.mark.parametrize("shards,skeleton", [(1, 100), (7, 100), (40, 1000), (40, 3)])
def test_any_sharding_gives_the_same_trie(spark, shards, skeleton):
    rows = made(shards, 300) + [(c, t, "user", "same") for c in range(1000, 1400) for t in range(3)]  # a third share one path
    convs = P.conversations_of(frame(spark, rows))
    plain = P.trie(P.packed(convs.select("conv_id", "turns")), n_shards=shards, skeleton=skeleton)
    assert result(plain) == brute(rows, rebuild=False)
    rebuilt = P.trie(P.packed(P.share_heads(convs)), n_shards=shards, skeleton=skeleton)
    assert result(rebuilt) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", "b"), (5, 0, "user", "b"), (6, 3, None, "x"),
            (-7, 1, "user", "neg"), (-5, 1, "user", "base"), (-5, 2, "user", "y" * 300000), (0, 0, "a", "1"), (0, 0, "a1", ""), (3, 9, "", "")]
    df = frame(spark, rows)
    assert result(P.trie(P.packed(P.share_heads(P.conversations_of(df))), n_shards=5)) == brute(rows)
    assert P.trie(P.packed(P.share_heads(P.conversations_of(df.limit(0))))).count() == 0


def test_long_conversation_and_long_list_of_ends(spark, monkeypatch):
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(2, t, "user", str(t)) for t in range(2990)] + [(c, 0, "user", "0") for c in range(10, 3000)]
    convs = P.conversations_of(frame(spark, rows))
    got = result(P.trie(P.packed(convs), n_shards=6))
    want = [(1, 0, None, 2992, 1, 1)]
    assert [r[:6] for r in got if r[1] == 0] == want and len(got) == 3001
    ends = {r[1]: r[7] for r in got}
    assert ends[1] == hashlib.sha256(",".join(map(str, range(10, 3000))).encode()).hexdigest()
    assert ends[2990] == hashlib.sha256(b"2").hexdigest() and ends[3000] == hashlib.sha256(b"1").hexdigest()
    assert {r[6] for r in got if r[1] == 0} == {sum((2991 if t == 0 else 1 if t < 2990 else 0) * len(str(t)) for t in range(3000))}


def test_chunks_of_one_hot_path(spark):
    ids = spark.range(50_000).select(F.lit(b"p" * 16).alias("path_id"), F.col("id").alias("conv_id"))
    chunks = ids.repartitionByRange(7, "path_id", "conv_id").sortWithinPartitions("path_id", "conv_id") \
        .mapInArrow(P._join_ids, "path_id binary, first long, n long, ids string")
    assert chunks.count() >= 15 and chunks.selectExpr("max(length(ids)) as m").first().m < 2 * P.CHUNK
    row = chunks.coalesce(1).sortWithinPartitions("path_id", "first").mapInArrow(P._hash_ids, "conv_id long, n long, sha string").collect()
    assert [tuple(r) for r in row] == [(0, 50_000, hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest())]
