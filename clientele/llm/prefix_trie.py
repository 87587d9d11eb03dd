"""Operator 11 -- prefix trie of conversations by a splitter skeleton.

Every distinct sequence of first turns is a node.  A conversation travels as its
packed path: 16 bytes a turn (the head of the SHA-256 of role and text) beside the
turns' text sizes; texts themselves are read once and never shuffled.

Method.  Distinct paths are dealt to shards by range.  The splitters come from a
sample of the paths, cut at equal sums of turns, and each is shortened to the
prefix that tells it from its neighbour.  A node whose members lie on both sides
of a splitter is a prefix of that splitter, so the trie of the splitters -- the
skeleton -- holds every node that no single shard can finish.  It is broadcast; each
shard walks its sorted paths with a stack, finishes all other nodes, and gives one
partial row for every skeleton node it meets.  The partial rows are reduced by
node, and the skeleton is folded from the bottom up.

Scale.  Conversations with equal paths are counted before the shards, so a path that
a third of all conversations share is one row there.  The ids that end at a path
are put in order by a range partitioning on (path, id), which cuts a hot path, and
joined to chunks of text in its tasks; the task that hashes a path's list streams its
chunks.  The skeleton has at most ``SKELETON`` nodes: beyond that every second
splitter is dropped until it fits, which makes shards larger and changes no
result.  The turns of one conversation, packed to 24 bytes each, must fit into a
task, and so must one shard's paths.

Defined cases.  Rows with a null conv_id take no part; a null turn comes first, equal turns of a
conversation are ordered by the SHA-256 of ``<length of role>:<role><text>`` and all
count, repeated rows too.  Null role or text is empty.  The root exists if there is any conversation;
an empty table has no nodes.  Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import stage, table

KEY = 16
SKELETON = 1 << 18
SAMPLE_A_SHARD = 64
TURNS_A_SHARD = 1 << 20
CHUNK = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order as structs of key and size."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").alias("at"), F.unhex(F.substring(F.sha2(body, 256), 1, 2 * KEY)).alias("key"),
                    F.octet_length(text).cast("long").alias("size"))
    return (rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), turn.alias("turn"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns")))


def packed(convs: DataFrame) -> DataFrame:
    """(conv_id, path_id, keys, sizes): each conversation's path as two byte strings
    and its 16-byte name."""
    flat = convs.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b"".join(k) for k in batch.column(1).to_pylist()]
            sizes = [np.array(s, np.int64).tobytes() for s in batch.column(2).to_pylist()]
            names = [hashlib.sha256(k).digest()[:KEY] for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (names, keys, sizes))],
                                             ["conv_id", "path_id", "keys", "sizes"])
    return flat.mapInArrow(run, "conv_id long, path_id binary, keys binary, sizes binary")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path_id, conv_id) to rows of joined decimal ids, one or more a path."""
    at, ids, size, out = None, [], 0, []

    def close():
        if ids:
            out.append((at, ids[0], len(ids), ",".join(map(str, ids))))

    def table_of():
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                          ["path_id", "first", "n", "ids"])
    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != at or size > CHUNK:
                close()
                at, ids, size = path, [], 0
            ids.append(conv)
            size += 20
        yield table_of()
        out.clear()
    close()
    yield table_of()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (path_id, first) to one row a path: its smallest conv_id, count and hash."""
    at, first, n, sha = None, None, 0, None
    for batch in batches:
        out = []
        for path, lead, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if path != at:
                if sha is not None:
                    out.append((first, n, sha.hexdigest()))
                at, first, n, sha = path, lead, 0, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
            n += count
        yield _ends(out)
    yield _ends([(first, n, sha.hexdigest())] if sha is not None else [])


def _ends(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n", "sha"])


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, n, sha, keys, sizes): one row a distinct path, under its smallest
    conversation, with the number of conversations that end there and their hash."""
    chunks = (paths.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
              .mapInArrow(_join_ids, "path_id binary, first long, n long, ids string"))
    ends = (chunks.repartition("path_id").sortWithinPartitions("path_id", "first")
            .mapInArrow(_hash_ids, "conv_id long, n long, sha string"))
    return ends.join(paths.select("conv_id", "keys", "sizes"), "conv_id")


def _common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    lo, hi = 0, n // KEY  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo * KEY:mid * KEY] == b[lo * KEY:mid * KEY] else (lo, mid)
    return lo


def _cut_points(n_shards: int):
    """Of a sorted sample, the paths that cut its turns into equal parts, shortened."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [k for b in batches for k in b.column(0).to_pylist()]
        total = sum(len(k) // KEY + 1 for k in keys)
        out, done, due = [], 0, 1
        for before, k in zip([None, *keys], keys):
            if done * n_shards >= due * total and before is not None:
                out.append(k[: (_common(before, k) + 1) * KEY])
                due = done * n_shards // total + 1
            done += len(k) // KEY + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["splitter"])
    return run


def splitters(paths: DataFrame, n_shards: int, n_paths: int, skeleton: int = SKELETON) -> list[bytes]:
    """At most n_shards - 1 paths that cut the (distinct) paths into shards; the
    nodes on them number at most ``skeleton``."""
    share = min(1.0, SAMPLE_A_SHARD * n_shards / max(n_paths, 1))
    some = paths.select("keys").where(F.pmod(F.xxhash64("keys"), F.lit(1 << 32)) < int(share * (1 << 32)) + 1)
    cut = some.coalesce(1).sortWithinPartitions("keys").mapInArrow(_cut_points(n_shards), "splitter binary")
    length = cut.withColumn("length", F.length("splitter"))
    found = sorted(r.splitter for r in length.where(F.col("length") <= skeleton * KEY).select("splitter").collect())
    while sum(map(len, found)) > skeleton * KEY:
        found = found[1::2]
    return found


class Skeleton:
    """The trie of the splitters: node 0 is the root, a child has a larger number than its parent."""

    def __init__(self, cuts: list[bytes]):
        self.cuts, self.child, self.parent, self.depth = cuts, {}, [-1], [0]
        for s in cuts:
            node = 0
            for i in range(0, len(s), KEY):
                at = (node, s[i:i + KEY])
                if at not in self.child:
                    self.child[at] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(i // KEY + 1)
                node = self.child[at]


class _Node:
    """An open node of the current path; ``skeleton`` is its number there, or None."""

    __slots__ = ("skeleton", "size", "conv", "n", "children", "leaves", "saved", "sha", "below")

    def __init__(self, skeleton, size):
        self.skeleton, self.size, self.conv, self.n = skeleton, size, None, 0
        self.children = self.leaves = self.saved = 0
        self.sha, self.below = None, []

    def add(self, conv, n):
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


class _Walk:
    """Walks one shard's sorted distinct paths."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.out, self.start = skeleton, [], None
        self.reset()

    def reset(self):
        self.open, self.path = [_Node(0, 0)], b""

    def take(self, conv, n, sha, keys, sizes):
        same = _common(self.path, keys)
        self.close_to(same)
        sizes = np.frombuffer(sizes, np.int64)
        for d in range(same, len(keys) // KEY):
            up = self.open[-1].skeleton
            node = None if up is None else self.skeleton.child.get((up, keys[d * KEY:(d + 1) * KEY]))
            self.open.append(_Node(node, int(sizes[d])))
        self.path = keys
        last = self.open[-1]
        last.add(conv, n)
        last.sha = sha

    def close_to(self, depth):
        while len(self.open) > depth + 1:
            v, up = self.open.pop(), self.open[-1]
            d = len(self.open)
            if v.skeleton is not None:
                self.partial(v, d)
                continue
            v.leaves = v.leaves if v.children else 1
            v.saved += (v.n - 1) * v.size
            for row in v.below:
                self.out.append((None, False, *row[:2], v.conv, *row[2:]))
            row = (v.conv, d, v.n, v.children, v.leaves, v.saved, v.size, v.sha)
            if up.skeleton is None:
                up.below.append(row)
            else:
                self.out.append((up.skeleton, False, *row[:2], None, *row[2:]))
            up.add(v.conv, v.n)
            up.children += 1
            up.leaves += v.leaves
            up.saved += v.saved

    def partial(self, v, depth):
        """What this shard knows of a skeleton node, without the nodes of the skeleton below it."""
        self.out.append((v.skeleton, True, v.conv, depth, None, v.n, v.children, v.leaves, v.saved, v.size, v.sha))

    def end(self):
        self.close_to(0)
        self.partial(self.open[0], 0)
        self.reset()


_SHARD_ROW = ("skeleton long, partial boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
              "n_leaves long, saved_tokens long, size long, ends_sha256 string")


def _rows(out: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 8, pa.string()]
    cols = list(zip(*out)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _SHARD_ROW.split(", ")])


def _finish(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, at = _Walk(Skeleton(sent.value)), None
        for batch in batches:
            for shard, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if shard != at and at is not None:
                    walk.end()
                at = shard
                walk.take(*row)
                if len(walk.out) > 20_000:
                    yield _rows(walk.out)
                    walk.out = []
        if at is not None:
            walk.end()
        yield _rows(walk.out)
    return run


def _deal(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(sent.value, k) for k in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])
    return run


def _fold(skeleton: Skeleton, partials: list) -> list[tuple]:
    """Whole rows of the skeleton's nodes, from their reduced partial rows."""
    known = {r.skeleton: r for r in partials}
    size = len(skeleton.parent)
    n, children, leaves, saved = ([0] * size for _ in range(4))
    conv: list = [None] * size
    for v in range(size - 1, -1, -1):  # children come before their parent
        r = known.get(v)
        if r is not None:
            n[v] += r.n_convs
            children[v] += r.n_children
            leaves[v] += r.n_leaves
            conv[v] = min((x for x in (conv[v], r.conv_id) if x is not None), default=None)
            saved[v] += r.saved_tokens + (n[v] - 1) * r.size
        leaves[v] = leaves[v] if children[v] else 1
        up = skeleton.parent[v]
        if up >= 0:
            n[up] += n[v]
            children[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]
            conv[up] = min(x for x in (conv[up], conv[v]) if x is not None)
    return [(v, conv[v], skeleton.depth[v], conv[skeleton.parent[v]] if v else None, n[v], children[v], leaves[v], saved[v],
             known[v].ends_sha256) for v in range(size) if v in known]


def trie(paths: DataFrame, n_shards: int | None = None, skeleton: int = SKELETON) -> DataFrame:
    """One row a node of the trie of ``packed`` conversations."""
    spark: SparkSession = paths.sparkSession
    distinct = stage(distinct_paths(stage(paths, "trie-paths")), "trie-distinct")
    n_paths, n_turns = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("keys") / KEY + 1), F.lit(0.0))).first()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = n_shards or max(4 * n_parts, int(n_turns) // TURNS_A_SHARD + 1)
    cuts = splitters(distinct, n_shards, n_paths, skeleton)
    sent = spark.sparkContext.broadcast(cuts)
    columns = ["conv_id", "n", "sha", "keys", "sizes"]
    dealt = distinct.select(columns).mapInArrow(_deal(sent), "shard int, conv_id long, n long, sha string, keys binary, sizes binary")
    rows = stage(dealt.repartition(max(n_parts, n_shards // 4), "shard").sortWithinPartitions("shard", "keys")
                 .mapInArrow(_finish(sent), _SHARD_ROW), "trie-shards")
    partials = rows.where("partial").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("size").alias("size"), F.max("ends_sha256").alias("ends_sha256"))
    top = spark.createDataFrame(_fold(Skeleton(cuts), partials.collect()), f"skeleton long, {NODE}")
    names = top.select("skeleton", F.col("conv_id").alias("parent_of"))
    below = (rows.where("NOT partial").join(F.broadcast(names), "skeleton", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_of")))
    nodes = [x.split()[0] for x in NODE.split(", ")]
    return below.select(nodes).unionByName(top.select(nodes)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def share_heads(convs: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The contract's rebuilt conversations: the head of the conversation whose id is the
    next multiple of ``every``, then the own turns after it; the head's length is a
    checksum of the id, at most ``most``."""
    h: Column = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = stage(conversations_of(table(spark, sf_dir, "conversations")), "trie-convs")
    return trie(packed(share_heads(convs)))


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, conv_id::VARCHAR AS name, list_transform(range(8 * length(conv_id::VARCHAR)),
    lambda i: (ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS bits FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, (xor(list_reduce(list_prepend(4294967295::UBIGINT, bits::UBIGINT[]),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 9)::BIGINT AS h FROM bits),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos + 100000000, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, list({'r': role, 't': text}) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
named AS (
  SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS ends_at FROM placed),
nodes AS (
  SELECT node, depth, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = ends_at), '')) AS ends_sha256
  FROM named GROUP BY node, depth),
parents AS (
  SELECT n.node, n.depth, p.node AS parent FROM nodes n LEFT JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT a.node, a.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM nodes n JOIN named a ON a.conv_id = n.node AND a.depth <= n.depth LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth
  GROUP BY a.node, a.depth)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, p.parent AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN parents p USING (node, depth) JOIN below b USING (node, depth) LEFT JOIN kids k USING (node, depth)
"""
