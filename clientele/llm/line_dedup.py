"""Operator 1 -- reversible line deduplication.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
in lower case.  Keys of at least ``min_chars`` code points that are found in
at least ``min_docs`` documents are *repeated*: all their lines go, except in
the largest doc_id that holds the key.  All other lines stay.

State (``LineIndex``), all of it tables:

* ``refs``    (k1, k2, doc_id): which document holds which key (128-bit hash);
* ``counts``  (k1, k2, n_docs, keeper): exact reference counts, aggregated from
  ``refs``; only keys a batch touches are counted anew;
* ``filters`` (shard, data): one cuckoo filter per key shard, holding exactly
  the repeated keys.  An insertion adds the keys that reach ``min_docs``, a
  document deletion removes those that fall below it, so the index after
  deleting a document is the index that never saw it.

A decision probes the documents' keys against the filter of their shard.
Only what passes (repeated keys, and a few false positives) is joined with the
exact counts, which alone decide.

Scale.  Probing meets a shard's filter with its keys by partition and sort
order: the filter row comes first, the keys stream past it.  Keys are spread
over ``SALTS`` copies of a shard by document, so one line held by a third of
all documents is spread too; counting combines map-side.  ``keys_per_shard``
bounds a filter's size; the shard count is set by the first batch, ``rebuild``
changes it.

Defined cases.  A null or empty text is one empty line.  Rows that share a
doc_id count as one document and each gets its own result row.  Rows with a
null doc_id are returned whole: they hold no key and lose no line.  An empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import stage, utf8
from clientele.llm.cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
SALTS = 16
KEYS_PER_SHARD = 2_000_000


def line_key(line: bytes, min_chars: int) -> int | None:
    """The 128-bit key of a line; None when it is too short to be judged."""
    key = line.strip(SPACE).lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_intdigest(key)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 64) - 1
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {k for k in (line_key(x, min_chars) for x in text.as_py().split(b"\n")) if k is not None}
                ids.extend([doc] * len(found))
                keys.extend(found)
            k1 = np.array([k >> 64 for k in keys], np.uint64).view(np.int64)
            k2 = np.array([k & low for k in keys], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])
    return run


def postings(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(k1, k2, doc_id): the distinct line keys of every document."""
    rows = (docs.where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long"), utf8().alias("text"))
            .mapInArrow(_keys(min_chars), "k1 long, k2 long, doc_id long"))
    return rows.distinct()


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with these documents added; documents already in it
        keep the keys they had."""
        new = postings(docs, self.min_chars).join(self.refs, ["k1", "k2", "doc_id"], "left_anti")
        new = stage(new, "line-new")
        return self._changed(stage(self.refs.unionByName(new), "line-refs"), new)

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """The index without the documents named in column ``doc_id``."""
        ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        gone = stage(self.refs.join(ids, "doc_id", "left_semi").select("k1", "k2", "doc_id"), "line-gone")
        left = self.refs.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id")
        return self._changed(stage(left, "line-refs"), gone)

    def _changed(self, refs: DataFrame, by: DataFrame) -> "LineIndex":
        touched = by.select("k1", "k2").distinct()
        now = _count(refs.join(touched, ["k1", "k2"], "left_semi"))
        counts = stage(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(now), "line-counts")
        old = self.counts.join(touched, ["k1", "k2"], "left_semi").where(F.col("n_docs") >= self.min_docs)
        now = now.where(F.col("n_docs") >= self.min_docs)
        moves = (now.join(old, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(True).alias("added"))
                 .unionByName(old.join(now, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("added")))
                 .withColumn("shard", shard_of(self.n_shards)))
        filters = (self.filters.groupBy("shard").cogroup(moves.groupBy("shard"))
                   .applyInArrow(_move, "shard int, data binary"))
        return replace(self, refs=refs, counts=counts, filters=stage(filters, "line-filters"))

    def rebuild(self, n_shards: int) -> "LineIndex":
        """The same index with another number of shards."""
        return replace(self, filters=stage(_filters(self.counts, self.min_docs, n_shards), "line-filters"), n_shards=n_shards)

    def decide(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """One row per document: doc_id, n_lines, n_dropped, kept (binary UTF-8).
        ``keys``: the documents' ``postings``, where they are at hand."""
        hits = self.probe(keys if keys is not None else postings(docs, self.min_chars))
        repeated = self.counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keeper")
        drops = (hits.join(repeated, ["k1", "k2"]).where(F.col("doc_id") != F.col("keeper"))
                 .groupBy("doc_id").agg(F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2")))
        both = docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).join(drops, "doc_id", "left")
        return both.mapInArrow(_cut(self.min_chars), "doc_id long, n_lines long, n_dropped long, kept binary")

    def probe(self, keys: DataFrame) -> DataFrame:
        """The keys that their shard's filter may hold."""
        none = F.lit(None)
        asked = keys.select(shard_of(self.n_shards).alias("shard"),
                            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
                            F.lit(1).alias("kind"), "k1", "k2", "doc_id", none.cast("binary").alias("data"))
        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"),
                                   none.cast("long").alias("k1"), none.cast("long").alias("k2"), none.cast("long").alias("doc_id"), "data")
        met = asked.unionByName(held).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        return met.mapInArrow(_probe, "k1 long, k2 long, doc_id long")


def shard_of(n_shards: int):
    return F.pmod(F.col("k1"), F.lit(n_shards)).cast("int")


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _filters(counts: DataFrame, min_docs: int, n_shards: int) -> DataFrame:
    return (counts.where(F.col("n_docs") >= min_docs).select(shard_of(n_shards).alias("shard"), "k1", "k2")
            .groupBy("shard").applyInArrow(_build, "shard int, data binary"))


def _u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _row(shard: int, f: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([f.to_bytes()], pa.binary())})


def _build(group: pa.Table) -> pa.Table:
    f = CuckooFilter.sized(2 * group.num_rows)
    f.insert(_u64(group["k1"]), _u64(group["k2"]))
    return _row(group["shard"][0].as_py(), f)


def _move(held: pa.Table, moves: pa.Table) -> pa.Table:
    if not moves.num_rows:
        return held.select(["shard", "data"])
    f = CuckooFilter.from_bytes(held["data"][0].as_py()) if held.num_rows else CuckooFilter.sized(4 * moves.num_rows)
    k1, k2, added = _u64(moves["k1"]), _u64(moves["k2"]), moves["added"].to_numpy()
    f.remove(k1[~added], k2[~added])
    f.insert(k1[added], k2[added])
    return _row(moves["shard"][0].as_py(), f)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, None
    for batch in batches:
        shard, salt, kind = (batch.column(i).to_numpy() for i in range(3))
        k1, k2 = _u64(batch.column(3).fill_null(0)), _u64(batch.column(4).fill_null(0))
        group = shard.astype(np.int64) * SALTS + salt
        hit = np.zeros(batch.num_rows, bool)
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] < kind[:-1])]) if batch.num_rows else []
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            if kind[lo] == 0:
                at, held = group[lo], CuckooFilter.from_bytes(batch.column(6)[int(lo)].as_py())
                lo += 1
            if lo < hi and at == group[lo]:  # a shard without repeated keys has no filter
                hit[lo:hi] = held.contains(k1[lo:hi], k2[lo:hi])
        keep = pa.array(hit)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (3, 4, 5)], ["k1", "k2", "doc_id"])


def _cut(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in batches:
            lines, dropped, kept = [], [], []
            texts, a, b = batch.column(1), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                n, out = text.count(b"\n") + 1, text
                gone = a[i].as_py()
                left = n
                if gone:
                    gone = {(x & mask) << 64 | (y & mask) for x, y in zip(gone, b[i].as_py())}
                    stay = [x for x in text.split(b"\n") if line_key(x, min_chars) not in gone]
                    left, out = len(stay), b"\n".join(stay)
                lines.append(n)
                dropped.append(n - left)
                kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def build(keys: DataFrame, min_docs: int = 5, min_chars: int = 40, n_shards: int | None = None,
          keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
    """A new index over ``postings``; ``keys`` should be a staged table."""
    counts = stage(_count(keys), "line-counts")
    n_shards = n_shards or max(8, -(-keys.count() // keys_per_shard))
    filters = stage(_filters(counts, min_docs, n_shards), "line-filters")
    return LineIndex(keys, counts, filters, n_shards, min_docs, min_chars)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """The whole job over one table: index it, then decide for each document."""
    keys = stage(postings(docs, min_chars), "line-refs")
    return build(keys, min_docs, min_chars).decide(docs, keys)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from clientele.llm.common import table
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
