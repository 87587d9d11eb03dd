"""Operator 3 -- SimHash near-dedup by covering locality-sensitive hashing.

A document's text has A-Z lower-cased and is cut into words ``[^\\x20\\x09-\\x0D]+``;
its shingles are all runs of ``shingle`` words, repeats included, joined by one
space (fewer words: the whole sequence).  A fingerprint bit is set when it is
set in more than half of the shingles' XXH64 values (seed 42).

Covering LSH for radius r: bit i has a non-zero vector m(i) over GF(2) of
r + 1 dimensions, and each of the 2^(r+1) - 1 non-zero vectors v gives one table
whose mask holds the bits with <m(i), v> = 1.  For any r bits there is a v
orthogonal to all their m(i), so two fingerprints that differ in r bits or
fewer agree under at least one mask: no pair is missed.

Equal fingerprints are one node before anything else, so exact copies cost
nothing.  A bucket of up to ``bucket_limit`` distinct fingerprints is linked in
numpy: small ones by counting differing bits, larger ones by the points one bit
away (two fingerprints differ in two bits or fewer exactly when they share such
a point), and it emits a spanning forest, never all pairs.  Larger buckets are
linked by the same rule as a Spark grouping over those points, where no group
can have more than 65 members.  Components come from alternating large-star and
small-star rounds, each written to the shared folder.

Defined cases.  No words (null, empty or white texts): fingerprint zero, linked
like any other.  Rows sharing a doc_id get their own fingerprint each.  A null
doc_id takes part in linking but is never a component's id; a component of such
rows only has a null id.  An empty table gives an empty result.  Only ``doc_id``
and ``text`` are read by ``near_duplicates``; ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import release_caches, stage, table, utf8

BUCKET_LIMIT = 100_000
BRUTE = 256
BLOCK = 1 << 18


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, in blocks of bounded size."""
    low = text.lower()
    norm = b" ".join(low.split()) if len(low) < 1 << 22 else re.sub(rb"[ \t-\r]+", b" ", low).strip(b" ")
    if not norm:
        return
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.r_[0, spaces + 1]
    ends = np.r_[spaces, len(norm)]
    starts, ends = (starts[: len(starts) - n + 1], ends[n - 1:]) if len(starts) > n else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        yield np.array([digest(norm[a:b], 42) for a, b in zip(starts[at: at + BLOCK].tolist(), ends[at: at + BLOCK].tolist())], np.uint64)


def fingerprint(text: bytes, n: int) -> int:
    """The 64-bit fingerprint as a signed integer."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, n):
        total += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view(np.int64)[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp): one row per document; ``tie`` tells texts of one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["doc_id", "tie", "fp"])
    return docs.select(F.col("doc_id").cast("long"), _tie().alias("tie"), utf8().alias("text")).mapInArrow(run, "doc_id long, tie long, fp long")


def _tie():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def covering_masks(radius: int) -> list[int]:
    """One 64-bit mask per table (unsigned)."""
    n = (1 << (radius + 1)) - 1
    of_bit = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if bin(of_bit[i] & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of these distinct fingerprints the index of its root."""
    n = len(fps)
    if n <= BRUTE:
        i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    else:  # points at most one bit away, over the bits in which the bucket varies
        vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
        flips = np.array([0] + [1 << b for b in range(64) if vary >> b & 1], np.uint64)
        points = (fps[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(n), len(flips))
        order = np.argsort(points, kind="stable")
        points, owner = points[order], owner[order]
        first = np.searchsorted(points, points, side="left")
        if radius == 2:
            i, j = owner, owner[first]
        else:  # radius 1: only points that are fingerprints themselves
            at = np.searchsorted(fps, points) if np.all(fps[1:] > fps[:-1]) else None
            assert at is not None, "fingerprints of a bucket are sorted"
            at = np.minimum(at, n - 1)
            real = fps[at] == points
            i, j = owner[real], at[real]
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                fps = np.sort(row.values.to_numpy().view(np.uint64))
                root = _forest(fps, radius)
                moved = np.flatnonzero(root != np.arange(len(fps)))
                a.append(fps[moved])
                b.append(fps[root[moved]])
            empty = np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [empty]).view(np.int64)) for x in (a, b)], ["a", "b"])
    return run


def links(nodes: DataFrame, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` that
    are linked by steps of ``radius`` differing bits or fewer."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(radius)))
    buckets = nodes.select("fp", F.posexplode(masks).alias("mask", "bits")).select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
    sizes = stage(buckets.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    # the explicit exchange lets Spark split the join where a bucket is large
    members = (buckets.join(sizes.where(F.col("n") <= bucket_limit), ["mask", "key"]).repartition("mask", "key")
               .groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps"))
    edges = members.mapInArrow(_bucket_edges(radius), "a long, b long")
    large = buckets.join(sizes.where(F.col("n") > bucket_limit), ["mask", "key"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(64)))
    around = large.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    near = around.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 1:
        near = near.where(F.array_contains("fps", F.col("point")))
    hub = F.col("point") if radius == 1 else F.array_min("fps")
    star = near.select(F.explode("fps").alias("a"), hub.alias("b")).where("a <> b")
    return edges.unionByName(star)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every
    node but the roots.  Large-star and small-star rounds until nothing moves."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, tie, fp, component_id): one row per document."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, radius, bucket_limit)).select(F.col("node").alias("fp"), "root")
    grouped = nodes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = stage(grouped.join(named, "root").select("fp", F.col("root").alias("component"), "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", "tie", "fp", "component_id", "component")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near duplicates: of each component the document with the
    smallest doc_id stays, of its texts the one with the smallest hash, and of rows that repeat
    both the first by their columns as JSON.  The choice is made on fingerprint rows, so a
    doc_id with several texts loses none that is alone in its component.  Rows without a doc_id stay."""
    known = near_duplicates(docs, shingle, radius).where(F.col("doc_id").isNotNull())
    chosen = known.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("c"), F.count(F.lit(1)).alias("n")).select("c.*", "n")
    chosen = chosen.select(F.col("doc_id").alias("_stay_id"), F.col("tie").alias("_stay_tie"), (F.col("n") > 1).alias("_several"))
    kept = docs.join(chosen, (F.col("doc_id").cast("long") == F.col("_stay_id")) & (_tie() == F.col("_stay_tie")))
    row = F.struct(*docs.columns)
    several = kept.where("_several").groupBy("_stay_id", "_stay_tie").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.where("NOT _several").select(docs.columns).unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
