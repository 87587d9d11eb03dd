"""Operator 7 -- exact top-k search by term-at-a-time accumulation.

Component x of a vector becomes the integer weight floor(64 x); the score of a
candidate is the integer inner product with the query.  Dimensions are terms:
a candidate block keeps, for each dimension, its postings (candidate, weight)
with a non-zero weight; a query row is the sparse list of its own non-zero
dimensions.  Term after term a query scatters its weight times the posting weights
into a dense score array over the block's candidates; partition selection takes the
k best of the block, and a ranked window merges the blocks.
The search is exhaustive: every candidate is scored, nothing is pruned.

Scale.  Queries and candidates are packed into blocks of fixed size; one task
group scores one block of queries against one block of candidates, so memory is
bounded by the two block sizes and a hot vector is just one row of a block.

Defined cases.  Vectors that are null or hold a null, NaN or infinite component
take no part; rows with a null vec_id neither.  Vectors of different lengths
meet in their common dimensions (an empty vector scores 0).  Ties go to the
smaller vec_id.  Repeated rows are candidates each; a query id occurs once as
query, with its smallest vector, and no row with its own id is a candidate.
Weights beyond 64 bits saturate, and scores wrap like Java longs.  Empty
tables give an empty result.  Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import table

Q_BLOCK, C_BLOCK = 1024, 8192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, w): the vectors that take part, as integer weights."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    top = float(2 ** 63 - 1024)
    weight = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * 64, F.lit(top)), F.lit(-top))).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False))) \
        .select(F.col(id_col).cast("long").alias("vec_id"), weight.alias("w"))


def _matrix(t: pa.Table) -> np.ndarray:
    """Weights as rows, shorter vectors filled with zero."""
    rows = t["w"].combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    flat = rows.values.to_numpy()[rows.offsets[0].as_py():]
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat[: int(size.sum())]
    return out


class Postings:
    """A candidate block by dimension: the candidates that hold it, with their weights.
    A dimension that most candidates hold is kept for all of them, zeros included."""

    def __init__(self, c: np.ndarray):
        self.most = float(np.abs(c.astype(float)).max(initial=0))
        self.n, self.columns = len(c), np.ascontiguousarray(c.T)
        self.held = [np.flatnonzero(x) for x in self.columns]
        self.cast: dict = {}

    def scores(self, dims: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One sparse query's dense score array, one term after another."""
        bound = self.most * float(np.abs(weights.astype(float)).max(initial=0)) * max(len(dims), 1)
        kind = np.int32 if bound < 2 ** 31 else np.int64
        if kind not in self.cast:
            self.cast[kind] = self.columns.astype(kind), np.empty(self.n, kind)
        columns, part = self.cast[kind]
        out = np.zeros(self.n, kind)
        for d, w in zip(dims.tolist(), weights.astype(kind)):
            at = self.held[d]
            if 4 * len(at) >= self.n:
                np.multiply(columns[d], w, out=part)
                out += part
            else:
                out[at] += columns[d, at] * w
        return out


def _best(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        c_id = candidates["vec_id"].to_numpy()
        order = np.argsort(c_id, kind="stable")
        c_id, block = c_id[order], Postings(_matrix(candidates)[order])
        q_id, q = queries["vec_id"].to_numpy(), _matrix(queries)[:, : len(block.columns)]
        out = [[], [], []]
        for query, row in zip(q_id, q):
            dims = np.flatnonzero(row)
            s = block.scores(dims, row[dims])
            lo, hi = np.searchsorted(c_id, query, "left"), np.searchsorted(c_id, query, "right")
            s, ids = (np.delete(s, slice(lo, hi)), np.delete(c_id, slice(lo, hi))) if lo < hi else (s, c_id)
            pick = np.arange(len(s))
            if len(s) > k:  # the k-th score, all above it, and of its ties the smallest ids
                kth = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > kth)
                pick = np.r_[above, np.flatnonzero(s == kth)[: k - len(above)]]
            for x, y in zip(out, (np.full(len(pick), query), ids[pick], s[pick].astype(np.int64))):
                x.append(y)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table([pa.array(x, pa.int64()) for x in flat], names=["query_id", "vec_id", "score"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, q_block: int = Q_BLOCK, c_block: int = C_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ``usable`` rows of both sides."""
    queries = queries.groupBy("vec_id").agg(F.min("w").alias("w"))
    n_q, n_c = max(1, -(-queries.count() // q_block)), max(1, -(-candidates.count() // c_block))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_c)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = candidates.select("vec_id", "w", block.alias("c")).select("vec_id", "w", "c", every(n_q).alias("q"))
    right = queries.select("vec_id", "w", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("q")).select("vec_id", "w", "q", every(n_c).alias("c"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_best(k), "query_id long, vec_id long, score long")
    ranked = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
