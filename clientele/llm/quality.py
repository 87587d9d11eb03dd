"""Operator 8 -- quality classifier: modified Kneser-Ney perplexity.

An interpolated modified Kneser-Ney model of order 4 over UTF-8 bytes (case kept:
shouting, symbol noise and table debris are what it is to find) is trained on
trusted text: documents that the label table calls good and not toxic.  A
document is rejected when its perplexity per byte lies above the threshold of its
language: ``quantile`` of the trusted documents' perplexities in that language,
times ``slack``.  Every trusted document counts here, whether or not the model was
trained on it.  Both sides of that comparison are smoothed by ``prior`` bytes of
the trusted mean, so a few odd bytes do not condemn a very short text.  A language with too few trusted documents (``least``) uses the
threshold of all languages together.

The model's tables are made by sharded joins keyed by n-gram: counts of the
highest order, continuation counts of the lower ones, totals and counts of
counts per context, and each order's probabilities from the order below.  Of the
finished model the orders up to three (at most 2^24 entries, by the alphabet)
and the ``head`` most frequent 4-grams are broadcast; a document's 4-grams beyond
the head are counted per document and joined with the rest of the table, which
is sharded by n-gram.  Nothing of the model is cut off.

The model is trained on the ``max_trusted`` trusted documents with the smallest hash
of their doc_id (a documented bound; their ids are sent to the tasks, so no text is
shuffled to train).  The mean, the quantiles and the ``least`` test take all trusted
documents, by a join of the scores with the labels.

Defined cases.  A null or empty text is scored as its end symbol alone.  A label
that is null counts as no label; a document with several label rows is trusted
when all of them agree.  Without any trusted document every document is kept,
with a null perplexity.  A null language is a language of its own.  Rows equal in
doc_id, language and text give one result row; ``keep_good`` keeps or drops them
all, null doc_ids included, and keeps all columns.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import release_caches, ship, shipped, stage, table, utf8

ORDER = 4
START, END = 0xFF, 0xFE  # bytes that no UTF-8 text holds
HEAD = 1 << 19
CHUNK = 1 << 20
MAX_TRUSTED = 50_000
QUANTILE, SLACK, LEAST, PRIOR = 0.99, 1.2, 50, 100


def slices(text: bytes) -> Iterator[bytes]:
    """The text between its symbols; a long one in slices that share three bytes."""
    whole = bytes([START]) * (ORDER - 1) + text + bytes([END])
    for at in range(0, len(whole) - ORDER + 1, CHUNK):
        yield whole[at: at + CHUNK + ORDER - 1]


def grams_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the 4-grams of each slice, where each slice's begin)."""
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    grams = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    size = np.array([len(p) - 3 for p in parts])
    begin = np.cumsum(size + 3) - (size + 3)
    if len(parts) > 1:  # without the grams that reach into the next slice
        keep = np.ones(len(grams), bool)
        keep[(begin[1:, None] - 3 + np.arange(3)[None, :]).ravel()] = False
        grams = grams[keep]
    return grams, np.cumsum(size) - size


def _chunks(rows) -> Iterator[list]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def trusted_docs(labels: DataFrame) -> DataFrame:
    """(doc_id) of every document whose labels all call it good and not toxic."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> list[int]:
    """The documents that the model is trained on."""
    return [r.doc_id for r in trusted_docs(labels).orderBy(F.xxhash64("doc_id")).limit(max_trusted).collect()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), utf8().alias("text"))


def gram_counts(texts: DataFrame, ids: list[int]) -> DataFrame:
    """(gram, n) over the texts of these documents."""
    sent = texts.sparkSession.sparkContext.broadcast(np.sort(np.array(ids, np.int64)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        wanted = np.frombuffer(sent.value, np.int64)
        keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in batches:
            doc = batch.column(0).fill_null(-1).to_numpy()
            mine = np.isin(doc, wanted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for part in _chunks((p,) for x in batch.column(1).filter(pa.array(mine)) for p in slices(x.as_py())):
                k, n = np.unique(grams_of([t for (t,) in part])[0], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["gram", "n"])
    return texts.select("doc_id", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted keys and natural logs: p[k] of k-grams, back[k] of contexts of
    k - 1 bytes.  p[4] holds the head only; ``whole`` when that is all of it."""
    p: dict[int, tuple[np.ndarray, np.ndarray]]
    back: dict[int, tuple[np.ndarray, np.ndarray]]
    whole: bool

    @staticmethod
    def _look(found, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there) for each key."""
        held, value = found
        if not len(held):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        there = held[at] == keys
        return np.where(there, value[at], 0.0), there

    def lower(self, grams: np.ndarray) -> np.ndarray:
        """ln of each 4-gram's probability if the table of order 4 does not hold it."""
        grams = grams.astype(np.int64)
        out = np.full(len(grams), -np.log(258.0))
        for k in range(1, ORDER):
            value, there = self._look(self.p[k], grams & ((1 << 8 * k) - 1))
            back, _ = self._look(self.back[k], (grams & ((1 << 8 * k) - 1)) >> 8)
            out = np.where(there, value, out + back)
        return out + self._look(self.back[ORDER], grams >> 8)[0]


def train(counts: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The broadcast part of the model, and the table (gram, delta) of the
    4-grams beyond the head: what their own probability adds to ``lower``."""
    spark = counts.sparkSession
    grams = {ORDER: stage(counts, "kn-counts")}
    for k in range(ORDER - 1, 0, -1):  # in how many longer n-grams does it stand at the end
        longer = grams[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("gram"))
        grams[k] = stage(longer.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "kn-counts")
    p = {0: None}
    back = {}
    for k in range(1, ORDER + 1):
        n = [grams[k].agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()[j] for j in range(4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        cut = [min(i, max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.0 for i in (1, 2, 3)]
        c = F.col("n")
        taken = F.when(c == 1, cut[0]).when(c == 2, cut[1]).otherwise(cut[2])
        rows = grams[k].select("gram", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1).cast("long")).alias("suffix"),
                               c.cast("double").alias("n"), taken.alias("taken"))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("gamma"))
        back[k] = totals.select(F.col("context").alias("gram"), (F.col("gamma") / F.col("total")).alias("value"))
        rows = rows.join(totals, "context")
        under = F.lit(1 / 258)
        if k > 1:
            rows = rows.join(p[k - 1].select(F.col("gram").alias("suffix"), F.col("value").alias("under")), "suffix")
            under = F.col("under")
        value = (F.col("n") - F.col("taken") + F.col("gamma") * under) / F.col("total")
        # what an unseen n-gram of this context would have got
        p[k] = stage(rows.select("gram", value.alias("value"), (F.col("gamma") / F.col("total") * under).alias("unseen"), "n"), "kn-p")
    size = p[ORDER].count()
    top = p[ORDER].orderBy(F.desc("n"), "gram").limit(head).select("gram", "value") if size > head else p[ORDER].select("gram", "value")
    held = {k: _sorted(p[k]) for k in range(1, ORDER)} | {ORDER: _sorted(top)}
    model = Model(held, {k: _sorted(back[k]) for k in range(1, ORDER + 1)}, size <= head)
    rest = p[ORDER].select("gram", (F.log("value") - F.log("unseen")).alias("delta"))
    if size > head:
        rest = rest.join(spark.createDataFrame([(int(g),) for g in held[ORDER][0]], "gram long"), "gram", "left_anti")
    else:
        rest = rest.limit(0)
    return model, rest


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("gram", F.log("value").alias("value")).toArrow()
    order = np.argsort(got["gram"].to_numpy())
    value = got["value"].to_numpy()[order]
    return got["gram"].to_numpy()[order], np.nan_to_num(value, neginf=-50.0)


def _scored(sent, tails: bool):
    """Per document the sum with the broadcast part; or (tails) its counts of the
    4-grams beyond the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        model: Model = shipped(sent)
        for batch in batches:
            rows = ((*row, int(k == 0), p) for *row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3))
                    for k, p in enumerate(slices(text.as_py())))
            for part in _chunks(rows):
                grams, begin = grams_of([r[-1] for r in part])
                keys, at = np.unique(grams, return_inverse=True)
                own, there = model._look(model.p[ORDER], keys.astype(np.int64))
                ids = [pa.array([r[i] for r in part], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()))]
                if not tails:
                    value = np.where(there, own, model.lower(keys))
                    sums = np.add.reduceat(value[at], begin)
                    size = np.diff(np.r_[begin, len(grams)])
                    copies = pa.array([r[3] for r in part], pa.int32())
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(size), pa.array(sums), copies], ["doc_id", "lang", "tag", "n", "ll", "copies"])
                else:
                    out = np.flatnonzero(~there[at])
                    doc = np.searchsorted(begin, out, side="right") - 1
                    pair, n = np.unique(doc.astype(np.int64) << 32 | grams[out], return_counts=True)
                    ids = [x.take(pa.array(pair >> 32)) for x in ids]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(pair & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["doc_id", "lang", "tag", "gram", "n"])
    return run


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """(doc_id, lang, tag, n, perplexity): ``tag`` is the text's hash."""
    texts, sent = _texts(docs), ship(docs.sparkSession, model)
    sums = texts.mapInArrow(_scored(sent, False), "doc_id long, lang string, tag long, n long, ll double, copies int")
    if not model.whole:
        tails = texts.mapInArrow(_scored(sent, True), "doc_id long, lang string, tag long, gram long, n long")
        more = tails.join(rest, "gram").select("doc_id", "lang", "tag", F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("delta")).alias("ll"), F.lit(0).alias("copies"))
        sums = sums.unionByName(more)
    total = sums.groupBy("doc_id", "lang", "tag").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.sum("copies").alias("copies"))
    return total.select("doc_id", "lang", "tag", (F.col("n") / F.col("copies")).cast("long").alias("n"), F.exp(-F.col("ll") / F.col("n")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST, prior: int = PRIOR,
             max_trusted: int = MAX_TRUSTED, head: int = HEAD) -> DataFrame:
    """(doc_id, lang, tag, n, perplexity, smoothed, threshold, keep), one row per distinct document."""
    ids = trusted_ids(labels, max_trusted)
    counts = stage(gram_counts(_texts(docs), ids), "kn-grams")
    if counts.isEmpty():
        none = F.lit(None).cast("double")
        return _texts(docs).select("doc_id", "lang", "tag", (F.length("text") + 1).cast("long").alias("n"), none.alias("perplexity"), none.alias("smoothed"), none.alias("threshold"), F.lit(True).alias("keep")).distinct()
    scored = stage(score(docs, *train(counts, head)), "kn-scores")
    trusted = stage(scored.join(trusted_docs(labels), "doc_id", "left_semi").select("lang", "n", "perplexity"), "kn-trusted")
    mean = trusted.agg(F.sum(F.col("n") * F.log("perplexity")) / F.sum("n")).first()[0]
    smoothed = F.exp((F.col("n") * F.log("perplexity") + prior * mean) / (F.col("n") + prior))
    scored, trusted = scored.withColumn("smoothed", smoothed), trusted.withColumn("smoothed", smoothed)
    level = F.percentile_approx("smoothed", quantile, 10_000).alias("level")
    by_lang = {r.lang: r.level for r in trusted.groupBy("lang").agg(level, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    overall = trusted.agg(level).first().level
    limit = F.lit(overall * slack)
    for lang, x in by_lang.items():  # as many as there are languages
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), x * slack).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("keep", F.col("smoothed") <= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bad = classify(docs, labels, **params).where("not keep").select(F.col("doc_id").alias("_bad_id"), F.col("tag").alias("_bad_tag"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_bad_tag"))
    return docs.join(bad.distinct(), same, "left_anti")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n", "perplexity", "smoothed", "threshold", "keep")
