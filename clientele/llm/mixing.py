"""Operator 6 -- mixing to target weights by soft domain membership.

Domains are the classes of the label table (``clean``, ``low`` quality, ``toxic``).
Two logistic classifiers over hashed presence of words, their first four bytes and
their shapes, toxic against the rest and low against good quality, give every document
a posterior p over the domains: toxic, else low, else clean.  A document that is both
counts as toxic, and low wording says nothing against that.  With n its words and r its rate
(expected copies), a domain's expected total is E_d = sum r n p_d.  The rates solve

    minimise  1/2 sum_d (E_d - T_d)^2 / (N S_d)  +  l/2 sum n/N (r - 1)^2,   0 <= r <= max_rate

where T is the target, N all words and S_d the domain's natural total, so each
target counts in proportion to its domain.  Projected gradient descent runs on the
cluster: a step changes r by a function of the document's own p and of the last
residual vector, so a document's rate is replayed from the short history of
residuals, and a round is one pass over (n, p) that returns a handful of sums.

Scale.  No shuffle of texts, no join: training data are a bounded sample of
labelled documents (``max_per_class``, smallest hash of doc_id first); posteriors
are staged once as a few numbers per document; residuals are a few numbers per
round.

Defined cases.  A null or empty text has no words and posterior of the classifier's
bias.  A toxic mark counts whatever the quality; other labels with a null quality are
left out, a null toxic mark is 0; of several label rows of a document the worst class
counts.  Without labels every document
is ``clean``.  Null and repeated doc_ids are rows like any other (each row has its
own rate; the draw for fractions is by doc_id and text).  ``mix`` keeps all
columns.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import ship, shipped, stage, table, utf8, worker_cache

DOMAINS = ("clean", "low", "toxic")
BUCKETS = 1 << 18
MAX_PER_CLASS = 2000
SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
REPEAT = re.compile(rb"(.)\1+", re.S)
PIECE = 1 << 20


def _buckets(w: bytes, shapes: dict, heads: dict) -> tuple[int, int, int]:
    """Buckets of a word, of its first four bytes and of its shape; the last two recur and are looked up."""
    form = w.translate(SHAPE)
    shape = shapes.get(form)
    if shape is None:
        shape = shapes[form] = zlib.crc32(REPEAT.sub(rb"\1", form)[:32], 77) % BUCKETS
    word = w.lower().strip(b".,;:!?()[]\"'")
    start = word[:4]
    head = heads.get(start)
    if head is None:
        head = heads[start] = zlib.crc32(start, 99) % BUCKETS
    return zlib.crc32(word) % BUCKETS, head, shape


def features(text: bytes) -> tuple[int, np.ndarray]:
    """(number of words, distinct feature buckets) of a text."""
    cache = worker_cache("mixing-features")
    known, shapes, heads = (cache.setdefault(k, {}) for k in ("words", "shapes", "heads"))
    n, found = 0, set()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        n += len(words)
        words = set(words)
        new = words.difference(known)
        if max(len(known) + len(new), len(shapes), len(heads)) > 150_000:
            for held in (known, shapes, heads):
                held.clear()
            new = set(words)
        for w in new:
            if len(w) < 64:
                known[w] = _buckets(w, shapes, heads)
            else:
                found.update(_buckets(w, {}, {}))
                words.discard(w)
        found.update(chain.from_iterable(map(known.__getitem__, words)))
        at = end
    return n, np.fromiter(found, np.int32, len(found))


@dataclass
class Classifier:
    weight: np.ndarray  # BUCKETS x 2: log odds of toxic and of low
    bias: np.ndarray

    def posterior(self, found: np.ndarray) -> np.ndarray:
        z = self.bias + (self.weight[found].sum(axis=0) if len(found) else 0)
        toxic, low = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return np.array([(1 - toxic) * (1 - low), (1 - toxic) * low, toxic])


def fit(rows: list[tuple[int, np.ndarray]], n_classes: int, least_df: int = 4, least_z: float = 5.0, rounds: int = 200, rate: float = 0.1,
        l2: float = 3e-4, balance: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by class: full-batch logistic regression with Adam, over the buckets that stand in ``least_df``
    documents or more and whose presence tells some class apart (``least_z`` deviations)."""
    weight, bias = np.zeros((BUCKETS, n_classes)), np.zeros(n_classes)
    if not rows:
        bias[0] = 50.0
        return weight, bias
    seen = np.stack([np.bincount(np.concatenate([x for c, x in rows if c == k] or [[]]).astype(int), minlength=BUCKETS) for k in range(n_classes)], axis=1)
    df, of = seen.sum(axis=1, keepdims=True), np.bincount([c for c, _ in rows], minlength=n_classes)
    share = of / len(rows)
    # signed root of each bucket's chi-square against each class
    z = (seen - df * share) / np.sqrt(np.maximum(df * share * (1 - share) * (1 - df / (len(rows) + 1)), 1e-9))
    used = np.flatnonzero((df[:, 0] >= least_df) & (np.abs(z).max(axis=1) >= least_z))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    held = [place[x][place[x] >= 0] for _, x in rows]
    size = np.array([len(x) for x in held])
    col = np.concatenate(held).astype(int)
    row = np.repeat(np.arange(len(rows)), size)
    y = np.eye(n_classes)[[c for c, _ in rows]]
    share = of.clip(1)
    importance = ((len(rows) / n_classes / share) ** balance)[y.argmax(axis=1)][:, None]
    w, b = np.zeros((len(used), n_classes)), np.zeros(n_classes)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        z = b + np.stack([np.bincount(row, w[col, c], minlength=len(rows)) for c in range(n_classes)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        err = (z / z.sum(axis=1, keepdims=True) - y) * importance / len(rows)
        grad = [np.stack([np.bincount(col, err[row, c], minlength=len(used)) for c in range(n_classes)], axis=1) + l2 * w, err.sum(axis=0)]
        for k, x in enumerate((w, b)):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            x -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    weight[used] = w
    return weight, b


def odds(rows: list[tuple[int, np.ndarray]]) -> Classifier:
    """Rows of (mark, feature buckets); a mark is 0 good, 1 low, 2 unknown quality, and 3 more if toxic."""
    made = [fit([(k // 3, x) for k, x in rows], 2), fit([(k % 3, x) for k, x in rows if k % 3 < 2], 2)]
    return Classifier(np.stack([w[:, 1] - w[:, 0] for w, _ in made], axis=1).astype(np.float32), np.array([b[1] - b[0] for _, b in made]))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Classifier:
    spark = docs.sparkSession
    of = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg((F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("toxic"), F.min("quality").alias("quality"))
    low = F.when(F.col("quality") == 0, 1).when(F.col("quality").isNull(), 2).otherwise(0)
    kind = F.when(F.col("toxic"), 2).when(F.col("quality") == 0, 1).otherwise(0)
    of, wanted = of.select("doc_id", kind.alias("kind"), (F.col("toxic").cast("int") * 3 + low).alias("mark")), {}
    for k in range(len(DOMAINS)):
        wanted |= {r.doc_id: r.mark for r in of.where(F.col("kind") == k).orderBy(F.xxhash64("doc_id")).limit(max_per_class).collect()}
    sent = ship(spark, (np.array(sorted(wanted), np.int64), np.array([wanted[d] for d in sorted(wanted)], np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kinds = shipped(sent)
        for batch in batches:
            doc = batch.column(0).fill_null(-1).to_numpy()
            mine = np.flatnonzero(np.isin(doc, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            out = [(int(kinds[np.searchsorted(ids, doc[i])]), features(batch.column(1)[int(i)].as_py())[1].tobytes()) for i in mine]
            yield pa.RecordBatch.from_arrays([pa.array([int(doc[i]) for i in mine], pa.int64()), pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["doc_id", "kind", "found"])
    if not wanted:
        return odds([])
    got = docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, kind int, found binary")
    got = got.groupBy("doc_id").agg(F.max("kind").alias("kind"), F.max("found").alias("found"))  # one row where rows share an id
    rows = [(r.kind, np.frombuffer(r.found, np.int32)) for r in got.orderBy("doc_id").toLocalIterator()]
    return odds(rows)


def _measured(text: bytes, model: Classifier) -> tuple[int, np.ndarray]:
    n, found = features(text)
    return n, model.posterior(found)


@dataclass
class Rates:
    """The fitted rates as their history: a document's rate is replayed from its posterior."""
    scaled: np.ndarray    # rounds x domains: residuals times each domain's weight
    step: float
    pull: float
    max_rate: float

    def of(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for e in self.scaled:
            r = np.clip(r - self.step * (p @ e + self.pull * (r - 1)), 0.0, self.max_rate)
        return r


def solve(measured: DataFrame, targets, max_rate: float, pull: float = 0.02, rounds: int = 40, tolerance: float = 1e-4) -> Rates:
    """``measured``: (n, p array).  ``targets``: natural totals -> target totals."""
    spark, d = measured.sparkSession, len(DOMAINS)

    def totals(rates: Rates) -> np.ndarray:
        sent = ship(spark, rates)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rates, out = shipped(sent), np.zeros(d)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column(1).flatten().to_numpy().reshape(-1, d)
                    out += (rates.of(p) * batch.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [f"e{i}" for i in range(d)])
        got = measured.mapInArrow(run, ", ".join(f"e{i} double" for i in range(d)))
        row = got.agg(*(F.sum(f"e{i}").alias(f"e{i}") for i in range(d))).first()
        return np.array([x or 0.0 for x in row])
    rates = Rates(np.zeros((0, d)), 0.5, pull, max_rate)
    natural = totals(rates)
    if natural.sum() == 0:
        return rates
    target, before = np.asarray(targets(natural), float), None
    e = natural
    for _ in range(rounds):
        scaled = (e - target) / np.maximum(natural, 1e-3 * natural.sum())
        rates.scaled = np.vstack([rates.scaled, scaled])
        e = totals(rates)
        if before is not None and np.abs(e - before).max() < tolerance * natural.sum():
            break
        before = e
    return rates


def measure(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n, p, draw): words, posterior, and a number in [0, 1) for fractions."""
    sent = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(sent)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x.as_py() for x in batch.column(1)]
            found = [_measured(t, model) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64())),
                                              pa.array([draw(i, t) for i, t in zip(ids, texts)], pa.float64())], ["doc_id", "n", "p", "draw"])
    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, n long, p array<double>, draw double")


def draw(doc_id: int | None, text: bytes) -> float:
    return xxhash.xxh64_intdigest(text, (doc_id or 0) & 0xFFFFFFFF) / 2.0 ** 64


def weights(**share: float):
    """Targets by shares of all words."""
    return lambda natural: np.array([share.get(d, 0.0) for d in DOMAINS]) * natural.sum()


def multiples(**times: float):
    """Targets by multiples of each domain's natural total."""
    return lambda natural: np.array([times.get(d, 1.0) for d in DOMAINS]) * natural


def rates(docs: DataFrame, labels: DataFrame, targets, max_rate: float = 4.0) -> DataFrame:
    """(doc_id, n_words, p_clean, p_low, p_toxic, rate, copies): one row per row of ``docs``."""
    measured = stage(measure(docs, train(docs, labels)), "mixing-measured")
    found = ship(docs.sparkSession, solve(measured.select("n", "p"), targets, max_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped(found)
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, len(DOMAINS))
            r = fitted.of(p)
            copies = np.floor(r + batch.column(3).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p[:, i]) for i in range(len(DOMAINS))), pa.array(r), pa.array(copies)],
                                             ["doc_id", "n_words", *(f"p_{d}" for d in DOMAINS), "rate", "copies"])
    return measured.mapInArrow(run, "doc_id long, n_words long, p_clean double, p_low double, p_toxic double, rate double, copies long")


def mix(docs: DataFrame, labels: DataFrame, targets, max_rate: float = 4.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all columns."""
    model = train(docs, labels)
    fitted = solve(stage(measure(docs, model), "mixing-measured").select("n", "p"), targets, max_rate)
    sent, at = ship(docs.sparkSession, (model, fitted)), (docs.columns.index("doc_id"), docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted = shipped(sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [(t or "").encode() for t in batch.column(at[1]).to_pylist()]
            p = np.array([_measured(t, model)[1] for t in texts])
            u = np.array([draw(i, t) for i, t in zip(batch.column(at[0]).to_pylist(), texts)])
            copies = np.floor(fitted.of(p) + u).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
    return docs.mapInArrow(run, docs.schema)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights(clean=0.92, low=0.06, toxic=0.02))
