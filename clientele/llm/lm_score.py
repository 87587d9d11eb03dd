"""Operator 4 -- language-model scoring with a log-bilinear model.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token.
Documents whose crc32(doc_id as text) mod 7 is not 2 are trained on; the others are
held out.

*Counts.*  Every training token is counted.  The base score of a text is the sum of
log10((c + 1) / (N + V + 1)) over its tokens.

*Model.*  The ``vocab - 1`` most frequent tokens have a number each, all others share
one.  The next token's score after two tokens is q . Q[w] + b[w] with
q = C1 R[w1] + C2 R[w2].  It is trained with noise-contrastive estimation against the
unigram distribution, in numpy: every task runs over its own training texts from the
same start, and the parameters are averaged, weighted by tokens, in a tree of tasks.
``rounds`` such passes follow one another.  Scoring is normalised: contexts are
made distinct per block, and batched matrix products give the log-softmax over the
whole vocabulary.  A token outside the vocabulary has the shared entry's
probability times its own share, (c + 1) over that sum for all such tokens and one
unseen, so the model is a distribution over all texts.

Scale.  At most ``head`` most frequent tokens travel to the tasks (a fixed bound); all
other tokens are counted per document and joined with the sharded counts.  Partial
counts are summed per task first.  Texts are read in pieces.

Defined cases.  A null or empty text is its end token.  A null doc_id reads as the
empty text under crc32 (0: trained on).  Rows equal in doc_id and text are trained
on each and scored as one result row.  An empty training set gives every token
count 0 and the model's score equals the base score.  An empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import ship, shipped, stage, table, utf8

END = b"\n"            # no word holds a line end
VOCAB, DIM = 512, 24
HEAD = 1 << 17
NOISE, BATCH, RATE = 64, 2048, 0.05
ROUNDS = 1
FLUSH = 400_000
PIECE = 1 << 20


def token_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text in pieces; a very long word is named by its hash."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].lower().split()
        if end - at > 64 and max(map(len, words), default=0) > 64:
            words = [w if len(w) <= 64 else b"\xff" + xxhash.xxh3_128_digest(w) for w in words]
        if words:
            yield words
        at = end
    yield [END]


def _texts(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), held.alias("held_out"), utf8().alias("text"))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over the training texts."""
    def sent(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        for batch in batches:
            for text in batch.column(0):
                for words in token_pieces(text.as_py()):
                    c.update(words)
                if len(c) > FLUSH:
                    yield sent(c)
                    c = Counter()
        if c:
            yield sent(c)
    return texts.where("not held_out").select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Params:
    """R: context vectors (one row more, before the text), Q: output vectors, C: one
    matrix for each place of the context, b: biases."""
    R: np.ndarray
    Q: np.ndarray
    C: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, dim: int) -> "Params":
        rng = np.random.default_rng(4)
        v = len(share)
        return cls(rng.normal(0, 0.1, (v + 1, dim)).astype(np.float32), rng.normal(0, 0.1, (v, dim)).astype(np.float32),
                   np.stack([np.eye(dim, dtype=np.float32)] * 2) * 0.5, np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.Q, self.C, self.b)]).astype(np.float64)

    def like(self, flat: np.ndarray) -> "Params":
        out, at = [], 0
        for x in (self.R, self.Q, self.C, self.b):
            out.append(flat[at: at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Params(*out)

    def step(self, c1: np.ndarray, c2: np.ndarray, y: np.ndarray, log_share: np.ndarray, rng, rate: float, past: list) -> None:
        """One noise-contrastive step; the noise words are shared by the batch."""
        noise = np.searchsorted(np.cumsum(np.exp(log_share)), rng.random(NOISE)).clip(max=len(log_share) - 1)
        e1, e2 = self.R[c1], self.R[c2]
        q = e1 @ self.C[0] + e2 @ self.C[1]
        shift = float(np.log(NOISE))                               # a numpy double would turn all that follows into doubles
        up = (q * self.Q[y]).sum(axis=1) + self.b[y] - log_share[y] - shift
        down = q @ self.Q[noise].T + (self.b[noise] - log_share[noise] - shift)
        g_up = 1 / (1 + np.exp(np.clip(up, -30, 30)))              # towards the data
        np.clip(down, -30, 30, out=down)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        g_down = np.divide(-1, down, out=down)                     # away from the noise; in place, as it is large
        g_q = g_up[:, None] * self.Q[y] + g_down @ self.Q[noise]
        d_q = _summed(len(self.Q), y, g_up[:, None] * q) + _summed(len(self.Q), noise, g_down.T @ q)
        d_b = np.bincount(y, g_up, len(self.b)) + np.bincount(noise, g_down.sum(axis=0), len(self.b))
        d_r = _summed(len(self.R), c1, g_q @ self.C[0].T) + _summed(len(self.R), c2, g_q @ self.C[1].T)
        d_c = np.stack([e1.T @ g_q, e2.T @ g_q])
        for i, (x, d) in enumerate(((self.R, d_r), (self.Q, d_q), (self.C, d_c), (self.b, d_b))):  # Adagrad
            d = (d / len(y)).astype(np.float32)
            past[i] += d * d
            x += rate * d / np.sqrt(past[i])

    def log_probs(self, c1: np.ndarray, c2: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of y after (c1, c2)."""
        n = len(self.R)
        key = c1.astype(np.int64) * n + c2
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        edges = np.r_[np.flatnonzero(new), len(key)]
        pair, at = key[edges[:-1]], np.cumsum(new) - 1
        out = np.empty(len(y), np.float64)
        held = np.empty((2, min(1024, len(pair)), len(self.b)), np.float32)
        for lo in range(0, len(pair), 1024):
            hi = min(lo + 1024, len(pair))
            z, e = held[:, : hi - lo]
            np.matmul(self.R[pair[lo:hi] // n] @ self.C[0] + self.R[pair[lo:hi] % n] @ self.C[1], self.Q.T, out=z)
            z += self.b
            z -= z.max(axis=1, keepdims=True)
            total = np.log(np.exp(z, out=e).sum(axis=1))
            mine, row = order[edges[lo]: edges[hi]], at[edges[lo]: edges[hi]] - lo
            out[mine] = z[row, y[mine]] - total[row]
        return out


def _summed(n: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of x added up by their place among n."""
    m = x.shape[1]
    return np.bincount((at[:, None] * m + np.arange(m)).ravel(), x.ravel(), n * m).reshape(n, m)


def _contexts(ids: np.ndarray, starts: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each one; ``before`` stands before a text."""
    c1, c2 = np.r_[before, ids[:-1]], np.r_[before, before, ids[:-2]][: len(ids)]
    c1[starts] = before
    c2[starts] = before
    after = starts + 1
    c2[after[after < len(ids)]] = before
    return c1, c2


def _numbered(batches, number, vocab: int, text_at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token numbers, starts of texts) in blocks of about FLUSH tokens."""
    ids, starts = [], []
    for batch in batches:
        for text in batch.column(text_at):
            starts.append(len(ids))
            for words in token_pieces(text.as_py()):
                ids.extend(map(number, words, repeat(vocab - 1)))
            if len(ids) >= FLUSH:
                yield np.array(ids), np.array(starts)
                ids, starts = [], []
    if ids:
        yield np.array(ids), np.array(starts)


def fit(texts: DataFrame, names: list[bytes], share: np.ndarray, dim: int = DIM, rounds: int = ROUNDS, rate: float = RATE) -> Params:
    """Average of the tasks' models after each pass over all training texts."""
    spark, params = texts.sparkSession, Params.start(share, dim)
    for _ in range(rounds):
        sent = ship(spark, (params, {w: i for i, w in enumerate(names)}, np.log(share).astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, numbers, log_share = shipped(sent)
            rng, total = np.random.default_rng(7), 0
            past = [np.full(x.shape, 1e-8, np.float32) for x in (own.R, own.Q, own.C, own.b)]
            for ids, starts in _numbered(batches, numbers.get, len(log_share), 0):
                c1, c2 = _contexts(ids, starts, len(log_share))
                order = rng.permutation(len(ids))
                for lo in range(0, len(ids), BATCH):
                    pick = order[lo: lo + BATCH]
                    own.step(c1[pick], c2[pick], ids[pick], log_share, rng, rate, past)
                total += len(ids)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([(own.flat() * total).tobytes()], pa.binary()), pa.array([total], pa.int64())], ["data", "tokens"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, total = None, 0
            for batch in batches:
                for data, n in zip(batch.column(0), batch.column(1).to_pylist()):
                    x = np.frombuffer(data.as_py())
                    flat, total = x + (0 if flat is None else flat), total + n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([total], pa.int64())], ["data", "tokens"])
        kind = "data binary, tokens long"
        parts = texts.where("not held_out").select("text").mapInArrow(run, kind).repartition(8).mapInArrow(merged, kind).collect()
        if parts:
            params = params.like(sum(np.frombuffer(p.data) for p in parts) / sum(p.tokens for p in parts))
    return params


@dataclass
class Scorer:
    params: Params
    vocab: int
    head: dict[bytes, int]       # token -> place by frequency; the first vocab - 1 are the model's
    base: np.ndarray             # log10 base probability by place
    tail: np.ndarray             # log10 share among the tokens outside the vocabulary, 0 inside

    def run(self, texts: list[bytes], rest_too: bool = True):
        """Per text (tokens, tokens in the head, base, model), and the counts of the rest
        (empty without ``rest_too``)."""
        ids, starts, rest = [], [], []
        for text in texts:
            starts.append(len(ids))
            others = Counter()
            for words in token_pieces(text):
                found = list(map(self.head.get, words, repeat(-1)))
                if rest_too and -1 in found:
                    others.update(w for w, i in zip(words, found) if i < 0)
                ids += found
            rest.append(others)
        ids, starts = np.array(ids), np.array(starts)
        known = ids >= 0
        y = np.where(known & (ids < self.vocab - 1), ids, self.vocab - 1)
        c1, c2 = _contexts(y, starts, self.vocab)
        model = self.params.log_probs(c1, c2, y) / np.log(10)
        if len(self.base):
            model += np.where(known, self.tail[ids], 0.0)
            base = np.where(known, self.base[ids], 0.0)
        else:
            base = np.zeros(len(ids))
        add = lambda x: np.add.reduceat(x, starts)
        return np.diff(np.r_[starts, len(ids)]), add(known.astype(np.int64)), add(base), add(model), rest


def _scored(sent, tails: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shipped(sent)
        for batch in batches:
            held, size, first = [], 0, 0
            for i in range(batch.num_rows):
                held.append(batch.column(3)[i].as_py())
                size += len(held[-1])
                if size < PIECE and i + 1 < batch.num_rows:
                    continue
                part = batch.slice(first, len(held))
                first, size = i + 1, 0
                if tails:
                    rest = []
                    for text in held:
                        c = Counter()
                        for words in token_pieces(text):
                            c.update(filterfalse(scorer.head.__contains__, words))
                        rest.append(c)
                    doc = pa.array(np.repeat(np.arange(len(rest)), [len(c) for c in rest]))
                    tokens = [w for c in rest for w in c]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(tokens, pa.binary()), pa.array([n for c in rest for n in c.values()], pa.int64())],
                                                     ["doc_id", "tag", "token", "tf"])
                else:
                    n, known, base, model, _ = scorer.run(held, rest_too=False)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n), pa.array(known), pa.array(base), pa.array(model)],
                                                     ["doc_id", "tag", "held_out", "n_tokens", "n_known", "base", "model"])
                held = []
    return run


def frequent(counts: DataFrame, most: int) -> list:
    """The most frequent tokens, ``most`` of them or as many fewer as share the last
    step of counts (an eighth of a doubling), by falling count: a few hundred sums
    find the count to start from, so only these rows reach the driver."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True):
        total += r.tokens
        if total > most:
            break
        least = r.step
    if least is None:
        return []
    return sorted(counts.where(step >= least).collect(), key=lambda r: (-r.n, bytes(r.token)))


def score(docs: DataFrame, vocab: int = VOCAB, dim: int = DIM, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark, texts = docs.sparkSession, _texts(docs)
    counts = stage(token_counts(texts), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total.n or 0, total.v
    top = frequent(counts, head)
    names = [bytes(r.token) for r in top]
    c = np.array([r.n for r in top], float)
    inside = min(vocab - 1, len(names))
    # the tokens outside the vocabulary, and one unseen
    outside = float(n - c[:inside].sum() + (v - inside) + 1)
    share = np.r_[c[:inside], max(1.0, n - c[:inside].sum())]
    share = share / share.sum()
    params = fit(texts, names[:inside], share, dim, rounds)
    every = float(n + v + 1)
    tail = np.log10((c + 1) / outside)
    tail[:inside] = 0.0
    scorer = Scorer(params, inside + 1, {w: i for i, w in enumerate(names)}, np.log10((c + 1) / every), tail)
    sent = ship(spark, scorer)
    sums = texts.mapInArrow(_scored(sent, False), "doc_id long, tag long, held_out boolean, n_tokens long, n_known long, base double, model double").withColumn("copies", F.lit(1))
    others = texts.select("doc_id", "tag", "held_out", "text").mapInArrow(_scored(sent, True), "doc_id long, tag long, token binary, tf long")
    found = others.join(counts, "token", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    none = F.lit(None)
    more = found.select("doc_id", "tag", none.cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).cast("long").alias("n_known"),
                        (F.col("tf") * F.log10((F.col("c") + 1) / F.lit(every))).alias("base"), (F.col("tf") * F.log10((F.col("c") + 1) / F.lit(outside))).alias("model"), F.lit(0).alias("copies"))
    both = sums.unionByName(more).groupBy("doc_id", "tag").agg(
        F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "model", "copies")))
    per = F.col("copies")
    return both.select("doc_id", "held_out", (F.col("n_tokens") / per).cast("long").alias("n_tokens"), (F.col("n_known") / per).cast("long").alias("n_known"),
                       F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / per).alias("base_score"), (F.col("model") / per).alias("score"))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
