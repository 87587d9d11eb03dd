"""Operator 13 -- spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into
the other.  The vocabulary is cut by word length; every length gets blocked Bloom
filters (a block of 512 bits, one bit in each of its eight 64-bit lanes).  Each word
generates its edits -- deletions, and replacements by a greater letter, so that
every near pair is generated once -- as hashes, never as strings: the hash is a
sum of letter times coefficient, so an edit changes one term.  Only hashes that a
broadcast filter lets through become strings, and these are joined with the
vocabulary itself, which removes the false positives.

Scale.  Words are counted inside the tasks and combined before the shuffle.  A length
with many words has several filter segments by hash, each built in its own group
of about ``SEGMENT_KEYS`` words, so one frequent length is many groups.  A pass over
the vocabulary broadcasts at most ``PASS_BYTES`` of segments (one segment is about
256 KB); a larger vocabulary takes more passes, each of which generates the edits
of the lengths it holds.  No word has more near words than edits, so a word's
group is bounded; roots follow forms by pointer doubling over joins.

Defined cases.  Null and empty texts have no words; a null doc_id counts as the empty
string in the checksum.  Repeated rows count each.  A letter deleted at either of two equal
neighbours gives one word, counted as one near word.  Long texts are read in slices of
their runs.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import stage, table, utf8

RUNS_AT_ONCE = 200_000
HELD = 200_000
LONG = 64
BITS_A_KEY, SEGMENT_KEYS, PASS_BYTES = 16, 1 << 17, 64 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counter(dropped: int, least: int):
    """Runs of letters of whole texts, as (word, n) rows combined within a task."""
    runs = re.compile("[a-zÀ-ÿ]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def table_of():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                found = runs.finditer(text.as_py().translate(_LOWER).decode("utf-8", "replace"))
                while some := Counter(m.group() for m in islice(found, RUNS_AT_ONCE)):
                    for word, n in some.items():
                        if len(word) >= least:
                            h = zlib.crc32(word.encode(), seed)
                            if h % dropped == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < least:
                                    continue
                            held[word] += n
                    if len(held) > HELD:
                        yield table_of()
                        held.clear()
        yield table_of()
    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, dropped: int = 199) -> DataFrame:
    """(word, n): the words of the corpus.  Of every run whose checksum ``dropped`` divides, one letter goes."""
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(_counter(dropped, least_length), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def coefficients(n: int) -> np.ndarray:
    """An odd 64-bit factor for every place in a word."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Rows of equal word length, in blocks that bound the letters at once."""
    rows: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        rows.setdefault(len(w), []).append(i)
    for length, at in rows.items():
        step = max(1, (1 << 20) // length)
        for lo in range(0, len(at), step):
            yield length, at[lo:lo + step]


def _place(h: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bits) of raw hashes; the 16 upper bits choose the block, six each a lane's bit."""
    m = _mixed(h.copy())
    segment = (_mixed(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)) % np.uint64(n_segments) if n_segments > 1 else np.zeros(len(h), np.uint64)
    return segment.astype(np.int64), m


def _block(m: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((m >> np.uint64(48)) * np.uint64(n_blocks) >> np.uint64(16)).astype(np.int64)


class LengthFilter:
    """The segments that a pass holds of one length's filter."""

    def __init__(self, n_segments: int, n_blocks: int, segments: dict[int, bytes]):
        self.n_segments, self.n_blocks = n_segments, n_blocks
        self.at = np.full(n_segments, -1, np.int64)
        for i, s in enumerate(sorted(segments)):
            self.at[s] = i
        self.lanes = np.concatenate([np.frombuffer(segments[s], np.uint64).reshape(n_blocks, 8) for s in sorted(segments)])

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Indices of the raw hashes that all eight lanes let through."""
        segment, m = _place(h, self.n_segments)
        base = self.at[segment]
        left = np.flatnonzero(base >= 0)
        m = m[left]
        row = base[left] * self.n_blocks + _block(m, self.n_blocks)
        for lane in range(8):
            bit = (m >> np.uint64(6 * lane)) & np.uint64(63)
            hit = np.flatnonzero(self.lanes[row, lane] >> bit & np.uint64(1))
            left, m, row = left[hit], m[hit], row[hit]
        return left


def segment_bytes(m: np.ndarray, n_blocks: int) -> bytes:
    lanes = np.zeros((n_blocks, 8), np.uint64)
    row = _block(m, n_blocks)
    for lane in range(8):
        np.bitwise_or.at(lanes[:, lane], row, np.uint64(1) << ((m >> np.uint64(6 * lane)) & np.uint64(63)))
    return lanes.tobytes()


def _shapes(counts: dict[int, int], segment_keys: int) -> dict[int, tuple[int, int]]:
    """length class -> (segments, blocks a segment)."""
    out = {}
    for length, n in counts.items():
        n_segments = -(-n // segment_keys)
        out[length] = n_segments, max(1, min(1 << 16, -(-(n * BITS_A_KEY) // (512 * n_segments))))
    return out


def _hashes(shapes: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = [[], [], []]
            for length, at in _by_length(words):
                kind = min(length, LONG)
                h = (_letters([words[i] for i in at], length) * coefficients(length)).sum(1, dtype=np.uint64)
                segment, m = _place(h, shapes[kind][0])
                for x, y in zip(out, (np.full(len(at), kind, np.int32), segment.astype(np.int32), m.view(np.int64))):
                    x.append(y)
            flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int32, np.int32, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["length", "segment", "m"])
    return run


def filters(vocab: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(length, segment, data): the Bloom filter segments of a vocabulary."""
    def build(group: pa.Table) -> pa.Table:
        length, segment = group["length"][0].as_py(), group["segment"][0].as_py()
        data = segment_bytes(group["m"].to_numpy().view(np.uint64), shapes[length][1])
        return pa.table({"length": pa.array([length], pa.int32()), "segment": pa.array([segment], pa.int32()), "data": pa.array([data], pa.binary())})
    return (vocab.select("word").mapInArrow(_hashes(shapes), "length int, segment int, m long")
            .groupBy("length", "segment").applyInArrow(build, "length int, segment int, data binary"))


def _edits(words: list[str], alphabet: np.ndarray, held: dict[int, LengthFilter]) -> Iterator[tuple[int, str]]:
    """(row, edited word) for the edits that the filters let through."""
    for length, at in _by_length(words):
        same, shorter = held.get(min(length, LONG)), held.get(min(length - 1, LONG))
        if same is None and shorter is None:
            continue
        letters, coef = _letters([words[i] for i in at], length), coefficients(length)
        terms = letters * coef
        if same is not None:
            whole = terms.sum(1, dtype=np.uint64)
            for i in range(length):
                row, col = np.nonzero(alphabet[None, :] > letters[:, i, None])
                h = whole[row] + (alphabet[col].astype(np.uint64) - letters[row, i].astype(np.uint64)) * coef[i]
                for k in same.may_hold(h).tolist():
                    w = words[at[row[k]]]
                    yield at[row[k]], f"{w[:i]}{chr(alphabet[col[k]])}{w[i + 1:]}"
        if shorter is not None and length > 1:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            moved = letters[:, 1:] * coef[:-1]
            after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            for i in range(length):
                row = np.flatnonzero(letters[:, i] != letters[:, i + 1]) if i < length - 1 else np.arange(len(at))
                h = before[row, i] + (after[row, i] if i < length - 1 else np.uint64(0))
                for k in shorter.may_hold(h).tolist():
                    w = words[at[row[k]]]
                    yield at[row[k]], w[:i] + w[i + 1:]


def _probe(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, parts = sent.value
        held = {length: LengthFilter(*shape, segments) for length, (shape, segments) in parts.items()}
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = list(_edits(words, alphabet, held))
            yield pa.RecordBatch.from_arrays([pa.array([e for _, e in found], pa.string()), pa.array([words[i] for i, _ in found], pa.string()),
                                              pa.array([counts[i] for i, _ in found], pa.int64())], ["edit", "word", "n"])
    return run


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        seen |= set("".join(batch.column(0).to_pylist()).encode("latin-1"))
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["letter"])


def near_pairs(vocab: DataFrame, segment_keys: int = SEGMENT_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, edit, edit_n): every pair of near words once, for a staged vocabulary of
    Latin-1 words."""
    spark: SparkSession = vocab.sparkSession
    size = F.least(F.length("word"), F.lit(LONG))
    counts = {r.length: r.n for r in vocab.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    alphabet = vocab.select("word").mapInArrow(_alphabet, "letter int").distinct().collect()  # at most 256 rows
    alphabet = np.array(sorted(r.letter for r in alphabet), np.uint8)
    shapes = _shapes(counts, segment_keys)
    built = stage(filters(vocab, shapes), "spelling-filters")
    passes, room = [], 0
    for length in sorted(shapes):
        n_segments, n_blocks = shapes[length]
        for s in range(n_segments):
            if not passes or room < 64 * n_blocks:
                passes.append([])
                room = pass_bytes
            passes[-1].append((length, s))
            room -= 64 * n_blocks
    found = None
    for wanted in passes:
        lengths, (lo, hi) = sorted({x for x, _ in wanted}), (wanted[0], wanted[-1])
        at = F.struct(F.col("length"), F.col("segment"))
        rows = built.where(F.col("length").isin(lengths)).where((at >= F.struct(*map(F.lit, lo))) & (at <= F.struct(*map(F.lit, hi)))).collect()
        parts: dict = {}
        for r in rows:
            parts.setdefault(r.length, (shapes[r.length], {}))[1][r.segment] = bytes(r.data)
        sent = spark.sparkContext.broadcast((alphabet, parts))
        part = vocab.where((F.length("word") >= lengths[0]) & (F.least(F.length("word") - 1, F.lit(LONG)) <= lengths[-1])) \
            .select("word", "n").mapInArrow(_probe(sent), "edit string, word string, n long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "edit string, word string, n long")
    return found.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit").select("word", "n", "edit", "edit_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for acyclic (word, root) links, one a word: every word's last."""
    links = stage(links, "spelling-roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stage(links.select("word", "root").join(step, "root", "left")
                      .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if links.where("moved").limit(1).count() == 0:
            return links.select("word", "root")


def group_variants(vocab: DataFrame, factor: int = 5, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a staged vocabulary."""
    both = near_pairs(vocab, **sizes).select(F.inline(F.array(
        F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
        F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    takes = -F.col("best.less") >= factor * F.col("n")
    judged = stage(vocab.join(best, "word", "left").select(
        "word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(stage(vocabulary(table(spark, sf_dir, "documents")), "spelling-words"))


SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bits AS (
  SELECT run, m, list_transform(range(4 * length(code)), lambda i:
    ((instr('0123456789ABCDEF', substr(code, 2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END, 1)) - 1) >> (i % 4)::INT) & 1) AS bits FROM counted),
hashed AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::UBIGINT, bits::UBIGINT[]),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)::BIGINT AS h FROM bits),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM hashed),
vocab AS (
  SELECT word, sum(m)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
masks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocab v ON v.word = s.cut
  UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocab v ON v.word = s.cut),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
judged AS (
  SELECT v.word, CASE WHEN b.near_n >= 5 * v.n THEN b.near END AS form, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.near_n >= 5 * v.n THEN b.near_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
walk AS (
  SELECT word, word AS at FROM judged
  UNION ALL SELECT w.word, j.form FROM walk w JOIN judged j ON j.word = w.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, w.at AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN walk w ON w.word = j.word JOIN judged e ON e.word = w.at AND e.form IS NULL
"""
