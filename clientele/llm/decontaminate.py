"""Operator 10 -- benchmark decontamination by BM25 with block-max WAND.

The test items are the indexed documents; every training passage is a query.
Words are ``[0-9a-z\\x80-\\xff]+`` bytes after lower-casing A-Z.  A text is cut into
passages of twice the longest item's words, each starting one longest item after
the last, so any run of words as long as an item lies whole in some passage.

An item's BM25 score for a passage is divided by the item's score for itself, so
1 means that every word of the item is there, and one threshold holds for all
items.  Block-max WAND finds all items at or above it: a passage whose words'
largest impacts together stay below the threshold is left at once; then the words'
largest impacts per block of items rule out blocks; in a block that is left, cursors
stand on the posting lists, and the pivot is the first item that the lists' maxima
allow.

A retrieved item is verified in windows of twice its own words within the passage: its
question (all but its last sentence; for a single sentence the first three quarters of
its words) and its answer (the rest) each need ``overlap`` of their word trigrams in one
window, so a long item beside it widens nothing.  Items of fewer than ``LEAST`` words are not
searched; they leak only into a text that consists of their words.

Scale.  One pass over the training texts, no shuffle of texts.  The index is
broadcast in parts of at most ``items_per_index`` items; inverse document
frequencies come from all items.

Defined cases.  Null and empty texts hold no words, so they neither leak nor are
leaked.  A question or answer of fewer than three words is matched by its whole
sequence.  Items with a null id are searched but reported with a null item_id.
Repeated items and repeated documents give one row per (doc_id, item_id) with the
best score.  ``decontaminate`` decides row by row and keeps all columns, so null
and repeated doc_ids are safe there.  Empty tables: nothing leaks.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import release_caches, ship, shipped, stage, table, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTENCE = re.compile(rb"(?<=[.?!\n])\s*")
K1, B = 1.2, 0.75
BLOCK = 8
DENSE = 1 << 22  # cells of a table of block maxima; larger ones are kept by word
THRESHOLD, OVERLAP = 0.6, 0.6
ITEMS_PER_INDEX = 20_000
LONG = 1 << 22
LEAST = 5  # words of the shortest item that is searched


def parts_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer."""
    said = [w for w in (WORD.findall(s) for s in SENTENCE.split(text.lower())) if w]
    if len(said) > 1:
        return [w for s in said[:-1] for w in s], said[-1]
    words = said[0] if said else []
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@dataclass
class Item:
    item_id: int | None
    question: set
    answer: set
    n_words: int


class BlockMaxIndex:
    """Posting lists of items with their largest impacts, by list and by block."""

    def __init__(self, texts: list[tuple[int | None, bytes]], idf: dict[bytes, float], mean: float):
        self.items, self.lists = [], {}
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        for item_id, text in texts:
            question, answer = parts_of(text)
            words = question + answer
            if len(words) < LEAST:
                if words:
                    self.short.setdefault(tuple(words), []).append(len(self.items))
                    self.items.append(Item(item_id, set(), set(), len(words)))
                continue
            tf = Counter(words)
            impact = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                self.lists.setdefault(w, []).append((len(self.items), x / own))
            self.items.append(Item(item_id, grams(question), grams(answer), len(words)))
        self.longest = max((i.n_words for i in self.items), default=1)
        self.most = {w: max(x for _, x in p) for w, p in self.lists.items()}
        self.known = frozenset(self.most)
        self.n_blocks = len(self.items) // BLOCK + 1
        self.blocks = {}  # word -> (blocks that hold it, largest impact in each)
        for w, p in self.lists.items():
            top: dict[int, float] = {}
            for item, x in p:
                top[item // BLOCK] = max(top.get(item // BLOCK, 0.0), x)
            self.blocks[w] = np.array(list(top), np.int64), np.array(list(top.values()))
        self.row = {w: i for i, w in enumerate(self.lists)}
        self.dense = None
        if len(self.lists) * self.n_blocks <= DENSE:
            self.dense = np.zeros((len(self.lists), self.n_blocks), np.float32)
            for w, (b, x) in self.blocks.items():
                self.dense[self.row[w], b] = x

    def search(self, words: set[bytes], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score the threshold or more."""
        threshold -= 1e-9  # sums in another order
        words = list(words)
        if not words:
            return []
        if self.dense is not None:
            bound = self.dense[[self.row[w] for w in words]].sum(axis=0)
        else:
            held, most = zip(*map(self.blocks.__getitem__, words))
            bound = np.bincount(np.concatenate(held), np.concatenate(most), self.n_blocks)
        live = bound >= threshold - 1e-4  # single precision
        if not live.any():
            return []
        found = []
        for b in np.flatnonzero(live).tolist():
            found += self._pivots(words, b * BLOCK, (b + 1) * BLOCK, threshold)
        return found

    def _pivots(self, words: list[bytes], start: int, end: int, threshold: float) -> list[tuple[int, float]]:
        """WAND over the items of one block."""
        lists = [(self.lists[w], self.most[w]) for w in words]
        at = [bisect.bisect_left(p, (start,)) for p, _ in lists]
        found = []
        while True:
            here = sorted((lists[i][0][at[i]][0], i) for i in range(len(lists)) if at[i] < len(lists[i][0]) and lists[i][0][at[i]][0] < end)
            total, pivot = 0.0, None
            for item, i in here:
                total += lists[i][1]
                if total >= threshold:
                    pivot = item
                    break
            if pivot is None:
                return found
            score = 0.0
            for item, i in here:
                if item > pivot:
                    break
                self._seek(lists[i][0], at, i, pivot)
                if at[i] < len(lists[i][0]) and lists[i][0][at[i]][0] == pivot:
                    score += lists[i][0][at[i]][1]
                    at[i] += 1
            if score >= threshold:
                found.append((pivot, score))

    @staticmethod
    def _seek(postings: list, at: list[int], i: int, item: int) -> None:
        n = len(postings)
        while at[i] < n and postings[at[i]][0] < item:
            at[i] += 1

    def leaks(self, text: bytes, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """item -> best (score, question overlap, answer overlap) over the text's passages."""
        out: dict[int, tuple[float, float, float]] = {}
        most, step = self.most, self.longest
        for words in _stretches(text, 2 * step):
            if self.short and len(words) < LEAST and len(text) <= LONG:
                out.update((i, (1.0, 1.0, 1.0)) for i in self.short.get(tuple(words), ()))
            held = [self.known.intersection(words[i: i + step]) for i in range(0, len(words), step)]
            bound = [sum(map(most.__getitem__, x)) for x in held]
            for k in range(max(1, len(held) - 1) if held else 0):
                if sum(bound[k: k + 2]) < threshold - 1e-9:
                    continue
                terms, start = held[k].union(*held[k + 1: k + 2]), k * step
                if sum(map(most.__getitem__, terms)) < threshold - 1e-9:
                    continue
                hits = self.search(terms, threshold)
                if hits:
                    passage = words[start: start + 2 * step]
                    for item, score in hits:
                        share = self._overlap(self.items[item], passage)
                        if min(share) >= overlap:
                            out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return out

    @staticmethod
    def _overlap(item: Item, passage: list[bytes]) -> tuple[float, float]:
        """The shares of question and answer in the passage's best window."""
        best = 0.0, 0.0
        for at in range(0, max(1, len(passage) - item.n_words), item.n_words):
            window = passage[at: at + 2 * item.n_words]
            by = {n: grams(window, n) for n in (1, 2, 3)}
            share = [sum(g in by[len(g)] for g in part) / len(part) if part else 1.0 for part in (item.question, item.answer)]
            best = max(best, (share[0], share[1]), key=lambda x: (min(x), x))
        return best


def _stretches(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The text's words; a very long text comes in stretches that share ``width`` words."""
    if len(text) <= LONG:
        yield WORD.findall(text.lower())
        return
    at, tail = 0, []
    while at < len(text):
        end = at + LONG
        while end < len(text) and (text[end] >= 0x80 or chr(text[end]).isalnum()):
            end += 1
        words = tail + WORD.findall(text[at:end].lower())
        yield words
        at, tail = end, words[-width:]


def indexes(items: DataFrame, items_per_index: int = ITEMS_PER_INDEX) -> Iterator[BlockMaxIndex]:
    """The items as indexes of bounded size, one after another."""
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [WORD.findall(x.as_py().lower()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in found], pa.list_(pa.binary())), pa.array([len(w) for w in found], pa.int64())], ["words", "n"])
    texts = items.select(F.col("item_id").cast("long"), utf8().alias("text"))
    seen = texts.select("text").mapInArrow(words_of, "words array<binary>, n long")
    total = seen.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).first()
    if not total.docs:
        return
    df = stage(seen.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "item-words")
    n_parts = -(-total.docs // items_per_index)
    part = F.pmod(F.xxhash64("text"), F.lit(n_parts))
    for p in range(n_parts):
        held = texts.where(part == p)
        rows = [(r.item_id, bytes(r.text)) for r in held.sort("item_id", "text").toLocalIterator()]
        own = held.select("text").mapInArrow(words_of, "words array<binary>, n long").select(F.explode("words").alias("word")).distinct()
        idf = {bytes(r.word): float(np.log(1 + (total.docs - r.df + 0.5) / (r.df + 0.5))) for r in df.join(own, "word", "left_semi").toLocalIterator()}
        yield BlockMaxIndex(rows, idf, total.mean)


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """One row per document and item that it holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), utf8().alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for index in indexes(items, items_per_index):
        sent = ship(spark, index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            release_caches()
            index = shipped(sent)
            for batch in batches:
                rows = [(doc, index.items[item].item_id, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                        for item, found in index.leaks(text.as_py(), threshold, overlap).items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        out = out.unionByName(texts.mapInArrow(run, LEAKS))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                  items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """The rows that hold no test item, with all their columns."""
    for index in indexes(items, items_per_index):
        sent, place = ship(docs.sparkSession, index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            release_caches()
            index = shipped(sent)
            for batch in batches:
                texts = (x.as_py() for x in batch.column(place))
                yield batch.filter(pa.array([not index.leaks((t or "").encode(), threshold, overlap) for t in texts], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
