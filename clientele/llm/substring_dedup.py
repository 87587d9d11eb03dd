"""Operator 5 -- exact substring deduplication by depth-limited radix sort.

Every byte of a document goes that is covered by a ``width``-byte window which
also starts in a document with a smaller doc_id.  Windows never cross documents
and are judged on the input, not on what is left.

A suffix array is ordered only as deep as the threshold: suffixes that agree on
``width`` bytes are the same window, and order beyond that decides nothing.  The
sort is a most-significant-digit radix sort over the cluster:

1. *First digit: the window's minimizer.*  The smallest hash among the 20-byte
   grams of a window depends on the window alone, so equal windows share it, and
   neighbouring windows mostly share theirs: a text is cut into runs of windows
   of one minimizer.  Minimizers seen in one document only hold unique windows;
   a pass that exchanges packed minimizer hashes finds the others and marks them
   in a bitmap.  The bitmap has a fixed size whatever the corpus
   (``bitmap_bits``), so it may be broadcast; a fuller bitmap lets more runs
   through and costs time, never a result.
2. *Further digits.*  The runs that are left are exchanged by the first bits of
   their minimizer, packed and compressed, each content once per flush of a task
   with the documents and places that hold it.  Within a
   minimizer the windows are refined eight bytes at a time; a window alone in
   its class leaves the sort, and after the last digit each class is exactly one
   repeated window, whose smallest doc_id is known.
3. *Coverage.*  Windows whose smallest doc_id is smaller than the document's own
   become byte intervals, gathered per document and cut out.

A minimizer with more than ``group_limit`` contents, or eight times as many places,
is not held in one task: the smallest document of its windows is found by a Spark
aggregation over their 128-bit hashes, and joined back to contents and places.

Defined cases.  A null or empty text has no bytes.  Rows that share a doc_id are
cut each by its own text; they are not smaller than each other.  Rows with a
null doc_id neither lose bytes nor take any from others.  Texts of any length
are read in segments.  An empty table gives an empty result.  Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import give_back, lean, stage, table, utf8

GRAM = 20
PIECE = 64            # windows in one run at most
SEGMENT = 1 << 19     # bytes worked on at a time
FLUSH = 1 << 21       # minimizers kept in a task before they are sent
BITMAP_BITS = 28
GROUP_LIMIT = 200_000  # contents, or eight times as many places
SLICE = 1 << 20       # windows of places expanded at a time
JUDGED = 30_000       # contents judged at a time, whole groups
_B = 0x9E3779B97F4A7C15


def _joined(h: np.ndarray, g: np.ndarray, skip: int, length: int, n: int) -> np.ndarray:
    """Hashes of ``length``-grams from those of their first ``skip`` bytes and of the rest."""
    count = n - length + 1
    return h[:count] * np.uint64(pow(_B, length - skip, 1 << 64)) + g[skip: skip + count]


def minimizers(buf: np.ndarray, width: int) -> np.ndarray:
    """For each window start the smallest mixed hash of the window's grams."""
    n = len(buf)
    h, length = {1: buf.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * length <= GRAM:
        h[2 * length] = _joined(h[length], h[length], length, 2 * length, n)
        length *= 2
    gram, done = h[length], length
    for part in sorted((x for x in h if x < length), reverse=True):
        if done + part <= GRAM:
            gram = _joined(gram, h[part], done, done + part, n)
            done += part
    gram = gram ^ (gram >> np.uint64(31))
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(27)
    gram *= np.uint64(0x94D049BB133111EB)
    gram ^= gram >> np.uint64(31)
    span, low = width - GRAM + 1, gram
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size:])
    return low


def segments(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, offsets, documents): texts strung together, about SEGMENT bytes a
    time; a longer text comes in pieces that overlap by ``width - 1`` bytes.
    documents: (doc_id, tag, place of the piece in the text)."""
    parts, held, size = [], [], 0
    for batch in batches:
        for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            for at in range(0, max(1, len(text) - width + 1), SEGMENT):
                part = text[at: at + SEGMENT + width - 1]
                if len(part) < width:
                    continue
                parts.append(part)
                held.append((doc, tag, at))
                size += len(part)
                if size >= SEGMENT:
                    yield _strung(parts), np.cumsum([0, *map(len, parts)]), held
                    parts, held, size = [], [], 0
    if parts:
        yield _strung(parts), np.cumsum([0, *map(len, parts)]), held


def _strung(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8)


def runs(buf: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of windows with one minimizer: (start, number of windows, minimizer, document)."""
    low = minimizers(buf, width)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[offsets[:-1]] = True
    tails = offsets[1:] - width + 1       # first start whose window leaves the document
    new[tails[tails < len(low)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(low)])
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start < tails[doc]
    # a smallest hash is seldom a large one: mixed again, so that first bits fill shards and bitmap evenly
    h = low[start[inside]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_B)
    return start[inside], count[inside], h ^ (h >> np.uint64(29)), doc[inside]


def _anchors(width: int, bits: int, shards: int):
    """Per task and shard the minimizers seen in one document, and in several,
    each as the 40 bits below the shard's."""
    low_bits = np.uint64(24)

    def sent(alone: list[np.ndarray], many: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(alone))
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        h, count = h[first], np.diff(np.r_[np.flatnonzero(first), len(h)])
        more = np.unique(np.concatenate([*many, h[count > 1]]))
        h = np.setdiff1d(h[count == 1], more, assume_unique=True)
        rows = [[], [], []]
        shift = np.uint64(64 - int(np.log2(shards)))
        edges = np.arange(shards, dtype=np.uint64)
        cut = lambda x: [*np.searchsorted((x >> shift), edges), len(x)]
        a, b = cut(h), cut(more)
        for s in range(shards):
            if a[s] < a[s + 1] or b[s] < b[s + 1]:
                rows[0].append(s)
                rows[1].append(_packed(h[a[s]: a[s + 1]], shards))
                rows[2].append(_packed(more[b[s]: b[s + 1]], shards))
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["shard", "alone", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, many, size = [], [], 0
        for buf, offsets, _ in segments(batches, width):
            _, _, h, doc = runs(buf, offsets, width)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            pair = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            h = h[pair]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[first, len(h)])
            alone.append(h[first[count == 1]])
            many.append(h[first[count > 1]])
            size += len(first)
            if size >= FLUSH:
                yield sent(alone, many)
                alone, many, size = [], [], 0
        if alone:
            yield sent(alone, many)
    return run


def _packed(h: np.ndarray, shards: int) -> bytes:
    """The five bytes below the shard's bits of each hash."""
    x = (h << np.uint64(int(np.log2(shards)))) >> np.uint64(24)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(x.as_py() for x in blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _marked(bits: int, shards: int):
    """The shard's part of the bitmap: a bit for each minimizer of two documents or more."""
    own = bits - int(np.log2(shards))

    def run(group: pa.Table) -> pa.Table:
        import zlib
        alone = np.sort(_unpacked(group["alone"]))
        twice = alone[1:][alone[1:] == alone[:-1]]
        many = _unpacked(group["many"])
        # a minimizer may be alone in one task and stand among several in another
        part = np.zeros(1 << own, bool)
        part[(np.concatenate([twice, many]) >> np.uint64(40 - own)).astype(np.int64)] = True
        out = pa.table({"shard": group["shard"].slice(0, 1), "part": pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())})
        del alone, twice, many, part
        give_back()
        return out
    return run


def repeated_bitmap(docs: DataFrame, width: int, bits: int) -> bytes:
    """2^bits bits, indexed by the first bits of a minimizer."""
    import zlib
    wanted = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << min(bits - 8, 14, max(6, (wanted - 1).bit_length()))
    parts = (docs.mapInArrow(lean(_anchors(width, bits, shards)), "shard int, alone binary, many binary")
             .groupBy("shard").applyInArrow(_marked(bits, shards), "shard int, part binary"))
    size = (1 << bits) // 8 // shards
    out = bytearray(size * shards)
    for row in parts.toLocalIterator():
        out[row.shard * size: (row.shard + 1) * size] = zlib.decompress(row.part)
    return bytes(out)


PLACE = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("at", "<i4")])
KEY = 6               # bytes of a minimizer that are sent: equal ones stay together, unequal ones may meet


def _planes(x: np.ndarray, size: int = 0) -> bytes:
    """The ``size`` highest bytes of each number (default all), place by place, so that they compress."""
    raw = x.view(np.uint8).reshape(len(x), -1)
    return np.ascontiguousarray(raw[:, raw.shape[1] - size if size else 0:].T).tobytes()


def _numbers(data: bytes, at: int, n: int, kind: str, size: int = 0) -> tuple[np.ndarray, int]:
    """The numbers that ``_planes`` wrote at a place, and the place behind them."""
    whole = np.dtype(kind).itemsize
    size = size or whole
    out = np.zeros((n, whole), np.uint8)
    out[:, whole - size:] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return out.view(kind).ravel(), at + n * size


def _contents(width: int, bits: int, bitmap, shards: int):
    """(shard, runs): the runs that may repeat, by the first bits of their minimizers,
    packed and compressed; each content stands once per flush with all its places."""
    shift = np.uint64(64 - int(np.log2(shards)))

    def sent(found: dict, rows: list) -> pa.RecordBatch:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        h, of, doc, tag, at = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((of, h))
        h, of, doc, tag, at = (x[order] for x in (h, of, doc, tag, at))
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])      # a content has one minimizer
        last = np.r_[first[1:], len(of)]
        contents, key = list(found), h[first]
        cut = np.r_[np.searchsorted(key >> shift, np.arange(shards, dtype=np.uint64)), len(key)]
        out = [[], []]
        for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            a, b = cut[s], cut[s + 1]
            p, q = first[a], last[b - 1]
            texts = [contents[i] for i in of[first[a:b]].tolist()]
            size = np.fromiter(map(len, texts), np.uint32, len(texts))
            out[0].append(s)
            out[1].append(pack(b"".join([
                np.array([b - a, q - p], "<u4").tobytes(), _planes(key[a:b], KEY), _planes(size), _planes((last - first)[a:b].astype("<u4")),
                _planes(doc[p:q]), _planes(tag[p:q]), _planes(at[p:q]), *texts])))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["shard", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint8)
        found, rows, size = {}, [], 0
        for buf, offsets, held in segments(batches, width):
            start, count, h, doc = runs(buf, offsets, width)
            at = h >> np.uint64(64 - bits)
            may = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
            pieces = -(-count[may] // PIECE)
            row = np.repeat(np.flatnonzero(may), pieces)
            cut = PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            lo, doc = start[row] + cut, doc[row]
            hi = lo + np.minimum(PIECE, count[row] - cut) + width - 1
            whole, number = buf.tobytes(), found.setdefault
            of = np.array([number(whole[x:y], len(found)) for x, y in zip(lo.tolist(), hi.tolist())], np.int64)
            ids, tags, bases = (np.array(x, kind) for x, kind in zip(zip(*held), ("<i8", "<i4", "<i8")))
            rows.append((h[row], of, ids[doc], tags[doc], (bases[doc] + lo - offsets[doc]).astype("<i4")))
            size += len(row)
            if size >= 150_000:
                yield sent(found, rows)
                found, rows, size = {}, [], 0
        if size:
            yield sent(found, rows)
    return run


def _unpacked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, content, places), one row for each content of a flush."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress

    def column(offsets: np.ndarray, data: bytes) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    for batch in batches:
        for blob in batch.column(1):
            data = unpack(blob.as_py())
            n, n_places = (int(x) for x in np.frombuffer(data, "<u4", 2))
            h, at = _numbers(data, 8, n, "<i8", KEY)
            size, at = _numbers(data, at, n, "<u4")
            count, at = _numbers(data, at, n, "<u4")
            places = np.empty(n_places, PLACE)
            for name, kind in (("doc", "<i8"), ("tag", "<i4"), ("at", "<i4")):
                places[name], at = _numbers(data, at, n_places, kind)
            ends = np.r_[0, np.cumsum(count.astype(np.int64))] * PLACE.itemsize
            rows = pa.RecordBatch.from_arrays([pa.array(h), column(np.r_[0, np.cumsum(size.astype(np.int64))], data[at:]), column(ends, places.tobytes())],
                                              ["h", "content", "places"])
            for i in range(0, n, 10_000):
                yield rows.slice(i, 10_000)


def radix_classes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """A class number for each window start ``at``: windows of one group have the
    same class exactly when their ``width`` bytes are equal."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    out = np.arange(len(at))
    active, label = np.arange(len(at)), group
    for depth in [*range(0, width - 8, 8), width - 8]:
        digit = words[at[active] + depth]
        order = np.lexsort((digit, label))
        active, label, digit = active[order], label[order], digit[order]
        new = np.r_[True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])]
        label = np.cumsum(new) - 1
        several = np.bincount(label)[label] > 1
        active, label = active[several], label[several]
        if not len(active):
            return out
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    out[active] = np.repeat(active[first], np.diff(np.r_[first, len(active)]))
    return out


def _intervals(keys: list[int], contents: list[bytes], places: list[np.ndarray], width: int):
    """(doc, tag, lo, hi) arrays of what goes, for whole groups of one minimizer."""
    group = np.unique(np.array(keys, np.int64), return_inverse=True)[1]
    size = np.array([len(c) for c in contents])
    base = np.r_[0, np.cumsum(size)[:-1]]
    count = size - width + 1                      # windows of each content
    ends = np.cumsum(count)
    begin = ends - count
    of = np.repeat(np.arange(len(contents)), count)
    n_places = np.array([len(p) for p in places])
    flat = np.concatenate(places)
    least = np.minimum.reduceat(flat["doc"], np.r_[0, np.cumsum(n_places)[:-1]])
    smallest = least[of]
    shared = np.bincount(group)[group] > 1        # a content alone under its minimizer has no equals
    pick = np.flatnonzero(shared[of])
    if len(pick):
        buf = np.frombuffer(b"".join(contents), np.uint8)
        at = base[of[pick]] + (pick - begin[of[pick]])
        classes = radix_classes(buf, at, group[of[pick]], width)
        low = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(low, classes, smallest[pick])
        smallest[pick] = low[classes]
    yield from _gone(smallest, begin, count, np.repeat(np.arange(len(contents)), n_places), flat, width)


def _gone(smallest: np.ndarray, begin: np.ndarray, count: np.ndarray, content: np.ndarray, flat: np.ndarray, width: int):
    """(doc, tag, lo, hi) of each place's windows that a smaller document holds too;
    ``content``: the content of each place.  A bounded number of windows at a time."""
    width_of = count[content]
    upto = np.cumsum(width_of)
    edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(SLICE, int(upto[-1]), SLICE)), len(flat)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        steps, places = width_of[a:b], flat[a:b]
        row = np.repeat(np.arange(b - a), steps)
        step = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
        gone = smallest[begin[content[a:b]][row] + step] < places["doc"][row]
        edge = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (row[1:] != row[:-1])])
        last = np.flatnonzero(gone & np.r_[~gone[1:] | (row[1:] != row[:-1]), True])
        p = places[row[edge]]
        yield p["doc"], p["tag"], p["at"] + step[edge], p["at"] + step[last] + width


OUT = "doc_id long, tag int, lo int, hi int, content binary, places binary"


def _judged(width: int, limit: int):
    """Whole minimizer groups, several at a time; a group beyond the limit passes
    through unjudged, for ``_large``."""
    kind = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("content", pa.binary()), ("places", pa.binary())])

    def judged(rows) -> Iterator[pa.RecordBatch]:
        merged: dict[bytes, list] = {}
        for h, content, p in rows:
            merged.setdefault(content, [h, []])[1].append(p)
        for doc, tag, lo, hi in _intervals([h for h, _ in merged.values()], list(merged), [np.frombuffer(b"".join(p), PLACE) for _, p in merged.values()], width):
            none = pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), none, none], schema=kind)

    def passed(rows) -> pa.RecordBatch:
        n = pa.nulls(len(rows), pa.int32())
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), n, n, n, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_, key, over, size, held = [], [], None, False, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if row[0] != key:
                    if over:
                        if open_:
                            yield passed(open_)
                    else:
                        done += open_
                    open_, key, over, held = [], row[0], False, 0
                    if size >= JUDGED:
                        if done:
                            yield from judged(done)
                        done, size = [], 0
                open_.append(row)
                size += 1 + len(row[2]) // 512
                held += len(row[2]) // PLACE.itemsize
                if len(open_) > limit or held > 8 * limit or over and len(open_) >= 10_000:
                    over = True
                    yield passed(open_)
                    open_, size, held = [], 0, 0
        if over and open_:
            yield passed(open_)
        elif not over:
            done += open_
        if done:
            yield from judged(done)
    return run


def _windows(width: int):
    """(id1, id2, j, k1, k2, least): each window of a row once, whatever its places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 64) - 1
        for batch in batches:
            for id1, id2, content, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(content) - width + 1
                keys = [xxhash.xxh3_128_intdigest(content[j: j + width]) for j in range(n)]
                k1, k2 = (np.array(x, np.uint64).view(np.int64) for x in ([k >> 64 for k in keys], [k & low for k in keys]))
                least = int(np.frombuffer(places, PLACE)["doc"].min())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, id1)), pa.array(np.full(n, id2)), pa.array(np.arange(n, dtype=np.int32)), pa.array(k1), pa.array(k2),
                                                  pa.array(np.full(n, least))], ["id1", "id2", "j", "k1", "k2", "least"])
    return run


def _large_spans(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for least, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                smallest = np.array([x["least"] for x in sorted(least, key=lambda x: x["j"])], np.int64)
                flat = np.frombuffer(places, PLACE)
                for doc, tag, lo, hi in _gone(smallest, np.zeros(1, np.int64), np.array([len(smallest)]), np.zeros(len(flat), np.int64), flat, width):
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                                     ["doc_id", "tag", "lo", "hi"])
    return run


def _large(groups: DataFrame, width: int) -> DataFrame:
    """The same judgement for oversized groups: the smallest document of every window by
    an aggregation over the contents' windows, sent back to each row of content and
    places.  A row's places are those of one flush, so no task holds all of a passage."""
    rows = groups.select(F.xxhash64("content", "places").alias("id1"), F.xxhash64(F.lit(1), "places", "content").alias("id2"), "content", "places")
    windows = rows.mapInArrow(lean(_windows(width)), "id1 long, id2 long, j int, k1 long, k2 long, least long")
    least = windows.groupBy("k1", "k2").agg(F.min("least").alias("least"))
    back = windows.drop("least").join(least, ["k1", "k2"]).groupBy("id1", "id2").agg(F.collect_list(F.struct("j", "least")).alias("windows"))
    return rows.join(back, ["id1", "id2"]).select("windows", "places").mapInArrow(lean(_large_spans(width)), "doc_id long, tag int, lo int, hi int")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for text, lo, hi in zip(*(batch.column(i) for i in (2, 3, 4))):
            text, kept, removed, spans = text.as_py(), None, 0, 0
            if lo.is_valid:
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, lo.values.to_numpy(), 1)
                np.add.at(edge, hi.values.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone.sum()), int((gone & np.r_[True, ~gone[:-1]]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for x, y in zip(out, (len(text), removed, spans, text if kept is None else kept)):
                x.append(y)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_substrings(docs: DataFrame, width: int = 50, bitmap_bits: int = BITMAP_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): one row per document."""
    if width < 28:
        raise ValueError("width is at least 28 bytes")
    twice = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # rows that share a doc_id are told apart by their text
    tag = F.lit(0) if twice.isEmpty() else F.hash(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long"), tag.alias("tag"), utf8().alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(known, width, bitmap_bits))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(6, (2 * tasks - 1).bit_length())
    packed = known.mapInArrow(lean(_contents(width, bitmap_bits, bitmap, shards)), "shard int, runs binary")
    # a fixed number of tasks: joined by their compressed sizes, they would sort several times as much
    found = packed.repartition(tasks, "shard").mapInArrow(lean(_unpacked_runs), "h long, content binary, places binary")
    judged = stage(found.sortWithinPartitions("h").mapInArrow(lean(_judged(width, group_limit)), OUT), "substring-intervals")
    gone = judged.where(F.col("content").isNull()).select("doc_id", "tag", "lo", "hi") \
        .unionByName(_large(judged.where(F.col("content").isNotNull()).select("content", "places"), width))
    cuts = gone.groupBy("doc_id", "tag").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    both = texts.join(cuts, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "lo", "hi")
    return both.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
