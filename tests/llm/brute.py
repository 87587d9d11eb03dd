"""Plain-Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WHITE = b" \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def lines(docs):
    keys = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40 and doc_id is not None:
                keys.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        parts = (text or "").split("\n")
        stay = []
        for line in parts:
            held = keys.get(lower(line.strip(" \t\n\x0b\x0c\r")), ())
            if doc_id is None or len(held) < 5 or doc_id == max(held):
                stay.append(line)
        out.append((doc_id, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def words2(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def base_places(text):
    w, out = words2(text), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        out += [(label, i) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), out


def simhash(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_duplicates(docs, n=3, radius=2):
    fps = [simhash(t, n) for _, t in docs]
    distinct = sorted(set(fps))
    pairs = [(i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= radius]
    comp = dict(zip(distinct, components(len(distinct), pairs)))
    least = {}
    for (d, _), f in zip(docs, fps):
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    return [(d, f"{f:016x}", least.get(comp[f])) for (d, _), f in zip(docs, fps)]


def substrings(docs, width=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - width + 1):
                w = b[i:i + width]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i:i + width]] < d:
                    gone[i:i + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def top_k(vectors, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        qv = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def tokens4(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + ["\n"]  # no word holds a line end


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(docs):
    counts = Counter()
    for d, t in docs:
        if not held_out(d):
            counts.update(tokens4(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, held_out(d), len(tokens4(t)), sum(counts[x] > 0 for x in tokens4(t)), n,
             sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in tokens4(t))) for d, t in docs]
