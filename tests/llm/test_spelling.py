"""Operator 13 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clientele.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_of(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w in n:
        close = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n.get(form[w])))
    return sorted(rows, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)


def small_vocabulary(seed=1, size=500):
    r = random.Random(seed)
    words = {"".join(r.choice("abÀé") for _ in range(r.choice([6, 7, 7, 8, 70]))) for _ in range(size)}
    return {w: r.choice([5, 6, 30, 200, 1500]) for w in words}


@pytest.mark.parametrize("sizes", [{}, {"segment_keys": 20}, {"segment_keys": 20, "pass_bytes": 200}])
def test_pairs_forms_and_roots(spark, sizes):
    n = small_vocabulary()
    n |= {"b" * 70: 9, "b" * 71: 99, "b" * 64: 5, "b" * 63: 50, "chain" + "a" * 5: 5, "chain" + "a" * 4: 25, "chain" + "a" * 3: 125, "chain" + "a" * 2: 625}
    vocab = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(5)
    got = result(S.group_variants(vocab, **sizes))
    assert got == brute(n)
    assert {r[2] for r in got if r[0].startswith("chain")} == {"chainaa"}


def test_counts_with_deleted_letters(spark):
    r = random.Random(3)
    some = [w.upper() if r.random() < 0.2 else w for w in small_vocabulary(5, 300)]
    docs = [(i, " ".join(r.choices(some, k=60)) + ". x×y÷z") for i in range(120)]
    docs += [(None, None), (None, "Wörter " * 9), (7, ""), (7, "Repeat-repeat repeat"), (7, "Repeat-repeat repeat"), (8, "long" * 100_000), (9, "ДругиеСлова " * 9)]
    n = words_of(docs)
    assert any(zlib.crc32(f"{d}:{w.lower()}".encode()) % 199 == 0 for d, t in docs if t and d for w in t.split())
    vocab = S.vocabulary(frame(spark, docs))
    assert {x.word: x.n for x in vocab.collect()} == n
    assert result(S.group_variants(vocab)) == brute(n)
    assert S.group_variants(S.vocabulary(frame(spark, docs).limit(0))).count() == 0


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(S, "RUNS_AT_ONCE", 7)
    monkeypatch.setattr(S, "HELD", 3)
    import pyarrow as pa
    text = "alphas betass gammas deltas " * 50
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.encode()])], ["doc_id", "text"])
    total = Counter()
    for b in S._counter(199, 6)([batch]):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[w] += n
    assert total == words_of([(1, text)])


def test_filters_hold_their_words_and_let_few_others_through():
    r = random.Random(2)
    words = sorted({"".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(4000)})
    h = (S._letters(words, 9) * S.coefficients(9)).sum(1, dtype=np.uint64)
    (n_segments, n_blocks), = S._shapes({9: 2000}, 1000).values()
    segment, m = S._place(h[::2], n_segments)
    f = S.LengthFilter(n_segments, n_blocks, {s: S.segment_bytes(m[segment == s], n_blocks) for s in range(n_segments)})
    assert len(f.may_hold(h[::2])) == len(h[::2])
    assert len(f.may_hold(h[1::2])) < 20
