"""Operators 4, 5 and 6: cheaper steps give what the plain ones give, and tasks keep no memory."""

import zlib

import numpy as np
import pyarrow as pa

from clientele.llm import common, lm_score, mixing, substring_dedup


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def sub(self, *a):
        self.calls += 1
        return self.pattern.sub(*a)


def test_shape_of_a_word_is_worked_out_once_for_its_form(monkeypatch):
    shapes = Counted(mixing.REPEAT)
    monkeypatch.setattr(mixing, "REPEAT", shapes)
    mixing.worker_cache("mixing-features").clear()
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    mixing.features(" ".join(words).encode())
    assert shapes.calls == 1


def test_features_by_their_definition():
    def plain(text):
        found = set()
        for w in text.split():
            word, shape = w.lower().strip(b".,;:!?()[]\"'"), mixing.REPEAT.sub(rb"\1", w.translate(mixing.SHAPE))[:32]
            found |= {zlib.crc32(word) % mixing.BUCKETS, zlib.crc32(word[:4], 99) % mixing.BUCKETS, zlib.crc32(shape, 77) % mixing.BUCKETS}
        return len(text.split()), found
    for text in (b"", b" \n", b"One one, (one) 12 a1b22", "\u00c4rger \u00e4rger".encode(), b"x" * 63 + b" " + b"Y" * 64 + b" z " + b"9" * 300,
                 b" ".join(b"%d" % i for i in range(160_000)), b"One again"):
        n, found = mixing.features(text)
        assert (n, set(found.tolist())) == plain(text) and len(set(found.tolist())) == len(found)


def test_training_step_stays_in_single_precision(monkeypatch):
    kinds, exp = [], np.exp
    share = np.full(8, 1 / 8)
    p, rng = lm_score.Params.start(share, 4), np.random.default_rng(1)
    ids = rng.integers(0, 8, 50)
    log_share = np.log(share).astype(np.float32)
    monkeypatch.setattr(np, "exp", lambda x, **k: kinds.append(x.dtype) or exp(x, **k))
    p.step(ids, ids, ids, log_share, rng, 0.05, [np.full(x.shape, 1e-8, np.float32) for x in (p.R, p.Q, p.C, p.b)])
    assert kinds and set(kinds) == {np.dtype(np.float32)}


def test_log_probs_by_their_definition():
    rng, v = np.random.default_rng(2), 40
    p = lm_score.Params.start(np.full(v, 1 / v), 6)
    c1, c2, y = rng.integers(0, v + 1, 3000), rng.integers(0, v + 1, 3000), rng.integers(0, v, 3000)
    z = ((p.R[c1] @ p.C[0] + p.R[c2] @ p.C[1]) @ p.Q.T + p.b).astype(float)
    want = z[np.arange(3000), y] - np.log(np.exp(z).sum(axis=1))
    assert np.allclose(p.log_probs(c1, c2, y), want, atol=1e-5)
    none = np.empty(0, np.int64)
    assert len(p.log_probs(none, none, none)) == 0


def test_a_lean_task_gives_memory_back_after_its_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    out = common.lean(lambda batches: (x + 1 for x in batches))(iter([1, 2]))
    assert [next(out), next(out)] == [2, 3] and not said
    assert list(out) == [] and said == ["back"]
    common.lean(iter)


def test_contents_are_judged_a_bounded_number_at_a_time(monkeypatch):
    sizes, plain = [], substring_dedup._intervals
    monkeypatch.setattr(substring_dedup, "_intervals", lambda keys, *a: sizes.append(len(keys)) or plain(keys, *a))
    place = lambda doc: np.array([(doc, 0, 0)], substring_dedup.PLACE).tobytes()
    n = 50_000
    keys = np.repeat(np.arange(n // 2), 2)
    texts = [(b"%06d" % k) * 10 for k in keys]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([t + b"ab"[i % 2:] for i, t in enumerate(texts)], pa.binary()),
                                       pa.array([place(i) for i in range(n)], pa.binary())], ["h", "content", "places"])
    out = list(substring_dedup._judged(50, 1000)(iter([rows])))
    assert len(sizes) > 1 and sum(sizes) == n and max(sizes) <= 32_000
    gone = [d for b in out for d in b.column(0).to_pylist()]
    assert sorted(gone) == list(range(1, n, 2))
