"""Operators 4 and 9: the cheaper steps give what the plain ones give."""

from collections import Counter

import numpy as np

from clientele.llm import lm_score, token_files


def test_line_end_pieces_are_encoded_but_not_kept():
    e = token_files.Encoder(token_files.tokenizer_spec())
    e.pieces.clear()
    for text in ("One two.\nThree four", "x a\nb y", "w A.\nB., z", "w q\n1 r", "w x'\n y", "w a\n\nb c", "w a\r\nb d", "w é.\nÜb, d", "one",
                 "w it's\ndon't x", "w ab́\ncd e", "w a\nb\nc d", " a\nb", "a\nb.", "\n\na b", ""):
        assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
        assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert "four" in e.pieces and "two.\nThree" not in e.pieces


def test_rows_added_up_by_place():
    rng = np.random.default_rng(1)
    at, x = rng.integers(0, 7, 50), rng.normal(size=(50, 3))
    want = np.zeros((9, 3))
    np.add.at(want, at, x)
    assert np.allclose(lm_score._summed(9, at, x), want)


def test_scoring_leaves_the_rest_to_the_other_pass():
    share = np.array([0.5, 0.3, 0.2])
    base = np.log10(share)
    s = lm_score.Scorer(lm_score.Params.start(share, 4), 3, {b"a": 0, b"b": 1, lm_score.END: 2}, base, np.zeros(3))
    full, lean = s.run([b"a c b c", b"d"]), s.run([b"a c b c", b"d"], rest_too=False)
    assert all(np.array_equal(x, y) for x, y in zip(full[:4], lean[:4]))
    assert full[4] == [Counter({b"c": 2}), Counter({b"d": 1})] and not any(lean[4])
