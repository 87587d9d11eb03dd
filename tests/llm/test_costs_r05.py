"""Operator 9: a word behind a space is kept once, and the tokenizer's JSON is read once a worker."""

from clientele.llm import token_files


class Counted:
    def __init__(self, model):
        self.model, self.seen = model, []

    def tokenize(self, word):
        self.seen.append(word)
        return self.model.tokenize(word)


def test_a_word_behind_a_space_is_kept_once():
    e = token_files.Encoder(token_files.tokenizer_spec())
    e.pieces.clear()
    e.words.clear()
    e.model = Counted(e.model)
    for text in ("a xqword, Éxqword. xqword Éxqword", "a xqword.\nNext xqword", "xqword it's 12x, ... a., \n b  c xqword.,", "a .,. xq'word xqword,"):
        assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert e.model.seen.count("Ġxqword") == 1
    assert "xqword" in e.pieces and "Éxqword" in e.pieces and "xqword," in e.pieces
    assert " xqword" not in e.words and " Éxqword" not in e.words


def test_specification_is_parsed_once_a_worker(monkeypatch):
    spec = token_files.tokenizer_spec()
    first = token_files.Encoder(spec)
    monkeypatch.setattr(token_files.json, "loads", lambda s: 1 / 0)
    again = token_files.Encoder(spec)
    assert again.special == first.special == ["<|endoftext|>"] and again.cut is first.cut is True
