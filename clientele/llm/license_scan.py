"""Operator 2 -- license scan by template-markup matching.

A template is wording with two kinds of markup, after the public license-list
convention: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;min=a;max=b>>`` stands for a to b words of any kind.  All other wording is
mandatory.  Each template compiles to an automaton over words; a place matches
when a run of words is accepted, so mandatory wording must be there exactly,
in order, with nothing but the allowed regions between.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The result
has every place (label, first word, one past the last word of the longest
acceptance from that start) and ``score``: the share of the text's words that lie
in some place.

Scale.  One pass, no shuffle.  Texts are read in blocks with the longest
template's length carried over, so memory does not grow with a text; an
automaton only runs where a word that can open a template stands.

Defined cases.  A null or empty text has no words, no places and score 0.
Repeated rows get their own row each; a null doc_id stays null.  An empty table
gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import table, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARK = re.compile(r"<<(beginOptional|endOptional|var[^>]*)>>")
BLOCK = 1 << 20
ANY = None

# (label, template): the phrases the query's contract fixes
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# (label, template): notices in common use, with what licensors vary marked
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("bsd", "redistribution and use in source and binary forms <<beginOptional>>with or without modification<<endOptional>> are permitted"),
    ("cc-by-sa", "<<beginOptional>>creative commons<<endOptional>> cc by sa"),
    ("copyright", "copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=8>> all rights reserved"),
    ("gpl-notice", "gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license"),
    ("gpl-or-later", "either version <<var;min=1;max=2>> of the license or <<beginOptional>>at your option<<endOptional>> any later version"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this <<var;min=1;max=6>> to deal in the software without restriction"),
]


@dataclass
class Automaton:
    """States 0..final; ``step[s]`` lists (word or ANY, next), ``skip[s]`` empty moves."""
    label: str
    step: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    longest: int = 0

    def _state(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.step[at].append((word, to))
        self.longest += 1
        return to

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def first(self) -> set[bytes]:
        out = {w for s in self.closure({0}) for w, _ in self.step[s]}
        if ANY in out or len(self.step) - 1 in self.closure({0}):
            raise ValueError(f"template {self.label} must open with wording")
        return out

    def match(self, words: list[bytes], at: int) -> int:
        """One past the last word of the longest acceptance from ``at``; -1 if none."""
        states, end, final = self.closure({0}), -1, len(self.step) - 1
        while states and at < len(words):
            word = words[at]
            states = self.closure({t for s in states for w, t in self.step[s] if w is ANY or w == word})
            at += 1
            if final in states:
                end = at
        return end


def compile_template(label: str, markup: str) -> Automaton:
    out, at, opened = Automaton(label), 0, []
    for i, part in enumerate(MARK.split(markup)):
        if i % 2 == 0:
            for word in WORD.findall(part.encode().lower()):
                at = out._word(at, word)
        elif part == "beginOptional":
            opened.append(at)
        elif part == "endOptional":
            to = out._state()  # a state of its own, which both ways reach
            out.skip[at].append(to)
            out.skip[opened.pop()].append(to)
            at = to
        else:
            bounds = dict(x.split("=") for x in part.split(";")[1:])
            least, most = int(bounds.get("min", 0)), int(bounds["max"])
            ways = []
            for n in range(most):
                if n >= least:
                    ways.append(at)
                at = out._word(at, ANY)
            for way in ways:
                out.skip[way].append(at)
    if opened:
        raise ValueError(f"template {label} leaves an optional region open")
    return out


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block; no word is cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and (text[end] >= 0x80 or chr(text[end]).isalnum()):
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


def find_places(text: bytes, automata: list[Automaton]) -> tuple[int, list[tuple[str, int, int]], int]:
    """(number of words, places, number of words in some place)."""
    opens: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.first():
            opens.setdefault(w, []).append(a)
    return _find(text, opens, max((a.longest for a in automata), default=0))


def _find(text: bytes, opens: dict[bytes, list[Automaton]], reach: int):
    places, total, words = [], 0, []
    blocks = word_blocks(text)
    block = next(blocks, None)
    while block is not None:  # a block may hold no word
        following = next(blocks, None)
        words += block
        ready = len(words) if following is None else max(0, len(words) - reach)
        for i in [i for i, w in enumerate(words[:ready]) if w in opens]:
            for a in opens[words[i]]:
                end = a.match(words, i)
                if end > 0:
                    places.append((a.label, total + i, total + end))
        total += ready
        if following is None:
            break
        words, block = words[ready:], following
    covered, reached = 0, 0
    for _, start, end in sorted(places, key=lambda p: p[1]):
        covered += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total, places, covered


def scan(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, n_words, places, score): every place of every template."""
    automata = [compile_template(label, markup) for label, markup in templates]
    opens: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.first():
            opens.setdefault(w, []).append(a)
    reach = max((a.longest for a in automata), default=0)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_find(x.as_py(), opens, reach) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"label": a, "start": b, "end": c} for a, b, c in p] for _, p, _ in found], kind),
                pa.array([c / n if n else 0.0 for n, _, c in found], pa.float64())], ["doc_id", "n_words", "places", "score"])
    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<label:string,start:long,end:long>>, score double")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    # a base phrase and a template may bear on the same words: base places keep a mark of their own
    found = scan(table(spark, sf_dir, "documents"), [(f"={a}", b) for a, b in BASE] + TEMPLATES)
    base = F.filter("places", lambda p: p["label"].startswith("="))

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.ltrim(p["label"], F.lit("="))))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
                        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
                        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), "score")
