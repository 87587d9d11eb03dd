"""Operator 9 -- token ids in packed binary files.

Every text is encoded with a public tokenizer (its JSON is a parameter), id 0 ends
each document, and documents are written in ascending order of doc_id to files
that hold every id in the fewest bits its vocabulary needs.

File format (little-endian)::

    8 bytes  b"CLTOK001"
    u4 bits   u4 block_ids   u8 n_docs   u8 n_ids   u8 n_blocks
    i8[n_docs] doc ids        u1[n_docs] 1 where the doc id is not null
    u8[n_docs] end of each document, in ids from the file's start
    u8[n_blocks + 1] byte offset of each block, from the first block
    blocks: block_ids ids each (the last one fewer), most significant bit first,
            each starting on a whole byte

A block is unpacked by numpy at once; any run of ids needs only its own blocks.

Scale.  Texts are range-partitioned by doc_id (and a hash of the text, so rows
sharing an id can be spread), so files are written by many tasks; each file is
written under another name and then renamed, under a name that depends only on
its place, so a repeated task replaces its own files.  Where a document starts
among all ids is its place in the file plus the sizes of the files before it: running
sums over the files of a part and over the parts.  Files are read back with Spark's binary
reader.  Encoding is cached by space-delimited piece, which cannot change ids:
this tokenizer's pre-tokens never span a single space between two other
characters.

Defined cases.  A null or empty text is one end id.  Rows sharing a doc_id are
documents each, ordered by their text's hash; null doc_ids come first.  Texts are
encoded in pieces whatever their length.  An empty table writes no file and
gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import scratch, stage, table, worker_cache

MAGIC = b"CLTOK001"
HEADER = "<8sIIQQQ"
BLOCK_IDS = 4096
FILE_IDS = 1 << 22
CACHE = 650_000       # pieces kept by the encoder; none that holds a line end
WORDS = 100_000       # pre-tokens kept besides: those that are no piece
CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: how the byte-level tokenizer splits a text.
LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LIMIT = "\u0250"
SPACE = "\u0120"  # the letter of the byte 32


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-bit numbers, most significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(raw[:, 32 - bits:]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    raw = np.zeros((n, 32), np.uint8)
    raw[:, 32 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(raw, axis=1).view(">u4").ravel().astype(np.uint32)


def file_bytes(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate([*docs, np.empty(0, np.uint32)])
    blocks = [pack(ids[i: i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    return b"".join([
        struct.pack(HEADER, MAGIC, bits, block_ids, len(docs), len(ids), len(blocks)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.cumsum([len(d) for d in docs]).astype("<u8").tobytes(),
        np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.base, self.data = at + 8 * (n_blocks + 1), data

    def block(self, i: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - i * self.block_ids)
        return unpack(self.data[self.base + self.offsets[i]: self.base + self.offsets[i + 1]], n, self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the file, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return got[start - first * self.block_ids: end - first * self.block_ids]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class Encoder:
    """The tokenizer with caches over pieces between single spaces and over pre-tokens.

    A new piece is split into pre-tokens, and new pre-tokens go through the library's
    model.  A word behind a space is a piece itself, kept once."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        held = worker_cache(f"tokens-{zlib.crc32(spec.encode())}")
        self.tokenizer = held.get("tokenizer") or held.setdefault("tokenizer", Tokenizer.from_str(spec))
        self.pieces, self.words = held.setdefault("pieces", {}), held.setdefault("words", {})
        if "special" not in held:  # once a worker: every task makes an encoder
            parsed = json.loads(spec)
            kind = parsed.get("pre_tokenizer") or {}
            held["special"] = [t["content"] for t in parsed.get("added_tokens", [])]
            # only where pre-tokens are known to end at such spaces
            held["cut"] = (parsed.get("normalizer") is None and parsed.get("post_processor") is None and kind.get("type") == "ByteLevel"
                           and kind.get("use_regex", True) and not kind.get("add_prefix_space"))
        self.special, self.cut = held["special"], held["cut"]
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}  # bytes as the model's letters

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.cut or any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        return np.frombuffer(b"".join([b"".join(x) for x in self._stretches(text)]), "<u4")

    def _ids(self, word: str) -> bytes:
        if word.isascii() and (word[1:] if word[0] == " " else word).isalnum():
            mapped = SPACE + word[1:] if word[0] == " " else word  # all but the space are their own letters
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        ids = self.words[word] = self._ids(word)
        return ids

    def _behind_space(self, word: str) -> bytes:
        ids = self.pieces[word] = self._ids(" " + word)
        return ids

    def _leading(self, piece: str) -> bytes:
        """A piece at the start of a text, with no space before it."""
        if not (piece.isascii() and piece.isalpha()):
            return self._plain(piece)
        if len(self.words) > WORDS:
            self.words.clear()
        return self.words.get(piece) or self._word(piece)

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Cache pieces that hold no space, as they stand behind one.  Those that hold a line
        end are returned instead: two words met by chance, which seldom come again."""
        get, word, split, once = self.words.get, self._word, LATIN.findall, {}
        kept, behind = self.pieces.get, self._behind_space
        for piece in pieces:
            cached = once if "\n" in piece else self.pieces
            if not piece.isascii() and max(piece) >= LIMIT:
                # beyond the Latin letters two Unicode versions might class a character differently
                cached[piece] = self._plain(" " + piece)
                continue
            core = piece.rstrip(".,")
            if core.isalpha():  # a word and what ends it: no other split is possible
                ids = kept(core) or behind(core)
                if len(core) < len(piece):
                    end = piece[len(core):]
                    cached[piece] = ids + (get(end) or word(end))
                continue
            before, line, after = piece.partition("\n")
            head, tail = before.rstrip(".,"), after.rstrip(".,")
            if line and head.isalpha() and tail.isalpha():  # one line end between two such words
                parts = (before[len(head):], line, tail, after[len(tail):])
                cached[piece] = b"".join([kept(head) or behind(head), *[get(x) or word(x) for x in parts if x]])
            else:
                cached[piece] = b"".join([get(x) or word(x) for x in split(" " + piece)])
        if len(self.words) > WORDS:
            self.words.clear()
        return once

    def _stretches(self, text: str) -> Iterator[list[bytes]]:
        """Encoded pieces, about a million characters of text at a time."""
        at, lead, cached = 0, False, self.pieces
        while at < len(text):
            cut = CUT.search(text, at + (1 << 20)) if len(text) - at > 1 << 21 else None
            end = cut.start() if cut else len(text)
            part = text[at:end] if cut or at else text
            if len(cached) > CACHE:
                cached.clear()
            words = part.split(" ")
            first = [] if lead else [words.pop(0)]
            got = list(map(cached.get, words))
            if None in got:
                missing = [i for i, x in enumerate(got) if x is None]
                new = list(dict.fromkeys([words[i] for i in missing]))
                if first == [""] or "" in new or any(w[0].isspace() or w[-1].isspace() for w in new) or (first and first[0][-1:].isspace()):
                    words = CUT.split(part)  # other white space beside a space
                    first = [] if lead else [words.pop(0)]
                    missing, got = range(len(words)), [None] * len(words)
                    new = [w for w in dict.fromkeys(words) if w not in cached]
                once = self._new([w for w in new if " " not in w])
                for w in new:
                    if " " in w:
                        cached[w] = self._plain(" " + w)
                for i in missing:
                    got[i] = cached.get(words[i]) or once[words[i]]
            yield [self._leading(w) for w in first] + got
            at, lead = end + 1, True


def _written(spec: str, folder: str, bits: int, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext
        encoder, part = Encoder(spec), TaskContext.get().partitionId()
        store, path = FileSystem.from_uri(folder)
        doc_ids, docs, size, seq = [], [], 0, 0

        def put() -> pa.RecordBatch:
            name, data = f"part-{part:06d}-{seq:04d}.tok", file_bytes(doc_ids, docs, bits)
            draft = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [size], "n_bytes": [len(data)]})
        end = np.array([end_id], np.uint32)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py()), end])
                if bits < 32 and int(ids.max()) >> bits:
                    raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
                if docs and size + len(ids) > file_ids:
                    yield put()
                    doc_ids, docs, size, seq = [], [], 0, seq + 1
                doc_ids.append(doc)
                docs.append(ids)
                size += len(ids)
        if docs:
            yield put()
    return run


def write_tokens(docs: DataFrame, spec: str, folder: str, bits: int | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files and return their manifest (file, part, seq, n_docs, n_ids, n_bytes).
    ``spec``: the tokenizer's JSON.  ``bits``: default, the fewest for its ids."""
    if bits is None:
        from tokenizers import Tokenizer
        bits = max(1, (Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1).bit_length())
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(ordered.mapInArrow(_written(spec, folder, bits, end_id, file_ids), "file string, part long, seq long, n_docs long, n_ids long, n_bytes long"), "token-manifest")


def ids_before(manifest: DataFrame) -> DataFrame:
    """(file, before): the ids of all files before each, by the numbers of part and file: a sum
    within each part, and one over the parts."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("of_part")).selectExpr("part", "sum(of_part) over (order by part) - of_part as before_part")
    return (manifest.selectExpr("file", "part", "sum(n_ids) over (partition by part order by seq) - n_ids as inside")
            .join(parts, "part").select("file", (F.col("before_part") + F.col("inside")).alias("before")))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): every document of the files,
    ``start`` counted over all files in order."""
    kind = "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = TokenFile(content.as_py())
                rows = [held.doc(i).astype("<u4") for i in range(len(held.ends))]
                size = np.array([len(x) for x in rows], np.int64)
                out = [pa.array([name] * len(rows)), pa.array(held.doc_ids, mask=~held.known), pa.array(held.ends - size), pa.array(size),
                       pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["file", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
    if manifest.isEmpty():
        return spark.createDataFrame([], kind).drop("file").withColumnRenamed("at", "start")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, kind)
    return found.join(ids_before(manifest), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def tokenizer_spec(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_and_read(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, tokenizer_spec(tokenizer), folder))


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))
