"""Token ids of whole texts in files of Simple-8b blocks, and their reader.

write() deals the documents out by ascending id (null first, then by a hash of the text), encodes each text,
appends the end id, and writes a file for each partition; read() decodes the files block by block and returns
a row for each document. A file is: magic; blocks of `block_ids` ids, each its words and its escapes; a footer
with the blocks' offsets and sizes, the documents' ids and numbers of tokens; the footer's offset.

Texts are cut at ASCII white space and each distinct piece goes through the tokenizer once in a while (a
bounded table keeps ids by piece). That is exact for tokenizers that put texts in form NFC, lower-case them,
normalise white space away and never merge across it or across letters and marks, which `split_safe` states;
with it off, whole texts are encoded. Texts that hold the content of an added token, in whatever case, are
encoded whole; texts with combining marks are cut but not lower-cased before, as capitals and small letters
compose with different marks; a mark behind a piece is cut off only where the piece is in its normal form.

Cases: null and blank texts have the end id alone; repeated rows are documents of their own; no rows make no
file and no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import files
from quern.llm.common import new_path, settle
from quern.llm.simple8b import decode, encode
from quern.ship import ship

#: Fixed value: begins and ends every file.
MAGIC = b"QS8B0001"
U64 = np.uint64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class TokenParams:
    tokenizer: str  # path of a tokenizers JSON file, the same on every machine
    end_id: int = 2
    block_ids: int = 1 << 16
    split_safe: bool = True
    memo_pieces: int = 1_000_000


class _Places(dict):
    """Piece -> its number; a new piece gets the next one and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


#: The first bytes of combining marks that compose with ASCII letters (U+0300 to U+036F).
MARKS = (b"\xcc", b"\xcd")
#: A word and the marks behind it: never one token, as no pre-token has both letters and marks.
TAIL = re.compile(rb"(.*[a-z\x80-\xff])([.,!?;:*%$&#|]+)", re.DOTALL)


def _normal(text: str) -> bool:
    """Normalising would not change it."""
    return text.islower() and text.isascii() or text == text.lower() and is_normalized("NFC", text)


def _byte_level() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTable:
    """Token ids by piece of text: pieces' places in one growing array."""

    def __init__(self, p: TokenParams):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.p, self.tok = p, Tokenizer.from_file(p.tokenizer)
        self.many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.model, self.level = self.tok.model, _byte_level()
        probe = ["a", "the", "wordiness", "été", "über", "ñandú", "größe", "слово", "言葉", "x" * 40]
        self.direct = p.split_safe and all(self._word(w) == self.tok.encode(w, add_special_tokens=False).ids for w in probe)
        #: Content of added tokens, which are found before anything is lower-cased.
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def _word(self, word: str) -> list[int]:
        """The ids of a lower-case word of letters, from the model itself: normalising would not change it."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.level))]

    def clear(self) -> None:
        self.place = _Places()
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _put(self, numbers: list[int], flat: np.ndarray, lens: np.ndarray) -> None:
        total = len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = flat
        self.start[numbers] = self.used + np.cumsum(lens) - lens
        self.length[numbers] = lens
        self.used += total

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([e.ids for e in self.many(pieces, add_special_tokens=False)])

    @staticmethod
    def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def _fill(self) -> None:
        place, new = self.place, self.place.new
        words, other, joined = [], [], []
        direct, tokenize = self.direct, self.model.tokenize
        i = 0
        while i < len(new):  # stems and tails join the queue
            piece = new[i]
            i += 1
            if direct and piece.isalpha() and piece.islower():
                words.append((place[piece], [t.id for t in tokenize(piece.decode("ascii"))]))
                continue
            text = piece.decode("utf-8", "replace")
            if direct and text.isalpha() and _normal(text):
                words.append((place[piece], self._word(text)))
            elif (m := TAIL.fullmatch(piece)) and (stem := m[1].decode("utf-8", "replace"))[-1].isalpha() and _normal(stem):
                joined.append((place[piece], place[m[1]], place[m[2]]))
            else:
                other.append((place[piece], text))
        while len(place) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        if words:
            self._put([n for n, _ in words], *self._flat([x for _, x in words]))
        if other:
            self._put([n for n, _ in other], *self._encode([t for _, t in other]))
        if joined:
            n, a, b = np.array(joined).T
            both = np.stack([a, b], axis=1).ravel()
            lens = self.length[both]
            self._put(n, self._gather(both, lens), lens.reshape(-1, 2).sum(axis=1))
        new.clear()

    def _gather(self, numbers: np.ndarray, lens: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.start[numbers] - (ends - lens), lens) + np.arange(int(lens.sum()))]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, tokens of each text), the end id after each text."""
        p = self.p
        if not p.split_safe:
            found = [[*e.ids, p.end_id] for e in self.many([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.array([len(x) for x in found], np.int64)
        if len(self.place) > p.memo_pieces:
            self.clear()
        parts, whole = [], []
        for i, t in enumerate(texts):
            low = t.translate(LOWER)
            if any(a in low for a in self.added):
                whole.append(i)
                parts.append([])
            else:
                parts.append((t if any(m in t for m in MARKS) else low).split())
        get = self.place.__getitem__
        at: list[int] = []
        for w in parts:
            at.extend(map(get, w))
        if self.place.new:
            self._fill()
        place = np.array(at, np.int64)
        lens = self.length[place]
        counts = np.array([len(w) for w in parts], np.int64)
        ends = np.concatenate(([0], np.cumsum(lens)))
        sizes = ends[np.cumsum(counts)] - ends[np.cumsum(counts) - counts] + 1
        out = np.full(int(sizes.sum()), p.end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(sizes) - 1] = False
        out[keep] = self._gather(place, lens)
        if whole:
            found = np.split(out, np.cumsum(sizes)[:-1])
            for i, e in zip(whole, self.many([texts[i].decode("utf-8", "replace") for i in whole], add_special_tokens=False), strict=True):
                found[i] = np.array([*e.ids, p.end_id], np.uint32)
            out, sizes = np.concatenate(found), np.array([len(x) for x in found], np.int64)
        return out, sizes


class BlockWriter:
    def __init__(self, f, p: TokenParams):
        self.f, self.p, self.at = f, p, len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[tuple[int, int, int, int]] = []  # offset, words, escapes, ids
        f.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.p.block_ids:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.p.block_ids * self.p.block_ids
            for i in range(0, whole, self.p.block_ids):
                self._block(flat[i : i + self.p.block_ids])
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = encode(ids)
        raw = words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
        self.f.write(raw)
        self.blocks.append((self.at, len(words), len(escapes), len(ids)))
        self.at += len(raw)

    def close(self, doc_ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        body = np.array(self.blocks, "<i8").reshape(-1, 4).tobytes() + doc_ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + sizes.astype("<i8").tobytes()
        self.f.write(body + struct.pack("<qqq", self.at, len(self.blocks), len(doc_ids)) + MAGIC)


class BlockReader:
    def __init__(self, f):
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 24 - len(MAGIC))
        tail = f.read()
        if tail[24:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        at, blocks, docs = struct.unpack("<qqq", tail[:24])
        f.seek(at)
        raw = f.read(end - 24 - len(MAGIC) - at)
        self.f = f
        self.blocks = np.frombuffer(raw, "<i8", blocks * 4).reshape(-1, 4)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, blocks * 32)
        self.valid = np.frombuffer(raw, "u1", docs, blocks * 32 + docs * 8).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, blocks * 32 + docs * 9)

    def block(self, k: int) -> np.ndarray:
        offset, words, escapes, n = (int(x) for x in self.blocks[k])
        self.f.seek(offset)
        raw = self.f.read(words * 8 + escapes * 16)
        return decode(np.frombuffer(raw, "<u8", words), n, np.frombuffer(raw, "<u8", escapes * 2, words * 8).reshape(-1, 2)).astype(np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids, in order; holds a block and the document at hand."""
        k, have = 0, np.empty(0, np.uint32)
        for size in self.sizes.tolist():
            parts, missing = [], size
            while missing > len(have):
                parts.append(have)
                missing -= len(have)
                have, k = self.block(k), k + 1
            parts.append(have[:missing])
            have = have[missing:]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


_tables: dict[TokenParams, PieceTable] = {}


def _table(p: TokenParams) -> PieceTable:
    if p not in _tables:
        _tables.clear()
        _tables[p] = PieceTable(p)
    return _tables[p]


def _writer(root: str, p: TokenParams):
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        table, path = _table(p), f"{root}/{uuid.uuid4().hex}.s8b"
        ids, valid, sizes = [], [], []
        with files.replacing(path) as f:
            out = BlockWriter(f, p)
            while first is not None:
                for at in range(0, len(first), 256):
                    b = first.slice(at, 256)
                    flat, n = table.ids([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b["text"].cast(pa.binary())])
                    out.add(flat)
                    ids.append(b["id"].fill_null(0).to_numpy(zero_copy_only=False))
                    valid.append(b["id"].is_valid().to_numpy(zero_copy_only=False))
                    sizes.append(n)
                first = next((b for b in batches if len(b)), None)
            out.close(np.concatenate(ids), np.concatenate(valid), np.concatenate(sizes))
        sizes = np.concatenate(sizes)
        yield pa.record_batch([[TaskContext.get().partitionId()], [path], [len(sizes)], [int(sizes.sum())]], schema=schema)

    return run


def write(docs: DataFrame, p: TokenParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token files in order: (part, path, docs, tokens, base), base the ids of all files before."""
    ship(docs.sparkSession)
    root = new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    mark = F.xxhash64("text")
    dealt = rows.repartitionByRange("id", mark).sortWithinPartitions("id", mark)
    made = settle(dealt.mapInArrow(_writer(root, p), "part long, path string, docs long, tokens long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(written: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files."""
    ship(written.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                with files.reading(path) as f:
                    r = BlockReader(f)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in r.documents()]
                    starts = base + np.cumsum(r.sizes) - r.sizes
                    yield pa.record_batch([pa.array(r.doc_ids, mask=~r.valid), pa.array(starts), pa.array(r.sizes), pa.array(crc, pa.int64())], schema=schema)

    spread = written.select("path", "base").repartition(max(1, written.count()))
    return spread.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")
