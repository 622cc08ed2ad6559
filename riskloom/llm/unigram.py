"""Unigram tokenisation: count-only Viterbi, and streaming Viterbi with decoding.

Aho-Corasick finds all vocabulary pieces that end at each character, longest first. The best path to a
place takes the first of equally good candidates in that order, which is the tie rule of the unigram
tokenizer (earliest start wins; only a strictly better score replaces). Scores are added in single precision,
like there. A character without a piece of its own gets the unknown score (10 below the worst piece) and
becomes its UTF-8 bytes with byte fallback; without it, unknown characters in a row are one unknown piece.

In a vocabulary where the space mark stands only at the start of pieces, no piece crosses from a word to the
next, so every path passes the start of every word. Words are then coded one by one, and each worker
remembers what it coded in a bounded memo that only saves time.

Defined results: null text is empty and has no pieces; repeated rows are coded each; a null doc_id keeps its
row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import column, small_batches, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field number, wire type, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: bytes | int = number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + n]
            at += n
        yield key >> 3, kind, value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == 0:
        return head + _varint(value)
    return head + (value if kind in (1, 5) else _varint(len(value)) + value)


def rank_score(place: int) -> float:
    """Score of the piece at a place of a vocabulary that is ordered by use (Zipf), in eighths, so that sums in single precision are exact."""
    return -round(8 * math.log(place + 2)) / 8


def as_unigram(model: bytes) -> bytes:
    """A model file with unigram scores: of one of another kind, pieces get scores by rank. Nothing is trained."""
    out, place = [], 0
    spec = next(v for n, _, v in _fields(model) if n == 2)
    kind = next((v for n, _, v in _fields(spec) if n == 3), 1)
    if kind == 1:
        return model
    for n, wire, value in _fields(model):
        if n == 1:
            part = {a: (b, c) for a, b, c in _fields(value)}
            if part.get(3, (0, _NORMAL))[1] == _NORMAL:
                part[2] = (5, np.float32(rank_score(place)).tobytes())
            place += 1
            value = b"".join(_field(a, b, c) for a, (b, c) in sorted(part.items()))
        elif n == 2:
            value = b"".join(_field(a, b, c) for a, b, c in _fields(value) if a != 3) + _field(3, 0, 1)
        out.append(_field(n, wire, value))
    return b"".join(out)


@dataclass
class Unigram:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    trim_spaces: bool = True
    byte_fallback: bool = False
    bytes_of: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Unigram:
        with open(path, "rb") as f:
            return Unigram.parse(as_unigram(f.read()))

    @staticmethod
    def parse(model: bytes) -> Unigram:
        m = Unigram([], [], [])
        for n, _, value in _fields(model):
            if n == 1:
                part = {a: c for a, _, c in _fields(value)}
                m.pieces.append(part.get(1, b"").decode())
                m.scores.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
                m.kinds.append(part.get(3, _NORMAL))
            elif n == 2:
                m.byte_fallback = bool(dict((a, c) for a, _, c in _fields(value)).get(35, 0))
            elif n == 3:
                spec = {a: c for a, _, c in _fields(value)}
                if spec.get(2):
                    raise ValueError("only models without a character map are supported")
                m.dummy_prefix, m.trim_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m.prepared()

    def prepared(self) -> Unigram:
        import ahocorasick

        normal = [s for s, k in zip(self.scores, self.kinds) if k == _NORMAL]
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        top = max(normal, default=0.0)
        self.machine, self.single, self.longest = ahocorasick.Automaton(), set(), 1
        self.by_word = True
        self.byte_id = {}
        for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)):
            if k == _BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
            elif k in (_NORMAL, _USER) and p:
                score = len(p.encode()) * top - 0.1 if k == _USER else s
                self.machine.add_word(p, (len(p), score, i))
                self.longest = max(self.longest, len(p))
                if len(p) == 1:
                    self.single.add(p)
                self.by_word &= MARK not in p.lstrip(MARK)
        if len(self.machine):
            self.machine.make_automaton()
        self.by_line = self.by_word and self.dummy_prefix and self.byte_fallback and not any("\n" in p for p in self.pieces)
        self.exact = all((8 * s).is_integer() for s in normal)  # sums are the same in single precision
        self.add = (lambda a, b: a + b) if self.exact else (lambda a, b: float(np.float32(a + b)))
        return self

    def normalise(self, text: str) -> str:
        if self.trim_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def chunks(self, text: str) -> tuple[list[str], bool]:
        """The text in parts that no piece crosses; True: each lacks the mark before it."""
        if self.trim_spaces and ("  " in text or text[:1] == " " or text[-1:] == " "):
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return [], False
        if self.by_word and self.dummy_prefix and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return words, True
        text = self.normalise(text)
        return (re.split(f"(?<=[^{MARK}])(?={MARK})", text) if self.by_word else [text]), False

    def lines(self, text: str) -> list[list[str]] | None:
        """Words of each line. Every path passes both sides of a line feed that no piece has, so lines are apart
        too; a line's words but the first have the mark before them, and so has the first of all. None where
        spaces in a row could share a piece."""
        if not self.by_line or MARK in text or not text:
            return None
        if self.trim_spaces and ("  " in text or text[:1] == " " or text[-1:] == " "):
            return None
        out = [line.split(" ") for line in text.split("\n")]
        if not out[0][0] or any("" in words[1:] for words in out):
            return None
        return out

    def steps(self, text: str) -> Iterator[tuple[int, int, float, int]]:
        """(end, start, score, id) of all pieces in the text, by end and then start; unknown characters have id -1."""
        known = self.single.issuperset(text)
        if known:
            for last, (n, score, i) in self.machine.iter(text):
                yield last + 1, last + 1 - n, score, i
            return
        done = 0  # ends up to here have had their unknown character
        for last, (n, score, i) in self.machine.iter(text) if len(self.machine) else ():
            for e in range(done + 1, last + 1):
                if text[e - 1] not in self.single:
                    yield e, e - 1, self.unknown_score, -1
            done = max(done, last)
            yield last + 1, last + 1 - n, score, i
        for e in range(done + 1, len(text) + 1):
            if text[e - 1] not in self.single:
                yield e, e - 1, self.unknown_score, -1

    def count(self, text: str) -> complex:
        """Number of pieces (real part) and score (imaginary) of the best path: no path is kept."""
        if self.exact and self.single.issuperset(text):
            return self._count_known(text)
        add = self.add
        best: list[float | None] = [0.0] + [None] * len(text)
        many = [0] * (len(text) + 1)
        loose = [False] * (len(text) + 1)  # the path ends in an unknown piece
        for end, start, score, i in self.steps(text):
            if (have := best[start]) is None:
                continue
            have = add(have, score)
            if best[end] is None or have > best[end]:
                best[end] = have
                if i >= 0:
                    many[end], loose[end] = many[start] + 1, False
                elif self.byte_fallback:
                    many[end] = many[start] + len(text[start].encode("utf-8", "surrogatepass"))
                else:
                    many[end], loose[end] = many[start] + (not loose[start]), True
        return complex(many[-1], best[-1] or 0.0)

    def _count_known(self, text: str) -> complex:
        """count() where every character is a piece and sums are exact."""
        best: list = [0.0] + [None] * len(text)
        many = [0] * (len(text) + 1)
        for last, piece in self.machine.iter(text):
            n, score, _ = piece
            end = last + 1
            have = best[end - n]
            if have is not None:
                have += score
                old = best[end]
                if old is None or have > old:
                    best[end] = have
                    many[end] = many[end - n] + 1
        return complex(many[-1], best[-1])

    def decode(self, ids: list[int]) -> str:
        out: list[bytes] = []
        for i in ids:
            k = self.kinds[i]
            if k == _BYTE:
                out.append(bytes([int(self.pieces[i][1:-1], 16)]))
            elif k != _CONTROL:
                out.append((" ⁇ " if k == _UNKNOWN else self.pieces[i]).encode())
        text = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Streaming:
    """Viterbi over characters that come in parts. It keeps the places that a path may still pass: those behind
    the last committed boundary. When they are more than `longest` and the back pointers of the last `longest` places meet at one boundary, the
    ids up to it are final and leave the window."""

    def __init__(self, model: Unigram):
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.text, self.best, self.back = "", [0.0], [(0, -1)]
        self.checked = 0
        self.peak = 0

    def feed(self, more: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(more), self.m.longest):
            self._extend(more[at : at + self.m.longest])
            self.peak = max(self.peak, len(self.text))
            if len(self.text) > self.m.longest:  # the window is full
                out += self._commit(self._meeting())
        return out

    def _extend(self, part: str) -> None:
        m, old = self.m, len(self.text)
        self.text += part
        self.best += [None] * len(part)
        self.back += [(0, -1)] * len(part)
        base = max(0, old - m.longest + 1)  # a piece that ends in the new part starts at most that far back
        best, back, add = self.best, self.back, m.add
        for end, start, score, i in m.steps(self.text[base:] if base else self.text):
            end += base
            if end <= old or (have := best[start + base]) is None:
                continue
            have = have + score if m.exact else add(have, score)
            if best[end] is None or have > best[end]:
                best[end], back[end] = have, (start + base, i)

    def _meeting(self) -> int:
        """The last boundary that the paths of all places a piece may still start at have in common."""
        n = len(self.text)
        live = {p for p in range(max(0, n - self.m.longest + 1), n + 1) if self.best[p] is not None}
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            live.add(self.back[p][0])
        return live.pop()

    def _commit(self, to: int) -> list[int]:
        path = []
        p = to
        while p:
            start, i = self.back[p]
            path.append((start, i))
            p = start
        out: list[int] = []
        for start, i in reversed(path):
            if i >= 0:
                out.append(i)
            elif self.m.byte_fallback:
                out += [self.m.byte_id[b] for b in self.text[start].encode("utf-8", "surrogatepass")]
            else:
                out.append(-1)
        self.text, self.best = self.text[to:], self.best[to:]
        self.back = [(s - to, i) for s, i in self.back[to:]]
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.text))
        self.clear()
        return out


class _Memo(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.recent = make, limit, {}

    def __missing__(self, word: str):
        got = self.recent.get(word)
        if got is None:
            got = self.make(word)
            if len(self) < self.limit:
                self[word] = got
            else:
                if len(self.recent) > self.limit // 4:
                    self.recent.clear()
                self.recent[word] = got
        return got


class Counter:
    """Pieces and score of whole texts."""

    def __init__(self, model: Unigram, limit: int = 500_000):
        self.model = model
        self.marked = _Memo(lambda w: model.count(MARK + w), limit)
        self.bare = _Memo(model.count, limit // 8)

    def __call__(self, text: str) -> tuple[int, float]:
        lines = self.model.lines(text)
        if lines is not None:
            lines[0] = ["", *lines[0]]
            heads = [w[0] for w in lines if w[0]] + ["\n"] * (len(lines) - 1)
            got = sum(map(self.bare.__getitem__, heads), 0j)
            for w in lines:
                got = sum(map(self.marked.__getitem__, w[1:]), got)
            return int(got.real), got.imag
        parts, marked = self.model.chunks(text)
        got = sum(map((self.marked if marked else self.bare).__getitem__, parts), 0j)
        return int(got.real), got.imag


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, model: Unigram, limit: int = 400_000):
        self.model, self.stream = model, Streaming(model)
        self.marked = _Memo(lambda w: self._ids(MARK + w), limit)
        self.bare = _Memo(self._ids, limit // 8)

    def _ids(self, chunk: str) -> bytes:
        return array("i", self.stream.feed(chunk) + self.stream.finish()).tobytes()

    def __call__(self, text: str) -> bytes:
        lines = self.model.lines(text)
        if lines is not None:
            lines[0] = ["", *lines[0]]
            feed, parts = self.bare["\n"], []
            for w in lines:
                head = [self.bare[w[0]]] if w[0] else []
                parts.append(b"".join([*head, *map(self.marked.__getitem__, w[1:])]))
            return feed.join(parts)
        parts, marked = self.model.chunks(text)
        out = b"".join(map((self.marked if marked else self.bare).__getitem__, parts))
        if not self.model.byte_fallback:  # unknown characters in a row are one piece
            ids = np.frombuffer(out, "<i4")
            keep = (ids >= 0) | np.concatenate([[True], ids[:-1] >= 0])[: len(ids)]
            out = np.where(ids < 0, self.model.unknown, ids)[keep].astype("<i4").tobytes()
        return out


@functools.cache
def _model(path: str) -> Unigram:
    return Unigram.load(path)


def _by_doc(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(_model(path))
        for b in small_batches(batches, "text"):
            got = [count(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return _by_doc(docs).mapInArrow(run, "doc_id long, n_tokens long, score double")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(_model(path))
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), pa.array([encode(t) for t in texts(b)], pa.binary())], names=["doc_id", "text", "ids"])

    return _by_doc(docs).mapInArrow(run, "doc_id long, text string, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and same (the decoded text is the text as the model normalises
    it) from rows of encoded()."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        words: dict[int, bytes] = {}
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            words[i] = bytes([int(p[1:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else (" ⁇ " if k == _UNKNOWN else p.replace(MARK, " ")).encode()
        for b in small_batches(batches, "text"):
            rows = []
            for doc_id, text, raw in zip(column(b, "doc_id").to_pylist(), texts(b), column(b, "ids").to_pylist()):
                out = b"".join(map(words.__getitem__, memoryview(raw).cast("i")))
                if model.dummy_prefix and out[:1] == b" ":
                    out = out[1:]
                plain = (re.sub(" +", " ", text).strip(" ") if model.trim_spaces else text).replace(MARK, " ")
                rows.append((doc_id, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(out).hexdigest(), out == plain.encode("utf-8", "surrogatepass")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"])

    return ids.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
