"""Byte-level BPE with the tokenizers library, by words that are encoded once.

A byte-level pre-tokenizer always cuts between a character that isn't white space and white space
behind it, and around a single line feed between two such characters. So a text's ids are the ids of
its words, each with the space or line feed before it. Words repeat; each worker has the library's BPE
model encode a word once and remembers its ids. The memo is bounded and only saves time: it never
decides an id. A text where the rule doesn't hold (runs of white space) is encoded whole.
"""

from __future__ import annotations

import json
import os
import string
from array import array

_PUNCTUATION = string.punctuation


def _byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


class _Memo(dict):
    """Learns what it lacks. When it is full, further words go to a smaller part that starts anew when it is full too."""

    def __init__(self, learn, limit: int):
        super().__init__()
        self.learn, self.limit, self.recent = learn, limit, {}

    def __missing__(self, w: str):
        got = self.recent.get(w, self)
        if got is self:
            got = self.learn(w)
            if len(self) < self.limit:
                self[w] = got
            else:
                if len(self.recent) > self.limit // 4:
                    self.recent.clear()
                self.recent[w] = got
        return got


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not any(c.isspace() for a in spec.get("added_tokens", []) for c in a["content"])
        )
        self.plain = not any(a["content"].isalpha() for a in spec.get("added_tokens", []))
        self.table = _byte_table()
        self.space, self.feed = self.table[32], self.table[10]
        #: by what follows a space, or by a line feed and what follows it; None: the rule doesn't hold
        self.memo = _Memo(self._learn, limit)
        self.heads = _Memo(lambda w: self._chunk(w, "", w) if w else b"", limit // 8)
        self.marks = _Memo(lambda w: self._whole([w])[0], 1000)

    def _whole(self, docs: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(docs, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _chunk(self, chunk: str, space: str, core: str) -> bytes:
        """Ids of chunk, which is space and then core."""
        if core.isalpha():
            tail = b""
        else:
            bare = core.rstrip(_PUNCTUATION)
            if not bare.isalpha() or not self.plain:
                return self._whole([chunk])[0]
            core, tail = bare, self.marks[core[len(bare) :]]
        if core.isascii():
            text = core
        elif len(data := core.encode()) <= 2 * len(core) and max(core) < "\u0250":  # Latin letters for any engine
            text = data.decode("latin-1").translate(self.table)
        else:
            return self._whole([chunk])[0]
        if not self.plain:
            return self._whole([chunk])[0]
        if space == " ":
            got = self.memo.get(core) if tail else None
            return (got or array("I", [t.id for t in self.tokenize(self.space + text)]).tobytes()) + tail
        return (self.marks["\n"] if space else b"") + array("I", [t.id for t in self.tokenize(text)]).tobytes() + tail

    def _learn(self, w: str) -> bytes | None:
        if not w or w[-1].isspace():
            return None
        if w[0] == "\n":
            return None if w[1].isspace() else self._chunk(w, "\n", w[1:])
        return None if w[0].isspace() else self._chunk(" " + w, " ", w)

    def encode(self, docs: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(docs)
        word, out = self.memo.__getitem__, []
        for d in docs:
            words = d.replace("\n", " \n").split(" ")
            head = words[0]
            try:
                if len(words) > 1 and (not head or head[-1].isspace()):
                    raise TypeError
                words[0] = b""
                out.append(self.heads[head] + b"".join(map(word, words[1:])))
            except TypeError:  # a None
                out.append(self._whole([d])[0])
        return out
