"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation
are rendered and consecutive outputs compared: what the longer one adds is the last turn's span. If the
longer one doesn't start with the shorter one, the template rewrites history; the turn is marked, and its span
starts where the outputs part. Inside a span, the text's own place is where outputs for two one-letter probes
differ, so no knowledge of the template is needed for the loss mask.

Whole prefixes are rendered, in the query too, so memory is a conversation and time grows with the square of its
length. A caller may promise a context, the number of turns before a turn that its rendering can depend on: then
prefixes start that many turns back, time is linear and memory bounded, but a template that rewrites turns farther
back isn't found out.

Rows are dealt by conversation, sorted, and streamed a turn at a time.

Defined results: turns are ordered by turn, role and text, nulls first; null text and role are empty; rows
that repeat a turn are turns each; a null conv_id is a conversation of its own; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import column, shuffle_parts, small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The control strings of the template below.
CONTROLS = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE ", "[/ROLE]"]
_FIND = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|<s>(?P<assistant>.*?)</s>|\[ROLE (?P<name>(?:\\.|[^\]\\])*)\](?P<other>.*?)\[/ROLE\]", re.S)


def escape(text: str) -> str:
    r"""Doubles each \ and puts one behind the first character of each control string, so none is left."""
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def instruct(turns: list[Turn]) -> str:
    """The template of the query."""
    marks = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
    out = []
    for role, text in turns:
        a, b = marks.get(role) or (f"[ROLE {escape(role).replace(']', chr(92) + ']')}]", "[/ROLE]")
        out.append(a + escape(text) + b)
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of what instruct() made."""
    out: list[Turn] = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        out.append((unescape(m["name"]) if kind == "other" else kind, unescape(m[kind])))
    return out


def _same(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


class Renderer:
    """Takes a conversation's turns one after another."""

    def __init__(self, template: Template, context: int | None = None):
        self.template, self.context = template, context
        self.turns: list[Turn] = []
        self.at = 0

    def add(self, role: str, text: str) -> dict:
        """The turn's piece of the output, its place, where in the piece its text is, and whether history changed."""
        before = self.turns
        old = self.template(before) if before else ""
        new = self.template([*before, (role, text)])
        x, y = (self.template([*before, (role, probe)]) for probe in "xy")
        part = _same(old, new)
        rewritten = part < len(old)
        head = _same(x, y)
        tail = _same(x[::-1], y[::-1])
        piece = new[part:]
        out = {"piece": piece, "start": self.at - (len(old) - part), "text_from": max(0, head - part), "text_to": max(0, len(new) - tail - part), "rewritten": rewritten}
        self.at = out["start"] + len(piece)
        self.turns = [*before, (role, text)]
        if self.context is not None:
            self.turns = self.turns[-self.context :] if self.context else []
        return out


_PIECES = "conv_id long, nth long, role string, start long, text_from long, text_to long, rewritten boolean, piece string"


def format_turns(conversations: DataFrame, template: Template = instruct, context: int | None = None) -> DataFrame:
    """A row for each turn, in order within its partition: the piece it adds and where its text is in it."""
    parts = shuffle_parts(conversations.sparkSession)
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.col(c).cast("string").alias(c) for c in ("role", "text"))]
    dealt = conversations.select(*cols).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, held, nth = None, None, 0
        for batch in small_batches(batches, "text"):
            rows = []
            for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if renderer is None or conv != held:
                    renderer, held, nth = Renderer(template, context), conv, 0
                got = renderer.add(role or "", text or "")
                rows.append((conv, nth, role or "", got["start"], got["text_from"], got["text_to"], got["rewritten"], got["piece"]))
                nth += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return dealt.mapInArrow(run, _PIECES)


def digests(pieces: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of each conversation, read back from the pieces of instruct(), which must come as
    format_turns() gives them: together and in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def close(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])

        for batch in batches:
            rows = []
            for conv, nth, a, b, rewritten, piece in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "nth", "text_from", "text_to", "rewritten", "piece"))):
                if not nth or state is None:
                    if state is not None:
                        rows.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == loss_role:
                        masked = unescape(piece[a:b])
                        state[3] += len(masked)
                        state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
                state[6] |= rewritten
            if rows:
                yield _digest_batch(rows)
        if state is not None:
            yield _digest_batch([close(state)])

    return pieces.mapInArrow(run, schema)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def conversations(pieces: DataFrame) -> DataFrame:
    """Formatted text and the spans under the loss mask, for conversations that fit in a row."""
    turn = F.struct("nth", "start", "role", (F.col("start") + F.col("text_from")).alias("from"), (F.col("start") + F.col("text_to")).alias("to"), "piece")
    got = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    spans = F.transform(F.filter("_t", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to")))
    return got.select("conv_id", F.array_join(F.col("_t.piece"), "").alias("formatted"), spans.alias("loss_spans"))
