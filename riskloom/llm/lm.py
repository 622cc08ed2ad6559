"""Language-model scoring with an Elias-Fano n-gram trie.

Training. Words are hashed to 64 bits; sorted hashes are the vocabulary, and a word's id is its place there.
Level 1 holds the words' counts. Level k holds the pairs (context, word) that occur, the context being a place
in level k - 1, sorted and cut into shards of about equal numbers of tokens; a context with very many tokens
is spread over several shards by word. Tasks count what they read, and (shard, sorted pairs, counts) arrays go
to the shard's reducer. Each training pass reads all training documents, at any size.

A shard of a level holds, for its contexts, the Elias-Fano sequence of where each one's words start, the
Elias-Fano sequence of the words (made non-decreasing by adding the last value of the context before, so a
search is relative to its context), and one byte each for the probability of each pair and the back-off weight
of each context. Probabilities are interpolated absolute discounting: (c - D) / C + D * T / C * lower, with C
the context's count, T its number of words, D = n1 / (n1 + 2 n2) of the level, and add-1/2 unigrams at the
bottom, which leave mass for unknown words. Logs are rounded to steps of 1/25.

Scoring maps shards into memory from the shared folder and looks up the distinct pairs of some megabytes of
text at a time, vectorised: pointers of the context, then a successor search among its words. Pairs that are not
there take the back-off weight and the lower level. The driver sees a manifest row a shard.

Defined results: null and empty texts are the end token alone; ASCII letters are lower-cased; a null doc_id
counts as training and keeps its row; repeated rows count and are scored each; other columns are ignored; with
no training documents every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import eliasfano
from riskloom.llm.blocks import runs
from riskloom.llm.common import WordHasher, column, filesystem, remove, shared_path, shuffle_parts, small_batches, stored

STEP = 1 / 25
#: tokens between places where a level may be cut, and of a shard at most; a shard has fewer where tasks would go without
PIECE, SHARD = 1 << 18, 1 << 21
BATCH = 8 << 20
_U = np.uint64
END = WordHasher().h(b"")  # no word is empty


# files of named arrays


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    spec, at, parts = {}, 0, []
    for k, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        spec[k] = (a.dtype.str, len(a), at)
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with store.open_output_stream(path) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for p in parts:
            f.write(p)


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """Arrays over a memory map where the shared folder is mounted, else over the file's bytes."""
    from pyarrow import fs

    store, path = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with store.open_input_file(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(data[:8].tobytes(), "little")
    spec = json.loads(data[8 : 8 + n].tobytes())
    return {k: data[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in spec.items()}


# what a model is made of


@dataclass
class Level:
    """Shards of a level in order: paths, place of the first entry, and from which (context, word) on."""

    paths: list[str] = field(default_factory=list)
    bases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    from_ctx: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    from_word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: int = 0
    discount: float = 0.5
    raw: list[str] = field(default_factory=list)
    #: a shard that has words of the context, for contexts that are spread
    home: dict[int, int] = field(default_factory=dict)


@dataclass
class Model:
    folder: str
    order: int
    buckets: int
    tokens: int = 0
    levels: list[Level] = field(default_factory=list)

    @property
    def words(self) -> int:
        return self.levels[0].size


def shard_of(ctx: np.ndarray, word: np.ndarray, from_ctx: np.ndarray, from_word: np.ndarray) -> np.ndarray:
    """The last shard that starts at or before (ctx, word)."""
    out = np.searchsorted(from_ctx, ctx, "right") - 1
    for c in np.unique(from_ctx[from_word > 0]).tolist():  # contexts that are spread over shards
        a, b = np.searchsorted(from_ctx, [c, c + 1])
        mine = np.flatnonzero(ctx == c)
        out[mine] = a - 1 + np.searchsorted(from_word[a:b], word[mine], "right")
    return out


def _sorted_pairs(a: np.ndarray, b: np.ndarray, tops: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by (a, b), integers from 0 on, and where distinct pairs start in it. tops: no value is above them.
    Pairs are packed with their places in a word, where they fit, as sorting values is much faster than sorting places."""
    n = len(a)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits_a, bits_b = (max(1, int(t).bit_length()) for t in tops or (a.max(), b.max()))
    place = n.bit_length()
    if bits_a + bits_b + place <= 64:
        key = (a.astype(_U) << _U(bits_b) | b.astype(_U)) << _U(place) | np.arange(n, dtype=_U)
        key.sort()
        order = (key & _U((1 << place) - 1)).astype(np.int64)
        key >>= _U(place)
    elif bits_a + bits_b <= 64:
        key = a.astype(_U) << _U(bits_b) | b.astype(_U)
        order = np.argsort(key)
        key = key[order]
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        return order, np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1]))


def counted(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with their counts added up."""
    order, first = _sorted_pairs(ctx, word)
    return ctx[order[first]], word[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]


def small(a: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    top = int(a.max()) if len(a) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([kind]) + a.astype(f"<u{kind}").tobytes()


def fitted(a: np.ndarray) -> np.ndarray:
    """Integers from 0 on in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@dataclass
class Batch:
    """Tokens of some texts: at is each one's place among the distinct ids (ascending; -1 for unknown words)."""

    at: np.ndarray
    ids: np.ndarray
    times: np.ndarray
    lengths: np.ndarray


@dataclass
class Found:
    """What a level has of a batch: the distinct n-grams that were looked up, in order, with their places (-1 if not
    there), last words, log10 probabilities and back-off weights, and each token's n-gram (-1 if none)."""

    of: np.ndarray
    place: np.ndarray
    word: np.ndarray
    logp: np.ndarray
    back: np.ndarray


class Reader:
    """A worker's view of a model; shards are opened when first needed."""

    def __init__(self, model: Model):
        self.m = model
        self.open: dict[str, dict] = {}

    def _arrays(self, path: str) -> dict[str, np.ndarray]:
        if path not in self.open:
            self.open[path] = open_arrays(path)
        return self.open[path]

    def tokens(self, texts_: pa.Array) -> Batch:
        """Tokens with the end of each text."""
        at, hashes, lengths = tokens(texts_)
        found, back = np.unique(self.ids(hashes), return_inverse=True)
        return Batch(back[at], found, np.bincount(back[at], minlength=len(found)), lengths)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary places of distinct hashes; -1 if not there."""
        order = np.argsort(h)
        u = h[order]
        got = np.full(len(u), -1, np.int64)
        bucket = ((u >> _U(40)) * _U(self.m.buckets) >> _U(24)).astype(np.int64)
        level = self.m.levels[0]
        for a, n in zip(*runs(bucket)):
            if not (path := level.paths[bucket[a]]):
                continue
            have = self._arrays(path)["hash"]
            at = np.minimum(np.searchsorted(have, u[a : a + n]), len(have) - 1)
            got[a : a + n] = np.where(have[at] == u[a : a + n], at + level.bases[bucket[a]], -1)
        out = np.empty(len(h), np.int64)
        out[order] = got
        return out

    def gathered(self, k: int, places: np.ndarray, raw: tuple[str, ...] = (), made: tuple[str, ...] = ()) -> list[np.ndarray]:
        """Values of entries of level k, from the raw and the finished arrays of their shards."""
        level = self.m.levels[k - 1]
        order, _ = _sorted_pairs(places, np.zeros(len(places), np.int64), (max(level.size - 1, 0), 0))
        sorted_ = places[order]
        out = [np.zeros(len(places), np.int64) for _ in (*raw, *made)]
        shard = np.searchsorted(level.bases, sorted_, "right") - 1
        for a, n in zip(*runs(shard)):
            s, i = shard[a], order[a : a + n]
            at = sorted_[a : a + n] - level.bases[s]
            for j, (paths, name) in enumerate([*((level.raw, x) for x in raw), *((level.paths, x) for x in made)]):
                out[j][i] = self._arrays(paths[s])[name][at]
        return out

    def counts(self, k: int, places: np.ndarray) -> np.ndarray:
        """Counts of entries of level k."""
        return self.gathered(k, places, ("count",))[0]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """log10 of (c + 1/2) / (N + (V + 1) / 2)."""
        c = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        c[known] = self.counts(1, ids[known])
        return np.log10((c + 0.5) / (self.m.tokens + 0.5 * (self.m.words + 1)))

    def find(self, k: int, ctx: np.ndarray, word: np.ndarray, scores: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of level k in order: place or -1, log10 probability there, log10 back-off weight of the context."""
        level = self.m.levels[k - 1]
        place, logp, back = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.zeros(len(ctx))
        if not len(level.paths):
            return place, logp, back
        shard = shard_of(ctx, word, level.from_ctx, level.from_word)
        for a, n in zip(*runs(shard)):
            s = shard[a]
            if s < 0 or not level.paths[s]:
                continue
            part = self._arrays(level.paths[s])
            first, last = (int(x) for x in part["range"])
            mine = a + np.flatnonzero((ctx[a : a + n] >= first) & (ctx[a : a + n] <= last))
            if not len(mine):
                continue
            pointers, words = eliasfano.Sequence(part, "p_"), eliasfano.Sequence(part, "w_")
            own = ctx[mine] - first
            each, many = runs(own)  # contexts come in order: pointers are read once for each
            lo, hi = pointers.get(own[each]).astype(np.int64), pointers.get(own[each] + 1).astype(np.int64)
            base = np.where(lo > 0, words.get(np.maximum(lo - 1, 0)), 0).astype(_U)
            lo, hi, base = (np.repeat(x, many) for x in (lo, hi, base))
            known = np.flatnonzero(word[mine] >= 0)
            at, hit = words.successor(lo[known], hi[known], base[known] + word[mine[known]].astype(_U))
            at, known = at[hit], mine[known[hit]]
            place[known] = at + level.bases[s]
            if scores:
                logp[known] = -STEP * part["prob"][at]
                back[mine] = -STEP * part["back"][own]
        for c, s in level.home.items() if scores else ():  # the word's own shard may have none of the context's words
            a, b = np.searchsorted(ctx, [c, c + 1])
            if a < b:
                part = self._arrays(level.paths[s])
                back[a:b] = -STEP * part["back"][c - int(part["range"][0])]
        return place, logp, back

    def levels(self, batch: Batch, top: int, scores: bool = True) -> Iterator[Found]:
        """Each level's n-grams of a batch, from 2 to top. One that isn't there is in no longer one that is."""
        before = _before(batch.lengths)
        last = Found(batch.at, batch.ids, batch.ids, batch.ids, batch.ids)
        for k in range(2, top + 1):
            use, ctx, end = followed(last, before, k)
            if k == 2:
                end, words = last.of[use], last.word
            else:  # 0: the shorter n-gram isn't there, so only the weight of the context is looked up
                end = np.where(end >= 0, end + 1, 0)
                words = np.append(-1, last.word)
            order, first = _sorted_pairs(ctx, end, (len(last.place), len(words)))
            one = order[first]
            word = words[end[one]]
            of = np.full(len(batch.at), -1, np.int64)
            of[use[order]] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
            place, logp, back = self.find(k, last.place[ctx[one]], word, scores)
            last = Found(of, place, word, logp, back)
            yield last

    def score(self, batch: Batch, low: np.ndarray) -> np.ndarray:
        """log10 probability of each token; low: unigram() of each."""
        out = low
        for found in self.levels(batch, self.m.order):
            use = np.flatnonzero(found.of >= 0)
            of = found.of[use]
            out = out.copy()
            out[use] = np.where(found.place[of] >= 0, found.logp[of], found.back[of] + out[use])
        return out

    def words_at(self, k: int, places: np.ndarray) -> np.ndarray:
        """The last word of entries of level k."""
        while k > 1:
            places = self.gathered(k, places, ("word",))[0]
            k = 1 if k == 2 else k - 1
        return places


def followed(last: Found, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose k - 1 tokens before them are an n-gram of the level below, that n-gram, and the one that ends with
    the token (-1: not there)."""
    there = np.append(last.place >= 0, False)  # -1 is none
    use = 1 + np.flatnonzero((before[1:] >= k - 1) & there[last.of[:-1]])
    end = last.of[use]
    return use, last.of[use - 1], np.where(there[end], end, -1)


def tokens(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token among the distinct ones, their hashes, number of tokens of each text) of strings, with the
    end of each."""
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts_, "")))
    flat = split.flatten()
    some = np.asarray(pc.binary_length(flat)) > 0  # empty ones are before the first and behind the last white space
    n = np.diff(np.append(0, np.cumsum(some))[np.append(0, np.cumsum(np.asarray(split.value_lengths(), np.int64)))])
    coded = flat.filter(pa.array(some)).dictionary_encode()
    words = coded.dictionary
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, ends, ends[1:]))), _U, len(words))
    out = np.full(int(n.sum()) + len(n), len(words), np.int64)
    rest = np.ones(len(out), bool)
    rest[np.cumsum(n + 1) - 1] = False
    out[rest] = np.asarray(coded.indices)
    return out, np.append(hashes, _U(END)), n + 1


def _before(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each text."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


_MANIFEST = "shard int, path string, n long, total long, n1 long, n2 long, first long, n_first long, last long, n_last long, split_at array<long>, split_part array<double>"
_COUNTED = "shard int, ctx binary, word binary, n binary"


def _counted_rows(shard: np.ndarray, ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cuts = [slice(a, a + m) for a, m in zip(*(x.tolist() for x in runs(shard)))]
    cols = [pa.array([int(shard[c.start]) for c in cuts], pa.int32()), pa.array([small(np.diff(ctx[c], prepend=0)) for c in cuts], pa.binary()), pa.array([small(word[c]) for c in cuts], pa.binary()), pa.array([small(n[c]) for c in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "ctx", "word", "n"])


def _reduce(rows: DataFrame, folder: str, level: int, parts: int) -> list:
    """Adds up each shard's counts, writes them, and returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard: int, held: list) -> pa.RecordBatch:
            ctx, word, n = counted(*(np.concatenate([h[j] for h in held]) for j in range(3)))
            path = f"{folder}/raw-{level}-{shard}-{uuid.uuid4().hex}"
            write_arrays(path, {"hash": ctx, "count": n} if level == 1 else {"ctx": fitted(ctx), "word": fitted(word), "count": fitted(n)})
            total = int(n.sum())
            ends = np.cumsum(n)
            pieces = -(-total // PIECE)
            target = total * np.arange(1, pieces) / pieces
            at = np.searchsorted(ends, target, "right")
            part = np.where(n[at] * pieces > total, (target - (ends[at] - n[at])) / n[at], 0.0)
            row = [shard, path, len(n), total, int((n == 1).sum()), int((n == 2).sum()), *((0, 0, 0, 0) if level == 1 else (int(ctx[0]), int((ctx == ctx[0]).sum()), int(ctx[-1]), int((ctx == ctx[-1]).sum()))), at.tolist(), part.tolist()]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 8, pa.list_(pa.int64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

        held: list = []
        now = None
        for b in batches:
            for shard, *cols in zip(*(column(b, c).to_pylist() for c in ("shard", "ctx", "word", "n"))):
                if held and shard != now:
                    yield close(now, held)
                    held = []
                now = shard
                ctx = np.frombuffer(cols[0], "<u8", offset=1) if level == 1 else np.cumsum(unsmall(cols[0]))
                held.append((ctx, unsmall(cols[1]), unsmall(cols[2])))
        if held:
            yield close(now, held)

    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard")
    # a row for each shard; the stored manifest names one file of each, whatever tasks were repeated
    return stored(dealt.mapInArrow(run, _MANIFEST), f"manifest-{level}").orderBy("shard").collect()


def train(docs: DataFrame, order: int = 3) -> Model:
    """A model of the documents (columns doc_id, text)."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    model = Model(shared_path(spark, "trie"), order, parts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", BATCH):
            at, h, _ = tokens(column(b, "text"))
            n = np.bincount(at, minlength=len(h))
            order_ = np.argsort(h)
            h, n = h[order_], n[order_]
            shard = ((h >> _U(40)) * _U(parts) >> _U(24)).astype(np.int64)
            cuts = [slice(a, a + m) for a, m in zip(*(x.tolist() for x in runs(shard)))]
            cols = [pa.array([int(shard[x.start]) for x in cuts], pa.int32()), pa.array([b"\x08" + h[x].tobytes() for x in cuts], pa.binary()), pa.array([small(np.zeros(x.stop - x.start, np.int64)) for x in cuts], pa.binary()), pa.array([small(n[x]) for x in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "ctx", "word", "n"])

    rows = _reduce(docs.mapInArrow(words, _COUNTED), model.folder, 1, parts)
    level = Level(paths=[""] * parts, bases=np.zeros(parts, np.int64))
    found = {r["shard"]: r for r in rows}
    for s in range(parts):
        level.bases[s] = level.size
        if r := found.get(s):
            level.paths[s] = r["path"]
            level.size += r["n"]
            model.tokens += r["total"]
    level.raw = level.paths
    model.levels.append(level)
    most = max(PIECE, min(SHARD, model.tokens // (2 * parts)))
    splits = _splits(rows, {s: int(level.bases[s]) for s in found}, model.words, most)
    for k in range(2, order + 1):
        rows = _reduce(_pairs(docs, model, k, splits), model.folder, k, parts)
        level = _level(rows, splits)
        model.levels.append(level)
        _finish(spark, model, k, rows, parts)
        splits = _splits(rows, {r["shard"]: int(level.bases[r["shard"]]) for r in rows}, model.words, most)
    return model


def _splits(rows: list, bases: dict[int, int], words: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) from which on each shard of the next level reaches. rows: shards of this, in order, which are cut
    in pieces; a shard takes pieces up to most tokens, or one."""
    out, held = [(0, 0)], 0
    for r in rows:
        base = bases[r["shard"]]
        piece = r["total"] / (1 + len(r["split_at"])) if most else 0
        for cut in [(base, 0), *((base + at, int(part * words)) for at, part in zip(r["split_at"], r["split_part"]))]:
            if held + piece > most or not most:
                out.append(cut)
                held = 0
            held += piece
    ctx, word = zip(*sorted(set(out)))
    return np.array(ctx, np.int64), np.array(word, np.int64)


def _pairs(docs: DataFrame, model: Model, k: int, splits: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Counts of (context, word); from level 3 on, the place of the shorter n-gram that ends with the word stands for it,
    as it tells the word, is in the same order and leads to the lower level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in small_batches(batches, "text", BATCH):
            batch = reader.tokens(column(b, "text"))
            last = Found(batch.at, batch.ids, batch.ids, batch.ids, batch.ids)
            for last in reader.levels(batch, k - 1, scores=False):
                pass
            _, ctx, end = followed(last, _before(batch.lengths), k)
            if len(ctx):
                order, first = _sorted_pairs(ctx, end, (len(last.place), len(last.place)))
                n = np.diff(first, append=len(order))
                c, w = ctx[order[first]], end[order[first]]
                yield _counted_rows(shard_of(last.place[c], last.word[w], *splits), last.place[c], last.place[w], n)

    return docs.mapInArrow(run, _COUNTED)


def _level(rows: list, splits: tuple[np.ndarray, np.ndarray]) -> Level:
    shards = len(splits[0])
    level = Level([""] * shards, np.zeros(shards, np.int64), *splits, raw=[""] * shards)
    found = {r["shard"]: r for r in rows}
    for s in range(shards):
        level.bases[s] = level.size
        if r := found.get(s):
            level.raw[s] = r["path"]
            level.size += r["n"]
    spread = set(splits[0][splits[1] > 0].tolist())
    level.home = {r[c]: r["shard"] for r in rows for c in ("first", "last") if r[c] in spread}
    n1, n2 = sum(r["n1"] for r in rows), sum(r["n2"] for r in rows)
    level.discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    return level


def _finish(spark, model: Model, k: int, rows: list, parts: int) -> None:
    """Writes the shards of level k with smoothed, quantised probabilities."""
    level = model.levels[k - 1]
    # contexts at the edges of shards may have words in several: their numbers of words, added up
    spread: Counter = Counter()
    for r in rows:
        spread[r["first"]] += r["n_first"]
        if r["last"] != r["first"]:
            spread[r["last"]] += r["n_last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            for shard, path in zip(column(b, "shard").to_pylist(), column(b, "path").to_pylist()):
                raw = open_arrays(path)
                ctx, word, n = raw["ctx"].astype(np.int64), raw["word"].astype(np.int64), raw["count"].astype(np.float64)
                start, many = runs(ctx)
                own = ctx[start]
                total = reader.counts(k - 1, own).astype(np.float64)
                kinds = np.array([spread.get(int(c), m) if i in (0, len(own) - 1) else m for i, (c, m) in enumerate(zip(own, many))], np.float64)
                weight = level.discount * kinds / total
                if k == 2:
                    lower = 10.0 ** reader.unigram(word)
                else:  # the shorter n-gram was seen where this one was
                    word, prob = reader.gathered(k - 1, word, ("word",), ("prob",))
                    word, lower = reader.words_at(k - 2, word) if k > 3 else word, (10.0 ** (-STEP * np.arange(256)))[prob]
                p = (n - level.discount) / np.repeat(total, many) + np.repeat(weight, many) * lower
                quant = lambda x: np.clip(np.rint(-np.log10(x) / STEP), 0, 255).astype(np.uint8)
                first, end = int(own[0]), int(own[-1])
                pointer = np.zeros(end - first + 2, np.int64)
                pointer[own - first + 1] = many
                back_ = np.zeros(end - first + 1, np.uint8)
                back_[own - first] = quant(weight)
                tops = word[start + many - 1]
                shift = np.concatenate([[0], np.cumsum(tops)[:-1]])
                out = {"range": np.array([first, end], np.int64), "prob": quant(p), "back": back_}
                for name, values in (("p_", np.cumsum(pointer)), ("w_", word + np.repeat(shift, many))):
                    out |= {name + key: a for key, a in eliasfano.encode(values).items()}
                uri = f"{model.folder}/level-{k}-{shard}-{uuid.uuid4().hex}"
                write_arrays(uri, out)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri])], names=["shard", "path"])

    todo = spark.createDataFrame([(r["shard"], r["path"]) for r in rows], "shard int, path string") if rows else None
    if todo is not None:
        for r in stored(todo.repartition(parts, "shard").mapInArrow(run, "shard int, path string"), f"level-{k}").collect():
            level.paths[r["shard"]] = r["path"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in small_batches(batches, "text", BATCH):
            batch = reader.tokens(column(b, "text"))
            lengths = batch.lengths
            low = reader.unigram(batch.ids)[batch.at]
            full = reader.score(batch, low)
            at = np.cumsum(lengths) - lengths
            cols = [np.add.reduceat((batch.ids >= 0)[batch.at].astype(np.int64), at), np.add.reduceat(low, at), np.add.reduceat(full, at)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(lengths), *map(pa.array, cols)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _by_doc(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _by_doc(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def train_and_score(docs: DataFrame, order: int = 3) -> DataFrame:
    """Scores all documents with a model of those that aren't held out."""
    own = _by_doc(docs)
    model = train(own.where(~held_out(F.col("doc_id"))), order)
    return score(own, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def delete(spark, model: Model) -> None:
    remove(spark, model.folder)
