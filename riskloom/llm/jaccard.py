"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Two sets of a and b elements with a Jaccard index of at least
NUM/100 differ in at most (100 - NUM) (a + b) / (100 + NUM) elements. Sizes are dealt into bands of ratio
BAND; for a band, D is the most by which a pair can differ whose smaller set is in it. A sketch deals the
elements to more than D blocks by a hash and XORs the hashes of each block's elements: an element that only
one set has changes one block, so two sets that belong together agree in all but D blocks (the Hamming
distance in blocks is at most the symmetric difference). Documents that agree in one block are candidates.

Blocks of fewer than two elements are the same in too many documents. They are left out as long as a
document has at most (blocks - D - 1) of them; a document with more gives those of one element too, and if it
has that many empty blocks, those as well. That loses nothing: if a pair agrees in blocks of fewer than two
elements only, at least blocks - D of them, then both documents have that many and give them; likewise if it
agrees in empty blocks only.

Within a task, documents that share a block are put together first, and one of them stands for the others in
the shuffle, so a block that very many documents share costs the shuffle one entry a task. Candidates are
not expanded to all pairs of a block: the most connected document of each block is compared with the others
(exact sets of shingles), then linked documents are joined to components, and only pairs of a block that are
in different components still, and aren't ruled out by size, a 512-bit parity sketch or the triangle
inequality of the Jaccard distance, are compared in a second round. After it no link can be missing.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than a shingle
make one shingle; equal sets are one class whatever their number; a null doc_id keeps its row, with null
component; rows that repeat a doc_id keep their rows, and an id is linked if one of its texts is; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks
from riskloom.llm.common import WordHasher, column, drop_stored, mix64, shuffle_parts, small_batches, stored, texts

BAND = 1.3
#: ids up to this number may be broadcast (16 MB); beyond, texts are shuffled to them
BROADCAST_IDS = 1_000_000
#: passes over the stored blocks, each of which shuffles a share of the keys; what a pass shuffled is freed at its end
PASSES = 4
#: rows of an Arrow batch
ROWS = 2000
_U = np.uint64


@functools.cache
def bands(num: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest size of a partner, D, blocks) of each band; no sketch is needed where D is 0."""
    low, rows = 1, []
    while low < 1 << 40:
        high = max(low + 1, math.ceil(low * BAND))
        most = (high - 1) * 100 // num
        d = (100 - num) * (high - 1 + most) // (100 + num)
        blocks = d + 1
        for _ in range(20):  # room for blocks of fewer than two elements, as many as most sets have
            mean = low / blocks
            few = blocks * math.exp(-mean) * (1 + mean)
            blocks = math.ceil(d + 1 + min(few + 0.7 * math.sqrt(few), d / 4 + 3))
        rows.append((low, most, d, blocks))
        low = high
    return tuple(np.array(c, np.int64) for c in zip(*rows))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, of a long array; the caller leaves out those over a document's end."""
    with np.errstate(over="ignore"):
        s = h.copy()
        for j in range(1, k):
            n = max(0, len(h) - j)
            s[:n] = s[:n] * _U(0x9E3779B97F4A7C15) + mix64(h[j:] ^ _U(j))
    return mix64(s)


def document_sets(docs: list[str], k: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [d.encode("utf-8", "surrogatepass").lower().split() for d in docs]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    h = hasher.array([w for s in split for w in s])
    g = shingle_hashes(h, k) if len(h) else h
    ends = np.cumsum(lengths)
    out = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(g[end - n : end - k + 1]))
        elif n:
            out.append(mix64(np.array([hasher.h(b"\0".join([b"%d" % n, *split[len(out)]]))], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def sketch_keys(sets: list[np.ndarray], num: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the set) for every block that counts."""
    low, most, d, n_blocks = bands(num)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(low, sizes, "right") - 1
    keys, owners = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for back in (0, 1):
        k = band - back
        use = (sizes > 0) & (k >= 0)
        k = np.maximum(k, 0)
        use &= (d[k] > 0) & (sizes <= most[k])
        mine = np.flatnonzero(use)
        if not len(mine):
            continue
        n, b = sizes[mine], n_blocks[k[mine]]
        g = np.concatenate([sets[i] for i in mine.tolist()])
        owner = np.repeat(np.arange(len(mine)), n)
        base = np.cumsum(b) - b
        block = ((g >> _U(32)) * np.repeat(b, n).astype(_U) >> _U(32)).astype(np.int64) + base[owner]
        first = np.flatnonzero(np.diff(block, prepend=-1))
        count = np.diff(first, append=len(block))
        at, who = block[first], owner[first]
        sig = np.bitwise_xor.reduceat(mix64(g ^ _U(0x5851F42D4C957F2D)), first)
        strong = count >= 2
        least = b - d[k[mine]]
        singles = b - np.bincount(who[strong], minlength=len(mine)) >= least
        empty = b - np.bincount(who, minlength=len(mine)) >= least
        inner = (at - base[who]).astype(_U)
        tag = mix64((k[mine][who].astype(_U) << _U(40)) | inner)
        take = strong | singles[who]
        keys.append(mix64(sig[take] ^ tag[take]))
        owners.append(mine[who[take]])
        for i in np.flatnonzero(empty).tolist():
            have = at[who == i] - base[i]
            rest = np.setdiff1d(np.arange(b[i]), have).astype(_U)
            keys.append(mix64(mix64((_U(k[mine[i]]) << _U(40)) | rest)))
            owners.append(np.full(len(rest), mine[i]))
    return np.concatenate(keys), np.concatenate(owners)


_SIDE = "kind int, doc_id long, n long, s1 long, s2 long, sketch array<long>, bucket int, keys binary, docs binary"
_NAMES = ["kind", "doc_id", "n", "s1", "s2", "sketch", "bucket", "keys", "docs"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def sketched(docs: DataFrame, k: int, num: int, buckets: int) -> DataFrame:
    """A row for each document (kind 0), blocks that documents of one task share (1), and one document for
    each block of a task (2), both as arrays by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in small_batches(batches, "text"):
            ids = column(batch, "doc_id").to_pylist()
            sets = document_sets(texts(batch), k, hasher)
            with np.errstate(over="ignore"):
                s1 = [int(s.sum(dtype=_U).astype(np.int64)) if len(s) else 0 for s in sets]
                s2 = [int(np.bitwise_xor.reduce(mix64(s)).astype(np.int64)) if len(s) else 0 for s in sets]
            sketch = [np.packbits((np.bincount((s & _U(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64) for s in sets]
            yield _rows(kind=[0] * len(ids), doc_id=ids, n=[len(s) for s in sets], s1=s1, s2=s2, sketch=sketch)
            # equal sets give their blocks once
            seen: set = set()
            for i, what in enumerate(zip(s1, s2)):
                if ids[i] is None or what in seen:
                    sets[i] = np.empty(0, _U)
                seen.add(what)
            keys, owner = sketch_keys(sets, num)
            if not len(keys):
                continue
            id_of = np.array([x or 0 for x in ids], np.int64)[owner]
            for cols in blocks.packed(keys, id_of, buckets):
                yield _rows(**cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIDE)


def shingle_set(text: str, k: int) -> set:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """a, b, inter, na, nb for pairs (a, b); pairs with one a are dealt by a and shares of its partners, and
    a task holds one set of a at a time."""
    ids = stored(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "candidate-ids")
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    if ids.count() <= BROADCAST_IDS:
        text = text.join(F.broadcast(ids), "_id", "left_semi")
    else:
        text = text.join(ids, "_id", "left_semi")
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("_fan")).withColumnRenamed("a", "_a")
    dealt = pairs.join(fan, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), "_fan").alias("salt"))
    member = dealt.join(text, F.col("b") == F.col("_id")).select("a", "salt", F.lit(1).alias("role"), "b", "text")
    hub = dealt.select("a", "salt").distinct().join(text, F.col("a") == F.col("_id")).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    both = hub.unionByName(member).repartition(shuffle_parts(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in small_batches(batches, "text"):
            rows = []
            for a, role, b, t in zip(*(column(batch, c).to_pylist() for c in ("a", "role", "b", "text"))):
                s = shingle_set(t or "", k)
                if role:
                    rows.append((a, b, len(own & s), len(own), len(s)))
                else:
                    own = s
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "inter", "na", "nb"])

    out = stored(both.mapInArrow(compare, "a long, b long, inter long, na long, nb long"), "verified")
    drop_stored(ids)
    return out


def near_groups(docs: DataFrame, k: int, num: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; links: 100 * intersection >= num * union."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    side = stored(sketched(docs, k, num, 16 * parts), "sketches", ROWS)
    # what the blocks take goes before texts are shuffled
    own = stored(side.where("kind = 0").select("doc_id", "n", "s1", "s2", "sketch"), "sets")
    rows = own.select("doc_id", "n", "s1", "s2")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cls"))
    of = rows.where("n > 0").join(classes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("_d"), "cls", "n").distinct()
    of = stored(of, "classes")
    # the entries of a key are all in one bucket, so in one pass
    members = [blocks.shared_keys(side.where(F.col("bucket") % PASSES == i), -(-parts // PASSES)) for i in range(PASSES)]
    met = [stored(x.join(of, F.col("id") == F.col("_d")).select("key", "cls", "n").distinct(), "shared-blocks") for x in members]
    drop_stored(side)

    def near(x, y):
        return 100 * F.least(x, y) >= num * F.greatest(x, y)

    def may_link(x, y, nx, ny):
        """512-bit sketches differ in no more bits than the sets may in elements."""
        bits = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(8)]
        return functools.reduce(lambda p, q: p + q, bits) * (100 + num) <= (100 - num) * (nx + ny)

    sketches = own.where("n > 0").select(F.col("doc_id").alias("cls"), "sketch")
    m = functools.reduce(DataFrame.unionByName, met)
    sketches = stored(sketches.join(m.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("sketch").alias("sketch")), "own-sketches")

    def compared(p: DataFrame) -> DataFrame:
        both = F.col("na") + F.col("nb") - F.col("inter")
        return verified(p, docs, k).select("a", "b", (100 * F.col("inter") >= num * both).alias("link"), (1 - F.col("inter") / both).alias("dist"))

    comp = blocks.linked(met, sketches, near, may_link, compared, slack=(100 - num) / 100)
    out = rows.join(classes, ["n", "s1", "s2"], "left").join(comp, F.col("cls") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cls", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """The documents whose id is the smallest of their component, and those that link with nothing."""
    kept = near_groups(docs, k, num).where("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_kept")), "left_semi")
