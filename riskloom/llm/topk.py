"""Exact top-k inner products through a pivot-distance index.

Vectors of integers are lifted by one coordinate to equal length (x, sqrt(M - |x|^2)), M the largest squared
length; a query gets 0 there. Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the largest products are the nearest
lifted vectors, and the triangle inequality holds. Each vector is keyed by its nearest pivot and its distance
to it; sorted by that key, vectors are cut into rings of at most RING rows (pivot, least and largest
distance). A query first takes the best products of its own ring. With its k-th best so far, a ring can be
left out when even a vector on its near side of the annulus could not be as good, or only as good with a
larger id. Queries are handled in groups of GROUP that lie near each other; for each pivot, a group needs
one range of distances, which is joined with the rings of that pivot, and what remains is multiplied.

Pivots are chosen by farthest-first from at most SAMPLE vectors (smallest by a hash of their id); every
vector is indexed, and the choice of pivots affects time only. Rings are made by a range-partitioned sort on
(pivot, distance, id), so equal vectors, however many, are spread over rings of bounded size.

The index holds the vectors of the most frequent length (ties: the longer) whose squared length is below LARGEST, so
that all it computes is exact in doubles. The others, huge or of other lengths, are multiplied in blocks: their
queries with all vectors of their length, and the other queries of that length with them.

Defined results: vectors that are null, empty or hold null, NaN or infinite components (or such that 256 of them
are infinite), or no vec_id, take no part; vectors meet those of their own length only; products beyond a long count
as its largest or smallest value; equal rows count once; an id with several vectors asks with each and gets the best
over all, and never meets its own id; fewer candidates than k give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import column, shuffle_parts, stored

PIVOTS = 32
SAMPLE = 2_048
RING = 1024
GROUP = 512
#: squared length from which on products may not be exact in doubles
LARGEST = 2.0**50


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and v (floor(factor * x), whole numbers as double) of the vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: e * factor)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(x) > 0))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.when(F.abs(e) < 2.0**53, F.floor(e).cast("double")).otherwise(e)).alias("v"))


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    col = column(batch, name)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _lift(x: np.ndarray, m: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, m - (x * x).sum(1)))[:, None]


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.hstack([x, last])
    square = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def choose_pivots(sample: np.ndarray, m: float, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first, from the first row on."""
    full = np.hstack([sample, _lift(sample, m)])
    chosen, far = [0], ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(full)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
    return full[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best other ids, ties to the smaller."""
    use = np.flatnonzero(ids != own)
    if len(use) > 4 * k:
        least = -np.partition(-scores[use], k - 1)[k - 1]
        use = use[scores[use] >= least]
    order = use[np.lexsort((ids[use], -scores[use]))[:k]]
    return [(int(scores[i]), int(ids[i])) for i in order]


_RING = "ring string, pivot int, dmin double, dmax double, low_id long, ids binary, data binary, queries binary, kth binary, kth_id binary"


def _square() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)


def index(vectors: DataFrame, every: int, k: int, dim: int) -> tuple[DataFrame, np.ndarray, float]:
    """Rings, and in each the queries (ids divisible by every) with their k-th best of the ring."""
    spark = vectors.sparkSession
    m = float(vectors.agg(F.max(_square())).first()[0])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    pivots = choose_pivots(np.array([r["v"] for r in sample], np.float64), m)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                d = _distances(x, _lift(x, m), pivots)
                near = d.argmin(1)
                data = [r.tobytes() for r in x.astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), column(b, "vec_id"), pa.array(data, pa.binary())], names=["pivot", "dist", "vec_id", "data"])

    keyed = vectors.mapInArrow(key, "pivot int, dist double, vec_id long, data binary")
    order = ["pivot", "dist", "vec_id"]
    dealt = stored(keyed, "keyed").repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def ring(part: int, nth: int, rows: list[tuple]) -> tuple:
        ids = np.array([r[2] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[3] for r in rows), "<i4").reshape(len(rows), dim).astype(np.float64)
        ask = np.flatnonzero(ids % every == 0)
        kth, kth_id = [], []
        for i, scores in zip(ask.tolist(), x[ask] @ x.T):
            best = _best(scores, ids, int(ids[i]), k)
            full = len(best) == k
            kth.append(best[-1][0] if full else -(2**62))
            kth_id.append(best[-1][1] if full else 2**62)
        pack = lambda a: np.array(a, "<i8").tobytes()
        return (f"{part}-{nth}", rows[0][0], rows[0][1], rows[-1][1], int(ids.min()), ids.tobytes(), b"".join(r[3] for r in rows), pack(ask), pack(kth), pack(kth_id))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, nth = 0, 0
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _RING.split(", ")]
        give = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
        for b in batches:
            for p, *row in zip(*(column(b, c).to_pylist() for c in ("part", "pivot", "dist", "vec_id", "data"))):
                part = p
                if held and (row[0] != held[0][0] or len(held) >= RING):
                    yield give(ring(part, nth, held))
                    held, nth = [], nth + 1
                held.append(tuple(row))
        if held:
            yield give(ring(part, nth, held))

    return stored(dealt.mapInArrow(cut, _RING), "rings"), pivots, m


def _in_blocks(vectors: DataFrame) -> DataFrame:
    """Vectors of one length, RING at most, in a row: d, ids, data (doubles)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, ids, data = 0, [], []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(data)])], names=["d", "ids", "data"])

        for b in batches:
            for i, v in zip(column(b, "vec_id").to_pylist(), column(b, "v")):
                if ids and (len(v) != d or len(ids) == RING):
                    yield give()
                    ids, data = [], []
                d = len(v)
                ids.append(i)
                data.append(v.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
        if ids:
            yield give()

    dealt = vectors.repartition(shuffle_parts(vectors.sparkSession), F.xxhash64("vec_id", "v")).sortWithinPartitions(F.size("v"))
    return dealt.mapInArrow(cut, "d int, ids binary, data binary")


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products, brought into the range of a long."""
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    whole = [[int(e) for e in row] for row in y.tolist()]
    return np.array([[max(-(2**63), min(2**63 - 1, sum(a * e for a, e in zip(row, other)))) for other in whole] for row in ([int(e) for e in r] for r in x.tolist())], np.int64)


def _plain(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of vectors for each query of that length."""
    asked = _in_blocks(queries).select("d", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                d, ids, data, q_ids, q_data = (column(b, c)[i].as_py() for c in ("d", "ids", "data", "q_ids", "q_data"))
                there, own = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                y, x = (np.frombuffer(a, "<f8").reshape(-1, d) for a in (data, q_data))
                rows = [(q, v, s) for q, line in zip(own.tolist(), _products(x, y)) for s, v in _whole_best(line, there, q, k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return _in_blocks(vectors).join(asked, "d").mapInArrow(multiply, "query_id long, vec_id long, score long")


def _whole_best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """As _best, of whole numbers that may be the smallest long."""
    order = [i for i in np.lexsort((ids, ~scores)).tolist() if ids[i] != own][:k]  # ~s falls as s grows
    return [(int(scores[i]), int(ids[i])) for i in order]


def search(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query (an id divisible by every) with other ids."""
    vectors = stored(vectors.dropDuplicates(["vec_id", "v"]), "vectors")
    small = _square() < LARGEST
    dims = vectors.where(small).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    held = small & (F.size("v") == dims["d"]) if dims else F.lit(False)
    found = _indexed(vectors.where(held), every, k, dims["d"]) if dims else None
    rest = vectors.where(~held)
    if not rest.isEmpty():
        asks = F.col("vec_id") % every == 0
        more = _plain(rest.where(asks), vectors, k).unionByName(_plain(vectors.where(held & asks), rest, k))
        found = found.unionByName(more) if found is not None else more
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(vectors: DataFrame, every: int, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: from each ring that may matter, the best of each query, the k best of all among them."""
    spark = vectors.sparkSession
    rings, pivots, m = index(vectors, every, k, dim)
    slack = 1e-3 + 1e-6 * m**0.5  # rounding of distances, which are roots of differences of squares up to m
    asking = rings.where(F.length("queries") > 0).select("pivot", "dmin", "ring", "ids", "data", "queries", "kth", "kth_id")
    asking = asking.repartitionByRange(shuffle_parts(spark), "pivot", "dmin", "ring").sortWithinPartitions("pivot", "dmin", "ring").withColumn("part", F.spark_partition_id())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of neighbouring rings in groups."""
        held: list[tuple] = []
        part = nth = 0

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{nth}"]), *(pa.array([b"".join(r[j] for r in rows)], pa.binary()) for j in range(4))], names=["grp", "q_ids", "q_data", "q_kth", "q_kth_id"]
            )

        for b in batches:
            for p, ids, data, ask, kth, kth_id in zip(*(column(b, c).to_pylist() for c in ("part", "ids", "data", "queries", "kth", "kth_id"))):
                part = p
                i = np.frombuffer(ask, "<i8")
                own, x = np.frombuffer(ids, "<i8")[i], np.frombuffer(data, "<i4").reshape(-1, dim)[i]
                for j in range(len(i)):
                    held.append((own[j].tobytes(), x[j].tobytes(), kth[8 * j : 8 * j + 8], kth_id[8 * j : 8 * j + 8]))
                    if len(held) == GROUP:
                        yield give(held)
                        held, nth = [], nth + 1
        if held:
            yield give(held)

    groups = stored(asking.mapInArrow(gather, "grp string, q_ids binary, q_data binary, q_kth binary, q_kth_id binary"), "query-groups")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pivot, the distances at which a vector may matter to a query of the group."""
        for b in batches:
            for grp, data, kth in zip(*(column(b, c).to_pylist() for c in ("grp", "q_data", "q_kth"))):
                x = np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.float64)
                d = _distances(x, np.zeros((len(x), 1)), pivots)
                r = np.sqrt(np.maximum(0.0, (x * x).sum(1) + m - 2.0 * np.frombuffer(kth, "<i8"))) + slack
                n = len(pivots)
                yield pa.RecordBatch.from_arrays([pa.array([grp] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array((d - r[:, None]).min(0)), pa.array((d + r[:, None]).max(0))], names=["grp", "pv", "lo", "hi"])

    wanted = groups.mapInArrow(ranges, "grp string, pv int, lo double, hi double")
    meet = (F.col("pivot") == F.col("pv")) & (F.col("dmax") >= F.col("lo")) & (F.col("dmin") <= F.col("hi"))
    pairs = rings.select("ring", "pivot", "dmin", "dmax").join(wanted, meet).select("grp", "ring")
    held = pairs.join(groups, "grp").join(rings.select("ring", "pivot", "dmin", "dmax", "low_id", "ids", "data"), "ring")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("q_ids", "q_data", "q_kth", "q_kth_id", "pivot", "dmin", "dmax", "low_id", "ids", "data")
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_data, q_kth, q_kth_id, pivot, dmin, dmax, low_id, ids, data = (column(b, c)[i].as_py() for c in names)
                q = np.frombuffer(q_data, "<i4").reshape(-1, dim).astype(np.float64)
                own, kth, kth_id = (np.frombuffer(a, "<i8") for a in (q_ids, q_kth, q_kth_id))
                d = _distances(q, np.zeros((len(q), 1)), pivots[pivot : pivot + 1])[:, 0]
                near = np.maximum(0.0, np.maximum(d - dmax, dmin - d) - 2 * slack)
                most = np.floor(((q * q).sum(1) + m - near * near) / 2 + 1e-3 + 1e-12 * m)
                use = np.flatnonzero((most > kth) | ((most == kth) & (low_id <= kth_id)))
                if not len(use):
                    continue
                there = np.frombuffer(ids, "<i8")
                scores = q[use] @ np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.float64).T
                good = scores >= kth[use][:, None]
                rows = [(int(own[j]), v, s) for j, line, g in zip(use.tolist(), scores, good) if g.any() for s, v in _best(line[g], there[g], int(own[j]), k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return held.mapInArrow(multiply, "query_id long, vec_id long, score long")
