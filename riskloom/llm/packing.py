"""Packing documents into sequences: shortest-pack-first over the length histogram.

A document's ids (with an end id) are cut at every LIMIT ids. The lengths of the pieces go into a
histogram of at most LIMIT bins, all that the driver sees. Lengths are placed longest first: a length
goes to the pattern with the shortest fill that has room, for as many of its copies as that pattern has,
and the pattern splits in two. Patterns then map back to pieces by rank: pieces of one length are
numbered in the order of (doc_id, start), and each range of ranks belongs to one place in one pattern.

Ranks come from a range-partitioned sort by (length, doc_id, start) and the row counts of its partitions,
so a length that a third of all pieces share is spread over many partitions.

Defined results: null text is empty and becomes one piece, its end id; repeated rows are packed each (of
pieces with the same doc_id and start either may get either place); null doc_id is kept and sorts first;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import WordEncoder
from riskloom.llm.common import column, shuffle_parts, small_batches, stored, texts

LIMIT = 1024


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian uint32) of each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * limit
        for batch in small_batches(batches, "text"):
            rows: list[tuple] = []
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoder.encode(texts(batch))):
                ids += end
                rows += [(doc_id, at // 4, min(step, len(ids) - at) // 4, len(ids) // 4, ids[at : at + step]) for at in range(0, len(ids), step)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.binary()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a pattern with how often each occurs, number of sequences)] for {length: pieces}."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # by fill
    fills: list[int] = []  # heap

    def add(fill: int, pattern: dict[int, int], count: int) -> None:
        if not open_[fill]:
            heapq.heappush(fills, fill)
        open_[fill].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = fills[0] if fills else limit
            if fill + length > limit:  # no open pattern has room
                fit = limit // length  # a new pattern of this length alone, several to a sequence
                if left >= fit:
                    add(fit * length, {length: fit}, left // fit)
                    left %= fit
                else:
                    add(left * length, {length: left}, 1)
                    left = 0
                continue
            pattern, count = open_[fill].pop()
            if not open_[fill]:
                heapq.heappop(fills)
            fit = min(left, (limit - fill) // length)  # as many as a sequence takes
            used = min(count, max(1, left // max(1, (limit - fill) // length)))
            if used == 1 or left >= used * fit:
                per = min(fit, left // used)
                add(fill + per * length, {**pattern, length: pattern.get(length, 0) + per}, used)
                left -= per * used
            if count > used:
                add(fill, pattern, count - used)
    return [(p, n) for fill in open_ for p, n in open_[fill]]


def slots(packed: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, sequences, offset): pieces of a length
    with a rank in the range fill the sequences in turn, a piece each, then again behind themselves."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in packed:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            out.append((length, used[length], used[length] + times * count, sequence, count, offset))
            used[length] += times * count
            offset += times * length
        sequence += count
    return out


def pack(pieces_: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, start and length; others are carried)."""
    spark = pieces_.sparkSession
    parts = shuffle_parts(spark)
    # stored, so that the cut and the ids are made once; then range partitions and places in them
    base = stored(pieces_, "pieces")
    dealt = base.repartitionByRange(parts, "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked-pieces")
    # a row for each partition and length: lengths are sorted over partitions, so partitions + limit rows at most
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("length", "_part").collect()
    histogram: dict[int, int] = defaultdict(int)
    firsts = []
    for r in counts:
        firsts.append((r["length"], r["_part"], histogram[r["length"]] - r["first"]))
        histogram[r["length"]] += r["n"]
    if not firsts:
        return dealt.drop("_part", "_at").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    shift = spark.createDataFrame(firsts, "length long, _part int, _shift long")
    places = spark.createDataFrame(slots(patterns(dict(histogram), limit)), "length long, _lo long, _hi long, _seq long, _n long, _off long")
    # both have a number of rows bounded by limit and partitions, whatever the number of pieces
    ranked = dealt.join(F.broadcast(shift), ["length", "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift"))
    rank = F.col("_rank")
    hit = ranked.join(F.broadcast(places.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (rank >= F.col("_lo")) & (rank < F.col("_hi")))
    nth = rank - F.col("_lo")
    return hit.withColumns({"sequence_id": F.col("_seq") + nth % F.col("_n"), "offset": F.col("_off") + F.floor(nth / F.col("_n")).cast("long") * F.col("length")}).select(*base.columns, "sequence_id", "offset")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids; each has at most LIMIT ids, so groups are small."""
    at = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), at.alias("_p")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(_p, X'', (a, p) -> a || p.ids)").alias("ids")
    )
