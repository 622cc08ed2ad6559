"""Jaro-Winkler similarity, the one string measure Spark lacks.

Applied in Arrow batches, to distinct pairs of strings of a batch (scored_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

MEMO = 200_000


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; the prefix counts only for strings whose Jaro similarity is over 0.7."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


def scored_pairs(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """pairs with an integer 0-100 similarity of columns a and b (0 if either is NULL).

    Rows pass in Arrow batches with the columns they came with: no shuffle, so neither many pairs nor a frequent
    pair of names costs one. Of a batch, distinct pairs are scored once; up to MEMO scores are kept for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], int] = {}
        for batch in batches:
            got = []
            for pair in zip(batch.column(batch.schema.get_field_index(a)).to_pylist(), batch.column(batch.schema.get_field_index(b)).to_pylist()):
                score = memo.get(pair)
                if score is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    x, y = pair
                    score = memo[pair] = 0 if x is None or y is None else int(100 * jaro_winkler(x, y) + 0.5)
                got.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int32())], names=[*batch.schema.names, out])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(out, IntegerType(), False)]))
