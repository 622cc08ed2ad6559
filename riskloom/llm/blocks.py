"""Candidates that share a hashed block, without all pairs of a block.

A task packs what it has as (key, id) arrays by bucket of the key. Ids of one task that share a key are put
together there: they are kept aside, and one of them stands for the others in the shuffle, so a key that very
many rows hold costs the shuffle one entry a task. linked() then compares the most connected id of each key
with the others, joins linked ids to components, and in a second round compares those pairs of a key that are
in different components still. After it, no two ids that share a key and link can be in different components.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import column, drop_stored, stored
from riskloom.llm.components import components

_U = np.uint64
#: kinds of rows: keys that ids of one task share, and one id for each key of a task
LOCAL, ONE = 1, 2


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
    return first, np.diff(first, append=len(sorted_))


def packed(keys: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[dict]:
    """Columns kind, bucket, keys and docs of a task's keys."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first, count = runs(keys)
    several = np.repeat(count > 1, count)
    for kind, ks, vs in ((LOCAL, keys[several], ids[several]), (ONE, keys[first], ids[first])):
        if not len(ks):
            continue
        where = ((ks >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
        start, n = runs(where)
        cuts = list(zip(start.tolist(), n.tolist()))
        yield {"kind": [kind] * len(start), "bucket": where[start], "keys": [ks[a : a + m].tobytes() for a, m in cuts], "docs": [vs[a : a + m].tobytes() for a, m in cuts]}


def _pairs(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["key", "id"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ks, vs in zip(column(b, "keys"), column(b, "docs")):
            yield _pairs(np.frombuffer(ks.as_py(), _U), np.frombuffer(vs.as_py(), np.int64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that several tasks have; rows come sorted by bucket, and one bucket is held at a time."""

    def close(ks: list, vs: list) -> Iterator[pa.RecordBatch]:
        keys, ids = np.concatenate(ks), np.concatenate(vs)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        _, count = runs(keys)
        several = np.repeat(count > 1, count)
        if several.any():
            yield _pairs(keys[several], ids[several])

    held, ks, vs = None, [], []
    for b in batches:
        for bucket, k, v in zip(column(b, "bucket").to_pylist(), column(b, "keys"), column(b, "docs")):
            if bucket != held and ks:
                yield from close(ks, vs)
                ks, vs = [], []
            held = bucket
            ks.append(np.frombuffer(k.as_py(), _U))
            vs.append(np.frombuffer(v.as_py(), np.int64))
    if ks:
        yield from close(ks, vs)


def shared_keys(side: DataFrame, parts: int) -> DataFrame:
    """key, id for keys that two ids or more have."""
    apart = side.where(F.col("kind") == ONE).select("bucket", "keys", "docs").repartition(parts, "bucket").sortWithinPartitions("bucket")
    local = side.where(F.col("kind") == LOCAL).select("keys", "docs")
    return apart.mapInArrow(_shared, "key long, id long").unionByName(local.mapInArrow(_unpack, "key long, id long"))


def linked(parts: list[DataFrame], sketches: DataFrame, near: Callable[..., Column], may_link: Callable[..., Column], verify: Callable[[DataFrame], DataFrame], slack: float | None = None) -> DataFrame:
    """node, component of ids with a link. parts: key, cls, n (distinct rows, stored(); they are freed here); sketches: cls, sketch.
    near(n, n): whether sizes allow a link; may_link(sketch, sketch, n, n): whether sketches do; verify(pairs a, b) gives a, b,
    link and dist, a metric if slack is given, the largest distance of a link."""
    members = functools.reduce(DataFrame.unionByName, parts)
    weight = members.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("w")).where("w > 1")
    m = members.join(weight, F.col("key") == F.col("_k")).drop("_k")
    central = m.groupBy(F.col("cls").alias("_c")).agg(F.sum("w").alias("total"))
    m = stored(m.join(central, F.col("cls") == F.col("_c")).select("key", "cls", "n", "total"), "blocks")
    for df in parts:
        drop_stored(df)
    hubs = m.groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("total", -F.col("cls"), "cls", "n")).alias("hub"))
    starred = m.join(hubs, F.col("key") == F.col("_k")).where((F.col("cls") != F.col("hub.cls")) & near(F.col("n"), F.col("hub.n")))
    pairs = starred.select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"), F.col("hub.n").alias("pa"), F.col("n").alias("pb")).distinct()
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("cls").alias(side), F.col("sketch").alias(f"_{side}")), side)
    pairs = pairs.where(may_link(F.col("_a"), F.col("_b"), F.col("pa"), F.col("pb"))).select("a", "b")
    pairs = stored(pairs, "pairs")
    first = stored(verify(pairs), "verified")
    drop_stored(pairs)
    comp = stored(components(first.where("link").select("a", "b")), "components")
    named = m.join(comp, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    mixed = named.groupBy(F.col("key").alias("_k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("w")).where("lo <> hi AND w > 2")
    rest = named.join(mixed.select("_k"), F.col("key") == F.col("_k")).drop("_k")
    if slack is None:
        rest = rest.withColumn("dist", F.lit(None).cast("double"))
    else:
        hub_of = hubs.select(F.col("_k").alias("_h"), F.col("hub.cls").alias("hub"))
        far = first.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "dist")
        rest = rest.join(hub_of, F.col("key") == F.col("_h")).join(far, (F.col("hub") == F.col("_a")) & (F.col("cls") == F.col("_b")), "left")
        rest = rest.select("key", "cls", "n", "comp", F.when(F.col("cls") == F.col("hub"), 0.0).otherwise(F.col("dist")).alias("dist"))
    rest = stored(rest.join(sketches, "cls"), "rest")
    drop_stored(m)
    x, y = rest.alias("x"), rest.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & near(F.col("x.n"), F.col("y.n"))
    if slack is not None:
        met &= F.coalesce(F.abs(F.col("x.dist") - F.col("y.dist")) <= slack + 1e-9, F.lit(True))
    met &= may_link(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))
    again = x.join(y, met).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    again = stored(again.join(known, ["a", "b"], "left_anti"), "second-pairs")
    drop_stored(rest)
    if not again.isEmpty():
        drop_stored(comp)
        edges = first.where("link").select("a", "b").unionByName(verify(again).where("link").select("a", "b"))
        comp = stored(components(edges), "components")
    for df in (first, again):
        drop_stored(df)
    return comp
