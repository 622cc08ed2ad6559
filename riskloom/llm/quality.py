"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Words and word pairs are hashed into BUCKETS bins. The raw multinomial counts every document; the trusted
one counts documents that the labels call good. A document's score is the mean, over its features, of
log p_trusted(bin) - log p_raw(bin). The threshold is the score that all but a share TAIL of other labelled
good documents reach, which the trusted counts don't hold, and every document is held against it.

All labelled good documents take part: of each ten ids by hash, four set the threshold and six are counted.

DataFrame functions only. Counting is a pass with a map-side sum into BUCKETS bins over all documents, and one over
the trusted; scoring is one narrow pass without a shuffle: the ratios, BUCKETS doubles, are a literal in the plan. Of
the corpus, the driver sees BUCKETS pairs of counts. Trusted ids are looked up in an exact broadcast bit set of 64 ids a word, without a shuffle, where it has
WORDS words at most (ids next to one another need one for 64); else a bit set of at most 2^FILTER bits, which loses
none, is followed by an equi-join that shuffles the texts that pass it. Scores that set the threshold are stored, and
TAIL of them sorted.

Defined results: null and empty texts have no words and fail the base rule; words are split at
[\\x20\\x09-\\x0D] only; repeated rows are judged each, alike; without trusted rows the ratio is 0 everywhere
and the base rule alone decides; columns of documents are carried whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import drop_stored, stored

BUCKETS = 10_000
FILTER = 24
WORDS = 1 << 20
TAIL = 0.001
WINDOW = 8
_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def words(text: Column) -> Column:
    """Words of a text as an array."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def _pairs(a: Column, apart: int) -> Column:
    """Hashes of (a[i], a[i + apart])."""
    n = F.greatest(F.size(a) - apart, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + apart), n), lambda x, y: F.xxhash64(x, y))


def with_features(docs: DataFrame) -> DataFrame:
    """Adds _ql_text, _ql_words, _ql_hash (of each word) and _ql_pair (of each two words)."""
    df = docs.withColumn("_ql_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_ql_words", words(F.col("_ql_text")))
    df = df.withColumn("_ql_hash", F.transform("_ql_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_ql_pair", _pairs(F.col("_ql_hash"), 1))


def repeated_words(n_words: Column, pair: str, window: int = WINDOW) -> list[tuple[str, Column]]:
    """Steps to the number of words that lie in windows found twice or more in the text, the first included.

    Hashes of 8 words come from those of 2 and 4. Only texts with a window found again (fewer distinct
    hashes than windows) are sorted.
    """
    assert window == 8
    twice = F.size(F.array_distinct(F.col("_ql_8"))) < F.size("_ql_8")
    ordered = F.when(twice, F.sort_array(F.transform("_ql_8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.expr("filter(_ql_sorted, (e, k) -> e.h = get(_ql_sorted, k - 1).h OR e.h = get(_ql_sorted, k + 1).h)")
    covered = F.expr(f"aggregate(zip_with(_ql_at, slice(_ql_at, 2, size(_ql_at)), (a, b) -> least({window}, b - a)), 0L, (s, x) -> s + x)")
    return [
        ("_ql_4", _pairs(F.col(pair), 2)),
        ("_ql_8", _pairs(F.col("_ql_4"), 4)),
        ("_ql_sorted", ordered),
        ("_ql_at", F.sort_array(F.transform(again, lambda e: e["i"]))),
        ("_ql_repeat", F.coalesce(F.when(F.size("_ql_at") > 0, covered), F.lit(0).cast("long"))),
    ]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids that are labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("_ql_id")).distinct()


def _chosen(docs: DataFrame, ids: DataFrame, most: int = FILTER, words: int = WORDS) -> DataFrame:
    """_ql_id and text of the documents whose id is in ids: by an exact bit set of at most so many words; with more, a
    bit set of hashes rules most others out before a join."""
    own = docs.select(F.col("doc_id").cast("long").alias("_ql_id"), "text").where("_ql_id IS NOT NULL")

    def bits(at: Column) -> DataFrame:
        bit = F.pmod(at, F.lit(64)).cast("int")
        return ids.groupBy(F.shiftright(at, 6).alias("_ql_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_ql_b"))

    def looked_up(at: Column) -> DataFrame:
        held = own.withColumn("_ql_at", at).join(F.broadcast(bits(at)), F.shiftright("_ql_at", 6) == F.col("_ql_w"))
        return held.where(F.getbit("_ql_b", F.pmod("_ql_at", F.lit(64)).cast("int")) == 1).select("_ql_id", "text")

    if bits(F.col("_ql_id")).count() <= words:
        return looked_up(F.col("_ql_id"))
    size = min(most, max(6, (16 * ids.count()).bit_length()))
    return looked_up(F.pmod(F.xxhash64("_ql_id"), F.lit(1 << size))).join(ids, "_ql_id", "left_semi")


def _bins(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features of the documents by bin."""
    bins = with_features(docs).select(F.explode(F.concat("_ql_hash", "_ql_pair")).alias("h"))
    out = np.zeros(buckets)
    for r in bins.groupBy(F.pmod("h", F.lit(buckets)).alias("bin")).agg(F.count("*").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bin; raw counts are of all documents."""
    good = _bins(_chosen(docs, trusted), buckets)
    if not good.sum():
        return [0.0] * buckets
    raw = _bins(docs.select("text"), buckets)
    return [math.log(g + 1) - math.log(good.sum() + buckets) - math.log(r + 1) + math.log(raw.sum() + buckets) for g, r in zip(good, raw)]


def scored(featured: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds _ql_score."""
    table = F.lit(np.array(ratios))
    featured = featured.withColumn("_ql_ratio", F.lit(len(ratios)))
    total = F.lit(0.0)
    for col in ("_ql_hash", "_ql_pair"):
        total = total + F.aggregate(F.col(col), F.lit(0.0), lambda s, h: s + F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int")))
    n = F.size("_ql_hash") + F.size("_ql_pair")
    return featured.withColumn("_ql_score", F.when(n > 0, total / n).otherwise(F.lit(0.0))).drop("_ql_ratio")


def judge(docs: DataFrame, labels: DataFrame, name: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """documents with a struct of counts, score and verdict."""
    trusted = trusted_ids(labels)
    held_out = F.pmod(F.xxhash64("_ql_id"), F.lit(10)) < 4
    ratios = fit(docs, trusted.where(~held_out), buckets)
    threshold = None
    if any(ratios):
        some = scored(with_features(_chosen(docs, trusted.where(held_out))), ratios).where(F.size("_ql_words") >= 20)
        some = stored(some.select("_ql_score"), "quality-scores")
        lowest = math.ceil(TAIL * some.count())  # percentile_disc
        threshold = some.orderBy("_ql_score").limit(lowest).agg(F.max("_ql_score")).first()[0] if lowest else None
        drop_stored(some)
    df = scored(with_features(docs), ratios)
    for k, c in repeated_words(F.size("_ql_words"), "_ql_pair"):
        df = df.withColumn(k, c)
    lines = F.filter(F.split("_ql_text", "\n", -1), lambda x: x.rlike(_WORD))
    df = df.withColumn("_ql_lines", lines)
    n = F.size("_ql_words").cast("long")
    failed = (n < 20) | (100 * F.col("_ql_repeat") > 30 * n)
    verdict = F.lit(True) if threshold is None else F.col("_ql_score") >= F.lit(threshold)
    counts = F.struct(
        n.alias("n_words"),
        F.length(F.array_join("_ql_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_ql_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_ql_lines") - F.size(F.array_distinct("_ql_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_ql_repeat").alias("n_repeat_words"),
        F.col("_ql_score").alias("llr"),
        failed.alias("base_failed"),
        (~failed & verdict).alias("kept"),
    )
    return df.select(*docs.columns, counts.alias(name))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged = judge(docs, labels, "_ql")
    # a filter on the verdict itself would be pushed down through the projections and repeat all they compute
    return judged.withColumn("_ql_keep", F.explode_outer(F.array("_ql.kept"))).where("_ql_keep").select(*docs.columns)
