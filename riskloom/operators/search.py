"""Ranked keyword search (BM25 over characters, prefixes at word starts) as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import search_text

K1, B = 1.2, 0.75
#: Words a query is searched without.
STOP = set("a an the of and or to in for is are what which who how do does with on at by from".split())
#: Endings that a word is searched without, longest first.
ENDINGS = ["ations", "ation", "ments", "ment", "ings", "ing", "ies", "ed", "es", "s"]


def stem(word: str) -> str:
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            if e == "ies":
                return word[:-3] + "y"
            if e == "es" and not re.search("(s|x|z|ch|sh)$", word[:-2]):
                return word[:-1]
            return word[: -len(e)]
    return word


def terms(query: str, most: int = 12) -> list[str]:
    words = re.findall("[a-z0-9$]+", query.lower().replace(",", ""))
    return list(dict.fromkeys(stem(w) for w in words if w not in STOP and len(w) > 1))[:most]


def bm25(docs: DataFrame, words: list[str], k: int, id_col: str = "doc_id", text_col: str = "text", keep=None) -> DataFrame:
    """The k best documents. Document frequencies are of the whole table, the mean length of those that `keep` holds for."""
    s = docs.select(F.col(id_col).alias("doc_id"), search_text(F.col(text_col)).alias("_s"), (keep if keep is not None else F.lit(True)).alias("_keep"))
    # Of a text only its length and counts go on. They pass an exchange that the statistics and the ranking share, so
    # a text is read once; what comes out of explode_outer isn't pushed down to where the text would be made again.
    s = s.withColumn("_s", F.explode_outer(F.array("_s")))
    cut = [F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(f" {w}"), F.lit(""))) for w in words]
    d = s.select("doc_id", F.explode_outer(F.array(F.struct("_keep", F.length("_s").alias("len"), F.array(*cut).alias("cut")))).alias("_c")).repartition("doc_id")
    cuts = [F.col("_c.cut")[i] for i in range(len(words))]
    stats = d.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(F.when(F.col("_c._keep"), F.col("_c.len"))), F.lit(0.0)), F.lit(1.0)).alias("mean"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(cuts)])  # one row
    d = d.withColumn("_c", F.explode_outer(F.array("_c"))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = cuts[i] / F.lit(float(len(w) + 1))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_c.len") / F.col("mean")))
    hits = sum(((c > 0).cast("int") for c in cuts), F.lit(0))
    ranked = d.where("_c._keep").withColumns({"hits": hits, "score": F.round(score, 4)}).where("hits > 0")
    return ranked.select("doc_id", "hits", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def snippet(body: str, words: list[str], most: int = 320) -> str:
    parts = [p for p in re.split(r"(?<=[.;])\s+", body) if len(p.split()) >= 4] or [body]
    best = max(parts, key=lambda p: (sum(f" {w}" in f" {p.lower()}" for w in words), -abs(len(p) - 160)))
    return best[:most]
