"""What a column holds: shares of values of each kind in one pass, and which columns refer to which keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import full_match

#: Kinds of content and the pattern of each (whole value).
KINDS = {
    "money": r"-?[0-9]+\.[0-9]{2}", "number": r"-?[0-9]+(\.[0-9]+)?", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "zip5": r"[0-9]{5}", "state": r"[A-Z]{2}", "email": r"[^@ ]+@[^@ ]+\.[a-z]+", "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "word": r"[A-Za-z]+",
    "name_last_first": r"[A-Z][A-Z' -]+, [A-Z][A-Z' -]+", "json": r"\{.*\}", "url": r"https?://.*", "code_number": r"[A-Za-z]+#[0-9]+",
}


def kind_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, kind, share of non-empty values: one aggregate over the table, then turned to rows."""
    aggs = []
    for c in columns:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        aggs += [F.avg(F.when(v.isNotNull(), full_match(v, p).cast("double"))).alias(f"{c}|{k}") for k, p in KINDS.items()]
    row = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"`{c}|{k}`").alias("share")) for c in columns for k in KINDS])
    return row.select(F.explode(rows).alias("r")).select("r.*").where("share > 0")


def overlap(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Share of the distinct values of a column that are keys."""
    v = child.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    p = parent.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(1))
    return v.join(p, "v", "left").agg((F.count("hit") / F.count("*")).alias("overlap"))
