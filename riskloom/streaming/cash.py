"""The cash rules on a stream: totals of party and window with late data, each window once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cash(stream: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 day", over: float = 0) -> DataFrame:
    """stream: at (timestamp), party_id, core, amount. Windows close when the watermark passes them."""
    per = stream.withWatermark("at", late).groupBy(F.window("at", length, slide), "party_id").agg(
        F.sum("amount").cast("decimal(38,2)").alias("total"), F.count("*").alias("n"), F.max((F.col("core") == "core_a").cast("int")).alias("in_a"), F.max((F.col("core") == "core_b").cast("int")).alias("in_b")
    )
    both = (F.col("in_a") == 1) & (F.col("in_b") == 1)
    return per.where(both & (F.col("total") > over)).select("party_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
