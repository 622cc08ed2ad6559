"""The driver's tables seen as bank extracts: orders are cash movements of two cores, events are account activity."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import decode

STATUS = {"F": "CLOSED", "O": "OPEN", "P": "IN_PROGRESS"}
TYPES = {"1-URGENT": "CASH_DEPOSIT", "2-HIGH": "WIRE_IN", "3-MEDIUM": "ACH_CREDIT", "4-NOT SPECIFIED": "CHECK", "5-LOW": "CARD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column, kind: str = "decimal(18,2)") -> Column:
    """An amount of a double as the SQL rounds it: the product with 100 as a double, halves away from zero. Spark's cast
    reads the shortest decimal form instead, which is on the other side of some halves (1.005)."""
    n = F.round(c * 100)
    return F.when(F.abs(n) < 9e17, (n.cast("long").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(kind)).otherwise(c.cast(kind))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("party_id"), F.when(F.col("o_orderkey") % 2 == 0, "core_a").otherwise("core_b").alias("core"),
        decode(F.col("o_orderpriority"), TYPES).alias("txn_type"), decode(F.col("o_orderstatus"), STATUS).alias("status"),
        F.col("o_orderdate").cast("date").alias("posted_date"), cents(F.col("o_totalprice")).alias("amount"), (F.col("o_orderstatus") == "F").alias("ctr_filed"),
    )


def last_day(txn: DataFrame):
    """One value, bound as a literal into the rules."""
    return txn.agg(F.max("posted_date")).first()[0]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("at"), F.col("ts").cast("date").alias("day"), "event_type", cents(F.col("value")).alias("amount"), "value")


def block_pairs(a: DataFrame, b: DataFrame, keys: list[str], rows: int = 20_000) -> DataFrame:
    """Pairs of a row of a and one of b with a larger key that agree in keys. The rows of a of a block of more than
    `rows` in b are dealt to salts, so no task has all its pairs, and only such a block is shuffled more than once;
    a merge join streams a and buffers one block of b."""
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * a.sparkSession.sparkContext.defaultParallelism)
    big = b.groupBy(*[F.col(k).alias("_" + k) for k in keys]).agg(F.ceil(F.count("*") / rows).cast("int").alias("_n")).where("_n > 1")
    big = F.broadcast(big)  # one for every `rows` rows at most
    salts = F.coalesce("_n", F.lit(1))

    def sized(df: DataFrame) -> DataFrame:
        met = [F.col(k) == F.col("_" + k) for k in keys]
        return df.join(big, met, "left")

    dealt = sized(a).select(*a.columns, F.pmod(F.xxhash64("p_partkey"), salts).cast("int").alias("_s")).repartition(parts, *keys, "_s")
    every = sized(b).select(*[F.col(c).alias("b_" + c) for c in b.columns], F.explode(F.sequence(F.lit(0), salts - 1)).alias("b__s")).repartition(parts, *["b_" + k for k in keys], "b__s")
    same = [F.col(k) == F.col("b_" + k) for k in [*keys, "_s"]]
    return dealt.hint("merge").join(every.hint("merge"), [*same, F.col("p_partkey") < F.col("b_p_partkey")])
