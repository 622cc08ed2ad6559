"""Money-movement rules over canonical transactions, their score and the work queue.

A transaction has party_id, core, txn_type, posted_date, posted_at, amount (decimal) and ctr_filed; rules take
thresholds as plain values, which become literals that Catalyst folds and pushes to the scan.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def in_window(txn: DataFrame, as_of, days: int) -> DataFrame:
    """The last `days` days up to as_of: posted_date > as_of - days."""
    return txn.where(F.col("posted_date") > F.date_sub(F.lit(as_of), days))


def cross_core_cash(txn: DataFrame, as_of, days: int, over: float) -> DataFrame:
    """Parties with cash in both cores in the window that sums to more than `over`."""
    cash = in_window(txn, as_of, days)
    per = cash.groupBy("party_id").agg(
        F.countDistinct("core").alias("cores"), F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"),
        F.min("posted_date").alias("first_date"), F.max("posted_date").alias("last_date"),
    )
    return per.where((F.col("cores") >= 2) & (F.col("total") > over))


def combined_days(txn: DataFrame, as_of, lookback: int, over: float, unit: Column | None = None) -> DataFrame:
    """Parties with days (or units) on which both cores together exceed `over` and nothing was filed; the largest such day."""
    day = unit if unit is not None else F.col("posted_date")
    per = in_window(txn, as_of, lookback).groupBy("party_id", day.alias("day")).agg(
        F.countDistinct("core").alias("cores"), F.sum("amount").cast(MONEY).alias("total"), F.max("ctr_filed").alias("filed")
    )
    missed = per.where((F.col("cores") >= 2) & (F.col("total") > over) & ~F.col("filed"))
    return missed.groupBy("party_id").agg(F.count("*").alias("days"), F.max("total").alias("amount"), F.max_by("day", F.struct("total", "day")).alias("worst_day"))


def near_threshold(txn: DataFrame, low: float, high: float, days: int, least: int) -> DataFrame:
    """Parties with a window of `days` days, starting at one of their deposits in [low, high), with `least` of them
    or more; the window with the most, then the largest total, then the latest start. One range-frame window
    per party in place of a self-join."""
    band = txn.where((F.col("amount") >= low) & (F.col("amount") < high)).withColumn("_day", F.unix_date("posted_date"))
    ahead = Window.partitionBy("party_id").orderBy("_day").rangeBetween(0, days - 1)
    starts = band.select("party_id", F.col("posted_date").alias("start"), F.count("*").over(ahead).alias("n"), F.sum("amount").over(ahead).cast(MONEY).alias("total")).distinct()
    best = starts.where(F.col("n") >= least).groupBy("party_id").agg(F.max(F.struct("n", "total", "start")).alias("w"))
    return best.select("party_id", "w.n", "w.total", F.col("w.start").alias("win_start"))


def _second(c: Column, kind: str) -> Column:
    """Whole seconds of a time. One without a zone is read by its fields, so no session's zone moves it."""
    if kind != "timestamp_ntz":
        return F.unix_timestamp(c.cast("timestamp"))
    return F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def rapid_in_out(ins: DataFrame, outs: DataFrame, hours: int, share: float, by: Sequence[str] = ("account_id", "txn_id", "at", "amount")) -> DataFrame:
    """Inflows of which at least `share` leaves the same account within 1 second to `hours` hours.

    ins: account_id, txn_id, at, amount; outs: account_id, at, amount; rows of ins that agree in `by` are one inflow
    (amount must be among them). The interval join has an equi-key on the account and the time slot (the inflow's
    and the next), so partitions stay small for busy accounts.
    """
    span = hours * 3600
    second = lambda df: _second(F.col("at"), df.schema["at"].dataType.simpleString())
    i = ins.withColumn("_sec", second(ins)).withColumn("_slot", F.explode(F.array(F.floor(F.col("_sec") / span), F.floor(F.col("_sec") / span) + 1)))
    o = outs.select(F.col("account_id").alias("_acc"), F.col("amount").alias("_amt"), second(outs).alias("_out")).withColumn("_s", F.floor(F.col("_out") / span))
    met = i.join(o, (i["account_id"] == o["_acc"]) & (F.col("_slot") == F.col("_s"))).where((F.col("_out") - F.col("_sec")).between(1, span))
    per = met.groupBy(*by).agg(F.sum("_amt").cast(MONEY).alias("out_total"), F.count("*").alias("n_out"))
    return per.where(F.col("out_total") >= F.col("amount") * F.lit(share).cast("decimal(10,4)"))


def woken_accounts(events: DataFrame, idle_days: int, follow_days: int) -> DataFrame:
    """Accounts that were idle for `idle_days` days or more: date of return and inflow in the days that follow.

    events: account_id, day, amount.
    """
    by = Window.partitionBy("account_id").orderBy("day")
    back = events.select("account_id", "day").distinct().withColumn("before", F.lag("day").over(by))
    back = back.where(F.datediff("day", "before") >= idle_days).select(F.col("account_id").alias("_a"), F.col("day").alias("woke"))
    met = events.join(back, F.col("account_id") == F.col("_a")).where(F.col("day").between(F.col("woke"), F.date_add("woke", follow_days)))
    return met.groupBy("account_id", "woke").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("inflow"))


def best_window(*totals: DataFrame) -> DataFrame:
    """The largest of several windows' totals per party (party_id, total)."""
    both = functools.reduce(DataFrame.unionByName, [t.select("party_id", "total") for t in totals])
    return both.groupBy("party_id").agg(F.max("total").alias("best"))


def expected_ratio(best: DataFrame, expected: DataFrame, factor: float, least: float) -> DataFrame:
    """MISMATCH above factor times what was expected, CONSISTENT up to half of that; both over `least`."""
    j = best.join(expected, "party_id").where(F.col("best") > least)
    kind = F.when(F.col("best") > factor * F.col("expected"), "MISMATCH").when(F.col("best") <= factor / 2 * F.col("expected"), "CONSISTENT")
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull())


def inconsistent_profiles(profiles: DataFrame) -> DataFrame:
    """Parties with profiles in both cores that name different occupations."""
    per = profiles.groupBy("party_id").agg(F.countDistinct("core").alias("cores"), F.countDistinct("occupation").alias("occupations"))
    return per.where("cores >= 2 AND occupations > 1")


def signals(fired: Sequence[tuple[str, DataFrame]], weights: DataFrame) -> DataFrame:
    """One row for each party and rule, with the rule's weight. fired: (code, party_id and evidence)."""
    rows = [f.select("party_id", F.lit(code).alias("rule_code"), F.col("amount").cast(MONEY).alias("amount"), F.col("evidence").cast("string").alias("evidence")) for code, f in fired]
    every = functools.reduce(DataFrame.unionByName, rows)
    return every.join(F.broadcast(weights), "rule_code")  # the rule table has one row a rule


def scores(signal: DataFrame, top: int = 3) -> DataFrame:
    """Sum of weights, clamped to 0-100, and the codes of the `top` rules by weight that add to it."""
    rank = Window.partitionBy("party_id").orderBy(F.desc("weight"), "rule_code")
    s = signal.withColumn("rn", F.row_number().over(rank))
    codes = F.sort_array(F.collect_list(F.when((F.col("rn") <= top) & (F.col("weight") > 0), F.struct("rn", "rule_code"))))
    raw = F.sum("weight")
    return s.groupBy("party_id").agg(
        raw.alias("raw_score"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("score"),
        F.nullif(F.array_join(codes["rule_code"], "; "), F.lit("")).alias("top_reasons"), F.max("amount").alias("max_amount"), F.count("*").alias("n_rules"),
    )


def queue(legacy: DataFrame, score: DataFrame, legacy_factor: float, least: float) -> DataFrame:
    """Open legacy alerts (party_id, alert_id, legacy_score) and parties over `least` without one, ranked.

    The rank is over one partition: the queue holds only open alerts and scores over the threshold.
    """
    s = score.select("party_id", "score", "raw_score", "max_amount", "top_reasons")
    open_ = legacy.join(s, "party_id", "left").select(
        F.col("alert_id").alias("item_id"), "party_id", F.lit("LEGACY").alias("origin"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.col("legacy_score") * legacy_factor).cast("double").alias("priority"),
        "raw_score", "max_amount", F.coalesce("top_reasons", F.lit("LEGACY_ALERT")).alias("reasons"),
    )
    new = s.where(F.col("score") >= least).join(legacy.select("party_id"), "party_id", "left_anti").select(
        F.concat(F.lit("ENG-"), F.col("party_id").cast("string")).alias("item_id"), "party_id", F.lit("ENGINE").alias("origin"),
        F.col("score").cast("double").alias("priority"), "raw_score", "max_amount", F.col("top_reasons").alias("reasons"),
    )
    both = open_.unionByName(new)
    order = Window.orderBy(F.desc("priority"), F.desc_nulls_last("raw_score"), F.desc_nulls_last("max_amount"), "item_id")
    return both.withColumn("queue_rank", F.row_number().over(order)).withColumn("queue_size", F.count("*").over(Window.partitionBy()))
