"""From extracts to a ranked work queue: every relation as a function of those before it.

build() gives lazy DataFrames by name; store=True writes each shared one as Parquet in the dependency order, so
later relations read files in place of repeating the plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import canonical, matching, risk
from riskloom.operators.vocabulary import RULES
from riskloom.sources.files import scan


@dataclass(frozen=True)
class Params:
    """Thresholds of the rules; as_of None takes the last posting."""

    as_of: date | None = None
    birth_as_of: date = date(2026, 8, 31)
    window_days: int = 30
    lookback_days: int = 184
    cash_total: float = 50000
    ctr: float = 10000
    band_low: float = 7000
    band_count: int = 4
    rapid_min: float = 25000
    rapid_hours: int = 48
    rapid_share: float = 0.9
    dormant_days: int = 365
    dormant_inflow: float = 10000
    follow_days: int = 30
    kyc_multiple: float = 3
    kyc_min: float = 10000
    min_score: float = 20
    legacy_factor: float = 0.6


def _said(*parts) -> Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def signals(spark: SparkSession, txn: DataFrame, account: DataFrame, kyc: DataFrame, p: Params) -> DataFrame:
    """The eight rules over canonical relations."""
    as_of = p.as_of or txn.agg(F.max("posted_date")).first()[0]
    owned = txn.where(F.col("party_id").isNotNull())
    cash = owned.where("txn_type = 'CASH_DEPOSIT'")
    text = lambda c: F.col(c).cast("string")
    window = risk.cross_core_cash(cash, as_of, p.window_days, p.cash_total)
    missed = risk.combined_days(cash, as_of, p.lookback_days, p.ctr)
    band = risk.near_threshold(risk.in_window(cash, as_of, p.lookback_days), p.band_low, p.ctr, p.window_days, p.band_count)
    move = risk.in_window(owned, as_of, p.lookback_days).select("account_id", "party_id", "txn_id", F.col("posted_at").alias("at"), "amount", "txn_type", "direction")
    rapid = risk.rapid_in_out(
        move.where(F.col("txn_type").isin("WIRE_IN", "ACH_CREDIT") & (F.col("amount") >= p.rapid_min)).select("account_id", "txn_id", "at", "amount"),
        move.where(F.col("txn_type").isin("WIRE_OUT", "ACH_DEBIT")).select("account_id", "at", "amount"), p.rapid_hours, p.rapid_share,
    ).join(account.select("account_id", "party_id"), "account_id").groupBy("party_id").agg(F.max("amount").alias("amount"), F.count("*").alias("n"))
    slept = account.where(F.col("party_id").isNotNull() & (F.datediff("reactivated_on", "dormant_since") >= p.dormant_days)).select(F.col("account_id").alias("_acc"), F.col("reactivated_on").alias("back"))
    woken = owned.where("direction = 'IN'").join(slept, F.col("account_id") == F.col("_acc")).where(F.col("posted_date").between(F.col("back"), F.date_add("back", p.follow_days)))
    woken = woken.groupBy("party_id").agg(F.sum("amount").alias("amount")).where(F.col("amount") >= p.dormant_inflow)
    recent = risk.in_window(cash, as_of, p.window_days).groupBy("party_id").agg(F.sum("amount").alias("total"))
    expected = kyc.where(F.col("party_id").isNotNull()).groupBy("party_id").agg(F.max("expected_cash").alias("expected"))
    compared = risk.expected_ratio(risk.best_window(recent, band), expected, p.kyc_multiple, p.kyc_min)
    none = F.lit(None).cast("decimal(38,2)")
    fired = [
        ("XCORE_CASH_30D", window.select("party_id", F.col("total").alias("amount"), _said(text("n"), " cash deposits in both cores, $", text("total")).alias("evidence"))),
        ("CTR_AGGREGATION_MISSED", missed.select("party_id", "amount", _said(text("days"), " days over the threshold together, worst ", text("worst_day")).alias("evidence"))),
        ("NEAR_THRESHOLD_CASH", band.select("party_id", F.col("total").alias("amount"), _said(text("n"), " deposits just below the threshold from ", text("win_start")).alias("evidence"))),
        ("RAPID_IN_OUT", rapid.select("party_id", "amount", _said(text("n"), " inflows left within hours").alias("evidence"))),
        ("DORMANT_REACTIVATION", woken.select("party_id", "amount", _said("inflow after dormancy $", text("amount")).alias("evidence"))),
        ("KYC_MISMATCH", compared.where("kind = 'MISMATCH'").select("party_id", F.col("best").alias("amount"), _said("expected a month $", text("expected")).alias("evidence"))),
        ("KYC_CONSISTENT_CASH", compared.where("kind = 'CONSISTENT'").select("party_id", F.col("best").alias("amount"), _said("expected a month $", text("expected")).alias("evidence"))),
        ("KYC_INCONSISTENT_ACROSS_CORES", risk.inconsistent_profiles(kyc.where(F.col("party_id").isNotNull())).select("party_id", none.alias("amount"), F.lit("occupations differ between cores").alias("evidence"))),
    ]
    weights = spark.createDataFrame([(k, float(w)) for k, w in RULES.items()], "rule_code string, weight double")
    return risk.signals(fired, weights)


def build(spark: SparkSession, folder: str, p: Params = Params(), store: str | None = None) -> dict[str, DataFrame]:
    raw = {t: scan(spark, folder, t) for t in ("core_a_customers", "core_a_accounts", "core_a_txns", "core_a_aml_alerts", "core_b_party", "core_b_deposit_account", "core_b_txn", "core_b_case_alert", "doc_kyc_summaries", "core_a_loans", "core_b_loan")}
    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        if store:
            df.write.mode("overwrite").parquet(f"{store}/{name}")
            df = spark.read.schema(df.schema).parquet(f"{store}/{name}")
        out[name] = df
        return df

    nick = spark.createDataFrame([("BOB", "ROBERT"), ("BILL", "WILLIAM"), ("LIZ", "ELIZABETH"), ("JIM", "JAMES"), ("KATE", "KATHERINE")], "nickname string, given string")
    std = put("customer_std", matching.standardise(matching.standard_a(raw["core_a_customers"]), matching.standard_b(raw["core_b_party"]), p.birth_as_of))
    pairs = put("match_candidates", matching.decide(matching.evidence(matching.candidates(std), nick)))
    links = put("auto_links", matching.mutual_best(pairs))
    xref = put("party_xref", matching.party_xref(std, links))
    put("match_review_queue", matching.review_queue(pairs, links))
    put("party", canonical.parties(xref, std))
    account = put("account", canonical.accounts(raw["core_a_accounts"], raw["core_b_deposit_account"], xref))
    put("loan", canonical.loans(raw["core_a_loans"], raw["core_b_loan"], xref))
    txn = put("transaction", canonical.transactions(raw["core_a_txns"], raw["core_b_txn"], account))
    alert = put("alert", canonical.alerts(raw["core_a_aml_alerts"], raw["core_b_case_alert"], account, xref))
    kyc = put("kyc_profile", canonical.profiles(raw["doc_kyc_summaries"], xref))
    put("dq_exceptions", canonical.quality_exceptions(std, raw["core_a_accounts"], account))
    signal = put("risk_signal", signals(spark, txn, account, kyc, p))
    score = put("risk_score", risk.scores(signal))
    open_ = alert.where(F.col("status").isin("OPEN", "IN_PROGRESS")).select("alert_id", "party_id", F.col("legacy_score").cast("double").alias("legacy_score"))
    put("alert_queue", risk.queue(open_, score, p.legacy_factor, p.min_score))
    return out
