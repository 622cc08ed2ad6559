"""One model of accounts, loans, transactions, alerts, profiles and branches over both cores; every row keeps its file and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import decode
from riskloom.operators import vocabulary as v

MONEY, RATE = "decimal(38,2)", "decimal(10,3)"
LINEAGE = ["source_file", "source_row"]


def _id(core: str, col: str) -> Column:
    return F.concat(F.lit(core + ":"), F.col(col))


def _cents(col: str) -> Column:
    return (F.col(col).cast(MONEY) / 100).cast(MONEY)


def _day(col: str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(F.substring(col, 1, 10), fmt)


def _compact(col: str) -> Column:
    return F.try_to_date(F.nullif(F.col(col), F.lit("00000000")), "yyyyMMdd")


def with_party(df: DataFrame, xref: DataFrame, record: str = "customer_record_id") -> DataFrame:
    x = xref.select(F.col("record_id").alias("_rec"), "party_id")
    return df.join(x, F.col(record) == F.col("_rec"), "left").drop("_rec")


def accounts(a: DataFrame, b: DataFrame, xref: DataFrame) -> DataFrame:
    """First core's accounts without repeated numbers (the first row of the file stays), and the second's."""
    first = Window.partitionBy("ACCT_NO").orderBy("source_row")
    a = a.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    x = a.select(
        _id("core_a", "ACCT_NO").alias("account_id"), F.lit("core_a").alias("core"), _id("core_a", "CIF_NO").alias("customer_record_id"), decode(F.col("PROD_CD"), v.PRODUCT_A).alias("product_type"),
        F.col("BR_CD").alias("branch"), _compact("OPEN_DT").alias("opened_on"), _compact("CLOSE_DT").alias("closed_on"), decode(F.col("ACCT_STAT"), v.ACCOUNT_STATUS_A).alias("status"),
        _compact("DORM_FLAG_DT").alias("dormant_since"), _compact("REACT_DT").alias("reactivated_on"), _cents("CUR_BAL_CENTS").alias("balance_usd"), F.col("INT_RATE_PCT").cast(RATE).alias("rate_pct"), *LINEAGE,
    )
    y = b.select(
        _id("core_b", "acct_ref").alias("account_id"), F.lit("core_b").alias("core"), _id("core_b", "party_uuid").alias("customer_record_id"), decode(F.col("product_name"), v.PRODUCT_B).alias("product_type"),
        F.col("branch_name").alias("branch"), _day("opened_on").alias("opened_on"), _day("closed_on").alias("closed_on"), F.col("acct_status").alias("status"),
        _day("dormant_since").alias("dormant_since"), _day("reactivated_on").alias("reactivated_on"), F.col("ledger_balance").cast(MONEY).alias("balance_usd"), F.col("rate_pct").cast(RATE).alias("rate_pct"), *LINEAGE,
    )
    return with_party(x.unionByName(y), xref)


def loans(a: DataFrame, b: DataFrame, xref: DataFrame) -> DataFrame:
    x = a.select(
        _id("core_a", "LOAN_NO").alias("loan_id"), F.lit("core_a").alias("core"), _id("core_a", "CIF_NO").alias("customer_record_id"), decode(F.col("LOAN_TYP"), v.LOAN_A, F.col("LOAN_TYP")).alias("loan_type"),
        F.col("BR_CD").alias("branch"), _compact("ORIG_DT").alias("booked_on"), _compact("MAT_DT").alias("matures_on"), _cents("ORIG_AMT_CENTS").alias("original_usd"), _cents("CUR_PRIN_CENTS").alias("principal_usd"),
        F.col("INT_RATE_PCT").cast(RATE).alias("rate_pct"), decode(F.col("COLL_TYP"), v.COLLATERAL_A).alias("cre_category"), (F.col("OWNER_OCC_FLG") == "Y").alias("owner_occupied"), F.col("DPD").cast("int").alias("days_past_due"), *LINEAGE,
    )
    cre = None
    for start, name in v.COLLATERAL_B.items():
        hit = (F.col("product_name") == "Commercial Real Estate") & F.col("collateral_desc").startswith(start)
        cre = (F.when if cre is None else cre.when)(hit, F.lit(name))
    y = b.select(
        _id("core_b", "note_number").alias("loan_id"), F.lit("core_b").alias("core"), _id("core_b", "party_uuid").alias("customer_record_id"), decode(F.col("product_name"), v.LOAN_B).alias("loan_type"),
        F.col("branch_name").alias("branch"), _day("booked_on").alias("booked_on"), _day("maturity_on").alias("matures_on"), F.col("original_amount").cast(MONEY).alias("original_usd"), F.col("principal_outstanding").cast(MONEY).alias("principal_usd"),
        F.col("interest_rate_pct").cast(RATE).alias("rate_pct"), cre.alias("cre_category"), (F.col("owner_occupied") == "true").alias("owner_occupied"), F.col("days_delinquent").cast("int").alias("days_past_due"), *LINEAGE,
    )
    return with_party(x.unionByName(y), xref)


def transactions(a: DataFrame, b: DataFrame, account: DataFrame) -> DataFrame:
    """Signed amounts become a direction and a magnitude; times stay local (an offset is dropped, not applied)."""
    ntz = lambda c, f: F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(c, F.lit(f)), "yyyy-MM-dd HH:mm:ss"))
    x = a.select(
        _id("core_a", "TXN_ID").alias("txn_id"), F.lit("core_a").alias("core"), _id("core_a", "ACCT_NO").alias("account_id"), ntz(F.concat("POST_DT", "POST_TM"), "yyyyMMddHHmmss").alias("posted_at"),
        decode(F.col("TXN_CD"), v.TXN_A).alias("txn_type"), _cents("AMT_CENTS").alias("signed_usd"), decode(F.col("CHNL_CD"), v.CHANNEL_A).alias("channel"), F.col("BR_CD").alias("branch"),
        (F.col("CTR_FLG") == "Y").alias("ctr_filed"), F.col("CPTY_NM").alias("counterparty"), F.col("CPTY_BANK").alias("counterparty_institution"), *LINEAGE,
    )
    y = b.select(
        _id("core_b", "txn_uuid").alias("txn_id"), F.lit("core_b").alias("core"), _id("core_b", "acct_ref").alias("account_id"), ntz(F.substring("txn_timestamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"),
        decode(F.col("txn_type_desc"), v.TXN_B).alias("txn_type"), (F.when(F.col("dr_cr") == "C", 1).otherwise(-1) * F.col("amount").cast(MONEY)).cast(MONEY).alias("signed_usd"), decode(F.col("channel_desc"), v.CHANNEL_B).alias("channel"), F.col("branch_name").alias("branch"),
        (F.col("ctr_filed") == "true").alias("ctr_filed"), F.col("counterparty"), F.col("counterparty_institution"), *LINEAGE,
    )
    own = account.select(F.col("account_id").alias("_acc"), "party_id")
    t = x.unionByName(y).join(own, F.col("account_id") == F.col("_acc"), "left").drop("_acc")
    return t.withColumns({"direction": F.when(F.col("signed_usd") >= 0, "IN").otherwise("OUT"), "amount": F.abs("signed_usd").cast(MONEY), "posted_date": F.col("posted_at").cast("date")})


def alerts(a: DataFrame, b: DataFrame, account: DataFrame, xref: DataFrame) -> DataFrame:
    x = a.select(
        _id("core_a", "ALERT_ID").alias("alert_id"), F.lit("core_a").alias("core"), _id("core_a", "CIF_NO").alias("customer_record_id"), _id("core_a", "ACCT_NO").alias("account_id"), decode(F.col("RULE_CD"), v.SCENARIO_A).alias("scenario"),
        _compact("ALERT_DT").alias("alert_date"), F.col("ALERT_SCORE").cast("int").alias("legacy_score"), decode(F.col("ALERT_STAT"), v.ALERT_STATUS_A).alias("status"), decode(F.col("DISPO_CD"), v.DISPOSITION_A).alias("disposition"),
        _compact("CLOSE_DT").alias("closed_on"), F.col("ASSIGNED_TO").alias("owner"), F.col("BR_CD").alias("branch"), *LINEAGE,
    )
    where = account.where("core = 'core_b'").select(F.col("account_id").alias("_acc"), F.col("branch").alias("_branch"))
    y = b.join(where, _id("core_b", "acct_ref") == F.col("_acc"), "left").select(
        _id("core_b", "case_ref").alias("alert_id"), F.lit("core_b").alias("core"), _id("core_b", "party_uuid").alias("customer_record_id"), _id("core_b", "acct_ref").alias("account_id"), decode(F.col("scenario_name"), v.SCENARIO_B).alias("scenario"),
        _day("created_at").alias("alert_date"), decode(F.col("priority"), v.PRIORITY_SCORE, F.lit(50)).alias("legacy_score"), decode(F.col("state"), v.ALERT_STATUS_B).alias("status"), decode(F.col("outcome"), v.DISPOSITION_B).alias("disposition"),
        _day("closed_at").alias("closed_on"), F.col("analyst").alias("owner"), F.col("_branch").alias("branch"), *LINEAGE,
    )
    return with_party(x.unionByName(y), xref)


def profiles(kyc: DataFrame, xref: DataFrame) -> DataFrame:
    p = kyc.select(
        "kyc_id", "core", F.concat_ws(":", "core", "customer_ref").alias("customer_record_id"), _day("review_date").alias("review_date"), "risk_rating", F.col("occupation_or_business").alias("occupation"),
        F.col("expected_monthly_cash_usd").cast(MONEY).alias("expected_cash"), F.col("expected_monthly_wires_usd").cast(MONEY).alias("expected_wires"), "source_of_funds", "summary_text", *LINEAGE,
    )
    return with_party(p, xref)


def branches(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select(_id("core_a", "BR_CD").alias("branch_id"), F.lit("core_a").alias("core"), F.col("BR_NM").alias("name"), F.col("CITY").alias("city"), F.col("ST").alias("state"))
    return x.unionByName(b.select(_id("core_b", "branch_name").alias("branch_id"), F.lit("core_b").alias("core"), F.col("branch_name").alias("name"), F.col("branch_city").alias("city"), F.col("branch_state").alias("state")))


def parties(xref: DataFrame, std: DataFrame) -> DataFrame:
    """One row a resolved customer; name and place of the first core that has the party."""
    j = xref.join(std.drop("core", "source_key"), "record_id")
    key = lambda core: F.max(F.when(F.col("core") == core, F.col("source_key")))
    return j.groupBy("party_id").agg(
        F.min("kind").alias("party_kind"), F.min_by("display_name", "core").alias("display_name"), F.min("birth_date").alias("birth_date"), F.min_by("city", "core").alias("city"), F.min_by("state", "core").alias("state"),
        F.countDistinct("core").alias("cores"), F.count("*").alias("records"), key("core_a").alias("core_a_key"), key("core_b").alias("core_b_key"), F.max("link_status").alias("link_status"),
    )


def quality_exceptions(std: DataFrame, a_accounts: DataFrame, account: DataFrame) -> DataFrame:
    """Missing, future or malformed values, repeated account numbers, accounts without a customer."""
    def rows(df, rule, severity, key, field, seen):
        return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col("core"), F.col(key).alias("record_key"), F.lit(field).alias("field"), seen.cast("string").alias("observed"))

    person = F.col("kind") == "PERSON"
    again = a_accounts.groupBy(F.concat(F.lit("core_a:"), "ACCT_NO").alias("k")).agg(F.count("*").alias("n")).where("n > 1").withColumn("core", F.lit("core_a"))
    known = std.select(F.col("record_id").alias("customer_record_id"))
    out = rows(std.where(person & F.col("birth_raw").isNull()), "DQ_MISSING_DOB", "WARNING", "record_id", "birth_date", F.col("birth_raw"))
    out = out.unionByName(rows(std.where(F.col("birth_raw").isNotNull() & F.col("birth_date").isNull()), "DQ_FUTURE_DOB", "CRITICAL", "record_id", "birth_date", F.col("birth_raw")))
    out = out.unionByName(rows(std.where(F.col("zip5").isNull()), "DQ_INVALID_ZIP", "WARNING", "record_id", "zip", F.col("zip_raw")))
    out = out.unionByName(rows(again, "DQ_DUPLICATE_KEY", "CRITICAL", "k", "account_id", F.concat(F.col("n").cast("string"), F.lit(" rows"))))
    return out.unionByName(rows(account.join(known, "customer_record_id", "left_anti"), "DQ_ORPHAN_ACCOUNT", "CRITICAL", "account_id", "customer", F.col("customer_record_id")))
