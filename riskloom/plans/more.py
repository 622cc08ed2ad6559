"""Further operators on the driver's tables, and the bank end to end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.text import decode
from riskloom.plans.canonical import STATUS, cents, table, transactions


def j02_account(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of both cores, repeated keys reduced to their first row, with their party."""
    one = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(one)).where("rn = 1")
    bal = cents(F.col("c_acctbal"), "decimal(38,2)")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.concat(F.lit("core_a:"), F.col("o_custkey").cast("string")).alias("account_id"), decode(F.col("o_orderstatus"), STATUS).alias("status"), F.col("o_orderdate").cast("date").alias("opened_on"), bal.alias("balance_usd"))


def j03_loan(spark: SparkSession, d: str) -> DataFrame:
    """Decoded by how a description starts."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_type").startswith("STANDARD"), "STANDARD").when(F.col("p_type").startswith("PROMO"), "PROMO").when(F.col("p_type").startswith("ECONOMY"), "ECONOMY")
    return p.select("p_partkey", kind.alias("loan_type"), (cents(F.col("p_retailprice"), "decimal(38,2)") / 100).cast("decimal(38,2)").alias("principal_usd"), (F.col("p_size") >= 25).alias("large"))


def j05_alert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('error', 'signup')")
    return e.select("event_id", decode(F.col("event_type"), {"error": "RAPID_MOVEMENT", "signup": "LARGE_CASH"}).alias("scenario"), F.when(F.col("value") >= 100, 90).when(F.col("value") >= 50, 75).otherwise(50).alias("legacy_score"), F.col("ts").cast("date").alias("alert_date"))


def j06_profile(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("c_mktsegment").alias("occupation"), cents(F.abs("c_acctbal") * 40).alias("expected_cash"), "n_name")


def j07_branch(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("core_a:"), F.col("n_nationkey").cast("string")).alias("branch_id"), F.lit("core_a").alias("core"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, d, "region").select(F.concat(F.lit("core_b:"), F.col("r_name")).alias("branch_id"), F.lit("core_b").alias("core"), F.col("r_name").alias("name")))


def k01_customer_record(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.agg(F.max("posted_date").alias("as_of"), F.countDistinct("party_id").alias("customers"))


def k06_open_by_month(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    old = F.datediff(F.lit("2001-08-01").cast("date"), "posted_date") > 30
    return t.groupBy("status").agg(F.count_if(old).alias("overdue"), F.count("*").alias("n"))


def k06_cash_customers(spark: SparkSession, d: str) -> DataFrame:
    """The customers with the most cash, ranked over the aggregate."""
    t = transactions(spark, d).where("txn_type = 'CASH_DEPOSIT'")
    per = t.groupBy("party_id").agg(F.sum("amount").cast("decimal(38,2)").alias("total"))
    return per.orderBy(F.desc("total"), "party_id").limit(5)


def o01_bounded_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct values and the smallest and largest value of columns, exactly, in one pass."""
    c = table(spark, d, "customer")
    cols = ["c_custkey", "c_nationkey", "c_mktsegment"]
    row = c.agg(*[x for k in cols for x in (F.countDistinct(k).alias(f"d_{k}"), F.min(k).cast("string").alias(f"lo_{k}"), F.max(k).cast("string").alias(f"hi_{k}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(f"d_{k}").alias("n_distinct"), F.col(f"lo_{k}").alias("low"), F.col(f"hi_{k}").alias("high")) for k in cols])).alias("r")).select("r.*")


def o07_code_translation(spark: SparkSession, d: str) -> DataFrame:
    """Codes with their meaning, and whether they need review."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    known = decode(F.col("o_orderpriority"), {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "5-LOW": "LOW"})
    return o.select("o_orderpriority", "n", known.alias("meaning"), known.isNull().alias("review"))


def a10_config_relation(spark: SparkSession, d: str) -> DataFrame:
    from riskloom.sources.files import config_relation

    return config_relation(spark, {"thresholds": {"ctr": 10000, "share": 0.9}, "name": "demo"})


def a20_control_totals(spark: SparkSession, d: str) -> DataFrame:
    """Lines against their orders: keys without lines, and totals by status."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    j = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.count_if(F.col("n_lines").isNull()).alias("without_lines"))


def _bank(spark: SparkSession) -> dict[str, DataFrame]:
    from riskloom.plans.bank import build
    from riskloom.sources.fixtures import generate

    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not root.startswith("/"):
        if root or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a mounted folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="riskloom-bank-")
    folder = f"{root}/bank-{uuid.uuid4().hex}"
    generate(f"{folder}/extracts", people=60, duplicates=20)
    # relations that several others read are written once and read again
    return build(spark, f"file://{folder}/extracts", store=f"file://{folder}/relations")


def bank_alert_queue(spark: SparkSession, d: str) -> DataFrame:
    """Extracts to ranked queue on the generated bank."""
    return _bank(spark)["alert_queue"]


def bank_auto_links(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark)["auto_links"]


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_PROGRESS' END"
ORACLE = {
    "j02_account": f"SELECT 'core_a:' || o_custkey::VARCHAR AS account_id, {_STATUS} AS status, CAST(o_orderdate AS DATE) AS opened_on, CAST(c_acctbal AS DECIMAL(38,2)) AS balance_usd FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o LEFT JOIN customer ON c_custkey = o_custkey",
    "j03_loan": "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'STANDARD' WHEN p_type LIKE 'PROMO%' THEN 'PROMO' WHEN p_type LIKE 'ECONOMY%' THEN 'ECONOMY' END AS loan_type, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(38,2)) AS principal_usd, p_size >= 25 AS large FROM part",
    "j05_alert": "SELECT event_id, CASE event_type WHEN 'error' THEN 'RAPID_MOVEMENT' ELSE 'LARGE_CASH' END AS scenario, CASE WHEN value >= 100 THEN 90 WHEN value >= 50 THEN 75 ELSE 50 END AS legacy_score, CAST(ts AS DATE) AS alert_date FROM events WHERE event_type IN ('error', 'signup')",
    "j06_profile": "SELECT c_custkey, c_mktsegment AS occupation, CAST(abs(c_acctbal) * 40 AS DECIMAL(18,2)) AS expected_cash, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "j07_branch": "SELECT 'core_a:' || n_nationkey::VARCHAR AS branch_id, 'core_a' AS core, n_name AS name FROM nation UNION ALL SELECT 'core_b:' || r_name, 'core_b', r_name FROM region",
    "k01_customer_record": "SELECT max(CAST(o_orderdate AS DATE)) AS as_of, count(DISTINCT o_custkey) AS customers FROM orders",
    "k06_open_by_month": f"SELECT {_STATUS} AS status, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 30) AS overdue, count(*) AS n FROM orders GROUP BY 1",
    "k06_cash_customers": "SELECT o_custkey AS party_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY total DESC, party_id LIMIT 5",
    "o01_bounded_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")),
    "o07_code_translation": "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' END AS meaning, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AS review FROM orders GROUP BY o_orderpriority",
    "a10_config_relation": "SELECT * FROM (VALUES ('thresholds.ctr', 10000.0::DOUBLE, '10000'), ('thresholds.share', 0.9::DOUBLE, '0.9'), ('name', NULL, 'demo')) t(name, num_value, text_value)",
    "a20_control_totals": "SELECT o_orderstatus, count(*) AS orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, count(*) FILTER (n IS NULL) AS without_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY o_orderstatus",
}


def queries() -> dict:
    return {k: globals()[k] for k in [*ORACLE, "bank_alert_queue", "bank_auto_links"]}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
