"""Domain operators on the driver's tables: risk rules and queue, matching, data quality, metrics, search, profiling."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.similarity import scored_pairs
from riskloom.functions.text import decode, party_key, search_text
from riskloom.operators import profile, risk, search
from riskloom.plans.canonical import STATUS, TYPES, activity, block_pairs, cents, last_day, table, transactions

_CASE = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
_TXN = f"(SELECT o_orderkey AS txn_id, o_custkey AS party_id, CASE WHEN o_orderkey % 2 = 0 THEN 'core_a' ELSE 'core_b' END AS core, {_CASE('o_orderpriority', TYPES)} AS txn_type, {_CASE('o_orderstatus', STATUS)} AS status, CAST(o_orderdate AS DATE) AS posted_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus = 'F' AS ctr_filed FROM orders)"
_LAST = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"
WEIGHTS = [("CASH_365D", 35.0), ("COMBINED_MONTH", 30.0), ("MISMATCH", 15.0), ("CONSISTENT", -20.0)]


def j04_transaction(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d)


def j01_party(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_txn"))
    return c.join(o, "c_custkey", "left").select("c_custkey", party_key(F.concat(F.lit("core_a:"), F.col("c_custkey").cast("string"))).alias("party_id"), "c_name", F.coalesce("n_txn", F.lit(0)).alias("n_txn"))


def _cash(spark, d, days):
    txn = transactions(spark, d)
    return risk.cross_core_cash(txn, last_day(txn), days, 300000)


def r01_cross_core_window(spark: SparkSession, d: str) -> DataFrame:
    return _cash(spark, d, 90)


def r02_combined_month(spark: SparkSession, d: str) -> DataFrame:
    txn = transactions(spark, d)
    return risk.combined_days(txn, last_day(txn), 100000, 300000, F.trunc("posted_date", "MM"))


def r03_near_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = activity(spark, d).where("event_type = 'purchase'").select(F.col("account_id").alias("party_id"), F.col("day").alias("posted_date"), "amount")
    return risk.near_threshold(e, 10, 80, 7, 3)


def r04_rapid_in_out(spark: SparkSession, d: str) -> DataFrame:
    e = activity(spark, d)
    ins = e.where("event_type = 'purchase' AND amount >= 100").select("account_id", "txn_id", "at", "amount", "value")
    outs = e.where("event_type IN ('click', 'error')").select("account_id", "at", "amount")
    # an id may stand at several times: the SQL's groups are those of account, id and value
    return risk.rapid_in_out(ins, outs, 48, 0.9, by=["account_id", "txn_id", "value", "amount"]).select("account_id", "txn_id", "amount", "out_total", "n_out")


def r05_woken(spark: SparkSession, d: str) -> DataFrame:
    return risk.woken_accounts(activity(spark, d).select("account_id", "day", "amount"), 3, 5)


def _expected(spark, d):
    txn = transactions(spark, d)
    month = txn.groupBy("party_id", F.trunc("posted_date", "MM").alias("m")).agg(F.sum("amount").alias("total"))
    day = txn.groupBy("party_id", "posted_date").agg(F.sum("amount").alias("total"))
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("party_id"), cents(F.abs("c_acctbal") * 40).alias("expected"))
    return risk.expected_ratio(risk.best_window(month, day), expected, 3, 10000)


def r06_r07_expected(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d).select("party_id", F.col("best").cast("decimal(38,2)").alias("best"), "kind")


def r08_inconsistent(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).where("amount > 400000").select("party_id", "core", F.col("txn_type").alias("occupation"))
    return risk.inconsistent_profiles(t)


def _signals(spark, d):
    month = r02_combined_month(spark, d)
    year = _cash(spark, d, 365)
    exp = _expected(spark, d)
    said = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    fired = [
        ("CASH_365D", year.select("party_id", F.col("total").alias("amount"), said("total ", "total").alias("evidence"))),
        ("COMBINED_MONTH", month.select("party_id", "amount", said("months ", "days").alias("evidence"))),
        ("MISMATCH", exp.where("kind = 'MISMATCH'").select("party_id", F.col("best").alias("amount"), F.lit("above expected").alias("evidence"))),
        ("CONSISTENT", exp.where("kind = 'CONSISTENT'").select("party_id", F.col("best").alias("amount"), F.lit("as expected").alias("evidence"))),
    ]
    return risk.signals(fired, spark.createDataFrame(WEIGHTS, "rule_code string, weight double"))


def r09_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d)


def r10_scores(spark: SparkSession, d: str) -> DataFrame:
    return risk.scores(_signals(spark, d))


def r11_queue(spark: SparkSession, d: str) -> DataFrame:
    legacy = transactions(spark, d).where("status = 'IN_PROGRESS' AND amount > 380000").select(F.concat(F.lit("AL-"), F.col("txn_id").cast("string")).alias("alert_id"), "party_id", (F.col("txn_id") % 100).cast("double").alias("legacy_score"))
    return risk.queue(legacy, risk.scores(_signals(spark, d)), 0.6, 30)


def r12_golden(spark: SparkSession, d: str) -> DataFrame:
    """(question, metric, value as text) rows."""
    t, c = transactions(spark, d), table(spark, d, "customer")
    rows = lambda df, q, m: df.select(F.lit(q).alias("question"), F.lit(m).alias("metric"), F.col("v").cast("string").alias("value"))
    parts = [
        rows(c.agg(F.count("*").alias("v")), "G01", "customers"), rows(t.agg(F.countDistinct("party_id").alias("v")), "G02", "active_parties"),
        rows(t.where("txn_type = 'CASH_DEPOSIT'").agg(F.sum("amount").cast("decimal(38,2)").alias("v")), "G07", "cash_in"),
        rows(t.agg(F.count_if(F.col("status") == "OPEN").alias("v")), "G03", "open"), rows(t.agg(F.max("posted_date").alias("v")), "G00", "as_of"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def r13_customer_view(spark: SparkSession, d: str) -> DataFrame:
    """Drill-down of the customers seen in both cores: totals by core."""
    t = transactions(spark, d)
    two = t.groupBy("party_id").agg(F.countDistinct("core").alias("cores")).where("cores = 2")
    return t.join(two, "party_id", "left_semi").groupBy("party_id", "core").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"), F.max("posted_date").alias("last_date"))


def r14_rule_recall(spark: SparkSession, d: str) -> DataFrame:
    """For parties expected to fire, the share that did, by rule."""
    expected = _cash(spark, d, 180).select("party_id", F.explode(F.split(F.lit("CASH_365D;COMBINED_MONTH"), ";")).alias("rule_code"))
    fired = _signals(spark, d).select("party_id", "rule_code", F.lit(1).alias("hit"))
    return expected.join(fired, ["party_id", "rule_code"], "left").groupBy("rule_code").agg(F.count("*").alias("expected"), F.count("hit").alias("fired"))


def h09_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))
    return scored_pairs(pairs, "a", "b", "jw")


#: Names up to which every two are scored ahead and sent to all executors (its square of rows, at most).
NAMES = 1000


def _matched() -> Column:
    return (F.col("jw") >= 88) | (F.col("edits") <= 1)


def _scored_names(names: DataFrame) -> DataFrame:
    """an, bn with their similarity and edit distance."""
    return scored_pairs(names, "an", "bn", "jw").withColumn("edits", F.levenshtein("an", "bn"))


def _similar(p: DataFrame) -> DataFrame:
    """an, bn, jw of names that stand in one block and match, a name with itself included. Either order has its
    own row: Jaro's greedy matching need not give one score for both."""
    n = p.select("p_brand", "p_size", "p_name").distinct()
    m = n.select(F.col("p_brand").alias("b_p_brand"), F.col("p_size").alias("b_p_size"), F.col("p_name").alias("bn"))
    met = n.join(m, (F.col("p_brand") == F.col("b_p_brand")) & (F.col("p_size") == F.col("b_p_size")))
    scored = _scored_names(met.select(F.col("p_name").alias("an"), "bn").distinct())
    return scored.where(_matched()).select("an", "bn", "jw")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that can be in a pair that matches: with a key, a brand, a size and a name."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    return p.dropna(subset=["p_partkey", "p_name", "p_brand", "p_size"])


CLASS = ["p_brand", "p_size", "p_type", "p_name"]


def _same_class(a: DataFrame, b: DataFrame, name: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[c] == b[c] for c in CLASS[:3]] + [a[name] == b["p_name"]])


def i04_i09_match(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a block with its similarity, score and decision.

    The result is all pairs, so its size grows with the square of a block. The rows of a block are dealt to tasks;
    names are scored once each two where they are few, else pair by pair, and no pair is shuffled.
    """
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type").where("p_partkey IS NOT NULL")
    names = [r[0] for r in p.where("p_name IS NOT NULL").select("p_name").distinct().limit(NAMES + 1).collect()]
    if len(names) <= NAMES:
        # whole numbers for names: a lookup by one long for each pair, in place of two strings
        ids = spark.createDataFrame(list(enumerate(names)), "id long, name string")
        rows = p.join(F.broadcast(ids), F.col("p_name") == F.col("name"), "left").select("p_partkey", "p_brand", "p_size", "p_type", "id")
        scored = _scored_names(ids.toDF("ai", "an").crossJoin(ids.toDF("bi", "bn")).repartition(8)).select((F.col("ai") * NAMES + F.col("bi")).alias("two"), "jw", "edits")
        pairs = block_pairs(rows, rows, ["p_brand", "p_size"])
        pairs = pairs.join(F.broadcast(scored), F.col("id") * NAMES + F.col("b_id") == F.col("two"), "left")
    else:
        pairs = scored_pairs(block_pairs(p, p, ["p_brand", "p_size"]), "p_name", "b_p_name", "jw").withColumn("edits", F.levenshtein("p_name", "b_p_name"))
        pairs = pairs.withColumn("jw", F.when(F.col("edits").isNotNull(), F.col("jw")))  # of a name that is null, null
    name, kind = _matched(), F.col("p_type") == F.col("b_p_type")
    return pairs.select(
        F.col("p_partkey").alias("a_key"), F.col("b_p_partkey").alias("b_key"), "jw", "edits", (F.when(name, 60).otherwise(0) + F.when(kind, 40).otherwise(0)).alias("score"),
        F.when(name & kind, "AUTO_LINK").when(name, "REVIEW").otherwise("REJECT").alias("decision"),
        F.when(name & kind, "NAME;TYPE").when(name, "NAME").when(kind, "TYPE").otherwise("").alias("reasons"),
    )


def i10_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    """Automatic links that are the best of both their keys; all have one score, so jw decides, then the smaller key.

    A class holds the rows of one block, type and name. Of a class, the best for a larger key is always the one with
    the smallest key, so a row is compared with one row of each class that matches its own, not with all its rows.
    """
    p = _parts(spark, d).dropna(subset=["p_type"])
    least = p.groupBy(*CLASS).agg(F.min("p_partkey").alias("a_key")).select("a_key").distinct()
    first = p.withColumnRenamed("p_partkey", "a_key").join(least, "a_key", "left_semi").distinct()
    side = first.join(_similar(p), F.col("p_name") == F.col("an")).select("a_key", "p_brand", "p_size", "p_type", "bn", "jw")
    rows = p.withColumnRenamed("p_partkey", "b_key")
    met = side.join(rows, _same_class(side, rows, "bn") & (F.col("a_key") < F.col("b_key"))).select("a_key", "b_key", (-F.col("jw")).alias("worse"))
    best_a = met.groupBy("b_key").agg(F.min(F.struct("worse", "a_key"))["a_key"].alias("a_key"))
    best_b = met.groupBy("a_key").agg(F.min(F.struct("worse", "b_key"))["b_key"].alias("b_key"))
    return best_b.join(best_a, ["a_key", "b_key"]).select("a_key", "b_key")


def i11_party_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", party_key(F.concat(F.lit("core_a:"), F.col("c_custkey").cast("string"))).alias("party_id"))


def i12_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to review of which the one key is no automatic link's first and the other none's second.

    A key is some link's first if a class that matches its own holds a larger key, so classes tell by their largest
    and smallest keys which rows are open, before any two rows are joined.
    """
    p, similar = _parts(spark, d), _similar(_parts(spark, d))
    ends = p.dropna(subset=["p_type"]).groupBy(*CLASS).agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    block = ["p_brand", "p_size", "p_type"]

    def open_rows(mine: str, other: str, bound: Column, linked: Column) -> DataFrame:
        met = ends.join(similar, F.col("p_name") == F.col(other)).groupBy(*block, F.col(mine).alias("p_name")).agg(bound.alias("bound"))
        marked = p.join(met, CLASS, "left").withColumn("linked", F.coalesce(linked, F.lit(False)))
        return marked.where(~F.col("linked")).join(marked.where("linked").select("p_partkey"), "p_partkey", "left_anti").drop("bound", "linked")

    a = open_rows("an", "bn", F.max("high"), F.col("p_partkey") < F.col("bound")).join(similar, F.col("p_name") == F.col("an")).drop("p_name")
    b = open_rows("bn", "an", F.min("low"), F.col("p_partkey") > F.col("bound"))
    b = b.select(*[F.col(c).alias("b_" + c) for c in b.columns])
    met = (F.col("p_brand") == F.col("b_p_brand")) & (F.col("p_size") == F.col("b_p_size")) & (F.col("bn") == F.col("b_p_name")) & (F.col("p_partkey") < F.col("b_p_partkey"))
    pairs = a.join(b, met & ~F.coalesce(F.col("p_type") == F.col("b_p_type"), F.lit(False)))
    return pairs.select(F.col("p_partkey").alias("a_key"), F.col("b_p_partkey").alias("b_key"), F.lit(60).alias("score"))


def i13_dq_rules(spark: SparkSession, d: str) -> DataFrame:
    row = lambda df, rule, sev, key, val: df.select(F.lit(rule).alias("rule_id"), F.lit(sev).alias("severity"), F.col(key).cast("string").alias("record_key"), val.cast("string").alias("observed"))
    dup = table(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    lone = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    low = table(spark, d, "customer").where("c_acctbal < 0")
    out = row(dup, "DQ_DUPLICATE_KEY", "CRITICAL", "k", F.concat(F.col("n").cast("string"), F.lit(" rows")))
    out = out.unionByName(row(lone, "DQ_NO_LABEL", "WARNING", "doc_id", F.col("lang")))
    return out.unionByName(row(low, "DQ_NEGATIVE_BALANCE", "WARNING", "c_custkey", cents(F.col("c_acctbal"))))


def _inner_pairs(p: DataFrame, keys: list[str]) -> DataFrame:
    """v: pairs of rows of one group with different p_partkey."""
    per = p.groupBy(*keys, "p_partkey").agg(F.count("*").alias("m"))
    n = per.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.expr("m * (m - 1) div 2")).alias("same"))
    return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2 - same")), F.lit(0)).alias("v"))


def i14_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Links found against a truth table: pairs of one name and type.

    Pairs are counted by the sizes of classes (the rows of one block, type and name), less pairs of equal keys; only
    where two names match in one order alone are rows joined.
    """
    p = _parts(spark, d)
    typed, similar = p.dropna(subset=["p_type"]), _similar(p).where("an <> bn")
    back = similar.select(F.col("bn").alias("an"), F.col("an").alias("bn"), F.lit(True).alias("both"))
    similar = similar.join(back, ["an", "bn"], "left")
    both, one = similar.where("both AND an < bn").select("an", "bn"), similar.where("both IS NULL").select("an", "bn")

    def across(left: DataFrame, right: DataFrame, names: DataFrame, value: Column, met: Column | None = None) -> DataFrame:
        """v: the sum of a value over what joins of two classes with names that match."""
        a = left.select(*[F.col(c).alias("a_" + c) for c in left.columns]).join(names, F.col("a_p_name") == F.col("an"))
        b = right.select(*[F.col(c).alias("b_" + c) for c in right.columns])
        on = functools.reduce(lambda x, y: x & y, [F.col("a_" + c) == F.col("b_" + c) for c in CLASS[:3]], F.col("bn") == F.col("b_p_name"))
        return a.join(b, on if met is None else on & met).agg(F.coalesce(F.sum(value), F.lit(0)).alias("v"))

    sizes = typed.groupBy(*CLASS).agg(F.count("*").alias("n"))
    keyed = typed.groupBy(*CLASS, "p_partkey").agg(F.count("*").alias("m"))
    shared = keyed.join(keyed.groupBy("p_partkey").count().where("count > 1").select("p_partkey"), "p_partkey", "left_semi")
    all_ = across(sizes, sizes, both, F.col("a_n") * F.col("b_n"))
    equal = across(shared, shared, both, F.col("a_m") * F.col("b_m"), F.col("a_p_partkey") == F.col("b_p_partkey"))
    ordered = across(typed, typed, one, F.lit(1), F.col("a_p_partkey") < F.col("b_p_partkey"))
    parts = {"true_pairs": _inner_pairs(p, ["p_brand", "p_size", "p_name"]), "correct": _inner_pairs(typed, CLASS), "all_": all_, "equal": equal, "ordered": ordered}
    counts = functools.reduce(DataFrame.crossJoin, [v.withColumnRenamed("v", k) for k, v in parts.items()])  # one row each
    linked = F.col("correct") + F.col("all_") - F.col("equal") + F.col("ordered")
    return counts.select("true_pairs", linked.alias("linked"), "correct", (F.col("true_pairs") - F.col("correct")).alias("in_review"))


def i15_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows and amounts loaded against control totals."""
    one = lambda name, col: table(spark, d, name).agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.sum(cents(F.col(col))).cast("decimal(38,2)").alias("amount"))
    got = one("orders", "o_totalprice").unionByName(one("customer", "c_acctbal")).unionByName(one("supplier", "s_acctbal"))
    want = spark.createDataFrame([("orders", 15000), ("customer", 1500), ("supplier", 99)], "file string, expected long")
    return got.join(want, "file", "left").select("file", "n", "amount", "expected", F.when(F.col("n") == F.col("expected"), "MATCH").otherwise("BREAK").alias("status"))


def k02_monthly(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.groupBy(F.trunc("posted_date", "MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OPEN").alias("n_open"), (F.count_if(F.col("status") == "CLOSED") / F.count("*")).alias("closed_share"))


def k03_cash_flow(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).where("txn_type IN ('CASH_DEPOSIT', 'WIRE_IN')")
    return t.groupBy("core", "txn_type").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count("*").alias("n"))


def k06_top_branches(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).join(table(spark, d, "customer"), F.col("party_id") == F.col("c_custkey"))
    return t.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")).orderBy(F.desc("n"), "c_nationkey").limit(3)


def l01_search_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(search_text(F.col("text"))).alias("h"))


def l04_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(search_text(F.col("text")).alias("s"))
    return s.agg(*[F.count_if(F.instr("s", f" {w}") > 0).alias(f"df_{w}") for w in ("the", "license", "und")])


def l06_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), ["the", "license", "und"], 20)


def l07_filtered_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), ["licens", "public"], 10, keep=F.col("lang") == "en")


def m01_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    spans = ["SMALL RING", "RED RING", "Customer#000000007"]
    return table(spark, d, "customer").where(F.upper("c_name").isin([s.upper() for s in spans])).select("c_custkey", "c_name").orderBy("c_custkey")


def n05_case_status(spark: SparkSession, d: str) -> DataFrame:
    """The latest decision of each case; cases without one are drafts."""
    e = table(spark, d, "events")
    last = e.where("event_type IN ('signup', 'error')").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))
    return e.select("user_id").distinct().join(last, "user_id", "left").select("user_id", F.coalesce(decode(F.col("decision"), {"signup": "APPROVED", "error": "REJECTED"}), F.lit("DRAFT")).alias("status"))


def o02_content_kinds(spark: SparkSession, d: str) -> DataFrame:
    a = profile.kind_shares(table(spark, d, "pages"), ["url"]).unionByName(profile.kind_shares(table(spark, d, "customer"), ["c_name", "c_custkey", "c_mktsegment"]))
    return a.unionByName(profile.kind_shares(table(spark, d, "nation"), ["n_name"])).unionByName(profile.kind_shares(table(spark, d, "events"), ["props"]))


def o06_link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return profile.overlap(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier"), "s_suppkey")


def o10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Generated checks of one table in one aggregate: rows, empty keys, repeated keys, values that don't parse."""
    p = table(spark, d, "pages")
    num = F.try_to_number(F.regexp_substr("url", F.lit("[0-9]{1,4}")), F.lit("9999"))
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("page_id").isNull()).alias("null_keys"), (F.count("*") - F.countDistinct("page_id")).alias("dup_keys"), F.count_if(num.isNull()).alias("not_parsed"))


_SIG = f"""(WITH t AS {_TXN}, y AS (SELECT party_id, sum(amount) AS amt FROM t WHERE posted_date > {_LAST} - 365 GROUP BY party_id HAVING count(DISTINCT core) >= 2 AND sum(amount) > 300000),
m AS (SELECT party_id, date_trunc('month', posted_date)::DATE AS m, sum(amount) AS total, count(DISTINCT core) AS cores, bool_or(ctr_filed) AS filed FROM t GROUP BY ALL),
mm AS (SELECT party_id, count(*) AS n, max(total) AS amt FROM m WHERE cores >= 2 AND total > 300000 AND NOT filed GROUP BY party_id),
b AS (SELECT party_id, max(total) AS best FROM (SELECT party_id, total FROM m UNION ALL SELECT party_id, sum(amount) FROM t GROUP BY party_id, posted_date) u GROUP BY party_id),
x AS (SELECT b.party_id, best, CASE WHEN best > 3 * e THEN 'MISMATCH' WHEN best <= 1.5 * e THEN 'CONSISTENT' END AS kind FROM b JOIN (SELECT c_custkey, CAST(abs(c_acctbal) * 40 AS DECIMAL(18,2)) AS e FROM customer) c ON c.c_custkey = b.party_id WHERE best > 10000)
SELECT party_id, 'CASH_365D' AS rule_code, CAST(amt AS DECIMAL(38,2)) AS amount, 'total ' || CAST(amt AS DECIMAL(38,2))::VARCHAR AS evidence, 35.0::DOUBLE AS weight FROM y
UNION ALL SELECT party_id, 'COMBINED_MONTH', CAST(amt AS DECIMAL(38,2)), 'months ' || n::VARCHAR, 30.0 FROM mm
UNION ALL SELECT party_id, kind, CAST(best AS DECIMAL(38,2)), CASE kind WHEN 'MISMATCH' THEN 'above expected' ELSE 'as expected' END, CASE kind WHEN 'MISMATCH' THEN 15.0 ELSE -20.0 END FROM x WHERE kind IS NOT NULL)"""
_SCORE = f"(SELECT party_id, sum(weight) AS raw_score, greatest(0.0::DOUBLE, least(100.0::DOUBLE, sum(weight))) AS score, string_agg(rule_code, '; ' ORDER BY rn) FILTER (rn <= 3 AND weight > 0) AS top_reasons, max(amount) AS max_amount, count(*) AS n_rules FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY weight DESC, rule_code) AS rn FROM {_SIG} g) s GROUP BY party_id)"
_PAIR = "(SELECT *, CASE WHEN nm AND ty THEN 'AUTO_LINK' WHEN nm THEN 'REVIEW' ELSE 'REJECT' END AS decision, CASE WHEN nm THEN 60 ELSE 0 END + CASE WHEN ty THEN 40 ELSE 0 END AS score FROM (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, a.p_name AS an, b.p_name AS bn, CAST(round(100 * jaro_winkler_similarity(a.p_name, b.p_name)) AS INTEGER) AS jw, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS edits, round(100 * jaro_winkler_similarity(a.p_name, b.p_name)) >= 88 OR levenshtein(a.p_name, b.p_name) <= 1 AS nm, a.p_type = b.p_type AS ty FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey) t)"
_ST = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9$]+', ' ', 'g')) || ' '"


def _bm25_sql(words: list[str], k: int, keep: str = "TRUE") -> str:
    df = ", ".join(f"count(*) FILTER (contains(s, ' {w}')) AS df{i}" for i, w in enumerate(words))
    tf = lambda w: f"((length(s) - length(replace(s, ' {w}', ''))) / {len(w) + 1}.0::DOUBLE)"
    one = lambda i, w: f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * {tf(w)} * 2.2::DOUBLE / ({tf(w)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(s) / mean))"
    hits = " + ".join(f"contains(s, ' {w}')::INTEGER" for w in words)
    return f"WITH d AS (SELECT doc_id, {keep} AS ok, {_ST} AS s FROM documents), st AS (SELECT count(*) AS n, avg(length(s)) FILTER (ok) AS mean, {df} FROM d) SELECT doc_id, {hits} AS hits, round({' + '.join(one(i, w) for i, w in enumerate(words))}, 4) AS score FROM d, st WHERE ok AND {hits} > 0 ORDER BY score DESC, doc_id LIMIT {k}"


def _kinds_sql() -> str:
    cols = [("pages", "url"), ("customer", "c_name"), ("customer", "c_custkey"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("events", "props")]
    rows = [f"SELECT '{c}' AS column_name, '{k}' AS kind, avg(regexp_full_match(trim({c}::VARCHAR), '{p.replace(chr(39), chr(39) * 2)}')::INTEGER::DOUBLE) AS share FROM {t} WHERE nullif(trim({c}::VARCHAR), '') IS NOT NULL" for t, c in cols for k, p in profile.KINDS.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) t WHERE share > 0"


ORACLE = {
    "j04_transaction": f"SELECT * FROM {_TXN} t",
    "j01_party": "SELECT c_custkey, 'PTY_' || left(md5('core_a:' || c_custkey::VARCHAR), 16) AS party_id, c_name, coalesce(n, 0) AS n_txn FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey",
    "r01_cross_core_window": f"SELECT party_id, count(DISTINCT core) AS cores, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total, min(posted_date) AS first_date, max(posted_date) AS last_date FROM {_TXN} t WHERE posted_date > {_LAST} - 90 GROUP BY party_id HAVING count(DISTINCT core) >= 2 AND sum(amount) > 300000",
    "r02_combined_month": f"SELECT party_id, count(*) AS days, CAST(max(total) AS DECIMAL(38,2)) AS amount, max_by(m, (total, m)) AS worst_day FROM (SELECT party_id, date_trunc('month', posted_date)::DATE AS m, count(DISTINCT core) AS cores, sum(amount) AS total, bool_or(ctr_filed) AS filed FROM {_TXN} t GROUP BY ALL) g WHERE cores >= 2 AND total > 300000 AND NOT filed GROUP BY party_id",
    "r03_near_threshold": "WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events WHERE event_type = 'purchase' AND CAST(value AS DECIMAL(18,2)) >= 10 AND CAST(value AS DECIMAL(18,2)) < 80), w AS (SELECT s.user_id, s.day, count(*) AS n, CAST(sum(b.v) AS DECIMAL(38,2)) AS total FROM (SELECT DISTINCT user_id, day FROM b) s JOIN b ON b.user_id = s.user_id AND b.day >= s.day AND b.day < s.day + 7 GROUP BY ALL) SELECT user_id AS party_id, n, total, day AS win_start FROM w WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, total DESC, day DESC) = 1",
    "r04_rapid_in_out": "SELECT i.user_id AS account_id, i.event_id AS txn_id, CAST(i.value AS DECIMAL(18,2)) AS amount, CAST(sum(CAST(o.value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS out_total, count(*) AS n_out FROM events i JOIN events o ON o.user_id = i.user_id AND date_diff('second', i.ts, o.ts) BETWEEN 1 AND 172800 WHERE i.event_type = 'purchase' AND CAST(i.value AS DECIMAL(18,2)) >= 100 AND o.event_type IN ('click', 'error') GROUP BY i.user_id, i.event_id, i.value HAVING sum(CAST(o.value AS DECIMAL(18,2))) >= CAST(i.value AS DECIMAL(18,2)) * 0.9",
    "r05_woken": "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events), b AS (SELECT user_id, day AS woke, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM (SELECT DISTINCT user_id, day FROM e) u) SELECT e.user_id AS account_id, woke, count(*) AS n, CAST(sum(v) AS DECIMAL(38,2)) AS inflow FROM b JOIN e ON e.user_id = b.user_id AND e.day BETWEEN woke AND woke + 5 WHERE woke - prev >= 3 GROUP BY ALL",
    "r06_r07_expected": f"SELECT party_id, amount AS best, rule_code AS kind FROM {_SIG} g WHERE rule_code IN ('MISMATCH', 'CONSISTENT')",
    "r08_inconsistent": f"SELECT party_id, count(DISTINCT core) AS cores, count(DISTINCT txn_type) AS occupations FROM {_TXN} t WHERE amount > 400000 GROUP BY party_id HAVING count(DISTINCT core) >= 2 AND count(DISTINCT txn_type) > 1",
    "r09_signals": f"SELECT * FROM {_SIG} g",
    "r10_scores": f"SELECT * FROM {_SCORE} s",
    "r11_queue": f"WITH s AS {_SCORE}, l AS (SELECT 'AL-' || txn_id::VARCHAR AS alert_id, party_id, (txn_id % 100)::DOUBLE AS legacy_score FROM {_TXN} t WHERE status = 'IN_PROGRESS' AND amount > 380000), q AS (SELECT alert_id AS item_id, l.party_id, 'LEGACY' AS origin, greatest(coalesce(score, 0), legacy_score * 0.6::DOUBLE)::DOUBLE AS priority, raw_score, max_amount, coalesce(top_reasons, 'LEGACY_ALERT') AS reasons FROM l LEFT JOIN s ON s.party_id = l.party_id UNION ALL SELECT 'ENG-' || party_id::VARCHAR, party_id, 'ENGINE', score, raw_score, max_amount, top_reasons FROM s WHERE score >= 30 AND party_id NOT IN (SELECT party_id FROM l)) SELECT *, row_number() OVER (ORDER BY priority DESC, raw_score DESC NULLS LAST, max_amount DESC NULLS LAST, item_id) AS queue_rank, count(*) OVER () AS queue_size FROM q",
    "r12_golden": f"WITH t AS {_TXN} SELECT 'G01' AS question, 'customers' AS metric, count(*)::VARCHAR AS value FROM customer UNION ALL SELECT 'G02', 'active_parties', count(DISTINCT party_id)::VARCHAR FROM t UNION ALL SELECT 'G07', 'cash_in', CAST(sum(amount) AS DECIMAL(38,2))::VARCHAR FROM t WHERE txn_type = 'CASH_DEPOSIT' UNION ALL SELECT 'G03', 'open', count(*) FILTER (status = 'OPEN')::VARCHAR FROM t UNION ALL SELECT 'G00', 'as_of', max(posted_date)::VARCHAR FROM t",
    "r13_customer_view": f"WITH t AS {_TXN} SELECT party_id, core, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total, max(posted_date) AS last_date FROM t WHERE party_id IN (SELECT party_id FROM t GROUP BY 1 HAVING count(DISTINCT core) = 2) GROUP BY party_id, core",
    "r14_rule_recall": f"WITH t AS {_TXN}, e AS (SELECT party_id FROM t WHERE posted_date > {_LAST} - 180 GROUP BY party_id HAVING count(DISTINCT core) >= 2 AND sum(amount) > 300000) SELECT r.rule_code, count(*) AS expected, count(g.party_id) AS fired FROM e CROSS JOIN (VALUES ('CASH_365D'), ('COMBINED_MONTH')) r(rule_code) LEFT JOIN {_SIG} g ON g.party_id = e.party_id AND g.rule_code = r.rule_code GROUP BY r.rule_code",
    "h09_jaro_winkler": "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, CAST(round(100 * jaro_winkler_similarity(a.p_name, b.p_name)) AS INTEGER) AS jw FROM n a JOIN n b ON left(a.p_name, 1) = left(b.p_name, 1) AND a.p_name < b.p_name",
    "i04_i09_match": f"SELECT a_key, b_key, jw, edits, score, decision, concat_ws(';', CASE WHEN nm THEN 'NAME' END, CASE WHEN ty THEN 'TYPE' END) AS reasons FROM {_PAIR} p",
    "i10_mutual_best": f"SELECT a_key, b_key FROM (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY score DESC, jw DESC, b_key) AS ra, row_number() OVER (PARTITION BY b_key ORDER BY score DESC, jw DESC, a_key) AS rb FROM {_PAIR} p WHERE decision = 'AUTO_LINK') q WHERE ra = 1 AND rb = 1",
    "i11_party_key": "SELECT c_custkey, 'PTY_' || left(md5('core_a:' || c_custkey::VARCHAR), 16) AS party_id FROM customer",
    "i12_review_queue": f"WITH p AS {_PAIR} SELECT a_key, b_key, score FROM p WHERE decision = 'REVIEW' AND a_key NOT IN (SELECT a_key FROM p WHERE decision = 'AUTO_LINK') AND b_key NOT IN (SELECT b_key FROM p WHERE decision = 'AUTO_LINK')",
    "i13_dq_rules": "SELECT 'DQ_DUPLICATE_KEY' AS rule_id, 'CRITICAL' AS severity, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS record_key, count(*)::VARCHAR || ' rows' AS observed FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'DQ_NO_LABEL', 'WARNING', doc_id::VARCHAR, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'DQ_NEGATIVE_BALANCE', 'WARNING', c_custkey::VARCHAR, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR FROM customer WHERE c_acctbal < 0",
    "i14_evaluation": f"SELECT count(*) FILTER (an = bn) AS true_pairs, count(*) FILTER (decision = 'AUTO_LINK') AS linked, count(*) FILTER (decision = 'AUTO_LINK' AND an = bn) AS correct, count(*) FILTER (decision = 'REVIEW' AND an = bn) AS in_review FROM {_PAIR} p",
    "i15_reconciliation": "WITH g AS (SELECT 'orders' AS file, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount, 15000::BIGINT AS expected FROM orders UNION ALL SELECT 'customer', count(*), CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)), 1500 FROM customer UNION ALL SELECT 'supplier', count(*), CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)), 99 FROM supplier) SELECT *, CASE WHEN n = expected THEN 'MATCH' ELSE 'BREAK' END AS status FROM g",
    "k02_monthly": f"SELECT date_trunc('month', posted_date)::DATE AS month, count(*) AS n, count(*) FILTER (status = 'OPEN') AS n_open, count(*) FILTER (status = 'CLOSED')::DOUBLE / count(*) AS closed_share FROM {_TXN} t GROUP BY 1",
    "k03_cash_flow": f"SELECT core, txn_type, CAST(sum(amount) AS DECIMAL(38,2)) AS total, count(*) AS n FROM {_TXN} t WHERE txn_type IN ('CASH_DEPOSIT', 'WIRE_IN') GROUP BY ALL",
    "k06_top_branches": f"SELECT c_nationkey, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM {_TXN} t JOIN customer ON c_custkey = party_id GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 3",
    "l01_search_text": f"SELECT doc_id, md5({_ST}) AS h FROM documents",
    "l04_document_frequency": f"SELECT count(*) FILTER (contains(s, ' the')) AS df_the, count(*) FILTER (contains(s, ' license')) AS df_license, count(*) FILTER (contains(s, ' und')) AS df_und FROM (SELECT {_ST} AS s FROM documents) t",
    "l06_bm25": _bm25_sql(["the", "license", "und"], 20),
    "l07_filtered_bm25": _bm25_sql(["licens", "public"], 10, "lang = 'en'"),
    "m01_name_lookup": "SELECT c_custkey, c_name FROM customer WHERE upper(c_name) IN ('SMALL RING', 'RED RING', 'CUSTOMER#000000007') ORDER BY c_custkey",
    "n05_case_status": "WITH l AS (SELECT user_id, event_type FROM events WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT u.user_id, coalesce(CASE event_type WHEN 'signup' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' END, 'DRAFT') AS status FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id",
    "o02_content_kinds": _kinds_sql(),
    "o06_link_discovery": "SELECT count(s.s_suppkey)::DOUBLE / count(*) AS overlap FROM (SELECT DISTINCT l_suppkey FROM lineitem) l LEFT JOIN (SELECT s_suppkey FROM supplier) s ON s.s_suppkey = l.l_suppkey",
    "o10_checks": "SELECT count(*) AS n, count(*) FILTER (page_id IS NULL) AS null_keys, count(*) - count(DISTINCT page_id) AS dup_keys, count(*) FILTER (NOT regexp_matches(url, '[0-9]')) AS not_parsed FROM pages",
}


def queries() -> dict:
    return {k: globals()[k] for k in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
