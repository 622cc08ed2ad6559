"""Relational core and scalar functions: one query an operator, with the SQL that checks it.

SQL holds queries whose text both engines read alike ({name} is a table); PAIRS has two texts where dialects
differ. Queries in the DataFrame API are functions with their SQL in ORACLE.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.text import full_match, reason_codes
from riskloom.plans.canonical import block_pairs, cents, table

SQL = {
    "b01_projection": "SELECT c_custkey, c_name, 'core_a' AS core, c_acctbal * 2 AS double_bal FROM {customer}",
    "b02_cte_chain": "WITH a AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amt FROM {orders}), b AS (SELECT o_custkey, CAST(sum(amt) AS DECIMAL(38,2)) AS total FROM a GROUP BY o_custkey), c AS (SELECT CAST(max(total) AS DECIMAL(38,2)) AS top FROM b) SELECT b.o_custkey, b.total FROM b CROSS JOIN c WHERE b.total * 2 > c.top",
    "b03_iff": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE 'CREDIT' END AS side FROM {customer}",
    "b04_case_no_else": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' END AS simple_case, CASE WHEN o_totalprice > 100000 THEN 'HIGH' WHEN o_totalprice > 50000 THEN 'MID' END AS searched_case FROM {orders}",
    "b06_predicates": "SELECT p_partkey, p_name FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_brand <> 'Brand#11' AND p_type IN (SELECT p_type FROM {part} WHERE p_size = 15) AND p_name LIKE '%ring%'",
    "b07_null_safe": "SELECT a.c_custkey, a.c_mktsegment IS NOT DISTINCT FROM NULLIF(a.c_mktsegment, 'BUILDING') AS same_seg FROM {customer} a",
    "b08_three_valued": "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY', FALSE) AS is_machinery FROM {customer}",
    "b09_coalesce_nullif": "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'NONE') AS seg FROM {customer}",
    "b10_boolean_projection": "SELECT s_suppkey, s_acctbal > 0 AS positive, s_nationkey = 3 OR s_acctbal < 0 AS flagged FROM {supplier}",
    "b11_clamp": "SELECT c_custkey, GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(5000 AS DOUBLE), c_acctbal)) AS clamped FROM {customer}",
    "b12_having": "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 50 AND max(l_quantity) >= 50",
    "b14_scalar_subquery": "SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM {orders}) AS share_of_max FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})",
    "b15_lateral_alias": "SELECT n_all, n_big, CAST(n_big AS DOUBLE) / n_all AS share FROM (SELECT (SELECT count(*) FROM {orders}) AS n_all, (SELECT count(*) FROM {orders} WHERE o_totalprice > 200000) AS n_big) t",
    "b17_date_literal": "SELECT o_orderkey FROM {orders} WHERE CAST(o_orderdate AS DATE) > DATE '2001-08-01' - 90",
    "b18_by_position": "SELECT n_regionkey, n_name, count(*) AS n FROM {nation} GROUP BY 1, 2 ORDER BY 1, 2",
    "c01_inner_join": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000",
    "c02_computed_key_join": "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND LEFT(a.p_name, 1) = LEFT(b.p_name, 1) AND a.p_partkey < b.p_partkey",
    "c03_left_join": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
    "c04_dictionary_both_ways": "SELECT n.n_nationkey, x.r_name AS forward_name, y.r_name AS backward_name FROM {nation} n LEFT JOIN {region} x ON x.r_regionkey = n.n_regionkey AND x.r_regionkey < n.n_nationkey LEFT JOIN {region} y ON y.r_regionkey = n.n_nationkey AND y.r_regionkey >= n.n_regionkey",
    "c06_not_exists": "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)",
    "c07_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)",
    "c08_semi_join": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')",
    "c13_multi_key_join": "SELECT l.l_orderkey, l.l_linenumber, count(*) AS n FROM {lineitem} l JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity > 45) q ON q.l_orderkey = l.l_orderkey AND q.l_linenumber = l.l_linenumber GROUP BY l.l_orderkey, l.l_linenumber",
    "c17_join_using": "SELECT doc_id, d.lang, l.quality FROM {documents} d JOIN {labels} l USING (doc_id)",
    "d01_aggregates": "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS n_cust, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS mean FROM {orders} GROUP BY o_orderstatus",
    "d02_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM {orders} GROUP BY o_orderstatus",
    "d03_conditional_sum": "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS big_total, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted FROM {lineitem} GROUP BY l_returnflag",
    "d04_any": "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_closed, max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS any_big FROM {orders} GROUP BY o_custkey",
    "d05_rows_to_columns": "SELECT max(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS asia, max(CASE WHEN r_name = 'EUROPE' THEN r_regionkey END) AS europe, max(CASE WHEN r_name = 'AFRICA' THEN r_regionkey END) AS africa FROM {region}",
    "d06_core_pivot": "SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS core_a_key, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END) AS core_b_key FROM {orders} GROUP BY o_custkey",
    "d10_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "d13_duplicate_count": "SELECT count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) AS extra_rows FROM {lineitem}",
    "d14_union_then_max": "SELECT k, max(v) AS best FROM (SELECT o_custkey AS k, o_totalprice AS v FROM {orders} UNION ALL SELECT c_custkey, c_acctbal FROM {customer}) t GROUP BY k",
    "f01_top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "f02_rank_filter": "SELECT c_custkey, c_nationkey, rn FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) t WHERE rn <= 3",
    "f03_nulls_last": "SELECT c_custkey, row_number() OVER (ORDER BY NULLIF(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) AS pos FROM {customer}",
    "f04_multi_key_order": "SELECT s_suppkey, s_nationkey, s_name FROM {supplier} ORDER BY s_nationkey, s_acctbal DESC, s_suppkey",
    "g01_union_all": "SELECT c_custkey AS k, 'C' AS kind FROM {customer} UNION ALL SELECT s_suppkey, 'S' FROM {supplier}",
    "g02_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "g03_intersect_except": "SELECT k, 'both' AS part FROM (SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) a UNION ALL SELECT k, 'only' FROM (SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) b",
    "h01_string_basics": "SELECT c_custkey, UPPER(c_mktsegment) AS up, LOWER(c_name) AS low, TRIM(CONCAT(' ', c_name, ' ')) AS bare, LEFT(c_name, 4) AS l4, RIGHT(c_name, 4) AS r4, LENGTH(c_name) AS n, REPLACE(c_name, '#', '-') AS rep FROM {customer}",
    "h03_split_part": "SELECT c_custkey, split_part(c_name, '#', 1) AS p1, split_part(c_name, '#', 2) AS p2, split_part(c_name, '#', 3) AS p3 FROM {customer}",
    "h08_concat": "SELECT n_nationkey, n_name || ':' || CAST(n_regionkey AS VARCHAR(10)) AS tag, n_name || NULLIF(n_name, n_name) AS gone, concat_ws('-', n_name, NULLIF('a', 'a'), 'x') AS ws FROM {nation}",
    "h16_date_arithmetic": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS plus30, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS minus7 FROM {orders}",
    "h18_casts": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS d_text, CAST(o_custkey AS INTEGER) AS i, CAST(o_totalprice AS DECIMAL(18,2)) AS m FROM {orders}",
    "h20_arithmetic": "SELECT c_custkey, ABS(CAST(c_acctbal AS DECIMAL(18,2))) AS mag, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END * CAST(c_acctbal AS DECIMAL(18,2)) AS flipped, ROUND(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS r1 FROM {customer}",
    "h22_count_text": "SELECT l_orderkey, CAST(count(*) AS VARCHAR(20)) || ' rows' AS seen FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 6",
    "e05_count_over": "SELECT r_regionkey, count(*) OVER () AS n FROM {region}",
    "e06_rank_of_aggregate": "SELECT n_regionkey, n, rn FROM (SELECT n_regionkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_regionkey) AS rn FROM {nation} GROUP BY n_regionkey) t",
}

PAIRS = {
    "a08_inline_values": ("SELECT o.o_orderstatus, v.meaning, count(*) AS n FROM {orders} o JOIN (VALUES ('F','CLOSED'),('O','OPEN'),('P','IN_PROGRESS')) AS v(code, meaning) ON v.code = o.o_orderstatus GROUP BY ALL", None),
    "b05_decode": ("SELECT o_orderkey, decode(o_orderstatus, 'F', 'CLOSED', 'O', 'OPEN', 'OTHER') AS st FROM {orders}", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END AS st FROM {orders}"),
    "d09_listagg": ("SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "h02_rtrim_chars": ("SELECT n_nationkey, trim(TRAILING ';' FROM concat(n_name, ';;')) AS bare FROM {nation}", "SELECT n_nationkey, rtrim(n_name || ';;', ';') AS bare FROM {nation}"),
    "h04_split_index": ("SELECT p_partkey, get(split(p_name, ' '), 0) AS w0, get(split(p_name, ' '), 7) AS w7 FROM {part}", "SELECT p_partkey, string_split(p_name, ' ')[1] AS w0, string_split(p_name, ' ')[8] AS w7 FROM {part}"),
    "h05_regexp_replace_all": ("SELECT c_custkey, regexp_replace(c_name, '[^0-9]+', '') AS digits FROM {customer}", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]+', '', 'g') AS digits FROM {customer}"),
    "h06_regexp_substr": ("SELECT page_id, regexp_substr(url, '[0-9]+') AS num FROM {pages}", "SELECT page_id, nullif(regexp_extract(url, '[0-9]+'), '') AS num FROM {pages}"),
    "h10_edit_distance": ("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, levenshtein(a.n_name, b.n_name) AS edits FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS edits FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "h11_hashes": ("SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM {customer}"),
    "h12_try_to_date": ("SELECT x, try_to_date(x, 'yyyyMMdd') AS d FROM VALUES ('20260131'), ('00000000'), ('20260231'), ('x') AS t(x)", "SELECT x, CAST(try_strptime(x, '%Y%m%d') AS DATE) AS d FROM (VALUES ('20260131'), ('00000000'), ('20260231'), ('x')) AS t(x)"),
    "h13_try_to_timestamp": ("SELECT x, CAST(try_to_timestamp(x, 'yyyyMMddHHmmss') AS TIMESTAMP_NTZ) AS ts FROM VALUES ('20260131235959'), ('20261331000000'), ('') AS t(x)", "SELECT x, try_strptime(x, '%Y%m%d%H%M%S') AS ts FROM (VALUES ('20260131235959'), ('20261331000000'), ('')) AS t(x)"),
    "h14_epoch": ("SELECT event_id, CAST(timestamp_seconds(1700000000 + event_id) AS DATE) AS d FROM {events}", "SELECT event_id, CAST(make_timestamp((1700000000 + event_id) * 1000000) AS DATE) AS d FROM {events}"),
    "h15_second_difference": ("SELECT user_id, unix_timestamp(CAST(max(ts) AS TIMESTAMP)) - unix_timestamp(CAST(min(ts) AS TIMESTAMP)) AS secs FROM {events} GROUP BY user_id", "SELECT user_id, date_diff('second', min(ts), max(ts)) AS secs FROM {events} GROUP BY user_id"),
    "h17_month": ("SELECT o_orderkey, trunc(CAST(o_orderdate AS DATE), 'MM') AS m FROM {orders}", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM {orders}"),
    "h19_try_to_number": ("SELECT x, try_cast(x AS DECIMAL(38,2)) AS n FROM VALUES ('12.345'), ('abc'), (''), ('-7') AS t(x)", "SELECT x, try_cast(x AS DECIMAL(38,2)) AS n FROM (VALUES ('12.345'), ('abc'), (''), ('-7')) AS t(x)"),
    "h23_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}"),
    "h25_number_format": ("SELECT c_custkey, format_number(CAST(c_acctbal AS DECIMAL(18,2)), 2) AS shown FROM {customer}", "SELECT c_custkey, format('{{:,.2f}}', CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE) AS shown FROM {customer}"),
    "h26_title_case": ("SELECT n_nationkey, initcap(lower(n_name)) AS shown FROM {nation} WHERE n_name NOT LIKE '% %'", "SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS shown FROM {nation} WHERE n_name NOT LIKE '% %'"),
    "d12_average_days": ("SELECT o_custkey, avg(datediff(DATE '2001-08-01', CAST(o_orderdate AS DATE))) AS mean_age FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, avg(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) AS mean_age FROM {orders} GROUP BY o_custkey"),
    "d11_ratio": ("SELECT l_returnflag, ROUND(100.0 * count_if(l_quantity > 25) / count(*), 2) AS pct FROM {lineitem} GROUP BY l_returnflag", None),
    "c15_explode_ordinal": ("SELECT p_partkey, CAST(pos AS BIGINT) AS pos, word FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) t AS pos, word", "SELECT p_partkey, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM {part}) t"),
}
PAIRS["a08_inline_values"] = (PAIRS["a08_inline_values"][0].replace("GROUP BY ALL", "GROUP BY o.o_orderstatus, v.meaning"),) * 2
PAIRS["d11_ratio"] = ("SELECT l_returnflag, CAST(count_if(l_quantity > 25) AS DOUBLE) / count(*) AS share FROM {lineitem} GROUP BY l_returnflag",) * 2
#: DuckDB names a table as it is; format() patterns keep their braces
_PLAIN = re.compile(r"\{(\w+)\}")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables its {names} stand for; nothing is registered in the session."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(_PLAIN.findall(text))})


def c05_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def c09_parameter_literal(spark: SparkSession, d: str) -> DataFrame:
    """A one-row parameter is read once and bound as a literal, so the filter reaches the scan."""
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice")).first()[0]
    return o.where(F.col("o_totalprice") > top * 0.9).select("o_orderkey", "o_totalprice")


def c14_union_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs that share one of several blocking keys.

    Rows that agree in all columns used are one. A pair comes up in its first block only: the second kind leaves out
    what the first gives, and of keys with several rows the pair's smallest common block counts. So no pairs are made distinct.
    """
    kinds = (["p_brand", "p_size"], ["p_type", "p_size"])
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type").where("p_partkey IS NOT NULL").distinct()
    twice = p.groupBy("p_partkey").count().where("count > 1").select("p_partkey")
    once, again = p.join(twice, "p_partkey", "left_anti"), p.join(twice, "p_partkey", "left_semi")
    named = lambda df: df.select(F.col("p_partkey").alias("a_key"), F.col("b_p_partkey").alias("b_key"))

    first = block_pairs(once, once, kinds[0])
    second = block_pairs(once, once, kinds[1]).where(~F.coalesce(F.col("p_brand") == F.col("b_p_brand"), F.lit(False)))

    def block(k: list[str]) -> Column:
        return F.when(F.col(k[0]).isNotNull() & F.col(k[1]).isNotNull(), F.struct(*k))

    held = ["_b0", "_b1"]  # blocks of a key, of both kinds
    sets = again.groupBy("p_partkey").agg(*(F.collect_set(block(k)).alias(c) for k, c in zip(kinds, held)))
    several = again.join(sets, "p_partkey")
    single = once.select("*", *(F.array_compact(F.array(block(k))).alias(c) for k, c in zip(kinds, held)))
    common = [F.array_intersect(c, "b_" + c) for c in held]

    def blocks(a: DataFrame, b: DataFrame) -> DataFrame:
        out = []
        for i, k in enumerate(kinds):
            x, y = (df.select("p_partkey", *k, *held).dropDuplicates(["p_partkey", *k]) for df in (a, b))
            here = F.array_min(common[i]) == F.struct(*k)
            out.append(named(block_pairs(x, y, k).where(here & (F.size(common[0]) == 0) if i else here)))
        return out[0].unionByName(out[1])

    return named(first).unionByName(named(second)).unionByName(blocks(several, several.unionByName(single))).unionByName(blocks(single, several))


def c16_value_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a column's distinct values that are keys of a parent."""
    child = table(spark, d, "orders").select(F.col("o_custkey").alias("v")).distinct()
    parent = table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.lit(1).alias("hit")).distinct()
    return child.join(parent, "v", "left").agg((F.count("hit") / F.count("*")).alias("overlap"))


def c18_latest_row(spark: SparkSession, d: str) -> DataFrame:
    last = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    newest = table(spark, d, "orders").withColumn("rn", F.row_number().over(last)).where("rn = 1").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return table(spark, d, "customer").select("c_custkey").join(newest, "c_custkey", "left")


def b13_qualify(spark: SparkSession, d: str) -> DataFrame:
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(one)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def b16_bound_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Values go in as parameters, never into the text."""
    return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_name = :name OR c_mktsegment = :seg", args={"name": "Customer#000000001", "seg": "O'Brien; --"}, customer=table(spark, d, "customer"))


def d07_min_by(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("first_name"))


def d08_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The day with the most events, then the largest total, then the latest."""
    day = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("total"))
    return day.groupBy("user_id").agg(F.max_by("day", F.struct("n", "total", "day")).alias("best_day"), F.max("n").alias("n"))


def d15_evidence_sentence(spark: SparkSession, d: str) -> DataFrame:
    top = F.max(cents(F.col("o_totalprice")))
    said = F.concat(F.count("*").cast("string"), F.lit(" orders, largest $"), F.round(top, 0).cast("bigint").cast("string"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(said.alias("evidence"))


def d16_pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return wide.select("user_id", *[F.coalesce(k, F.lit(0)).alias("n_" + k) for k in kinds])


def e02_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are the best for both sides, by two windows."""
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(cents(F.col("l_quantity"))).alias("qty"))
    s = Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey")
    p = Window.partitionBy("l_partkey").orderBy(F.desc("qty"), "l_suppkey")
    return pairs.withColumns({"ra": F.row_number().over(s), "rb": F.row_number().over(p)}).where("ra = 1 AND rb = 1").select("l_suppkey", "l_partkey", F.col("qty").cast("decimal(38,2)").alias("qty"))


def e04_global_rank(spark: SparkSession, d: str) -> DataFrame:
    order = Window.orderBy(F.desc("s_acctbal"), F.desc_nulls_last("s_nationkey"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(order).alias("queue_rank"))


def e07_corpus_average(spark: SparkSession, d: str) -> DataFrame:
    """The corpus average is a one-row aggregate bound as a literal, not an unpartitioned window."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("len"))
    total = docs.agg(F.sum("len").alias("s"), F.count("len").alias("n")).first()
    return docs.select("doc_id", (F.col("len") / F.lit(total["s"] / total["n"])).alias("rel_len"))


def e08_latest_decision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def e09_ingestion_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy("n_nationkey")).alias("source_row"))


def e10_running_total(spark: SparkSession, d: str) -> DataFrame:
    """Running total by core over a dense grid of months."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 2).alias("core"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), cents(F.col("o_totalprice")).alias("amt"))
    span = o.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).withColumn("core", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    per = grid.join(o.groupBy("core", "month").agg(F.sum("amt").alias("amt")), ["core", "month"], "left")
    run = Window.partitionBy("core").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("core", "month", F.sum(F.coalesce("amt", F.lit(0).cast("decimal(28,2)"))).over(run).cast("decimal(38,2)").alias("running"))


def e11_rank_and_share(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return per.select("c_mktsegment", "n", F.rank().over(Window.orderBy(F.desc("n"))).alias("rk"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def e12_rolling_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.unix_date(F.col("ts").cast("date")).alias("day"), cents(F.col("value")).alias("v"), "event_id")
    back = Window.partitionBy("user_id").orderBy("day").rangeBetween(-6, 0)
    return e.select("event_id", F.count("*").over(back).alias("n7"), F.sum("v").over(back).cast("decimal(38,2)").alias("s7"), F.max("v").over(back).alias("m7"))


def e03_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    top = w.withColumn("rn", F.row_number().over(rank)).where("rn <= 3")
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]), "; ").alias("top3"))


def h07_full_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", full_match(F.col("c_name"), "Customer#[0-9]{9}").alias("whole"), full_match(F.col("c_name"), "[0-9]{9}").alias("part"))


def h21_bound_as_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.datediff(F.lit("2001-08-31").cast("date"), F.col("o_orderdate").cast("date")).alias("age_days"))


def i09_reason_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", reason_codes([(F.col("c_acctbal") < 0, "NEGATIVE"), (F.col("c_acctbal") > 9000, "RICH"), (F.col("c_nationkey") < 5, "NEAR")]).alias("reasons"))


ORACLE = {
    "c05_anti_join": "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL",
    "c09_parameter_literal": "SELECT o_orderkey, o_totalprice FROM orders, (SELECT max(o_totalprice) AS m FROM orders) p WHERE o_totalprice > m * 0.9::DOUBLE",
    "c14_union_of_blocks": "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey",
    "c16_value_overlap": "SELECT count(c.c_custkey)::DOUBLE / count(*) AS overlap FROM (SELECT DISTINCT o_custkey AS v FROM orders) o LEFT JOIN (SELECT c_custkey FROM customer) c ON c.c_custkey = o.v",
    "c18_latest_row": "SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o.o_custkey = c.c_custkey AND o.rn = 1",
    "b13_qualify": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) = 1",
    "b16_bound_parameters": "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000001'",
    "d07_min_by": "SELECT s_nationkey, min_by(s_name, s_suppkey) AS first_name FROM supplier GROUP BY s_nationkey",
    "d08_argmax": "SELECT user_id, day AS best_day, n FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, sum(CAST(value AS DECIMAL(18,2))) DESC, CAST(ts AS DATE) DESC) AS rn FROM events GROUP BY user_id, CAST(ts AS DATE)) t WHERE rn = 1",
    "d15_evidence_sentence": "SELECT o_custkey, count(*)::VARCHAR || ' orders, largest $' || CAST(round(max(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS BIGINT)::VARCHAR AS evidence FROM orders GROUP BY o_custkey",
    "d16_pivot_counts": "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY user_id",
    "e02_mutual_best": "SELECT l_suppkey, l_partkey, CAST(qty AS DECIMAL(38,2)) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS ra, row_number() OVER (PARTITION BY l_partkey ORDER BY qty DESC, l_suppkey) AS rb FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY ALL) p) q WHERE ra = 1 AND rb = 1",
    "e04_global_rank": "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_nationkey DESC NULLS LAST, s_suppkey) AS queue_rank FROM supplier",
    "e07_corpus_average": "SELECT doc_id, length(text)::DOUBLE / (SELECT sum(length(text))::DOUBLE / count(text) FROM documents) AS rel_len FROM documents",
    "e08_latest_decision": "SELECT user_id, event_type AS last_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "e09_ingestion_order": "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS source_row FROM nation",
    "e10_running_total": "SELECT g.core, g.month, CAST(sum(coalesce(p.amt, 0)) OVER (PARTITION BY g.core ORDER BY g.month ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running FROM (SELECT CAST(m AS DATE) AS month, core FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders) s, (VALUES (0::BIGINT), (1::BIGINT)) v(core)) g LEFT JOIN (SELECT o_orderkey % 2 AS core, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amt FROM orders GROUP BY ALL) p ON p.core = g.core AND p.month = g.month",
    "e11_rank_and_share": "SELECT c_mktsegment, n, rank() OVER (ORDER BY n DESC) AS rk, n::DOUBLE / sum(n) OVER () AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) t",
    "e12_rolling_window": "SELECT event_id, count(*) OVER w AS n7, CAST(sum(v) OVER w AS DECIMAL(38,2)) AS s7, max(v) OVER w AS m7 FROM (SELECT event_id, user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events) t WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "e03_top_reasons": "SELECT user_id, string_agg(event_type, '; ' ORDER BY rn) AS top3 FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) t WHERE rn <= 3 GROUP BY user_id",
    "h07_full_match": "SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS whole, regexp_full_match(c_name, '[0-9]{9}') AS part FROM customer",
    "h21_bound_as_of": "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-31') AS INTEGER) AS age_days FROM orders",
    "i09_reason_codes": "SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_acctbal > 9000 THEN 'RICH' END, CASE WHEN c_nationkey < 5 THEN 'NEAR' END) AS reasons FROM customer",
}


def queries() -> dict:
    texts = SQL | {k: v[0] for k, v in PAIRS.items()}
    out = {k: functools.partial(lambda spark, d, t: run_sql(spark, d, t), t=t) for k, t in texts.items()}
    return out | {k: globals()[k] for k in ORACLE}


def oracle_sql() -> dict[str, str]:
    texts = SQL | {k: v[1] for k, v in PAIRS.items()}
    return {k: _PLAIN.sub(r"\1", t).replace("{{", "{").replace("}}", "}") for k, t in texts.items()} | ORACLE
