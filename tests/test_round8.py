"""Pairs of several blocking keys where keys are repeated."""

from pyspark.sql import functions as F
from test_round3 import against_sql, parts


def test_no_pairs_are_made_distinct(spark, tmp_path):
    rows = parts(spark, repeated=True)
    other = rows.where("p_partkey % 7 = 0").withColumns({"p_type": F.lit("LARGE"), "p_brand": F.lit("Brand#1")})
    df, want = against_sql(spark, tmp_path, "c14_union_of_blocks", part=rows.unionByName(rows).unionByName(other).unionByName(rows))
    assert len(want) > 1000
    top = df._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union" and all(top.children().apply(i).nodeName() != "Aggregate" for i in range(top.children().size()))


def test_large_blocks_are_dealt_to_salts(spark, tmp_path):
    from riskloom.plans.canonical import block_pairs

    p = parts(spark, repeated=True)
    pairs = [sorted(map(str, block_pairs(p, p, ["p_brand", "p_size"], n).select("p_partkey", "b_p_partkey").collect())) for n in (7, 10**6)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 1000
