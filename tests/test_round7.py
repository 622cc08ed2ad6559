"""Cases of the seventh round: amounts with halves of a cent."""

from datetime import datetime, timedelta

from test_round3 import against_sql


def test_halves_of_a_cent_are_rounded_as_in_the_sql(spark, tmp_path):
    """1.005 is 100.49999999999999 cents as a double; its shortest form reads as 100.5."""
    halves = [1.005, 68.345, 163.345, 0.285, 2.675, 0.125, 99.995, 100.005, 147.675, 100.0]
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    rows = [(i, at(i), i % 5, ("purchase", "click", "error")[i % 3], halves[i * 7 % 10] + i // 10 % 3, "{}") for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for name in ("r04_rapid_in_out", "r03_near_threshold", "e12_rolling_window", "d08_argmax"):
        _, want = against_sql(spark, tmp_path / name, name, events=events)
        assert want
    customer = spark.createDataFrame([(i, (-1) ** i * (x + i), i % 3) for i, x in enumerate(halves * 4)], "c_custkey long, c_acctbal double, c_nationkey int")
    against_sql(spark, tmp_path / "i13", "i13_dq_rules", customer=customer, lineitem=spark.createDataFrame([(1, 1)], "l_orderkey long, l_linenumber int"), documents=spark.createDataFrame([(1, "en")], "doc_id long, lang string"), labels=spark.createDataFrame([(1,)], "doc_id long"))
