"""The batch interval join: pairs against all pairs, and what crosses the network."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import market
from tidewater.plans import registry

ROWS = [(i, "AB"[i % 5 == 0], t) for i, t in enumerate([0, 0, 1, 9, 10, 11, 19, 20, 21, 30, 40, 41, 55, 70, 70, 79, 80, 81, 160, 161, -1, -10, -11, 5, 159, 170])] + [(90, None, 5), (91, "A", None), (92, None, None), (93, "A", 0)]


def near(a, b, width):
    return a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= width


@pytest.mark.parametrize("span", [1, 2, 16])
def test_pairs_are_all_pairs(spark, span):
    rows = spark.createDataFrame(ROWS, "id long, symbol string, timestamp long")
    want = sorted((a[0], a[1], a[2], b[0], b[2]) for a in ROWS for b in ROWS if near(a, b, 10))
    own = market.interval_join(rows, None, 10, span=span)
    assert own.columns == ["id", "symbol", "timestamp", "right_id", "right_timestamp"] and sorted(map(tuple, own.collect())) == want
    both = market.interval_join(rows, rows, 10, span=span, parts=3)
    assert both.columns == own.columns and sorted(map(tuple, both.collect())) == want
    other = rows.where("id % 3 > 0").select("symbol", "timestamp", F.col("id").alias("bar_id"))
    got = market.interval_join(rows.where("id % 2 = 0").select("timestamp", "id", "symbol"), other, 10, span=span)
    assert got.columns == ["timestamp", "id", "symbol", "right_timestamp", "bar_id"]
    assert sorted(map(tuple, got.collect())) == sorted((a[2], a[0], a[1], b[2], b[0]) for a in ROWS for b in ROWS if near(a, b, 10) and a[0] % 2 == 0 and b[0] % 3 > 0)


def test_events_are_dealt_once(spark):
    """One shuffle, and no join that sorts copies of its rows."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = registry.j2_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange ") == 1 and "Join" not in plan
