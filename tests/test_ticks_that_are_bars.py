"""Rows that are a tick and a bar each: dealt once, with the sums that ticks and bars apart have."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import market
from tidewater.plans import registry

ROW = "symbol string, timestamp long, price double, volume long, data_source string, event_id long"


def odd_rows(n=200):
    r = random.Random(5)
    at = lambda: r.choice([None, r.randrange(-40, 60), r.randrange(-4, 40) * 10])
    return [(r.choice(["A", "B", None]), at(), r.choice([None, -1.5, r.random() * 9]), r.choice([None, -3, r.randrange(50), 10 + i]), r.choice(["x", "y", None]), i) for i in range(n)]


@pytest.mark.parametrize("order", [("timestamp", "event_id"), ("event_id",)])
@pytest.mark.parametrize("span", [1, 2, None])
def test_as_with_ticks_apart(spark, order, span):
    rows = spark.createDataFrame(odd_rows(), ROW)
    as_sums = lambda df: sorted((*x[:2], None if x[2] is None else round(x[2], 5), *x[3:]) for x in map(tuple, df.collect()))
    apart = market.tick_bar_sums(rows.select("symbol", "timestamp", "price"), rows.drop("price"), 10, order, span)
    assert as_sums(market.tick_bar_sums(None, rows, 10, order, span)) == as_sums(apart)


def test_each_row_crosses_the_network_once(spark):
    """One row is dealt for each of T5's events (none of these lies at the end of a span), not a tick and a bar."""
    rows = spark.range(1000).selectExpr("'A' AS symbol", "id * 7 AS timestamp", "1.5D AS price", "id AS volume", "'x' AS data_source", "id AS event_id")
    got = market.tick_bar_vwap(None, rows, order=("timestamp", "event_id"))
    assert got.agg(F.sum("n_pairs")).first()[0] == sum(1 for i in range(1000) for j in range(max(0, i - 142), min(1000, i + 143)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Range (") == 2  # the rows, and the last bars of spans


def test_t5_reads_events_once_for_both(spark):
    plan = registry.QUERIES["T5_A3_unknown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_wide_rows_are_sorted_once_for_the_sums(spark, capsys):
    """Sums from the start of a bucket use the order that adding up equal times leaves."""
    rows = spark.createDataFrame(odd_rows(), ROW)
    market.pair_sums(rows, rows, 10).explain()
    plan = capsys.readouterr().out
    assert plan.count("Window") == 2 and plan.count("Sort [") == 2
