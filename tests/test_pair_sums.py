"""Sums over the pairs of an interval join, without the pairs, against the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import market

TICK, BAR = "symbol string, timestamp long, price double", "symbol string, timestamp long, volume long, data_source string"


def odd_rows(seed, n=150):
    """Times before 1970, at the ends of buckets, equal and missing; prices and volumes that are missing or below 0, and no symbols."""
    r = random.Random(seed)
    at = lambda: r.choice([None, r.randrange(-40, 60), r.randrange(-4, 6) * 10])
    ticks = [(r.choice(["A", "B", None]), at(), r.choice([None, -1.5, 0.0, r.random() * 9, 1 / 3])) for _ in range(n)]
    bars = [(r.choice(["A", "B", None]), at(), r.choice([None, -3, 0, r.randrange(50)]), r.choice(["x", "y", "z", None])) for _ in range(n)]
    return ticks, bars


def as_rows(df):
    return sorted((r["symbol"], r["window_end"], None if r["vwap"] is None else round(r["vwap"], 5), r["n_pairs"], r["data_source"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_sums_of_pairs(spark, seed):
    ticks, bars = odd_rows(seed)
    ticks, bars = spark.createDataFrame(ticks, TICK), spark.createDataFrame(bars, BAR)
    pairs = market.interval_join(ticks, bars, 10).withColumn("ts", F.greatest("timestamp", "right_timestamp"))
    for window in (1, 7, 1000):
        assert as_rows(market.vwap(market.pair_sums(ticks, bars, 10), window)) == as_rows(market.vwap(pairs, window))


@pytest.mark.parametrize("span", [1, 3, 16])
def test_spans_change_no_sum(spark, span):
    """Rows at the ends of spans, and before 1970, meet those of the span before."""
    ticks, bars = odd_rows(7)
    ticks, bars = spark.createDataFrame(ticks, TICK), spark.createDataFrame(bars, BAR)
    pairs = market.interval_join(ticks, bars, 10).withColumn("ts", F.greatest("timestamp", "right_timestamp"))
    assert as_rows(market.vwap(market.pair_sums(ticks, bars, 10, span=span), 1)) == as_rows(market.vwap(pairs, 1))


def test_one_row_for_each_time(spark):
    """Rows of equal time are added up before they are copied to two buckets, and rows cross the network once but at the ends of spans."""
    rows = spark.range(3000).selectExpr("'A' AS symbol", "id % 2 * 5 AS timestamp", "2.0D AS price", "1L AS volume", "cast(id % 4 AS string) AS data_source")
    got = market.pair_sums(rows, rows, 10)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert sorted(map(tuple, got.collect())) == [("A", 0, 4_500_000.0, 2_250_000, 2_250_000, "2"), ("A", 5, 13_500_000.0, 6_750_000, 6_750_000, "3")]


def test_no_number_spoils_only_its_own_pairs(spark):
    ticks = spark.createDataFrame([("A", 1, float("nan")), ("A", 12, 2.0), ("A", 25, 3.0)], TICK)
    bars = spark.createDataFrame([("A", 2, 5, "x"), ("A", 14, 1, "y"), ("A", 26, 2, None)], BAR)
    got = {r["ts"]: (r["weighted"], r["volume"], r["n_pairs"], r["data_source"]) for r in market.pair_sums(ticks, bars, 10).collect()}
    assert str(got.pop(2)) == "(nan, 5, 1, 'x')"
    assert got == {12: (10.0, 5, 1, "x"), 14: (2.0, 1, 1, "y"), 26: (6.0, 2, 1, None)}


def test_no_join_makes_the_pairs(spark, capsys):
    """All rows at one time: the pairs would be the square of the rows, and no operator of the plan makes them."""
    rows = spark.range(3000).selectExpr("'A' AS symbol", "1000L AS timestamp", "id AS event_id", "cast(1 AS double) AS price", "1L AS volume", "'x' AS data_source")
    got = market.tick_bar_vwap(rows.select("symbol", "timestamp", "price"), rows, order=("timestamp", "event_id"))
    got.explain()
    assert "right_timestamp" not in capsys.readouterr().out
    assert got.first()["n_pairs"] == 9_000_000


@pytest.mark.parametrize("span", [1, 2, 5, None])
def test_volumes_made_where_pairs_are_summed(spark, span):
    """Equal times, long gaps, volumes that fall, are missing or below 0: as with per-bar volume made first."""
    r = random.Random(3)
    at = lambda: r.choice([None, r.randrange(-40, 60), r.randrange(-4, 40) * 10])
    bars = [(r.choice(["A", "B", None, "unknown"]), at(), r.choice([None, -3, r.randrange(50), 10 + i]), r.choice(["x", "y", None]), i) for i in range(200)]
    ticks, bars = spark.createDataFrame(odd_rows(3)[0], TICK), spark.createDataFrame(bars, BAR + ", event_id long")
    keyed = lambda df: df.withColumn("symbol", market.keyed(F.col("symbol")))
    volumes = market.per_tick_volume(keyed(bars), ["timestamp", "event_id"]).select("symbol", "timestamp", F.col("per_tick_volume").alias("volume"), market.from_source())
    as_sums = lambda df: sorted((*x[:2], None if x[2] is None else round(x[2], 5), *x[3:]) for x in map(tuple, df.collect()))
    assert as_sums(market.tick_bar_sums(ticks, bars, 10, ("timestamp", "event_id"), span)) == as_sums(market.pair_sums(keyed(ticks), volumes, 10))


def test_bars_cross_the_network_once(spark):
    """Neither bars nor their volumes are dealt anew for the sums, nothing is joined, and what made the bars is dealt once."""
    rows = spark.range(3000).selectExpr("'A' AS symbol", "id * 7 AS timestamp", "id AS event_id", "cast(1 AS double) AS price", "'x' AS data_source")
    bars = rows.withColumn("volume", F.expr("sum(1L) OVER (PARTITION BY symbol ORDER BY timestamp)"))
    got = market.tick_bar_vwap(rows.select("symbol", "timestamp", "price"), bars, order=("timestamp", "event_id"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("REPARTITION_BY_COL") == 1 and "ReusedExchange" in plan
