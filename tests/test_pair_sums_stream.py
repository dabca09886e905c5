"""Sums of pairs on streams: over several batches they are those of the batch form, and no pair is made."""

from pyspark.sql import functions as F

from tidewater.operators import market
from tidewater.sources.scratch import shared_dir
from tidewater.streaming import market_stream as MS

TICK, BAR = "symbol string, timestamp long, price double", "symbol string, timestamp long, per_tick_volume long, data_source string"
DAYS = 864_000_000  # a watermark begins at 1970, and times up to it are late


def run(spark, parts):
    """Each part is a batch of its own, with the state of those before."""
    path = shared_dir(spark)
    with MS.rocksdb(spark):
        for ticks, bars in parts:
            spark.createDataFrame(ticks, TICK).write.mode("append").parquet(f"{path}/ticks")
            spark.createDataFrame(bars, BAR).write.mode("append").parquet(f"{path}/bars")
            streams = [MS.event_time(spark.readStream.schema(s).parquet(f"{path}/{n}"), "1 day") for s, n in ((TICK, "ticks"), (BAR, "bars"))]
            out = MS.pair_sums_stream(*streams, 10).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out")
            out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("ts", F.unix_millis("ts"))


def test_batches_meet(spark):
    ticks = [(s, DAYS + 1000 * (i * 7 % 50), None if i % 9 == 4 else i / 3) for i in range(60) for s in ("A", None)]
    bars = [("A" if i % 4 else None, DAYS + 1000 * (i * 11 % 50) + i % 2, None if i % 13 == 5 else i - 5, ["x", None, "z"][i % 3]) for i in range(60)]
    got = run(spark, [(ticks[i::3], bars[i::3]) for i in range(3)])
    keyed = [spark.createDataFrame(r, s).withColumn("symbol", market.keyed(F.col("symbol"))) for r, s in ((ticks, TICK), (bars, BAR))]
    pairs = market.interval_join(keyed[0], keyed[1].withColumn("data_source", market.from_source()), 10_000).withColumnRenamed("per_tick_volume", "volume")
    pairs = pairs.withColumn("ts", F.greatest("timestamp", "right_timestamp"))
    show = lambda df: sorted((r["symbol"], r["window_end"], None if r["vwap"] is None else round(r["vwap"], 5), r["n_pairs"], r["data_source"]) for r in df.collect())
    for window in (1, 7000, 100_000):
        assert show(market.vwap(got, window)) == show(market.vwap(pairs, window))


def test_rows_of_one_time_make_few_rows(spark):
    got = run(spark, [([("A", 1000, 2.0)] * 300, [("A", 1000, 1, "x")] * 200)]).collect()
    assert [(r["weighted"], r["volume"], r["n_pairs"]) for r in got] == [(120_000.0, 60_000, 60_000)]


def test_no_number(spark):
    got = run(spark, [([("A", 1000, float("nan")), ("A", 30_000, 1.0)], [("A", 2000, 1, "x"), ("A", 31_000, 3, "x")])]).collect()
    assert sorted(str((r["ts"], r["weighted"])) for r in got) == ["(2000, nan)", "(31000, 3.0)"]
