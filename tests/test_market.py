"""Volume and mean goldens, sinks, and batch against stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.operators import enrich, market
from tidewater.operators.dedup import keep_latest
from tidewater.session import build_session
from tidewater.sources import scratch, sinks
from tidewater.sources.scratch import shared_dir, stored
from tidewater.streaming import market_stream as MS

BARS = [(1, "A", 1000, 5), (2, "A", 2000, 7), (3, "A", 60400, 3), (4, "A", 61400, 3), (5, "A", 61400, 8)]
SCHEMA = "event_id long, symbol string, timestamp long, volume long"


def test_per_tick_volume(spark):
    got = market.per_tick_volume(spark.createDataFrame(BARS, SCHEMA), ["event_id"]).orderBy("event_id").collect()
    assert [r["per_tick_volume"] for r in got] == [5, 2, 3, 0, 8]


def test_vwap_golden(spark):
    ticks = spark.createDataFrame([("A", 1000, 10.0), ("A", 59500, 20.0), ("A", 60100, 30.0)], "symbol string, timestamp long, price double")
    got = market.tick_bar_vwap(ticks, spark.createDataFrame(BARS[:3], SCHEMA)).orderBy("window_end").collect()
    assert [(r["window_end"], r["vwap"], r["n_pairs"]) for r in got] == [(60000, 10.0, 2), (120000, 25.0, 2)]


def test_bars_to_ticks(spark):
    bar = spark.createDataFrame([("AAPL", 1000, 220.06, 219.96)], "symbol string, timestamp long, open_price double, close_price double")
    got = market.bars_to_ticks(bar).orderBy("timestamp").collect()
    assert len(got) == 90 and got[0]["price"] == 220.06 and got[-1]["timestamp"] == 1979 and got[-1]["price"] == 219.96111


def test_volume_over_buckets(spark):
    """However wide a bucket is, the row before is the one that arrived before, in another bucket or in none; no symbol is a symbol."""
    rows = [(i, None if i % 3 == 0 else "A", 1000 * i, (i * 7) % 11) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r["event_id"]: r["per_tick_volume"] for r in market.per_tick_volume(df, ["timestamp", "event_id"]).collect()}
    last = {}
    for i, s, t, v in rows:
        pv, pt = last.get(s, (0, 0))
        assert want[i] == (v - pv if v >= pv and t > pt else v)
        last[s] = (v, t)
    for every in (1, 1500, 7000):
        assert {r["event_id"]: r["per_tick_volume"] for r in market.per_tick_volume(df, ["timestamp", "event_id"], every=every).collect()} == want


def test_stream_in_order_of_arrival(spark):
    """Several batches, times that go back, a restart from the checkpoint: as the batch form in the order of arrival."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = shared_dir(spark)
    rows = [*BARS, (6, "A", 500, 9), (7, "A", 62000, 12), (8, "B", 1, 4), (9, "A", 63000, None), (10, "A", 64000, 15)]
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        MS.per_tick_volume_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["per_tick_volume"] for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {r["event_id"]: r["per_tick_volume"] for r in market.per_tick_volume(spark.createDataFrame(rows, SCHEMA), ["event_id"]).collect()}
    assert 9 not in got and got[6] == 9 and got[7] == 3


def test_source_of_the_last_pair(spark):
    pairs = spark.createDataFrame([("A", 10, 1.0, 1, "x"), ("A", 30, 2.0, 1, "y"), ("A", 20, 3.0, 1, "z"), ("A", 30, 2.0, 1, "w")], "symbol string, ts long, price double, volume long, data_source string")
    assert market.vwap(pairs).first()["data_source"] == "y"
    assert "data_source" not in market.vwap(pairs.drop("data_source")).columns


def test_point_sink_is_idempotent(spark):
    path = shared_dir(spark)
    spark.createDataFrame(BARS, SCHEMA).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    for check in ("a", "b"):  # a replay of the same batch
        sinks.point_sink(stream, f"{path}/out", f"{path}/{check}", ["symbol", "timestamp"]).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 4


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def gold(spark, url):
    return sorted(tuple(r) for r in spark.read.jdbc(url, "GOLD", properties=DERBY).collect())


def test_jdbc(spark, tmp_path):
    url, schema = f"jdbc:derby:{tmp_path}/db;create=true", "ID long, LABEL string"
    sinks.write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], schema), url, "GOLD", key=["ID"], mode="upsert", **DERBY)  # no table yet
    sinks.write_jdbc(spark.createDataFrame([(2, "c"), (3, "d")], schema), url, "GOLD", key=["ID"], mode="upsert", **DERBY)
    assert gold(spark, url) == [(1, "a"), (2, "c"), (3, "d")]
    # a batch that doesn't fit fails, the table stays, and no staging table is left
    with pytest.raises(Exception):
        sinks.write_jdbc(spark.createDataFrame([(4, "e", 1)], schema + ", OTHER int"), url, "GOLD", key=["ID"], mode="upsert", **DERBY)
    assert gold(spark, url) == [(1, "a"), (2, "c"), (3, "d")]
    names = spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') t", properties=DERBY).collect()
    assert [r[0] for r in names] == ["GOLD"]
    sinks.write_jdbc(spark.createDataFrame([(9, "z")], schema), url, "GOLD", **DERBY)
    assert gold(spark, url) == [(9, "z")]


def test_upsert_rewrites_touched_days(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id string, scraped_at timestamp, v int"
    at = lambda day: datetime(2024, 1, day)
    order = [F.col("scraped_at").desc(), F.col("v").desc()]
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert sinks.current(spark, path) is None and sinks.upsert(frame(), path, ["id"], order) is None
    sinks.upsert(frame(("a", at(1), 1), ("b", at(2), 1), ("c", at(3), 1)), path, ["id"], order)
    got = sinks.upsert(frame(("a", at(4), 2), ("a", at(4), 3), ("d", at(2), 2)), path, ["id"], order)
    rows = sorted((r["id"], r["v"], str(r["scraped_day"])) for r in got.collect())
    assert rows == [("a", 3, "2024-01-04"), ("b", 1, "2024-01-02"), ("c", 1, "2024-01-03"), ("d", 2, "2024-01-02")]
    assert sorted(p.name for p in (tmp_path / "t/rows/version=2").glob("scraped_day=*")) == ["scraped_day=2024-01-02", "scraped_day=2024-01-04"]  # not that of c, nor the first, which is empty now
    assert sinks.upsert(frame(("c", at(1), 9)), path, ["id"], order).count() == 4  # older: c stays as it was
    assert {r["id"]: r["v"] for r in sinks.current(spark, path).collect()}["c"] == 1


def test_session_settings(spark):
    session = build_session(object_store={"endpoint": "http://store:9000", "access_key": "a", "secret_key": "b"}, catalog={"name": "lake", "class": "x.Y", "warehouse": "s3a://w"})
    get = session.conf.get
    assert get("spark.sql.adaptive.enabled") == "true" and get("spark.hadoop.fs.s3a.path.style.access") == "true" and get("spark.hadoop.fs.s3a.connection.ssl.enabled") == "false"
    assert get("spark.sql.catalog.lake") == "x.Y" and get("spark.sql.catalog.lake.warehouse") == "s3a://w"


class Session:
    """What shared_dir asks of a session, without a folder set."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = {}, self, master


def test_scratch_folders(spark):
    stored(spark.range(3)).count()
    assert scratch.clear(spark) >= 1 and scratch.clear(spark) == 0
    assert shared_dir(Session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            shared_dir(Session(master))


def test_keep_latest_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 5)], "k int, v int")
    assert sorted((str(r[0]), r[1]) for r in keep_latest(df, ["k"], [F.col("v").desc()]).collect()) == [("1", 5), ("None", 2)]
    assert keep_latest(df.limit(0), ["k"], [F.col("v")]).isEmpty()


def test_enrich_parts(spark):
    df = spark.createDataFrame([("Head", None), ("Head", "short"), ("Head", "x" * 60)], "h string, s string")
    got = df.select(enrich.text_to_summarise(F.col("h"), F.col("s")).alias("t"), enrich.sentiment_text(F.col("h"), F.col("s")).alias("c")).collect()
    assert [r["t"] for r in got] == ["Head", "Head", "x" * 60] and got[0]["c"] == "Head"
    notes = spark.createDataFrame([([("pos", {"confidence": "0.9"})],), ([],), (None,)], "a array<struct<result:string,metadata:map<string,string>>>")
    label, score = enrich.annotation(F.col("a"))
    assert [tuple(r) for r in notes.select(label, score).collect()] == [("pos", 0.9), (None, None), (None, None)]
