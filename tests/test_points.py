"""The table of points: last write wins over batches and crashes, retention, rollups."""

import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.sources import points as P

SCHEMA = "symbol string, timestamp long, seq long, price double"
HOUR = 3_600_000


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(spark, path):
    return sorted((r["symbol"] or "", -1 if r["timestamp"] is None else r["timestamp"], r["price"]) for r in P.read_points(spark, path, SCHEMA).collect())


def files(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.glob("t/span=*/*.parquet")}


def test_last_write_wins(spark, tmp_path):
    path, key = f"file://{tmp_path}/t", ["symbol", "timestamp"]
    assert content(spark, path) == []
    P.merge_points(frame(spark, ("A", 1, 1, 0.0), ("A", 1, 3, 2.0), ("A", 1, 2, 9.0), ("B", HOUR, 4, 5.0), (None, None, 5, 6.0), ("A", 1, 1, 0.0)), 0, path, key, arrival="seq")
    assert content(spark, path) == [("", -1, 6.0), ("A", 1, 2.0), ("B", HOUR, 5.0)]
    before = files(tmp_path)
    second = frame(spark, ("A", 1, 1, 1.0), ("C", 1, 1, 7.0))  # an earlier place in a later batch wins
    P.merge_points(second, 1, path, key, arrival="seq")
    want = [("", -1, 6.0), ("A", 1, 1.0), ("B", HOUR, 5.0), ("C", 1, 7.0)]
    assert content(spark, path) == want
    other = "span=1970-01-01-01/"
    assert {f for f in before if other in f} == {f for f in files(tmp_path) if other in f}  # an hour without points in the batch stays as it was
    P.merge_points(second, 1, path, key, arrival="seq")  # replayed
    P.merge_points(frame(spark, ("A", 1, 9, 3.0)), 0, path, key, arrival="seq")  # an older batch that is replayed loses
    assert content(spark, path) == want
    P.merge_points(frame(spark), 2, path, key)
    assert content(spark, path) == want


def test_crash_before_and_amid_moves(spark, tmp_path, monkeypatch):
    """However far a batch got, doing it again ends with the same table."""
    key, first, second = ["symbol", "timestamp"], [(s, h * HOUR, 1, 1.0) for s in "AB" for h in range(4)], [("A", h * HOUR, 2, 2.0) for h in range(6)]
    want = sorted([("A", h * HOUR, 2.0) for h in range(6)] + [("B", h * HOUR, 1.0) for h in range(4)])
    move = P._replace_spans
    for at in range(3):
        path = f"file://{tmp_path}/{at}/t"
        P.merge_points(frame(spark, *first), 0, path, key)

        def broken(session, staged, target, at=at):
            fs, place = P.filesystem(session, staged)
            names = sorted(f.getPath().getName() for f in fs.listStatus(place) if f.getPath().getName().startswith("span="))
            for name in names[: at * 2]:
                fs.delete(P.filesystem(session, f"{target}/{name}")[1], True)
                if name != names[at * 2 - 1]:  # the last one was taken away and not yet put in its place
                    fs.rename(P.filesystem(session, f"{staged}/{name}")[1], P.filesystem(session, f"{target}/{name}")[1])
            raise OSError("lost")

        monkeypatch.setattr(P, "_replace_spans", broken)
        with pytest.raises(OSError, match="lost"):
            P.merge_points(frame(spark, *second), 1, path, key)
        monkeypatch.setattr(P, "_replace_spans", move)
        P.merge_points(frame(spark, *second), 1, path, key)
        assert content(spark, path) == want
        assert not list(pathlib.Path(tmp_path, str(at), "t", "_staged").glob("*"))


def test_many_rows_of_one_hour(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 100)
    rows = spark.range(1000).select(F.lit("A").alias("symbol"), F.col("id").alias("timestamp"), F.col("id").alias("seq"), F.lit(1.0).alias("price"))
    P.merge_points(rows, 0, f"file://{tmp_path}/t", ["symbol", "timestamp"])
    assert len(files(tmp_path)) > 3 and P.read_points(spark, f"file://{tmp_path}/t", SCHEMA).count() == 1000


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_retention(spark, tmp_path, unit):
    path, day = f"file://{tmp_path}/t", 24 * HOUR
    step = HOUR if unit == "hour" else day
    rows = [("A", h * step + m * step // 60, 1, 1.0) for h in range(6) for m in (0, 10, 50)]
    assert P.drop_expired(spark, path, SCHEMA, "timestamp") == []
    P.merge_points(frame(spark, *rows), 0, path, ["symbol", "timestamp"], unit=unit)
    before = files(tmp_path)
    last = "2 HOURS" if unit == "hour" else "2 DAYS"
    gone = P.drop_expired(spark, path, SCHEMA, "timestamp", last, unit=unit)
    newest = 5 * step + 50 * step // 60
    assert content(spark, path) == sorted(("A", t, p) for _, t, _, p in rows if t >= newest - 2 * step)
    spans = P.spans_of(spark, path)
    assert len(gone) == 3 and len(spans) == 3 and not set(gone) & set(spans)
    kept = {f for f in before if f.split("/")[1].removeprefix("span=") in spans[1:]}
    assert kept and kept <= files(tmp_path)  # nothing of later hours was written anew
    assert P.drop_expired(spark, path, SCHEMA, "timestamp", last, unit=unit) == []
    assert len(P.drop_expired(spark, path, SCHEMA, "timestamp", last, now=datetime(2030, 1, 1), unit=unit)) == 3 and content(spark, path) == []


def test_sink_keeps_an_interval(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for i in range(3):
        frame(spark, *(("A", (3 * i + h) * HOUR, 1, float(i)) for h in range(4))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        P.point_sink(stream, path, f"{tmp_path}/c", ["symbol", "timestamp"], keep="4 HOURS").trigger(availableNow=True).start().awaitTermination()
    assert content(spark, path) == [("A", h * HOUR, 1.0 if h < 6 else 2.0) for h in range(5, 10)]


def test_rollup_merges(spark):
    rows = spark.createDataFrame([("A", 1, 1.0), ("A", 2, None), ("A", 61, 4.0), ("B", 1, None), (None, 1, 2.0)], "symbol string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    rolled = P.rollup(rows, ["v"], "1 minute")
    got = {(r["symbol"], r["bucket_end"]): r["mean_v"] for r in P.rollup_means(rolled, ["v"]).collect()}
    assert got == {("A", 60000): 1.0, ("A", 120000): 4.0, ("B", 60000): None, (None, 60000): 2.0}
    wide = {(r["symbol"], r["bucket_end"]): r["mean_v"] for r in P.rollup_means(rolled, ["v"], every_ms=120_000).collect()}
    assert wide == {("A", 120000): 2.5, ("B", 120000): None, (None, 120000): 2.0}
