"""Files that arrive, objects that tasks write, what is refused and why, what is late, and state that goes on."""

import json
import pathlib
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.operators import market, media_items
from tidewater.plans.flows import forget_last_commit, in_rounds
from tidewater.sources import envelope, intake, objects
from tidewater.streaming import late
from tidewater.streaming import market_stream as MS

ROWS = "id long, source_file string, scraped_at timestamp, checksum_sha256 string"


def test_objects(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{i % 3}/{i}.bin", bytes([i]) * i) for i in range(40)] + [("é x/y", b"\x00\xff"), ("none", None)], "k string, v binary").repartition(4)
    for _ in range(2):  # written again, the same content is no error
        objects.write_objects(rows, f"file://{tmp_path}/out", F.col("k"), F.col("v"))
        got = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        assert got == {r["k"]: bytes(r["v"] or b"") for r in rows.collect()} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "none", "é x"]
    with pytest.raises(Exception, match="other content"):
        objects.write_objects(rows.withColumn("v", F.lit(b"new")), f"file://{tmp_path}/out", F.col("k"), F.col("v"))
    for bad in ("../up", "/root", "", None):
        with pytest.raises(Exception, match="no name for an object"):
            objects.write_objects(spark.createDataFrame([("fine", b"1"), (bad, b"2")], "k string, v binary").coalesce(1), f"file://{tmp_path}/bad", F.col("k"), F.col("v"))
    assert [p for p in (tmp_path / "bad").rglob("*")] == []  # a task that fails leaves nothing
    objects.write_objects(rows.limit(0), f"file://{tmp_path}/empty", F.col("k"), F.col("v"))
    assert list((tmp_path / "empty").rglob("*")) == []


def test_append_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame([(i, f, datetime(1970, 1, 1 + day), None) for i, f, day in rows], ROWS)
    news = "category string, headline string, image_url string, published_at_utc timestamp, source string, summary string, url string"
    wide = lambda df: df.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in news.split(", ")))
    first, second = wide(frame((1, "x:/a", 0), (2, "x:/a", 0), (3, "x:/b", 0))), wide(frame((10, "x:/a", 1), (20, "x:/c", 2)))
    seen = intake.append_once(first, path)
    assert seen["n_written"] == 3 and seen["n_bad_checksum"] == 3
    intake.append_once(second, path)
    intake.append_once(first, path)
    assert intake.append_once(first.limit(0), path)["n_written"] == 0
    table = spark.read.parquet(path)
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3, 10, 20]
    assert sorted(r["id"] for r in intake.scan_file(table, "1970-01-01", "x:/a").collect()) == [1, 2]
    assert len(list(tmp_path.glob("t/scraped_day=*"))) == 3 and len(list(tmp_path.glob("t/scraped_day=*/file_key=*"))) == 4


def test_take_in_after_a_crash(spark, tmp_path):
    """A batch whose rows were written, but not its hand-off, is done again from the checkpoint."""
    columns = "category string, headline string, image_url string, published_at_utc timestamp, source string, summary string, url string"
    (tmp_path / "in").mkdir()
    fail = {"on": False}

    def clean(raw):
        rows = raw.select(F.crc32(F.col("value").cast("binary")).alias("id"), F.col("source_path").alias("source_file"), F.timestamp_seconds(F.lit(5)).alias("scraped_at"), F.lit("x").alias("checksum_sha256"))
        return rows.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")))

    def rejects(raw):
        if fail["on"]:
            raise OSError("lost")
        return raw.select("source_path").where("value = 'bad'")

    def run():
        stream = intake.stream_envelopes(spark, f"file://{tmp_path}/in/*.json", 2)
        intake.take_in(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/c", clean, rejects).trigger(availableNow=True).start().awaitTermination()

    for n, broken in enumerate((False, True, False)):
        for i in range(3):
            (tmp_path / "in" / f"{n}-{i}.json").write_text(f"{n} {i}" if i else "bad")
        fail["on"] = broken
        if broken:
            with pytest.raises(Exception, match="lost"):
                run()
        else:
            run()
    handed = intake.read_part(spark, f"file://{tmp_path}/t", "handoff", intake.HANDOFF).collect()
    assert Counter(r["source_file"].rpartition("/")[2] for r in handed) == Counter(f"{n}-{i}.json" for n in range(3) for i in range(3)) and all(r["n_written"] == 1 for r in handed)
    assert max(Counter(r["batch"] for r in handed).values()) == 2  # never more files in a batch than asked for
    rows = intake.read_part(spark, f"file://{tmp_path}/t", "rows", "id long, source_file string").collect()
    assert len(rows) == 9 == len({r["source_file"] for r in rows})
    assert intake.read_part(spark, f"file://{tmp_path}/t", "rejected", "source_path string").count() == 3
    assert intake.read_part(spark, f"file://{tmp_path}/t", "totals", intake.TOTALS).agg(F.sum("n_written")).first()[0] == 9
    assert intake.read_part(spark, f"file://{tmp_path}/none", "rows", "id long").count() == 0


ITEM = {"id": 1, "category": "c", "datetime": 1, "headline": "h", "source": "s", "url": "u"}
META = {"category": "c", "article_count": 1, "scraped_at": "t"}


@pytest.mark.parametrize("doc, want", [
    ({"metadata": META, "news": [ITEM]}, None), ({"metadata": META, "news": []}, None), ("{broken", ("$", "JSON")), (None, ("$", "JSON")), ({"metadata": META}, ("$.news", "array")), ({"metadata": META, "news": {"a": 1}}, ("$.news", "array")),
    ({"news": [ITEM]}, ("$.metadata.category", "string")), ({"metadata": META | {"article_count": -1}, "news": [{}]}, ("$.metadata.article_count", "integer, v >= 0")),
    ({"metadata": META, "news": [ITEM, ITEM | {"id": "7"}, {}]}, ("$.news[1].id", "integer, v >= 0")), ({"metadata": META, "news": [ITEM | {"headline": "", "url": 3}]}, ("$.news[0].headline", "string, length(v) >= 1")),
    ({"metadata": META, "news": [ITEM | {"summary": 3}]}, ("$.news[0].summary", "string")), ({"metadata": META, "news": [3]}, ("$.news[0].id", "integer, v >= 0")), ({"metadata": META, "news": [None, ITEM]}, ("$.news[0].id", "integer, v >= 0")),
])
def test_rejections(spark, doc, want):
    raw = spark.createDataFrame([("f", doc if doc is None or isinstance(doc, str) else json.dumps(doc))], "source_path string, value string")
    got = [(r["at"], r["rule"]) for r in envelope.rejections(raw, "news").collect()]
    assert got == ([] if want is None else [want])
    assert envelope.validate_envelopes(raw, "news").first()["envelope_ok"] == (want is None)


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\xff\xd8\xff" + b"x" * 500)
    (tmp_path / "b.bin").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 5000)
    facts = media_items.facts_of_files(spark, f"file://{tmp_path}", 1000)
    got = {r["lz_url"].rpartition("/")[2]: (r["true_mime"], r["processed_bytes"], r["failure"]) for r in facts.collect()}
    assert got == {"a.bin": ("image/jpeg", 503, None), "b.bin": (None, 5008, "exceeds limit of 1000 bytes")}
    scans = [x for x in facts._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:]]
    assert len(scans) == 2 and "LessThanOrEqual(length,1000)" in scans[0] and "GreaterThan(length,1000)" in scans[1]
    assert "content" in scans[0].partition("ReadSchema")[2] and "content" not in scans[1].partition("ReadSchema")[2].partition("\n")[0]  # of large files, length alone


TICK = "event_id long, symbol string, timestamp long"


def test_late_rows_are_counted(spark, tmp_path):
    parts = [[(1, "A", 500), (2, "A", 15_000)], [(3, "A", 900), (4, "A", 9_999), (5, "A", 10_000), (6, "B", 40_000), (7, "B", None)], [(8, "A", 29_999), (9, "A", 30_000), (10, "A", 39_000)]]
    arrived = late.ObservedCounts("arrived")
    spark.streams.addListener(arrived)
    path = f"file://{tmp_path}"
    frames = [spark.createDataFrame(p, TICK).coalesce(1) for p in parts]
    in_rounds(spark, frames, path, TICK, lambda s: late.split_late(s.observe("arrived", F.count("*").alias("n")), f"{path}/split", f"{path}/state", 3000, 10_000))
    assert arrived.total(spark) == 10  # the last batch was run twice
    spark.streams.removeListener(arrived)
    # marks: none, 12,000, 37,000
    assert sorted(r["event_id"] for r in late.split_rows(spark, f"{path}/split", TICK).where("late").collect()) == [3, 4, 8]
    assert sorted(tuple(r) for r in late.counts_by_batch(spark, f"{path}/split").collect()) == [(0, 2, 0), (1, 5, 2), (2, 3, 1)]
    means = MS.event_time(late.on_time(spark, f"{path}/split", TICK)).groupBy(F.window("ts", "10 seconds")).count()
    query = means.writeStream.format("memory").queryName("late_windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert MS.dropped_as_late(query) == 0


BAR = "event_id long, symbol string, timestamp long, volume long"


def test_state_goes_on_from_a_batch(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many frames in a call
    try:
        rows = [(i, None if i % 5 == 0 else "AB"[i % 2], (i * 37) % 50 * 100 + i * 10, (i * 7) % 23) for i in range(120)]
        rows += [(200, "A", None, 3), (201, "B", 9, None)]
        first, parts = spark.createDataFrame(rows[:40], BAR), [spark.createDataFrame(r, BAR).repartition(3) for r in (rows[40:90], rows[90:])]
        path, state = f"file://{tmp_path}", market.last_bars(first, ["event_id"])
        sink = lambda s: MS.per_tick_volume_stream(s, state).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        in_rounds(spark, parts, path, BAR, sink, again=False)
        want = {r["event_id"]: r["per_tick_volume"] for r in market.per_tick_volume(spark.createDataFrame(rows, BAR), ["event_id"]).collect()}
        got = {r["event_id"]: r["per_tick_volume"] for r in spark.read.parquet(f"{path}/out").collect()}
        assert got == {i: v for i, v in want.items() if i >= 40} and len(got) == 80
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_silent_state_goes(spark, tmp_path):
    """With a time to live, a symbol that comes back after it counts from nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([(1, "A", 1000, 5)], BAR).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = MS.per_tick_volume_stream(spark.readStream.schema(BAR).parquet(f"{tmp_path}/in"), idle_ms=3000)
    query = out.writeStream.format("memory").queryName("idle").trigger(processingTime="0 seconds").start()
    made = lambda: {r["event_id"]: r["per_tick_volume"] for r in spark.table("idle").collect()}
    try:
        for n, wait in ((2, 0), (3, 8)):
            end = time.time() + 60
            while len(made()) < n - 1 and time.time() < end:
                time.sleep(0.2)
            time.sleep(wait)
            spark.createDataFrame([(n, "A", 1000 * n, 5 + n)], BAR).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        end = time.time() + 60
        while len(made()) < 3 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert made()[1] == 5 and made()[3] == 8  # 8 after silence, where 8 - 7 would be 1


def test_unknown_symbol_and_source(spark):
    ticks = spark.createDataFrame([(None, 1000, 10.0), ("unknown", 1500, 20.0), ("A", 1000, 1.0)], "symbol string, timestamp long, price double")
    bars = spark.createDataFrame([(1, None, 1000, 4, None), (2, "unknown", 1800, 6, None), (3, "A", 1200, 5, "x")], "event_id long, symbol string, timestamp long, volume long, data_source string")
    got = {r["symbol"]: (r["vwap"], r["n_pairs"], r["data_source"]) for r in market.tick_bar_vwap(ticks, bars).collect()}
    assert got == {"unknown": (15.0, 4, "unknown"), "A": (1.0, 1, "x")}


def test_forget_last_commit(spark, tmp_path):
    commits = pathlib.Path(tmp_path, "commits")
    commits.mkdir()
    for n in (0, 9, 10):
        (commits / str(n)).write_text("v1")
    forget_last_commit(spark, f"file://{tmp_path}")
    assert sorted(p.name for p in commits.iterdir()) == ["0", "9"]
