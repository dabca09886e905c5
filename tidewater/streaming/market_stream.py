"""The market flow on streams: watermarks, keyed state, interval join, windowed mean, fan-out, what was late."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewater.operators.market import from_source, keyed, vwap_columns

LATE = "3 seconds"


def event_time(df: DataFrame, late: str = LATE, ts: str = "timestamp", unit: str = "ms") -> DataFrame:
    """df with ts as event time and its watermark; a missing timestamp counts as now. unit says whether it has seconds or milliseconds."""
    at = F.timestamp_millis(F.col(ts)) if unit == "ms" else F.timestamp_seconds(F.col(ts))
    return df.withColumn("ts", F.coalesce(at, F.current_timestamp())).withWatermark("ts", late)


class TickVolume(StatefulProcessor):
    """Per-bar volume from cumulative volume, with the last volume and time of a symbol as state.

    Rows go in the order of arrival, which event_id tells (a topic's offset); their times may go back. Frames are taken one at a time: three
    numbers of each row are held until those of a symbol in one batch are in order, and what is made goes out in frames of OUT rows. With idle_ms, the
    state of a symbol that has been silent for so long goes.
    """

    OUT = 10_000

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "volume long, timestamp long", self.idle_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N803
        for volume, at in initialState[["volume", "timestamp"]].dropna().astype("int64").itertuples(index=False):
            self.last.update((int(volume), int(at)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        parts = [np.zeros((0, 4), np.int64)]
        for frame in rows:
            known = frame[frame["volume"].notna() & frame["timestamp"].notna()]
            unnamed = known["event_id"].isna()  # rows that don't say when they arrived come last
            parts.append(np.column_stack([unnamed, known["event_id"].fillna(0), known["timestamp"], known["volume"]]).astype(np.int64))
        bars = np.concatenate(parts)
        bars = bars[np.lexsort((bars[:, 1], bars[:, 0]))]
        if not len(bars):
            return
        at, volume = bars[:, 2], bars[:, 3]
        first, first_at = self.last.get() if self.last.exists() else (0, 0)
        before, before_at = np.concatenate(([first], volume[:-1])), np.concatenate(([first_at], at[:-1]))
        made = np.where((volume < before) | (at <= before_at), volume, volume - before)
        self.last.update((int(volume[-1]), int(at[-1])))
        for i in range(0, len(bars), self.OUT):
            some = slice(i, i + self.OUT)
            ids = pd.array(bars[some, 1], dtype="Int64")
            ids[bars[some, 0] == 1] = pd.NA
            yield pd.DataFrame({"symbol": key[0], "event_id": ids, "timestamp": at[some], "per_tick_volume": made[some]})

    def close(self) -> None:
        pass


def per_tick_volume_stream(bars: DataFrame, initial: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """The stream (symbol, event_id, timestamp, volume) with per_tick_volume; late rows count as they arrive. Needs the RocksDB state store.

    initial (symbol, volume, timestamp), one row for each symbol, is where a stream that has no checkpoint yet goes on from: market.last_bars of what
    a batch has done. idle_ms of silence, by the clock, end a symbol's state; such a query runs until it is stopped, as availableNow waits for clocks that
    never end. How many rows a batch has is for the source to bound
    (maxFilesPerTrigger).
    """
    schema = "symbol string, event_id long, timestamp long, per_tick_volume long"
    state = None if initial is None else initial.select("symbol", "volume", "timestamp").groupBy("symbol")
    return bars.groupBy("symbol").transformWithStateInPandas(TickVolume(idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime", state)


def interval_join_stream(ticks: DataFrame, volumes: DataFrame, width_s: int = 1) -> DataFrame:
    """Pairs of one symbol at most width_s seconds apart, stamped with the later time; data_source of the volumes is carried where they have
    it. No symbol, on either side, and no data_source read as unknown.

    Two joins, one for each order of the two times: each keeps the column that carries the watermark, so
    that a window over the pair's time can close. An equality on a time bucket beside that on the symbol spreads the state of a
    symbol over tasks; volumes go to their own bucket and both neighbours.
    """
    source = [from_source()] if "data_source" in volumes.columns else []
    bucket = lambda ts: F.floor(F.unix_seconds(F.col(ts)) / max(1, width_s))
    h = ticks.select(keyed(F.col("symbol")).alias("symbol"), F.col("ts").alias("h_ts"), "price", bucket("ts").alias("h_bucket"))
    w = volumes.select(keyed(F.col("symbol")).alias("w_symbol"), F.col("ts").alias("w_ts"), F.col("per_tick_volume").alias("volume"), *source, F.explode(F.array(*(bucket("ts") + i for i in (-1, 0, 1)))).alias("w_bucket"))
    source = ["data_source"] if source else []
    same, by = (F.col("symbol") == F.col("w_symbol")) & (F.col("h_bucket") == F.col("w_bucket")), F.expr(f"INTERVAL {width_s} SECONDS")
    later = h.join(w, same & (F.col("w_ts") >= F.col("h_ts")) & (F.col("w_ts") <= F.col("h_ts") + by)).select("symbol", F.col("w_ts").alias("ts"), "price", "volume", *source)
    sooner = h.join(w, same & (F.col("w_ts") < F.col("h_ts")) & (F.col("w_ts") >= F.col("h_ts") - by)).select("symbol", F.col("h_ts").alias("ts"), "price", "volume", *source)
    return later.union(sooner)


Rows = dict[str, np.ndarray]


class PairSums(StatefulProcessor):
    """Sums over the pairs of ticks and volumes that one bucket of time and the one before hold, as market.pair_sums has them: what comes in a
    batch meets what was there before and itself. The state, what the rows of one time add up to, goes when the watermark has passed the bucket.
    """

    COLUMNS = ["tick", "own", "at", "n", "price", "volume", "known", "data_source"]

    def __init__(self, width_us: int) -> None:
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "part binary")

    def combined(self, parts: list[Rows]) -> Rows:
        """A row for each side, bucket and time, in that order: sums, and the largest source."""
        rows = {c: np.concatenate([p[c] for p in parts]) for c in self.COLUMNS}
        order = np.lexsort((rows["at"], rows["own"], rows["tick"]))
        keys = [rows[c][order] for c in ("tick", "own", "at")]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        names, codes = np.unique(rows["data_source"], return_inverse=True)
        sums = {c: np.add.reduceat(rows[c][order], starts) for c in ("n", "price", "volume", "known")}
        return {c: k[starts] for c, k in zip(("tick", "own", "at"), keys, strict=True)} | sums | {"data_source": names[np.maximum.reduceat(codes[order], starts)]}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        new = self.combined([{c: frame[c].to_numpy() for c in self.COLUMNS} for frame in rows])
        old = []
        for (part,) in self.seen.get():
            table = pa.ipc.open_stream(part).read_all()
            old.append({c: table[c].to_numpy() for c in self.COLUMNS})
        buffer, table = pa.BufferOutputStream(), pa.table({c: pa.array(new[c]) for c in self.COLUMNS})
        with pa.ipc.new_stream(buffer, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.seen.appendValue((buffer.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        part = lambda r, tick: {c: v[r["tick"] == tick] for c, v in r.items()}
        if old:
            before = self.combined(old)
            both = self.combined([before, new])
            met = [(part(new, True), part(both, False)), (part(before, True), part(new, False))]
        else:
            met = [(part(new, True), part(new, False))]
        for ticks, volumes in met:
            for frame in (self.sums(ticks, volumes, True), self.sums(volumes, ticks, False)):
                if len(frame):
                    yield frame.assign(symbol=key[0])

    def sums(self, later: Rows, other: Rows, is_tick: bool) -> pd.DataFrame:
        """For the later rows, which are of this bucket: of the other side's rows of this bucket they meet all up to their time, of the bucket
        before all from their time less the width on. Sums go from both ends, and nothing is subtracted."""
        later = {c: v[later["own"]] for c, v in later.items()}
        here, last = ({c: v[other["own"] == own] for c, v in other.items()} for own in (True, False))
        i = np.searchsorted(here["at"], later["at"], "right" if is_tick else "left")
        j = len(last["at"]) - np.searchsorted(last["at"], later["at"] - self.width, "left")
        names = np.unique(np.concatenate(([""], other["data_source"])).astype(str))

        def reached(column: str, running: Callable) -> tuple[np.ndarray, np.ndarray]:
            a, b = here[column], last[column][::-1]
            if column == "data_source":
                a, b = (np.searchsorted(names, x.astype(str)) for x in (a, b))
            return tuple(np.concatenate((np.zeros(1, x.dtype), running(x)))[at] for x, at in ((a, i), (b, j)))

        n, known, price, volume = (np.add(*reached(c, np.cumsum)) for c in ("n", "known", "price", "volume"))
        some, any_known = n > 0, (later["known"] > 0) & (known > 0)
        if is_tick:
            weighted, total, n_total = later["price"] * volume, later["n"] * volume, known
            source = names[np.maximum(*reached("data_source", np.maximum.accumulate))]
        else:
            weighted, total, n_total, source = later["volume"] * price, later["volume"] * n, later["known"], later["data_source"]
        made = {"ts": later["at"].astype("datetime64[us]"), "weighted": weighted, "any_known": any_known, "volume": total, "has_volume": n_total > 0, "n_pairs": later["n"] * n, "data_source": source}
        return pd.DataFrame({c: v[some] for c, v in made.items()})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def pair_sums_stream(ticks: DataFrame, volumes: DataFrame, width_s: int = 1) -> DataFrame:
    """What the pairs of interval_join_stream add up to, without a pair being made: market.pair_sums on streams. The state has a row for each side, symbol and
    time of two buckets at most before the watermark, and work grows with the rows, however dense they are. Needs the RocksDB state store.
    """
    has_source = "data_source" in volumes.columns
    source = from_source() if has_source else F.lit("").alias("data_source")
    side = lambda df, tick, value, price, volume, source: df.select(
        keyed(F.col("symbol")).alias("symbol"), "ts", F.lit(tick).alias("tick"), price.alias("price"), volume.alias("volume"), F.col(value).isNotNull().cast("long").alias("known"), source
    )
    zero, value = F.lit(0).cast("long"), F.coalesce(F.round("price", 6).cast("double"), F.lit(0.0))
    rows = side(ticks, True, "price", value, zero, F.lit("").alias("data_source")).union(side(volumes, False, "per_tick_volume", F.lit(0.0), F.coalesce("per_tick_volume", zero), source))
    width_us = max(1, width_s) * 1_000_000
    rows = rows.withColumns({"at": F.unix_micros("ts"), "n": F.lit(1).cast("long"), "own": F.explode(F.array(F.lit(True), F.lit(False)))})
    rows = rows.withColumn("bucket", F.floor(F.col("at") / width_us) + F.when(F.col("own"), 0).otherwise(1))
    schema = "symbol string, ts timestamp, weighted double, any_known boolean, volume long, has_volume boolean, n_pairs long, data_source string"
    made = rows.groupBy("symbol", "bucket").transformWithStateInPandas(PairSums(width_us), schema, "Append", "EventTime", eventTimeColumnName="ts")
    weighted = F.when(F.col("any_known"), F.coalesce("weighted", F.lit(float("nan")))).alias("weighted")  # a frame has no way to tell NaN from null
    return made.select("symbol", "ts", weighted, F.when(F.col("has_volume"), F.col("volume")).alias("volume"), "n_pairs", *(["data_source"] if has_source else []))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def vwap_stream(pairs: DataFrame, window: str = "1 minute") -> DataFrame:
    """Volume-weighted mean by symbol and tumbling window of event time, in append mode; rows behind the watermark are dropped."""
    rows = pairs.groupBy("symbol", F.window("ts", window).alias("w")).agg(*vwap_columns(pairs))
    return rows.select("symbol", F.unix_millis(F.col("w.end")).alias("window_end"), *(c for c in rows.columns if c not in ("symbol", "w")))


def fan_out(stream: DataFrame, checkpoint: str, branches: dict[str, tuple[str, list[Column | str]]]) -> DataStreamWriter:
    """One validated stream, read and validated once, to several tables: branches names a folder and the columns of each.

    A batch is kept while its branches are written, and each goes to a folder of the batch's number: a batch that is retried overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for path, columns in branches.values():
                batch.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query have dropped as late, over the progress that it still knows; rows that a partial
    aggregation has put together count once."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
