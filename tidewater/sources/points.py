"""Points by series and time: a table in partitions of time in which the last write of a key wins, its retention, and rollups kept in it."""

from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructType

from tidewater.operators.dedup import keep_latest

#: Names of partitions, in the order of time, by their width; and how many rows of one partition and batch go to a task.
UNITS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}
FILE_ROWS = 2_000_000


def filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as an object of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def at_time(df: DataFrame, ts: str) -> Column:
    """A column of milliseconds, or of timestamps, as a timestamp; a missing one counts from 1970."""
    found = F.timestamp_millis(F.col(ts)) if isinstance(df.schema[ts].dataType, LongType) else F.col(ts).cast("timestamp")
    return F.coalesce(found, F.timestamp_seconds(F.lit(0)))


def read_points(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The points, with span (their partition) and the number of the batch that wrote each; none while there is no table."""
    own = spark.createDataFrame([], schema).schema
    own = own if "batch" in own.names else own.add("batch", "long")
    own = own if "span" in own.names else own.add("span", "string")
    try:
        return spark.read.schema(own).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], own)


def _replace_spans(spark: SparkSession, staged: str, path: str) -> None:
    """Moves each partition that is staged to the place of the table's own, a call or two for each, as a committer does."""
    fs, at = filesystem(spark, staged)
    for name in (f.getPath().getName() for f in fs.listStatus(at)):
        if name.startswith("span="):
            own = filesystem(spark, f"{path}/{name}")[1]
            fs.delete(own, True)
            if not fs.rename(filesystem(spark, f"{staged}/{name}")[1], own):
                raise OSError(f"{own} could not be replaced")
    fs.delete(at, True)


def merge_points(batch: DataFrame, number: int, path: str, key: list[str], ts: str | None = None, arrival: str | None = None, unit: str = "hour") -> None:
    """One batch of points into the table at path: of a key's rows the last stays, that of the latest batch, and within a batch the one whose
    arrival is largest (without arrival, or of equal ones, the one with the largest values). ts, the key's last column unless it is named, is in milliseconds or a
    timestamp; a key's rows must have one time. A partition of the table is an hour, or a day by unit.

    Only the partitions that a batch touches are read and written; one that gets many rows is written by several tasks. What they become is
    first written whole below _staged, in a folder of the batch's number, and then moved to their places: a batch that is retried after a crash
    finds it and goes on from there, and one that is replayed later loses to itself. Readers skip _staged. One writer at a time.
    """
    spark, ts = batch.sparkSession, ts or key[-1]
    staged = f"{path}/_staged/batch={number}"
    rows = batch.withColumns({"batch": F.lit(number).cast("long"), "span": F.date_format(at_time(batch, ts), UNITS[unit])})
    fs = filesystem(spark, staged)[0]
    if not fs.exists(filesystem(spark, f"{staged}/_SUCCESS")[1]):
        rows.persist()
        try:
            spans = dict(map(tuple, rows.groupBy("span").count().collect()))  # names of partitions
            old = read_points(spark, path, rows.schema).where(F.col("span").isin(list(spans)))
            rest = [c for c in batch.columns if c not in key and c != arrival]
            order = [F.desc("batch"), *([F.desc(arrival)] if arrival else []), *([F.desc(F.struct(*rest))] if rest else [])]
            merged = keep_latest(old.unionByName(rows), key, order)
            files = 1 + max(spans.values(), default=0) // FILE_ROWS
            tasks = min(max(1, len(spans) * files), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
            merged = merged.repartition(tasks, "span", F.pmod(F.xxhash64(*key), F.lit(files)))
            merged.write.mode("overwrite").partitionBy("span").parquet(staged)
        finally:
            rows.unpersist()
    _replace_spans(spark, staged, path)


def point_sink(
    stream: DataFrame, path: str, checkpoint: str, key: list[str], ts: str | None = None, arrival: str | None = None, keep: str | None = None, unit: str = "hour"
) -> DataStreamWriter:
    """A stream of points into the table at path, as merge_points does it; with keep, points older than that interval before the newest go."""

    def write(batch: DataFrame, number: int) -> None:
        merge_points(batch, number, path, key, ts, arrival, unit)
        if keep:
            drop_expired(batch.sparkSession, path, batch.schema, ts or key[-1], keep, unit=unit)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def spans_of(spark: SparkSession, path: str) -> list[str]:
    """The table's partitions, in order of time, from the listing of one folder."""
    fs, at = filesystem(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removeprefix("span=") for n in names if n.startswith("span="))


def drop_expired(spark: SparkSession, path: str, schema: StructType | str, ts: str, last: str = "1 HOUR", now: datetime | None = None, unit: str = "hour") -> list[str]:
    """Takes points older than an interval before now (else the newest point) out of storage, and returns the partitions that went.

    A partition goes by its name, with no data read; the one in which the interval begins is written anew without its expired points,
    staged first as in merge_points; later ones are not touched. The newest point is looked for in the last partition alone.
    """
    fs, staged = filesystem(spark, path)[0], f"{path}/_staged/expired"
    if fs.exists(filesystem(spark, f"{staged}/_SUCCESS")[1]):  # an earlier run broke off
        _replace_spans(spark, staged, path)
    spans = spans_of(spark, path)
    if not spans:
        return []
    points = read_points(spark, path, schema)
    end = F.max(at_time(points, ts)) if now is None else F.lit(now).cast("timestamp")
    cut = points.where(F.col("span") == spans[-1]).agg((end - F.expr(f"INTERVAL {last}")).alias("cut"))
    edge, cut = cut.select(F.date_format("cut", UNITS[unit]), F.unix_micros("cut")).first()
    gone = [h for h in spans if h < edge]
    if edge in spans:
        old = points.where(F.col("span") == edge)
        kept = F.unix_micros(at_time(points, ts)) >= cut
        n, n_kept = old.agg(F.count("*"), F.count_if(kept)).first()
        if not n_kept:
            gone.append(edge)
        elif n_kept < n:
            old.where(kept).write.mode("overwrite").partitionBy("span").parquet(staged)
            _replace_spans(spark, staged, path)
    for h in gone:
        fs.delete(filesystem(spark, f"{path}/span={h}")[1], True)
    return gone


def rollup(points: DataFrame, values: list[str], every: str = "1 second", ts: str = "ts", by: str = "symbol") -> DataFrame:
    """Sum and count of each value by series and bucket, the bucket named by its end in milliseconds. They are parts of a mean that merge with others.

    On a stream with a watermark, in update mode, each batch gives the buckets that it has changed, with all that they have so far.
    """
    parts = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("sum", F.sum), ("n", F.count))]
    rows = points.groupBy(by, F.window(ts, every).alias("w")).agg(*parts)
    return rows.select(by, F.unix_millis(F.col("w.end")).alias("bucket_end"), *(f"{name}_{v}" for v in values for name in ("sum", "n")))


def rollup_sink(stream: DataFrame, path: str, checkpoint: str, values: list[str], every: str = "1 second", ts: str = "ts", by: str = "symbol", unit: str = "hour") -> DataStreamWriter:
    """A running rollup of a stream with a watermark, kept in a table of points by series and bucket."""
    return point_sink(rollup(stream, values, every, ts, by), path, checkpoint, [by, "bucket_end"], unit=unit).outputMode("update")


def rollup_means(rolled: DataFrame, values: list[str], by: str = "symbol", every_ms: int | None = None) -> DataFrame:
    """Means by series and bucket from a rollup; every_ms merges its buckets into wider ones, a multiple of their width."""
    end = F.col("bucket_end") if every_ms is None else F.ceil(F.col("bucket_end") / F.lit(every_ms)) * every_ms
    sums = [(F.sum(f"sum_{v}") / F.nullif(F.sum(f"n_{v}"), F.lit(0))).alias(f"mean_{v}") for v in values]
    return rolled.groupBy(by, end.cast("long").alias("bucket_end")).agg(*sums)
