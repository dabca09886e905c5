"""Incremental intake of the landing zone: each file once, with the stream's checkpoint as the hand-off between jobs."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewater.functions.checksum import checksum
from tidewater.sources.points import filesystem

#: Hand-off of one batch: a row for each of its files.
HANDOFF = "source_file string, n_written long, latest_scraped_at timestamp, batch long"
TOTALS = "n_written long, n_bad_checksum long, first_scraped_at timestamp, latest_scraped_at timestamp, batch long"


#: Tasks of one listing of files or folders; Spark's own bound is 10,000, which makes it a task, and its metrics, for each.
LISTING_TASKS = 32


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside, and tables that are opened there, list many files in each task: a task tells the driver 3 KB of itself."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(LISTING_TASKS, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_envelopes(spark: SparkSession, glob: str, max_files: int = 1000) -> DataFrame:
    """A stream of whole files as read_envelopes gives them, at most max_files in a batch; the checkpoint of its query knows which ones were read."""
    with few_listing_tasks(spark):  # load looks at all that is there
        files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(glob)
    return files.select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))


def file_key(source_file: Column) -> Column:
    """A file's name as the name of a folder: short, whatever the name holds."""
    return F.substring(F.sha1(source_file), 1, 16)


def observed(seen: Observation, *names: str) -> dict:
    """What a write has counted; nulls where Spark knew beforehand that there is nothing to write, and so ran nothing that counts."""
    try:
        return seen.get
    except Py4JJavaError:
        return dict.fromkeys(names)


def append_once(df: DataFrame, path: str, kind: str = "news", ts: str = "scraped_at") -> dict:
    """Rows of whole files into partitions by day and file: files that are written again replace themselves, others of their days stay.

    Returns what the write has seen, counted by the write itself: rows, rows whose checksum is wrong or missing, first and last scrape time.
    A file's rows must all be in df, and on the same days as before. No rows change nothing.
    """
    seen = Observation()
    bad = ~F.col("checksum_sha256").eqNullSafe(checksum(kind))
    rows = df.withColumns({"scraped_day": F.to_date(ts), "file_key": file_key(F.col("source_file"))})
    rows = rows.observe(seen, F.count("*").alias("n_written"), F.count_if(bad).alias("n_bad_checksum"), F.min(ts).alias("first_scraped_at"), F.max(ts).alias("latest_scraped_at"))
    out = rows.hint("rebalance", "scraped_day", "file_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("scraped_day", "file_key").parquet(path)
    return {"n_written": 0, "n_bad_checksum": 0} | observed(seen, "first_scraped_at", "latest_scraped_at")


def scan_file(df: DataFrame, day: str, source_file: str) -> DataFrame:
    """Rows of one day and one file of a table that append_once wrote: one folder is read."""
    return df.where((F.col("scraped_day") == F.lit(day).cast("date")) & (F.col("file_key") == file_key(F.lit(source_file))) & (F.col("source_file") == source_file))


def take_in(stream: DataFrame, table: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame], rejects: Callable[[DataFrame], DataFrame] | None = None, kind: str = "news") -> DataStreamWriter:
    """A stream of files (source_path, value) through clean into the table rows below table, once each.

    For each batch, rejects may give what was refused, into rejected; handoff gets a row for each file, with no rows or some, and totals one
    with what the write counted. All of them are written by file or by batch number, so a batch that is retried, after a crash at whatever point,
    writes the same again. Which batch comes next is the checkpoint's to know: no job hands a list of files to another.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows = clean(batch)
            totals = append_once(rows, f"{table}/rows", kind)
            if rejects is not None:
                rejects(batch).write.mode("overwrite").parquet(f"{table}/rejected/batch={number}")
            counts = rows.groupBy("source_file").agg(F.count("*").alias("n_written"), F.max("scraped_at").alias("latest_scraped_at"))
            files = batch.select(F.col("source_path").alias("source_file")).join(counts, "source_file", "left").fillna(0, ["n_written"])
            files.write.mode("overwrite").parquet(f"{table}/handoff/batch={number}")
            one = spark.createDataFrame([tuple(totals[c] for c in ("n_written", "n_bad_checksum", "first_scraped_at", "latest_scraped_at"))], TOTALS.rpartition(", ")[0])
            one.coalesce(1).write.mode("overwrite").parquet(f"{table}/totals/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_part(spark: SparkSession, table: str, part: str, schema: str) -> DataFrame:
    """One of the tables that take_in writes; no rows while it isn't there."""
    fs, at = filesystem(spark, f"{table}/{part}")
    return spark.read.schema(schema).parquet(f"{table}/{part}") if fs.exists(at) else spark.createDataFrame([], schema)
