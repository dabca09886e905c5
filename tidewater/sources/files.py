"""Sources: whole files, tables, partitions, time ranges, topics."""

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = "value string, source_path string, source_file string"


def read_envelopes(spark: SparkSession, glob: str) -> DataFrame:
    """One row for each file: its text, full path and name. A glob without files gives an empty frame; other errors are raised."""
    try:
        files = spark.read.text(glob, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RAW_SCHEMA)
    return files.select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))


def input_objects(raw: DataFrame) -> DataFrame:
    """The different files of a scan. Jobs here handle a whole glob in one plan, so nothing loops over them."""
    return raw.select("source_path").distinct()


def scan_table(df: DataFrame, scraped_at: str | None = None, since: bool = False) -> DataFrame:
    """Rows of one scrape time, or from it on with since; no filter, or text that is no time, gives all rows.

    The day predicate beside it lets Parquet prune partitions.
    """
    if not scraped_at:
        return df
    try:
        at = datetime.fromisoformat(scraped_at.replace("Z", "+00:00"))
    except ValueError:
        return df
    at = F.lit(at.isoformat()).cast("timestamp")
    rows = df.where(F.col("scraped_at") >= at if since else F.col("scraped_at") == at)
    if "scraped_day" in df.columns:
        rows = rows.where(F.col("scraped_day") >= F.to_date(at) if since else F.col("scraped_day") == F.to_date(at))
    return rows


def scan_partition(df: DataFrame, day: str, source_file: str) -> DataFrame:
    """Rows of one day and one file; the day prunes partitions."""
    return df.where((F.col("scraped_day") == F.lit(day).cast("date")) & (F.col("source_file") == source_file))


def time_range(df: DataFrame, last: str, now: datetime | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the interval before now, e.g. '1 HOUR'; now is the clock unless it is given."""
    end = F.lit(now) if now is not None else F.current_timestamp()
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {last}")) & (F.col(ts) <= end))


def read_topic(spark: SparkSession, topic: str, servers: str, source: str = "kafka", **options: str) -> DataFrame:
    """A stream of a topic's messages as text. Kafka needs the connector's jar on the class path; with source text, a topic is a folder
    below servers, as publish() writes it."""
    if source == "text":
        return spark.readStream.schema("value string").options(**options).text(f"{servers}/{topic}")
    rows = spark.readStream.format(source).option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return rows.select(F.col("value").cast("string").alias("value"))
