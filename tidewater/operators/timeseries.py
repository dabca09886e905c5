"""Time-series queries of a dashboard."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.files import time_range


def bucket_mean(df: DataFrame, value: str, every: str = "1 second", ts: str = "ts", by: str = "symbol") -> DataFrame:
    """Mean by series and bucket, named by the bucket's end; empty buckets give no rows."""
    return df.groupBy(by, F.window(ts, every).alias("w")).agg(F.avg(value).alias(f"mean_{value}")).select(by, F.col("w.end").alias("bucket_end"), f"mean_{value}")


def series_names(vwap: DataFrame, now: datetime | None = None, last: str = "1 HOUR") -> DataFrame:
    return time_range(vwap, last, now).select("symbol", "data_source").distinct()


def mean_latency(ticks: DataFrame, now: datetime | None = None, last: str = "5 MINUTES", every: str = "1 second") -> DataFrame:
    return bucket_mean(time_range(ticks, last, now), "latency_ms", every)


def mean_price(ticks: DataFrame, now: datetime | None = None, last: str = "1 HOUR", every: str = "1 second") -> DataFrame:
    return bucket_mean(time_range(ticks, last, now), "price", every)


def vwap_series(vwap: DataFrame, now: datetime | None = None, last: str = "1 HOUR") -> DataFrame:
    return time_range(vwap, last, now).select("symbol", "ts", "vwap").orderBy("symbol", "ts")
