"""Keep-latest, merge and distinct."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order. Spark's window group limit drops later rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_latest(base: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Table and batch together, missing columns as null, one row for each key."""
    return keep_latest(base.unionByName(batch, allowMissingColumns=True), key, order)


def latest_posts_order() -> list[Column]:
    """Last scrape, last creation, first title; the checksum makes the order total."""
    return [F.col("scraped_at").desc(), F.col("created_utc").desc(), F.col("title").asc(), F.col("checksum_sha256").asc()]


def newest_articles(df: DataFrame, position: str) -> DataFrame:
    """By id the article published last; of equally late ones, the first by position."""
    return keep_latest(df, ["id"], [F.col("published_at_utc").desc_nulls_last(), F.col(position).asc()])


def first_rows(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of a total order; each task keeps n of its own, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
