"""Social posts: rules, cleaning, checksum, target schema."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions.checksum import checksum
from tidewater.functions.text import clean_string, epoch_to_timestamp
from tidewater.operators.articles import accepted
from tidewater.operators.media_items import process_media
from tidewater.sources.envelope import explode_records, validate_envelopes

# Field names of a post, stored and raw.
POST = ["id", "title", "author", "created_utc", "score", "url", "selftext", "num_comments", "permalink", "upvote_ratio", "is_original_content", "is_self", "subreddit", "scraped_at", "source_file", "checksum_sha256", "media_items"]
REQUIRED = [c for c in POST if c not in ("selftext", "media_items")]
RAW_FIELDS = ["id", "title", "author", "created_utc", "score", "url", "selftext", "num_comments", "permalink", "upvote_ratio", "is_original_content", "is_self"]


def project_posts(items: DataFrame, *keep: str) -> DataFrame:
    """The twelve fields that ingestion keeps, and the columns in keep."""
    return items.select(*keep, *RAW_FIELDS)


def clean_posts(df: DataFrame) -> DataFrame:
    """df (raw fields and scraped_at) with cleaned columns and reject_reason, the first rule that fails."""
    reason = R.first_failure(
        ("id", R.alphanumeric(F.col("id"))), ("title", R.min_length(F.col("title"))), ("author", R.min_length(F.col("author"))),
        ("created_utc", R.valid_epoch(F.col("created_utc"), F.col("scraped_at"))), ("url", R.any_url(F.col("url"))), ("permalink", R.min_length(F.col("permalink"))),
    )
    return df.withColumn("reject_reason", reason).withColumns({
        "title": clean_string(F.col("title")), "author": clean_string(F.col("author")), "created_utc": F.when(F.col("created_utc") >= 0, epoch_to_timestamp(F.col("created_utc"))),
        "url": clean_string(F.col("url")), "permalink": clean_string(F.col("permalink")), "score": R.count_or_zero(F.col("score")), "num_comments": R.count_or_zero(F.col("num_comments")),
        "selftext": clean_string(F.col("selftext")), "upvote_ratio": R.unit_ratio(F.col("upvote_ratio")), "is_original_content": R.flag(F.col("is_original_content")), "is_self": R.flag(F.col("is_self")),
    })


def finish_posts(df: DataFrame, compat: bool = False) -> DataFrame:
    return df.withColumn("checksum_sha256", checksum("posts", compat)).select(*POST)


def media_stats(posts: DataFrame) -> DataFrame:
    """How many posts have media, and how many items there are; an empty list counts as having media."""
    n: Column = F.when(F.col("media").isNull(), 0).otherwise(F.size("media"))
    return posts.agg(F.count_if(F.col("media").isNotNull()).alias("posts_with_media"), F.coalesce(F.sum(n), F.lit(0)).alias("total_media_items"))


def posts_from_files(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Posts of all valid files in raw (value, source_file), media processed against facts, in one plan."""
    files = validate_envelopes(raw, "posts").where("envelope_ok")
    rows = explode_records(files, "posts", keep=["source_file"]).select("source_file", "scraped_at", F.col("meta.subreddit").alias("subreddit"), "record.*")
    return finish_posts(process_media(accepted(clean_posts(rows)), facts))
