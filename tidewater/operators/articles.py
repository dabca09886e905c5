"""News articles: rules, cleaning, checksum, target schema."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions.checksum import checksum
from tidewater.functions.text import clean_string, epoch_to_timestamp
from tidewater.sources.envelope import explode_records, validate_envelopes

# Field names of an article, stored and raw.
ARTICLE = ["id", "category", "published_at_utc", "headline", "source", "summary", "url", "image_url", "scraped_at", "source_file", "checksum_sha256"]
REQUIRED = ["id", "category", "published_at_utc", "headline", "source", "url", "scraped_at", "source_file", "checksum_sha256"]
RAW_FIELDS = ["id", "category", "datetime", "headline", "source", "summary", "url", "image", "related"]


def project_news(items: DataFrame, *keep: str) -> DataFrame:
    """The nine fields that ingestion keeps, and the columns in keep."""
    return items.select(*keep, *RAW_FIELDS)


def clean_articles(df: DataFrame, of_file: Column, known: list[str] | None = None) -> DataFrame:
    """df (raw fields and scraped_at) with cleaned columns and reject_reason, the first rule that fails; null if none does."""
    reason = R.first_failure(
        ("id", R.valid_id(F.col("id"))), ("category", R.same_category(F.col("category"), of_file)), ("datetime", R.valid_epoch(F.col("datetime"), F.col("scraped_at"))),
        ("headline", R.min_length(F.col("headline"), R.MIN_HEADLINE)), ("source", R.known_source(F.col("source"), known)), ("url", R.web_url(F.col("url"))),
    )
    return df.withColumn("reject_reason", reason).withColumns({
        "category": clean_string(F.col("category")), "published_at_utc": F.when(F.col("datetime") >= 0, epoch_to_timestamp(F.col("datetime"))), "headline": clean_string(F.col("headline")),
        "source": clean_string(F.col("source")), "url": clean_string(F.col("url")), "image_url": R.image_url(F.col("image")), "summary": R.summary_text(F.col("summary")),
    })


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reject_reason IS NULL")


def rejected(df: DataFrame) -> DataFrame:
    """The quarantine: records with the rule that they broke."""
    return df.where("reject_reason IS NOT NULL")


def finish_articles(df: DataFrame, compat: bool = False) -> DataFrame:
    """Checksum and target columns."""
    return df.withColumn("checksum_sha256", checksum("news", compat)).select(*ARTICLE)


def articles_from_files(raw: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Articles of all valid files in raw (value, source_path), each different row once, in one plan."""
    files = validate_envelopes(raw, "news").where("envelope_ok")
    rows = explode_records(files, "news", keep=["source_path"]).select("source_path", "scraped_at", F.col("meta.category").alias("of_file"), "record.*")
    rows = accepted(clean_articles(rows.withColumnRenamed("source_path", "source_file"), F.col("of_file"), known))
    return finish_articles(rows).dropDuplicates()
