"""SHA-256 checksums over a canonical JSON form of a record."""

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewater.functions.text import iso_micros, iso_seconds

# The keys of each payload, in order.
NEWS_KEYS = ["category", "headline", "id", "image_url", "published_at_utc", "scraped_at", "source", "source_file", "summary", "url"]
POST_KEYS = ["author", "created_utc", "id", "is_original_content", "is_self", "num_comments", "permalink", "score", "selftext", "subreddit", "scraped_at", "title", "upvote_ratio", "url", "source_file"]
KEYS = {"news": NEWS_KEYS, "posts": POST_KEYS}


def payload(kind: str) -> Column:
    """The record's checksum fields as a struct; times as text, to the microsecond for news, to the second for posts."""
    as_text = iso_micros if kind == "news" else iso_seconds
    times = {"published_at_utc", "created_utc", "scraped_at"}
    return F.struct(*((as_text(F.col(k)) if k in times else F.col(k)).alias(k) for k in KEYS[kind]))


def checksum(kind: str, compat: bool = False) -> Column:
    """Hex SHA-256 of the payload as compact JSON with nulls kept.

    compat escapes other than ASCII characters and prints numbers as Python's json does; it runs in Python, in Arrow
    batches, and only matters where such hashes already exist.
    """
    if compat:
        return _python_json(F.to_json(payload(kind), {"ignoreNullFields": "false"}))
    return F.sha2(F.to_json(payload(kind), {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(StringType())
def _python_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), separators=(",", ":")).encode()).hexdigest(), na_action="ignore")
