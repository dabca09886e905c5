"""Bars, ticks, articles, posts and media derived from the given tables: what the registered queries read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS, WIDTH_MS = 86_400_000, 600_000
KNOWN = [f"src{i}" for i in range(15)]
#: A file has the records of a hundred documents at most; files are scraped at four times.
PART, SCRAPED = "cast(doc_id DIV 100 AS int)", "1700003000 + ((doc_id DIV 100) % 4) * 60"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), t.alias("timestamp"), "value", "user_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "symbol", "timestamp", F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose volume grows over a day, from two sources."""
    rows = events(spark, sf_dir)
    volume = F.expr(f"sum(cast(ceil(value) AS bigint)) OVER (PARTITION BY symbol, floor(timestamp / {DAY_MS}) ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)")
    return rows.select("event_id", "symbol", "timestamp", volume.alias("volume"), F.expr("concat('exchange', user_id % 2)").alias("data_source"))


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS of_file", "doc_id", "CASE WHEN lang = 'es' AND doc_id % 23 = 0 THEN -doc_id ELSE doc_id END AS id",
        "CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS category", "1700000000 + doc_id * 10 AS datetime",
        "left(text, cast(8 + doc_id % 60 AS int)) AS headline", "source", "CASE WHEN doc_id % 5 <> 0 THEN text END AS summary",
        "concat(CASE WHEN doc_id % 9 = 0 THEN 'ftp' ELSE 'https' END, '://', source, '.example.com/', doc_id) AS url",
        "CASE doc_id % 4 WHEN 1 THEN '  ' WHEN 2 THEN 'not a url' WHEN 3 THEN 'http://img.example.com/x.png' END AS image",
        f"timestamp_seconds({SCRAPED}) AS scraped_at", f"{PART} AS part", f"concat('news/', lang, '/', {PART}) AS source_file", "cast(NULL AS string) AS related",
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(CASE WHEN doc_id % 19 = 0 THEN 'p_' ELSE 'p' END, doc_id) AS id", "CASE WHEN doc_id % 29 = 0 THEN '   ' ELSE left(text, 60) END AS title", "source AS author",
        "1700000000 + doc_id * 10.5D AS created_utc", "cast(doc_id % 13 - 3 AS int) AS score", "CASE WHEN doc_id % 31 = 0 THEN 'nourl' ELSE concat('ftp://x/', doc_id) END AS url",
        "CASE WHEN doc_id % 7 <> 0 THEN text END AS selftext", "cast(doc_id % 11 - 1 AS int) AS num_comments", "concat('/r/', lang, '/', doc_id) AS permalink",
        "cast((doc_id % 130 - 10) / 100.0D AS double) AS upvote_ratio", "CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 END AS is_original_content", "doc_id % 2 = 0 AS is_self", "lang AS subreddit",
        f"timestamp_seconds({SCRAPED}) AS scraped_at", f"{PART} AS part", f"concat('posts/', lang, '/', {PART}) AS source_file",
    )


def media_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('media_type', element_at(array('image', 'gif', 'video', 'other'), cast((doc_id + i) % 4 AS int) + 1), 'lz_url', concat('s3a://lz/reddit/x/', doc_id, '-', i, '.png'), 'source_url', 'u', 'filename', 'f', 'content_type', 'c')"
    items = f"transform(sequence(0, cast(doc_id % 4 AS int)), i -> {item})"
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"CASE WHEN doc_id % 5 <> 0 THEN slice({items}, 1, cast(doc_id % 4 AS int)) END AS media")


def media_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(sequence(0, 3)) AS i").where("(doc_id + i) % 6 <> 0")
    return rows.selectExpr(
        "concat('s3a://lz/reddit/x/', doc_id, '-', i, '.png') AS lz_url", "element_at(array('image/png', 'image/gif', 'video/mp4', 'image/jpeg', NULL), cast((doc_id + 2 * i) % 5 AS int) + 1) AS true_mime",
        "cast((doc_id * 7 + i) % 10 * 10000000 AS bigint) AS processed_bytes", "CASE WHEN (doc_id + i) % 11 = 0 THEN 'broken' END AS failure",
    )


def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CASE page_id % 8 WHEN 0 THEN concat('https://i.redd.it/', page_id, '.jpg') WHEN 1 THEN concat('https://imgur.com/', page_id) WHEN 2 THEN concat('https://v.redd.it/', page_id) "
        "WHEN 3 THEN concat('https://gfycat.com/', page_id) WHEN 4 THEN concat(url, '.png') WHEN 5 THEN url WHEN 6 THEN concat('https://example.com/', page_id, '.MP4') ELSE '' END AS url",
    )


# The same in DuckDB's SQL.
_SCRAPED = SCRAPED.replace("DIV", "//")
EVENTS_SQL = f"""ev AS (SELECT event_id, event_type AS symbol, epoch_us(ts) // 1000 AS "timestamp", value, user_id FROM events),
ticks AS (SELECT event_id, symbol, "timestamp", value AS price FROM ev),
bars AS (SELECT event_id, symbol, "timestamp", CAST(sum(CAST(ceil(value) AS BIGINT)) OVER (PARTITION BY symbol, "timestamp" // {DAY_MS} ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS volume, 'exchange' || user_id % 2 AS data_source FROM ev),
lagged AS (SELECT *, coalesce(lag(volume) OVER w, 0) AS pv, coalesce(lag("timestamp") OVER w, 0) AS pt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp", event_id)),
volumes AS (SELECT event_id, symbol, "timestamp", data_source, CASE WHEN volume >= pv AND "timestamp" > pt THEN volume - pv ELSE volume END AS per_tick_volume FROM lagged)"""
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NEWS_SQL = rf"""raw AS (SELECT lang AS of_file, doc_id, CASE WHEN lang = 'es' AND doc_id % 23 = 0 THEN -doc_id ELSE doc_id END AS id,
CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS category, 1700000000 + doc_id * 10 AS dt,
{_TRIM.format("substr(text, 1, 8 + doc_id % 60)")} AS headline, source, CASE WHEN doc_id % 5 <> 0 THEN {_TRIM.format("text")} ELSE '' END AS summary,
(CASE WHEN doc_id % 9 = 0 THEN 'ftp' ELSE 'https' END) || '://' || source || '.example.com/' || doc_id AS url,
CASE WHEN doc_id % 4 = 3 THEN 'http://img.example.com/x.png' END AS image_url, 'news/' || lang || '/' || doc_id // 100 AS source_file, doc_id // 100 AS part, {_SCRAPED} AS scraped FROM documents),
news AS (SELECT *, CASE WHEN id < 0 THEN 'id' WHEN lower(category) <> lower(of_file) THEN 'category' WHEN dt > scraped + 3600 THEN 'datetime' WHEN length(headline) < 10 THEN 'headline'
WHEN source NOT IN ({", ".join(f"'{s}'" for s in KNOWN)}) THEN 'source' WHEN url LIKE 'ftp%' THEN 'url' END AS reject_reason FROM raw),
articles AS (SELECT *, sha256(CAST(to_json({{'category': category, 'headline': headline, 'id': id, 'image_url': image_url, 'published_at_utc': strftime(to_timestamp(dt) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'),
'scraped_at': strftime(to_timestamp(scraped) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), 'source': source, 'source_file': source_file, 'summary': summary, 'url': url}}) AS VARCHAR)) AS checksum_sha256 FROM news WHERE reject_reason IS NULL)"""
POSTS_SQL = rf"""raw AS (SELECT doc_id, (CASE WHEN doc_id % 19 = 0 THEN 'p_' ELSE 'p' END) || doc_id AS id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE {_TRIM.format("substr(text, 1, 60)")} END AS title, source AS author,
1700000000 + doc_id * 10.5 AS created, greatest(doc_id % 13 - 3, 0) AS score, CASE WHEN doc_id % 31 = 0 THEN 'nourl' ELSE 'ftp://x/' || doc_id END AS url, CASE WHEN doc_id % 7 <> 0 THEN {_TRIM.format("text")} END AS selftext,
greatest(doc_id % 11 - 1, 0) AS num_comments, '/r/' || lang || '/' || doc_id AS permalink, least(greatest(CAST((doc_id % 130 - 10) / 100 AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS upvote_ratio,
CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 ELSE false END AS is_original_content, doc_id % 2 = 0 AS is_self, lang AS subreddit, 'posts/' || lang || '/' || doc_id // 100 AS source_file, doc_id // 100 AS part, {_SCRAPED} AS scraped FROM documents),
posts AS (SELECT *, CASE WHEN doc_id % 19 = 0 THEN 'id' WHEN length(title) < 1 THEN 'title' WHEN created > scraped + 3600 THEN 'created_utc' WHEN url = 'nourl' THEN 'url' END AS reject_reason FROM raw)"""
