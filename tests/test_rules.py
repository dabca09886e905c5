"""Boundaries of the record rules, the file gate and the media tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import media as M
from tidewater.functions.checksum import checksum
from tidewater.functions.text import clean_string, is_uri, is_web_uri, parse_iso
from tidewater.operators import articles, media_items, posts, verify
from tidewater.sources.envelope import build_envelopes, envelope_key, kept_time_filter, validate_envelopes
from tidewater.sources import sinks
from tidewater.sources.files import read_envelopes

SCRAPED = 1_700_000_000
ARTICLE = {"id": 1, "category": "crypto", "datetime": SCRAPED, "headline": "ten chars!", "source": "Decrypt", "summary": " s ", "url": "https://a.b/c", "image": "http://i.j/k.png"}
NEWS = "id long, category string, datetime long, headline string, source string, summary string, url string, image string"


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), ({"id": -1}, "id"), ({"id": None}, "id"), ({"category": " CRYPTO "}, None), ({"category": "forex"}, "category"), ({"category": None}, "category"),
        ({"datetime": SCRAPED + 3600}, None), ({"datetime": SCRAPED + 3601}, "datetime"), ({"datetime": -1}, "datetime"), ({"headline": " nine char "}, "headline"),
        ({"source": "decrypt"}, "source"), ({"url": "ftp://a.b"}, "url"), ({"url": "https:///x"}, "url"), ({"summary": None}, None), ({"image": "  "}, None),
    ],
)
def test_article(spark, change, reason):
    row = ARTICLE | change
    df = spark.createDataFrame([tuple(row.values())], NEWS).withColumn("scraped_at", F.timestamp_seconds(F.lit(SCRAPED)))
    got = articles.clean_articles(df, F.lit("Crypto")).first()
    assert got["reject_reason"] == reason
    assert got["summary"] == (row["summary"] or "").strip()
    assert got["image_url"] == (row["image"] if row["image"].strip() else None)


def news(**item):
    return json.dumps({"metadata": {"category": "c", "article_count": 1, "scraped_at": "2024-01-01T00:00:00"}, "news": [ARTICLE | item]})


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        (news(), True), (news(id=-1), False), (news(id="1"), False), (news(id=1.0), True), (news(id=1.5), False), (news(headline=""), False), (news(image=None), False), (news(url=5), False),
        ("{", False), ("[]", False), (None, False), (json.dumps({"metadata": {"category": "c", "article_count": 0, "scraped_at": "x"}, "news": []}), True),
        (json.dumps({"metadata": {"category": "c", "article_count": 0, "scraped_at": "x"}}), False), (json.dumps({"metadata": {"article_count": 0, "scraped_at": "x"}, "news": []}), False),
    ],
)
def test_news_gate(spark, text, ok):
    assert validate_envelopes(spark.createDataFrame([(text,)], "value string"), "news").first()["envelope_ok"] is ok


POST = {
    "id": "post123", "title": "Test Post", "author": "testuser", "created_utc": 1617235200, "score": -4, "url": "https://example.com/post123", "selftext": "", "num_comments": 42, "permalink": "/r/x",
    "upvote_ratio": 0.95, "is_original_content": True, "is_self": False,
}


@pytest.mark.parametrize(
    ("change", "ok"),
    [({}, True), ({"id": "test_id_1"}, False), ({"upvote_ratio": 1.5}, False), ({"upvote_ratio": 1}, True), ({"num_comments": -1}, False), ({"is_self": 0}, False), ({"title": ""}, False), ({"title": "こんにちは世界"}, True)],
)
def test_post_gate(spark, change, ok):
    meta = {"subreddit": "s", "sort_by": "new", "time_filter": None, "post_count": 1, "scraped_at": "2024-01-01T00:00:00"}
    text = json.dumps({"metadata": meta, "posts": [POST | change]})
    assert validate_envelopes(spark.createDataFrame([(text,)], "value string"), "posts").first()["envelope_ok"] is ok


def test_post_cleaning(spark):
    schema = "id string, title string, author string, created_utc double, score int, url string, selftext string, num_comments int, permalink string, upvote_ratio double, is_original_content boolean, is_self boolean"
    rows = [tuple((POST | c).values()) for c in ({}, {"upvote_ratio": 2.0}, {"upvote_ratio": None, "is_self": None}, {"url": "ftp://x/y"}, {"url": "x"}, {"id": "日本1"}, {"author": " "})]
    rows = [tuple(float(v) if k in ("created_utc", "upvote_ratio") and v is not None else v for k, v in zip(POST, r, strict=True)) for r in rows]
    got = posts.clean_posts(spark.createDataFrame(rows, schema).withColumn("scraped_at", F.timestamp_seconds(F.lit(SCRAPED)))).collect()
    assert [r["reject_reason"] for r in got] == [None, None, None, None, "url", None, "author"]
    assert [r["upvote_ratio"] for r in got[:3]] == [0.95, 1.0, 0.0] and got[0]["score"] == 0 and got[2]["is_self"] is False


def test_text(spark):
    df = spark.createDataFrame([("  a b \n",), (None,), ("HTTP://h",), ("http://",), ("mailto:x",), ("2024-01-01T00:00:00Z",)], "s string")
    s = F.col("s")
    got = df.select(clean_string(s).alias("c"), is_web_uri(s).alias("w"), is_uri(s).alias("u"), parse_iso(s).alias("t")).collect()
    assert got[0]["c"] == "a b" and got[1]["c"] is None
    assert [r["w"] for r in got] == [False, False, True, False, False, False] and [r["u"] for r in got] == [False, False, True, False, False, False]
    assert got[5]["t"] is not None and got[2]["t"] is None


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://i.redd.it/example.jpg", "image"), ("https://i.redd.it/example.gif", "gif"), ("https://v.redd.it/example", "video"), ("https://imgur.com/example", "image"), ("https://gfycat.com/example", "gif"),
        ("https://example.com/image.jpg", "image"), ("https://example.com/video.mp4", "video"), ("https://example.com/page.html", None), ("", None), (None, None),
    ],
)
def test_media_type(spark, url, kind):
    got = spark.createDataFrame([(url,)], "u string").select(M.media_type(F.col("u")).alias("k"), M.file_extension(F.col("u"), F.lit("gif")).alias("e")).first()
    assert got["k"] == kind


def test_signatures_and_keys(spark):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF0000WEBP", b"\x00\x00\x00\x18ftypmp42", b"\x1a\x45\xdf\xa3", b"RIFF0000AVI ", b"text", None]
    got = spark.createDataFrame([(bytearray(h) if h else None,) for h in heads], "b binary").select(M.sniff_mime(F.col("b")).alias("m"), M.large_enough(F.col("b")).alias("l")).collect()
    assert [r["m"] for r in got] == ["image/jpeg", "image/png", "image/gif", "image/webp", "video/mp4", "video/webm", "video/x-msvideo", None, None] and not any(r["l"] for r in got)
    row = spark.range(1).select(M.processed_key(F.lit("reddit/a/images/x.y.png"), F.lit("jpeg")).alias("p"), M.object_key(F.lit("ask"), F.lit("image"), F.lit("f.jpg"), F.lit("daily")).alias("k"),
        envelope_key("reddit", F.lit("AskReddit"), F.lit("2023-04-01 12:30:45").cast("timestamp"), "daily").alias("e"), kept_time_filter(F.lit("new"), F.lit("day")).alias("t")).first()
    assert tuple(row) == ("processed_media/reddit/a/images/x.y.jpeg", "reddit/daily/ask/images/f.jpg", "reddit/daily/askreddit/20230401_123045.json", None)


def test_media_stats(spark):
    rows = [([1],), ([1, 2],), (None,), (None,), ([1, 2, 3],)]
    assert tuple(posts.media_stats(spark.createDataFrame(rows, "media array<int>")).first()) == (3, 6)
    assert tuple(posts.media_stats(spark.createDataFrame([], "media array<int>")).first()) == (0, 0)


def test_media_of_repeated_posts(spark):
    """Posts with one key, and whole posts that repeat, keep their own items; facts that repeat count once."""
    item = "struct<media_type:string,lz_url:string,source_url:string,filename:string,content_type:string>"
    one, other = ("image", "s3a://lz/a.png", "u", "f", None), ("image", "s3a://lz/b.png", "u", "f", "c")
    posts_ = spark.createDataFrame([(1, [one]), (1, [other]), (1, [one]), (2, [one, None, other]), (3, []), (4, None)], f"id int, media array<{item}>")
    facts = spark.createDataFrame([("s3a://lz/a.png", "image/png", 5, None)] * 2 + [("s3a://lz/b.png", "image/png", 5, None)], media_items.FACTS)
    got = media_items.process_media(posts_, facts)
    rows = sorted((r["id"], None if r["media_items"] is None else [x["lz_url"][-5] for x in r["media_items"]]) for r in got.collect())
    assert rows == [(1, ["a"]), (1, ["a"]), (1, ["b"]), (2, ["a", "b"]), (3, []), (4, None)] and got.columns == ["id", "media", "media_items"]


def test_verify_write(spark):
    """A missing checksum is a bad one, and files that weren't expected are told."""
    row = {"category": "c", "headline": "h", "id": 1, "image_url": None, "published_at_utc": None, "scraped_at": None, "source": "s", "summary": "", "url": "u"}
    schema = "category string, headline string, id long, image_url string, published_at_utc timestamp, scraped_at timestamp, source string, summary string, url string, source_file string"
    rows = spark.createDataFrame([(*row.values(), f) for f in ("a", "b", "x")], schema).withColumn("checksum_sha256", checksum("news"))
    rows = rows.withColumn("checksum_sha256", F.when(F.col("source_file") != "b", F.col("checksum_sha256")))
    expected = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("none", 0, 0)], "source_file string, n_clean long, n_expected long")
    got = {r["source_file"]: (r["n_written"], r["n_bad_checksum"], r["count_ok"], r["checksum_ok"]) for r in verify.verify_write(rows, expected, "news").collect()}
    assert got == {"a": (1, 0, True, True), "b": (1, 1, True, False), "none": (0, 0, True, True), "x": (1, 0, False, True)}


def test_landing_layout(spark, tmp_path):
    """Golden keys of the landing layout, as files; a second write of a file is an error."""
    records = spark.createDataFrame([(1, "AskReddit"), (2, "AskReddit"), (3, "News")], "id long, g string")
    at = F.lit("2023-04-01 12:30:45").cast("timestamp")
    files = build_envelopes(records.withColumn("p", (F.col("id") % 2 == 0).cast("int")), "news", "g", ["id"], at, part="p")
    sinks.write_envelopes(files, f"file://{tmp_path}", envelope_key("reddit", F.col("g"), at, "daily", F.col("p")))
    found = sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.json"))
    assert found == ["reddit/daily/askreddit/20230401_123045-1.json", "reddit/daily/askreddit/20230401_123045.json", "reddit/daily/news/20230401_123045.json"]
    assert json.loads((tmp_path / found[1]).read_text())["metadata"] == {"category": "AskReddit", "article_count": 1, "scraped_at": "2023-04-01T12:30:45"}
    assert not list(tmp_path.glob("_making*")) and read_envelopes(spark, f"file://{tmp_path}/reddit/daily/*/*.json").count() == 3


def test_compat_checksum(spark):
    import hashlib

    row = {"author": "é", "created_utc": "2021-04-01T00:00:00Z", "id": "a", "is_original_content": True, "is_self": False, "num_comments": 1, "permalink": "p", "score": 2, "selftext": None, "subreddit": "s", "scraped_at": "2021-04-01T00:00:00Z", "title": "t", "upvote_ratio": 0.5, "url": "u", "source_file": "f"}
    df = spark.createDataFrame([tuple(row.values())], "author string, created_utc string, id string, is_original_content boolean, is_self boolean, num_comments int, permalink string, score int, selftext string, subreddit string, scraped_at string, title string, upvote_ratio double, url string, source_file string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_utc", "scraped_at")})
    got = df.select(checksum("posts", compat=True).alias("c"), checksum("posts").alias("n")).first()
    assert got["c"] == hashlib.sha256(json.dumps(row, separators=(",", ":")).encode()).hexdigest()
    assert got["n"] == hashlib.sha256(json.dumps(row, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_missing_files_and_empty_groups(spark, tmp_path):
    assert read_envelopes(spark, f"{tmp_path}/nothing/*.json").columns == ["value", "source_path", "source_file"]
    assert read_envelopes(spark, f"{tmp_path}/nothing/*.json").isEmpty()
    empty = spark.createDataFrame([], NEWS + ", g string")
    assert build_envelopes(empty, "news", "g", ["id"], F.current_timestamp()).isEmpty()
    assert verify.all_verified(spark.createDataFrame([], "count_ok boolean, checksum_ok boolean, n_written long")).first()["verified"] is True
