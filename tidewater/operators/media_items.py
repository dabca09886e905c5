"""Media items of posts against a table of what is known about their content."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import media as M

FACTS = "lz_url string, true_mime string, processed_bytes long, failure string"
_ITEM = ["media_type", "lz_url", "source_url", "filename", "content_type", "tz_url", "tz_format", "tz_size_bytes", "validation_error", "conversion_error", "size_error"]


def media_facts(files: DataFrame, max_bytes: int = M.MAX_BYTES) -> DataFrame:
    """Facts from binary files (path, content): true type and size. Bytes that are too few count as a failure."""
    return files.select(
        F.col("path").alias("lz_url"), M.sniff_mime(F.col("content")).alias("true_mime"), F.octet_length("content").cast("long").alias("processed_bytes"),
        F.when(~M.large_enough(F.col("content")), "content too small").alias("failure"),
    )


def facts_of_files(spark: SparkSession, path: str, max_bytes: int = M.MAX_BYTES) -> DataFrame:
    """Facts about the binary files below path. Whether a file is too large is told by its length, before any of its content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > max_bytes)
    too_large = F.lit(f"exceeds limit of {max_bytes} bytes").alias("failure")
    rows = large.select(F.col("path").alias("lz_url"), F.lit(None).cast("string").alias("true_mime"), F.col("length").alias("processed_bytes"), too_large)
    return media_facts(files.where(F.col("length") <= max_bytes)).unionByName(rows)


def judged_item(item: Column, mime: Column, size: Column, failure: Column, bucket: str, max_bytes: int) -> Column:
    """An item with its processed address and three error columns, of which the first failure alone is set."""
    kind, fmt = item["media_type"], M.target_format(item["media_type"])
    invalid = F.when(mime.isNull(), "content not found or of unknown type").when(~M.valid_type(kind, mime), F.concat(F.lit("content is "), mime, F.lit(", not "), kind))
    unmade = F.when(invalid.isNull(), F.coalesce(failure, F.when(fmt.isNull(), F.lit("no target format"))))
    too_large = F.when(invalid.isNull() & unmade.isNull() & (size > max_bytes), F.concat(F.lit("exceeds limit of "), F.lit(str(max_bytes)), F.lit(" bytes")))
    good = invalid.isNull() & unmade.isNull() & too_large.isNull()
    key = M.processed_key(F.regexp_replace(item["lz_url"], r"^s3a?://[^/]+/", ""), fmt)
    return F.struct(
        *(item[c].alias(c) for c in _ITEM[:5]), F.when(good, M.object_url(bucket, key)).alias("tz_url"), F.when(good, fmt).alias("tz_format"), F.when(good, size).alias("tz_size_bytes"),
        invalid.alias("validation_error"), unmade.alias("conversion_error"), too_large.alias("size_error"),
    )


def one_fact(facts: DataFrame) -> DataFrame:
    """One row for each address: of several, the first in the order of its columns."""
    return facts.groupBy("lz_url").agg(F.min(F.struct("true_mime", "processed_bytes", "failure")).alias("_fact")).select("lz_url", "_fact.*")


def judge_media(posts: DataFrame, facts: DataFrame, key: list[str], bucket: str = "trusted-zone", max_bytes: int = M.MAX_BYTES) -> DataFrame:
    """key, pos and item for each media item of posts; null items are skipped. Items meet facts in a join on their address."""
    items = posts.select(*key, F.posexplode("media").alias("pos", "item")).where("item IS NOT NULL")
    rows = items.join(one_fact(facts), items["item.lz_url"] == F.col("lz_url"), "left")
    return rows.select(*key, "pos", judged_item(F.col("item"), F.col("true_mime"), F.col("processed_bytes"), F.col("failure"), bucket, max_bytes).alias("item"))


def process_media(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """posts with media_items: null for null media, else its items without any error, in order, maybe none.

    What becomes of a list depends on the list alone, so each different list is judged once, whatever posts have it: posts with
    the same id, and whole posts that repeat, keep their own items.
    """
    digest = F.sha2(F.to_json("media", {"ignoreNullFields": "false"}), 256)
    lists = posts.where("media IS NOT NULL").select(digest.alias("_list"), "media").dropDuplicates(["_list"])
    judged = judge_media(lists, facts, ["_list"]).where("item.tz_url IS NOT NULL").groupBy("_list").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_made"))
    kind = judged.schema["_made"].dataType.elementType["item"].dataType.simpleString()
    items = F.coalesce(F.transform("_made", lambda x: x["item"]), F.array().cast(f"array<{kind}>"))
    rows = posts.withColumn("_own", digest).join(judged, F.col("_own") == F.col("_list"), "left")
    return rows.select(*posts.columns, F.when(F.col("media").isNotNull(), items).alias("media_items"))
