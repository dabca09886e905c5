"""Exact dedup: sorted runs of digests merged in a tree."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import documents, mark, stored, table, without

#: Runs at most, and runs joined in one merge (four binomial rounds at once).
RUNS, FAN_IN = 4096, 16
_KEY = ["text_sha256", "n_bytes", "check_hash"]


def normalised(text: Column) -> Column:
    """Each stretch of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def merged_runs(first: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One run of all digests from first (run, key, least, place, n), in which a run has a digest once.

    In each round, fan_in neighbouring runs are dealt by digest and merged in sorted order; of a digest's rows, at most one from each
    run, the first is kept: the smallest identifier, verified by length and a second hash. What a round leaves is sorted, so that the
    next one sorts runs that are in order already, which is a merge of them. No round puts a whole run or group into one task.
    """
    merged, left = first, runs
    while left > 1:
        merged = merged.withColumn("run", (F.col("run") / fan_in).cast("int"))
        order = Window.partitionBy("run", *_KEY).orderBy(F.col("least").asc_nulls_last(), "place")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = merged.withColumns({"n": F.sum("n").over(whole), "nth": F.row_number().over(order)}).where("nth = 1").drop("nth")
        left = -(-left // fan_in)
    return merged


def _grouped(docs: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """exact_groups with the mark of each row's own text."""
    text = normalised(F.col("text"))
    rows = documents(docs).select("doc_id", mark(F.col("text")).alias("mark"), text.alias("text")).select(
        "doc_id",
        "mark",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("check_hash"),
        (F.spark_partition_id() % runs).alias("run"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = stored(rows)  # fixes runs and places
    place = F.coalesce(F.min_by("place", "doc_id"), F.min("place")).alias("place")
    first = rows.groupBy("run", *_KEY).agg(F.min("doc_id").alias("least"), place, F.count("*").alias("n"))
    kept = merged_runs(first, runs, fan_in).select(*_KEY, F.col("least").alias("keep_id"), F.col("place").alias("keep_place"), F.col("n").alias("group_size"))
    known = stored(first.select("run", *_KEY).join(stored(kept), _KEY))
    return rows.join(known, ["run", *_KEY]).select("doc_id", "mark", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    Each scan partition is a run; runs are merged as merged_runs says. A group with a third of all rows has one row for each
    run, so neither the rounds nor the way back to the documents meets a hot key.

    Null texts count as empty. A null doc_id never is the smallest unless all of a group are null; then keep_id is null.
    kept marks one row of each group: the one with the smallest doc_id, and where several have that id (or none has one), any one of
    them. Further columns aren't read. An empty table gives an empty result.
    """
    return _grouped(docs, runs, fan_in).drop("mark")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each different text, all columns carried: the row with the smallest doc_id, as exact_groups marks it.

    Null ids sort last, rows alike in id and text leave one, null texts are empty ones; columns of any name stay; an empty table gives
    an empty result.
    """
    rows = stored(_grouped(docs).select("doc_id", "mark", "kept"))
    pairs = rows.groupBy("doc_id", "mark").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    pairs = stored(pairs.where("NOT kept OR n > 1"))
    return without(docs, pairs.where("NOT kept"), pairs.where("kept"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
