"""Reports and gates around a write."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.checksum import checksum


def batch_summary(written: DataFrame) -> DataFrame:
    """Rows and last scrape time by file: what the next job needs to go on from."""
    return written.groupBy("source_file").agg(F.count("*").alias("n_written"), F.max("scraped_at").alias("latest_scraped_at"))


def high_watermark(written: DataFrame) -> DataFrame:
    """The first and last scrape time of a batch; a consumer that reads from the first on misses no file."""
    return written.agg(F.min("scraped_at").alias("first_scraped_at"), F.max("scraped_at").alias("latest_scraped_at"))


def verify_write(stored: DataFrame, expected: DataFrame, kind: str) -> DataFrame:
    """One row for each file of expected (source_file, n_clean, n_expected) or stored: rows stored, rows whose checksum fails, and verdicts.

    All rows are rehashed, not a sample; a missing checksum is a bad one. A file of which nothing was expected passes without a checksum
    test, but its count fails if it has rows, and so it does for files that expected doesn't name.
    n_dropped tells how many duplicates the write left out.
    """
    bad = ~F.col("checksum_sha256").eqNullSafe(checksum(kind))
    found = stored.groupBy("source_file").agg(F.count("*").alias("n_written"), F.count_if(bad).alias("n_bad_checksum"))
    rows = expected.join(found, "source_file", "full").fillna(0, ["n_clean", "n_expected", "n_written", "n_bad_checksum"])
    return rows.select(
        "source_file", "n_clean", "n_expected", "n_written", "n_bad_checksum", (F.col("n_clean") - F.col("n_written")).alias("n_dropped"),
        (F.col("n_written") == F.col("n_expected")).alias("count_ok"), ((F.col("n_expected") == 0) | (F.col("n_bad_checksum") == 0)).alias("checksum_ok"),
    )


def all_verified(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and(F.col("count_ok") & F.col("checksum_ok")), F.lit(True)).alias("verified"), F.sum("n_written").alias("n_written"))


def gate(df: DataFrame, required: list[str], key: list[str] | None = None, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """rule and n_bad for each constraint of a table: not null, values of an enumeration, unique key."""
    checks: list[tuple[str, Column]] = [(f"not_null:{c}", F.count_if(F.col(c).isNull())) for c in required]
    checks += [(f"enum:{c}", F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(values))) for c, values in (enums or {}).items()]
    row = df.agg(*(c.alias(name) for name, c in checks))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n_bad")) for name, _ in checks))).alias("x")).select("x.*")
    if key:
        twice = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n_bad"))
        out = out.unionByName(twice.select(F.lit("unique:" + ",".join(key)).alias("rule"), "n_bad"))
    return out
