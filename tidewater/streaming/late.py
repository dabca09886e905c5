"""What is late on a stream: told exactly, row by row, and kept."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.types import StructType

from tidewater.sources.intake import observed

SEEN = "highest long, n long, n_late long"


def split_late(stream: DataFrame, path: str, checkpoint: str, delay_ms: int, window_ms: int, ts: str = "timestamp") -> DataStreamWriter:
    """Rows of a stream into rows/batch=.../late=false or late=true below path, in one pass over each batch.

    A row is late as a windowed aggregation has it: the watermark of its batch, the highest time of all batches before less the delay, has reached
    the end of its tumbling window. The highest time, with the batch's counts, goes to a one-row table beside the rows; a batch looks at that of
    the batch before it, so one that is retried comes to the same result. Rows without a time are never late.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, None
        if number:
            before = spark.read.schema(SEEN).parquet(f"{path}/seen/batch={number - 1}").first()["highest"]
        end = (F.floor(F.col(ts) / window_ms) + 1) * window_ms
        late = F.lit(False) if before is None else F.coalesce(end <= before - delay_ms, F.lit(False))
        counted = Observation()
        rows = batch.withColumn("late", late).observe(counted, F.max(ts).alias("highest"), F.count("*").alias("n"), F.count_if("late").alias("n_late"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={number}")
        seen = {"n": 0, "n_late": 0} | observed(counted, "highest")
        highest = max((t for t in (before, seen["highest"]) if t is not None), default=None)
        spark.createDataFrame([(highest, seen["n"], seen["n_late"])], SEEN).coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _with_parts(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema.add("batch", "long").add("late", "boolean")


def split_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that split_late has written, with batch and late."""
    return spark.read.schema(_with_parts(spark, schema)).parquet(f"{path}/rows")


def on_time(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the rows that were in time, for stateful operators with the same delay: they drop none of them."""
    rows = spark.readStream.schema(_with_parts(spark, schema)).parquet(f"{path}/rows")
    return rows.where("NOT late").drop("batch", "late")


def counts_by_batch(spark: SparkSession, path: str) -> DataFrame:
    """batch, n and n_late."""
    return spark.read.schema(SEEN + ", batch long").parquet(f"{path}/seen").select("batch", "n", "n_late")


class ObservedCounts(StreamingQueryListener):
    """Sums a count that a stream observes, over all progress of all its runs; a batch that is run again counts once."""

    def __init__(self, name: str, field: str = "n") -> None:
        self.name, self.field = name, field
        self.batches: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found[self.field] or 0

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        pass

    def total(self, spark: SparkSession) -> int:
        """The sum, once all that has happened so far is known."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(self.batches.values())
