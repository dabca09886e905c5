"""What the training-data operators share: reading tables, writing shared tables, compressed chunks of texts.

Contract for every operator: ids may be null or repeated, texts may be null (read as empty) or very
long, tables may be empty, and further columns are ignored unless an operator says it carries them.
"""

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.scratch import shared_dir, stored  # noqa: F401

#: Text bytes in one chunk: bounds what one task holds in Python.
CHUNK_BYTES = 16 << 20
#: Rows that Python functions take from an Arrow batch at once.
ROWS_AT_ONCE = 512
#: Size up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader, so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: decides which rows a model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def labelled(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most bound labelled rows outside the held-out fold, taken in the order of a hash of the id.

    The bound makes the result safe to broadcast; a doc_id labelled twice keeps its larger label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A few rows at a time with their texts as UTF-8 bytes; an empty batch is passed on as it is."""
    for whole in batches:
        for start in range(0, max(1, whole.num_rows), ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            yield batch, batch.column("text").cast(pa.binary()).to_pylist()
    give_back()


def give_back() -> None:
    """Returns what a Python worker has freed to the machine: workers live on from one stage to the next beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs packed into stored rows (chunk, blob) of about chunk_bytes of text, without a shuffle.

    A blob is a zstandard-compressed Arrow stream, so a text that has to meet data of other tasks
    crosses the network compressed, and a task holds one chunk at a time. The ids of chunks are fixed
    by the stored table: later jobs and retried tasks see the same ones.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            start = used = 0
            for i, n in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
                used += n + 16
                if size + used >= chunk_bytes or i + 1 == batch.num_rows:
                    held.append(batch.slice(start, i + 1 - start))
                    size, used, start = size + used, 0, i + 1
                    if size >= chunk_bytes:
                        yield packed((task << 24) + made, held)
                        made, held, size = made + 1, [], 0
        if held:
            yield packed((task << 24) + made, held)

    def packed(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        # slices share buffers with their batch; combining copies only their own rows
        rows, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    import pyarrow.compute  # noqa: F401  loads pa.compute for the closure

    return stored(docs.mapInArrow(pack, "chunk long, blob binary"))


def unpacked(blob: bytes) -> pa.Table:
    """The rows of one chunk."""
    return pa.ipc.open_stream(blob).read_all()


def answered(side: DataFrame, keys: list[str], aggs: list[Column], keep: Column | None = None) -> DataFrame:
    """Rows of side with the aggregates over all rows of their key; keys that fail keep are dropped.

    The aggregation combines before its shuffle. Its result is stored, so that the join back is a
    plain one, in which adaptive execution splits a key that many rows carry.
    """
    side = stored(side)
    totals = side.groupBy(*keys).agg(*aggs)
    return side.join(stored(totals if keep is None else totals.where(keep)), keys)


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, marked for broadcast if its rows, counted, take at most BROADCAST_BYTES."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def mark(text: Column) -> Column:
    """64 bits that tell rows with the same doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs, all columns carried, without the rows whose (doc_id, mark) is among dropped; of rows that share one of repeated, one stays.

    Both tables are stored and have doc_id and mark. Ids and marks alone are compared: the few of dropped go to all tasks while they are
    known to be small, and only a larger table makes the documents cross the network.
    """
    own, named = f"_{uuid.uuid4().hex}", lambda t: t.select(F.col("doc_id").alias(f"{own}_id"), F.col("mark").alias(f"{own}_mark"))
    rows = docs.withColumn(own, mark(F.col("text")))
    same = rows["doc_id"].cast("long").eqNullSafe(F.col(f"{own}_id")) & (rows[own] == F.col(f"{own}_mark"))
    left = rows.join(small(named(dropped), 64), same, "left_anti")
    if repeated.isEmpty():
        return left.drop(own)
    again = small(named(repeated), 64)
    alike = left.join(again, same, "left_semi").dropDuplicates(["doc_id", own])
    return left.join(again, same, "left_anti").unionByName(alike).drop(own)
