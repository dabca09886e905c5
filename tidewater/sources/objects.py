"""A data source that writes rows as named objects: each task writes and publishes its own."""

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from posixpath import dirname

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Published(WriterCommitMessage):
    """How many objects a task has published."""

    n: int


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a URI (file, s3, hdfs, ...), and the place in it."""
    return stores.FileSystem.from_uri("s3://" + path.removeprefix("s3a://") if path.startswith("s3a://") else path)


class ObjectWriter(DataSourceArrowWriter):
    """Objects go to a hidden folder first, one for each attempt of a task. When an attempt has written all of its rows, it moves them to their names.
    An attempt that fails takes back what it has written and moved. The driver removes the hidden folder, in one call, whether the job ends well or not."""

    def __init__(self, path: str) -> None:
        self.path, self.making = path.rstrip("/"), f"_making-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Published:
        store, root = store_of(self.path)
        own, keys, moved = f"{root}/{self.making}/{uuid.uuid4().hex}", [], []
        store.create_dir(own, recursive=True)
        try:
            for batch in iterator:
                for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                    if not key or key.startswith("/") or ".." in key.split("/"):
                        raise ValueError(f"no name for an object: {key!r}")
                    with store.open_output_stream(f"{own}/{len(keys)}") as out:
                        out.write(content.as_py() or b"")
                    keys.append(key)
            for i, key in enumerate(keys):
                target = f"{root}/{key}"
                if store.get_file_info(target).type == stores.FileType.NotFound:
                    store.create_dir(dirname(target), recursive=True)
                    store.move(f"{own}/{i}", target)
                    moved.append(target)
                elif not self.same(store, f"{own}/{i}", target):
                    raise FileExistsError(f"{key} is there already, with other content")
        except BaseException:
            for target in moved:
                with suppress(OSError):
                    store.delete_file(target)
            raise
        finally:
            with suppress(OSError):
                store.delete_dir(own)
        return Published(len(keys))

    @staticmethod
    def same(store: stores.FileSystem, a: str, b: str) -> bool:
        """Whether two objects hold the same: then an earlier attempt has published it."""
        with store.open_input_stream(a) as x, store.open_input_stream(b) as y:
            while (part := x.read(1 << 20)) == y.read(1 << 20):
                if not part:
                    return True
        return False

    def _clean(self) -> None:
        store, root = store_of(self.path)
        with suppress(OSError):
            store.delete_dir(f"{root}/{self.making}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class ObjectSink(DataSource):
    """Format objects: rows (key string, content binary) below the option path."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"])


def write_objects(df: DataFrame, path: str, key: Column, content: Column) -> None:
    """One object below path for each row, under the name that key gives (not null, no way up), holding content (null counts as empty).

    Tasks write and publish, so the driver does nothing for a single object. Rows may be written again: an object that is there with the same
    content stays, one with other content is an error. Of a job that fails, tasks that had ended keep their objects, all others leave nothing. Not for
    speculative execution, in which two attempts of a task run side by side.
    """
    df.sparkSession.dataSource.register(ObjectSink)
    df.select(key.alias("key"), content.cast("binary").alias("content")).write.format("objects").mode("append").option("path", path).save()
