"""User-written sinks that get the rows where they are.

A sink writes each partition in its task, from Arrow batches, and says in a
message what it has written.  When all tasks are done, ``commit`` gets one
message per partition on the driver, of the attempt that counts; a task that
was retried or run twice has its other attempts' messages dropped.  If a task
fails for good, ``abort`` gets the messages there are.  So what a sink makes
visible in ``commit`` alone is replaced whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sluice.semantics import travels

travels(__name__)


class PartitionSink:
    """What a user writes: ``write`` runs in the tasks, the others on the driver."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Any:
        """Write one partition; the result travels to ``commit`` (it should be small)."""
        raise NotImplementedError

    def commit(self, messages: list[Any]) -> None:
        """Make what was written the content."""

    def abort(self, messages: list[Any]) -> None:
        """Drop what was written."""


@dataclass
class _Written(WriterCommitMessage):
    message: Any


class _Writer(DataSourceArrowWriter):
    def __init__(self, sink: PartitionSink):
        self.sink = sink

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _Written(self.sink.write(iterator))

    def commit(self, messages) -> None:
        self.sink.commit([m.message for m in messages if m is not None])

    def abort(self, messages) -> None:
        self.sink.abort([m.message for m in messages if m is not None])


def refill_partitions(df: DataFrame, sink: PartitionSink) -> None:
    """Make the rows the content of a user's sink, partition by partition."""
    name_ = f"sluice-sink-{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
            return _Writer(sink)

    df.sparkSession.dataSource.register(Source)
    df.write.format(name_).mode("overwrite").save()


class FilesSink(PartitionSink):
    """Parquet files in a folder, named by a list; the newest list is the content.

    The folder is a path or address that pyarrow can open on driver and
    executors.  A file is named by the attempt that writes it, so attempts do
    not meet; files in no list are of attempts that did not count.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.folder)
        return system, path

    def write(self, batches: Iterator[pa.RecordBatch]) -> str | None:
        system, path = self._open()
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(f"{path}/files")
                writer = pq.ParquetWriter(f"{path}/files/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
        if writer is None:
            return None
        writer.close()
        return name

    def commit(self, messages: list[str | None]) -> None:
        system, path = self._open()
        system.create_dir(f"{path}/lists")
        target = f"{path}/lists/{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{target}.new") as out:
            out.write(json.dumps(sorted(m for m in messages if m)).encode())
        # readers see whole lists only
        system.move(f"{target}.new", target)

    def abort(self, messages: list[str | None]) -> None:
        system, path = self._open()
        for name in messages:
            if name:
                system.delete_file(f"{path}/files/{name}")

    def files(self) -> list[str] | None:
        """The files of the content, or nothing before the first commit."""
        system, path = self._open()
        lists = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/lists", allow_not_found=True)) if f.path.endswith(".json")]
        if not lists:
            return None
        with system.open_input_stream(max(lists)) as found:
            return [f"{self.folder}/files/{name}" for name in json.loads(found.read())]

    def read(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        files = self.files()
        if files is None:
            raise FileNotFoundError(self.folder)
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
