"""A message log as a streaming source and sink with offsets.

The transport is the user's: a client of a broker that keeps messages in order, or FileLog, a log in files on any file system.
The source reads each message once between the offsets that Spark keeps in the checkpoint; the sink stages what tasks write
and publishes a batch as one step under a key, so a batch that is run again after a stop is published once. Nothing of the
messages passes through the driver, only offsets and names.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery

from segmill.sources.objects import ObjectStore, open_store

LOGGED = "offset bigint, value string"
#: Messages in an Arrow batch of a reader.
ROWS = 4096


class Transport(Protocol):
    """What a broker's client must do. It is sent to tasks, so it opens connections as they are used."""

    def latest(self) -> int:
        """How many messages there are."""

    def slices(self, start: int, end: int, most: int) -> list[Any]:
        """The messages from start to below end, as parts for tasks of at most `most` messages."""

    def fetch(self, part: Any) -> Iterator[tuple[int, str]]:
        """Offsets and texts of a part."""

    def stage(self, values: Iterator[str]) -> Any:
        """Take in a task's messages, unseen by readers; what is returned names them."""

    def publish(self, key: str, staged: list[Any]) -> None:
        """Append what was staged, as one step; nothing if this was done under the key before."""

    def discard(self, staged: list[Any]) -> None:
        """Forget what was staged."""


@dataclass(frozen=True)
class FileLog:
    """A log in files: lines in `data`, and in `commits` a file for each published batch, which names its data files. A commit
    has the number of the first offset, so readers find their place without reading data. One writer at a time."""

    root: str
    settings: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def at(spark: SparkSession, path: str) -> FileLog:
        root, settings = ObjectStore(spark, path).for_tasks()
        return FileLog(root, tuple(settings.items()))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return open_store(self.root, dict(self.settings))

    def _commits(self) -> list[tuple[int, int, str, str]]:
        """First offset, number of messages, digest of the key and path of each commit, in order."""
        store, base = self._open()
        found = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
        named = [(i.base_name.removesuffix(".json").split("-"), i.path) for i in found if i.base_name.endswith(".json")]
        return sorted((int(first), int(n), digest, path) for (first, n, digest), path in named)

    def latest(self) -> int:
        commits = self._commits()
        return commits[-1][0] + commits[-1][1] if commits else 0

    def slices(self, start: int, end: int, most: int) -> list[tuple[str, int, int, int]]:
        store, _ = self._open()
        parts = []
        for first, n, _, path in self._commits():
            if first >= end or first + n <= start:
                continue
            with store.open_input_stream(path) as source:
                files = json.loads(source.read())
            for name, count in files:
                low, high = max(start, first), min(end, first + count)
                parts += [(name, first, i, min(i + most, high)) for i in range(low, high, most)]
                first += count
        return parts

    def fetch(self, part: tuple[str, int, int, int]) -> Iterator[tuple[int, str]]:
        name, first, low, high = part
        store, base = self._open()
        with store.open_input_file(f"{base}/data/{name}") as source:
            for i, line in enumerate(io.BufferedReader(source), first):
                if i >= high:
                    return
                if i >= low:
                    yield i, json.loads(line)

    def stage(self, values: Iterator[str]) -> tuple[str, int]:
        store, base = self._open()
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        store.create_dir(f"{base}/data", recursive=True)
        with store.open_output_stream(f"{base}/data/{name}", compression=None) as out:
            for n, value in enumerate(values, 1):
                out.write(json.dumps(value).encode() + b"\n")
        return name, n

    def publish(self, key: str, staged: list[tuple[str, int]]) -> None:
        store, base = self._open()
        digest, commits = hashlib.sha256(key.encode()).hexdigest()[:32], self._commits()
        if any(d == digest for _, _, d, _ in commits):
            self.discard(staged)
            return
        n = sum(count for _, count in staged)
        store.create_dir(f"{base}/commits", recursive=True)
        pending = f"{base}/commits/.{uuid.uuid4().hex}"
        with store.open_output_stream(pending, compression=None) as out:
            out.write(json.dumps(staged).encode())
        # the log is longer from this one step on
        first = commits[-1][0] + commits[-1][1] if commits else 0
        store.move(pending, f"{base}/commits/{first:020}-{n:012}-{digest}.json")

    def discard(self, staged: list[tuple[str, int]]) -> None:
        store, base = self._open()
        for name, _ in staged:
            store.delete_file(f"{base}/data/{name}")


class Part(InputPartition):
    def __init__(self, part: Any) -> None:
        self.part = part


class LogReader(DataSourceStreamReader):
    """Messages by offsets; a task gets at most `most` of them."""

    def __init__(self, transport: Transport, most: int) -> None:
        self.transport, self.most = transport, most

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.transport.latest()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p) for p in self.transport.slices(start["offset"], end["offset"], self.most)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        for row in self.transport.fetch(partition.part):
            rows.append(row)
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        offsets, values = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=["offset", "value"])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    name: Any


class LogWriter(DataSourceStreamArrowWriter):
    """The column value of a batch; `key` tells the sink's batches from others'."""

    def __init__(self, transport: Transport, key: str) -> None:
        self.transport, self.key = transport, key

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        values = (v for batch in iterator for v in batch.column(batch.schema.get_field_index("value")).to_pylist() if v is not None)
        return Staged(self.transport.stage(values))

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.transport.publish(f"{self.key}/{batchId}", [m.name for m in messages if m is not None])

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.transport.discard([m.name for m in messages if m is not None])


def log_source(transport: Transport) -> type[DataSource]:
    """A data source over a transport, for spark.dataSource.register. Options: most (messages of a task, 100,000), key (of a
    sink's batches)."""

    class LogSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"segmill_log_{hashlib.sha256(repr(transport).encode()).hexdigest()[:16]}"

        def schema(self) -> str:
            return LOGGED

        def streamReader(self, schema) -> LogReader:
            return LogReader(transport, int(self.options.get("most", 100_000)))

        def streamWriter(self, schema, overwrite: bool) -> LogWriter:
            return LogWriter(transport, self.options.get("key", ""))

    return LogSource


def read_log(spark: SparkSession, transport: Transport, most: int = 100_000) -> DataFrame:
    """A stream of (offset, value)."""
    source = log_source(transport)
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("most", str(most)).load()


def write_log(stream: DataFrame, transport: Transport, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Append the column value of a stream, each row once, and stop at the end of what is there. Batches are known by the key,
    which stays with the checkpoint: its path, unless another is given. Null values are left out."""
    source = log_source(transport)
    stream.sparkSession.dataSource.register(source)
    return stream.select("value").writeStream.format(source.name()).option("key", key or checkpoint).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_table(spark: SparkSession, transport: Transport, start: int = 0, end: int | None = None, most: int = 100_000) -> DataFrame:
    """(offset, value) of the messages from start to below end, or to what is there now, read by tasks."""
    parts = transport.slices(start, transport.latest() if end is None else end, most)
    named = spark.createDataFrame([(pickle.dumps(p),) for p in parts], "part binary").repartition(max(1, len(parts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LogReader(transport, most)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield from reader.read(Part(pickle.loads(part)))

    return named.mapInArrow(read, LOGGED)
