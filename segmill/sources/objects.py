"""An object store on any file system that Spark reads: paths of local disks, HDFS or S3 alike.

Small administrative calls (put, get, delete, exists) go through the session's Hadoop file system. Listings and bulk reads and
writes are DataFrames made by tasks: Spark's own file sources leave out empty files and names that begin with _ or a dot. Tasks
open S3 with the endpoint and keys of the session's Hadoop settings, so both halves reach the same store.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segmill.sources.shared import new_shared_folder

SCHEMES = ("file", "hdfs", "viewfs", "s3a")
LISTED = "key string, size bigint, last_modified timestamp"
#: Contents of small objects are sent together up to so many bytes.
BATCH_BYTES = 32 << 20
#: Bytes that are written at once.
PIECE = 8 << 20
#: Objects in a page of a listing, and names by which the ranges of a listing are chosen.
PAGE, SAMPLE = 1000, 10_000


class ObjectStoreError(Exception):
    pass


class ObjectStore:
    """Objects below a root, under keys with slashes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        scheme = root.split("://", 1)[0] if "://" in root else "file"
        if scheme not in SCHEMES:
            raise ObjectStoreError(f"unsupported scheme {scheme}")
        self.spark, self.root = spark, root.rstrip("/") if "://" in root else "file://" + str(Path(root).absolute())
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)
        return path.getFileSystem(self._conf), path

    def _settings(self) -> dict[str, str]:
        """What tasks need to open the store: the Hadoop settings of its bucket, or those for all."""
        bucket = self.root.split("/")[2]
        found = {name: self._conf.get(f"fs.s3a.bucket.{bucket}.{name}") or self._conf.get(f"fs.s3a.{name}") for name in S3_SETTINGS}
        return {name: value for name, value in found.items() if value} if self.root.startswith("s3a:") else {}

    def for_tasks(self) -> tuple[str, dict[str, str]]:
        """The root and settings by which tasks open the store: what a mount table (viewfs) hides is resolved, and made if missing."""
        if not self.root.startswith("viewfs:"):
            return self.root, self._settings()
        store, path = self._at("")
        store.mkdirs(path)
        return store.resolvePath(path).toString().rstrip("/"), {}

    def put(self, key: str, data: bytes | str) -> None:
        """Bytes, or the path of a local file."""
        store, path = self._at(key)
        if isinstance(data, str):
            if not Path(data).is_file():
                raise ObjectStoreError(f"no file {data}")
            data = Path(data).read_bytes()
        out = store.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise ObjectStoreError(f"no object {key}")
        store, path = self._at(key)
        source = store.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def delete(self, key: str) -> bool:
        """An object or all objects below a key; False if there are none."""
        store, path = self._at(key)
        return bool(store.exists(path)) and bool(store.delete(path, True))

    def exists(self, key: str) -> bool:
        store, path = self._at(key)
        return bool(store.exists(path))

    def url(self, key: str) -> str:
        return f"{self.root}/{key}"

    def list(self, prefix: str = "") -> DataFrame:
        """key, size and last_modified of the objects below a directory; none if it doesn't exist. Contents aren't read."""
        return self.list_by_prefix(f"{prefix.strip('/')}/" if prefix.strip("/") else "")

    def list_by_prefix(self, prefix: str, tasks: int | None = None) -> DataFrame:
        """key, size and last_modified of the objects whose keys begin with a text.

        Each task takes a range of keys, also of one flat folder, and sends it page by page. Ranges are of about equal numbers
        of the first SAMPLE names.
        """
        root, settings = self.for_tasks()
        options = {"root": root, "prefix": prefix, "tasks": str(tasks or 4 * self.spark.sparkContext.defaultParallelism), "settings": json.dumps(settings)}
        self.spark.dataSource.register(ObjectListing)
        return self.spark.read.format(ObjectListing.name()).options(**options).load()

    def read(self, prefix: str = "") -> DataFrame:
        """key and content of the objects below a directory. A task holds one object, or small ones of up to BATCH_BYTES."""
        (root, settings), tasks = self.for_tasks(), 4 * self.spark.sparkContext.defaultParallelism

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = open_store(root, settings)
            held: list[tuple[str, bytes]] = []

            def sent() -> pa.RecordBatch:
                keys, contents = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(contents, pa.binary())], names=["key", "content"])

            for batch in batches:
                for key in batch.column(0).to_pylist():
                    with store.open_input_stream(f"{base}/{key}", compression=None) as source:
                        held.append((key, source.read()))
                    if sum(len(c) for _, c in held) > BATCH_BYTES:
                        yield sent()
                        held = []
            if held:
                yield sent()

        return self.list(prefix).select("key").repartition(tasks, "key").mapInArrow(read, "key string, content binary")

    def put_all(self, objects: DataFrame) -> int:
        """Write all rows (key, content) as objects, by tasks, and return how many were written.

        A task writes to files of its own and names them in a table; when all are there, a second job moves them to their keys,
        so an object is there as a whole or not at all, whichever tasks fail and run again. A store whose puts are whole
        anyway (S3) gets them at once. Existing objects are replaced; of rows with one key any one counts. A null content is
        empty. Null and empty keys, and those that lead out of the root, raise before anything is moved.
        """
        root, settings = self.for_tasks()
        pending = f".pending-{uuid.uuid4().hex}"
        whole = root.startswith("s3a:")

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = open_store(root, settings)
            for batch in batches:
                keys, places = batch.column("key").to_pylist(), []
                for key, content in zip(keys, batch.column("content"), strict=True):
                    _check(key)
                    places.append(key if whole else f"{pending}/{uuid.uuid4().hex}")
                    if not whole and store.get_file_info(f"{base}/{pending}").type == fs.FileType.NotFound:
                        raise ObjectStoreError("the write has ended")  # a task that outlives its job leaves nothing
                    _write(store, f"{base}/{places[-1]}", content.as_buffer() or b"")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.string())], names=["key", "place"])

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = open_store(root, settings)
            for batch in batches:
                for key, place in zip(batch.column("key").to_pylist(), batch.column("place").to_pylist(), strict=True):
                    # a task that runs again finds some moved already
                    if place != key and store.get_file_info(f"{base}/{place}").type == fs.FileType.File:
                        store.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
                        store.move(f"{base}/{place}", f"{base}/{key}")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        hadoop, path = self._at(pending)
        hadoop.mkdirs(path)
        # the table isn't among the objects
        table = new_shared_folder(self.spark, "manifest")
        try:
            objects.select("key", "content").mapInArrow(stage, "key string, place string").write.parquet(table)
            manifest = self.spark.read.schema("key string, place string").parquet(table)
            return manifest.mapInArrow(move, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        finally:
            self.delete(pending)
            scratch = self._jvm.org.apache.hadoop.fs.Path(table)
            scratch.getFileSystem(self._conf).delete(scratch, True)


def _check(key: str | None) -> None:
    if not key or key.startswith("/") or key.endswith("/") or any(part in ("", ".", "..") for part in key.split("/")):
        raise ObjectStoreError(f"{key!r} is no key")


def _write(store: fs.FileSystem, path: str, content: pa.Buffer | bytes) -> None:
    with store.open_output_stream(path, compression=None) as out:
        view = memoryview(content)
        for i in range(0, len(view), PIECE):
            out.write(view[i : i + PIECE])


#: Names of Hadoop's S3 settings below fs.s3a (fixed values).
S3_SETTINGS = ("endpoint", "endpoint.region", "access.key", "secret.key", "session.token", "connection.ssl.enabled", "path.style.access")


def s3_arguments(settings: dict[str, str]) -> dict[str, object]:
    """The same settings as pyarrow names them."""
    names = {"endpoint.region": "region", "access.key": "access_key", "secret.key": "secret_key", "session.token": "session_token"}
    found: dict[str, object] = {names[k]: v for k, v in settings.items() if k in names}
    scheme, _, host = settings.get("endpoint", "").rpartition("://")
    if host:
        plain = settings.get("connection.ssl.enabled", "true").lower() == "false"
        found |= {"endpoint_override": host.rstrip("/"), "scheme": scheme or ("http" if plain else "https")}
        if settings.get("path.style.access", "false").lower() == "false" and host.endswith("amazonaws.com"):
            found["force_virtual_addressing"] = True
    return found


def open_store(root: str, settings: dict[str, str]) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the path there, for a task."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    if root.startswith("s3a:"):
        return fs.S3FileSystem(**s3_arguments(settings)), root.removeprefix("s3a://")
    return fs.FileSystem.from_uri(root)


def names_below(store: fs.FileSystem, base: str, prefix: str) -> Iterator[tuple[str, fs.FileInfo | None]]:
    """Keys that begin with a prefix, and what is known of each. Folders of a local disk are read as a stream, whatever their
    size; other stores are asked folder by folder."""
    folders = [prefix.rpartition("/")[0]]
    while folders:
        folder = folders.pop()
        head = f"{folder}/" if folder else ""
        for name, is_folder, info in _entries(store, f"{base}/{folder}".rstrip("/")):
            key = head + name
            if is_folder:
                if f"{key}/".startswith(prefix) or prefix.startswith(f"{key}/"):
                    folders.append(key)
            elif key.startswith(prefix):
                yield key, info


def _entries(store: fs.FileSystem, path: str) -> Iterator[tuple[str, bool, fs.FileInfo | None]]:
    if not isinstance(store, fs.LocalFileSystem):
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            yield info.base_name, not info.is_file, info
    elif os.path.isdir(path):
        with os.scandir(path) as entries:
            for e in entries:
                # Hadoop keeps a checksum beside each file that it writes to a local disk
                if not (e.name.startswith(".") and e.name.endswith(".crc") and os.path.exists(f"{path}/{e.name[1:-4]}")):
                    yield e.name, e.is_dir(), None


class KeyRange(InputPartition):
    """Keys from `low` on and below `high`; None is no bound."""

    def __init__(self, low: str | None, high: str | None) -> None:
        self.low, self.high = low, high


class ObjectListing(DataSource):
    """Objects by ranges of keys. Options: root, prefix, tasks, and settings (JSON) to open the store."""

    @classmethod
    def name(cls) -> str:
        return "segmill_objects"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.prefix, self.tasks, self.settings = options["root"], options["prefix"], int(options["tasks"]), json.loads(options["settings"])

    def partitions(self) -> list[KeyRange]:
        store, base = open_store(self.root, self.settings)
        names = sorted({key for key, _ in islice(names_below(store, base, self.prefix), SAMPLE)})
        bounds = sorted({names[i * len(names) // self.tasks] for i in range(1, self.tasks)}) if len(names) > 1 else []
        return [KeyRange(low, high) for low, high in zip([None, *bounds], [*bounds, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        store, base = open_store(self.root, self.settings)
        inside = lambda key: (partition.low is None or key >= partition.low) and (partition.high is None or key < partition.high)
        found = ((key, info) for key, info in names_below(store, base, self.prefix) if inside(key))
        while page := list(islice(found, PAGE)):
            infos = [info or store.get_file_info(f"{base}/{key}") for key, info in page]
            there = [(key, i.size or 0, i.mtime) for (key, _), i in zip(page, infos, strict=True) if i.type != fs.FileType.NotFound]
            columns = zip(*there, strict=True) if there else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)], names=["key", "size", "last_modified"])
