"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: A key with at least this share of the rows is looked up by broadcast; there are at most HOT_KEYS of them.
HOT_KEYS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where it is unset and all
    work is done on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="segmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{_scratch.get() or shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The folder of the innermost scratch of this thread.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is materialised inside goes to a folder that is deleted at the end, so results must be written before. Without
    it, tables stay in the shared folder for as long as results that read them may be used."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        delete_folder(spark, folder)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage ends here and survives the loss of an executor. Also the
    table's path."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, what: str) -> DataFrame:
    return written(df, what)[0]


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join of `left` with `right`, whose `key` is unique and whose column `rows` tells how many left rows a key has.

    A key with 1/HOT_KEYS of all `total` left rows or more is hot. At most HOT_KEYS keys can be, so these are broadcast
    and their rows are not shuffled; the other rows take a shuffled join. `rows` is not in the result.
    """
    hot = (F.col(rows) > 0) & (F.col(rows) * HOT_KEYS >= F.lit(total))
    few = F.broadcast(right.where(hot).drop(rows))
    rest = left.join(few.select(key), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(right.where(~hot).drop(rows), key, "left"))


#: Bits of the map in may_be_in; 8 MB whatever the number of keys.
MAP_BITS = 1 << 26


def may_be_in(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with `flag`: False only if their key is surely not among the keys, so that these rows need no join. The keys are
    broadcast as a map of MAP_BITS bits of their hashes; the more keys there are, the more rows are flagged by chance."""
    place = lambda: F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(place()).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("_bits"))
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8).cast("int") + 1)) > 0, F.lit(False))
    kept = [c for c in rows.columns if c != flag]
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place())).join(F.broadcast(bits), "_bucket", "left")
    return joined.select(*kept, found.alias(flag))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.when(doc_id.isNotNull(), F.crc32(doc_id.cast("string").cast("binary")) % n)


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """doc_id and label of at most `limit` rows outside the held-out fold, those with the smallest hashes."""
    return (
        labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def crc_fold(doc_id: int | None, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects are made for a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


#: What a worker keeps of the words that it has met, and the longest of them. Longer ones are rare or unlike each other.
KEPT_BYTES, LONGEST_KEPT = 128 << 20, 64
#: Of an entry of a dict, beside key and value.
ENTRY_BYTES = 104


class Kept(dict[str | bytes, T]):
    """A table of words, bounded in bytes whatever the words are. It has two generations: when the younger one has half of the
    bytes it becomes the older, and the older goes, but for words that are asked for in the meantime."""

    def __init__(self, most: int = KEPT_BYTES) -> None:
        super().__init__()
        self.most, self.bytes, self.older = most, 0, {}

    def unknown(self, words: set[str] | set[bytes]) -> set[str] | set[bytes]:
        """The words that aren't in the table. The others are in the younger generation after this, and all of them can be looked
        up until words are kept."""
        # not by difference(), which would go through the whole table
        new = {w for w in words if w not in self}
        for word in [w for w in new if w in self.older]:
            self._add(word, self.older.pop(word))
            new.discard(word)
        return new

    def keep(self, found: Mapping[str, T] | Mapping[bytes, T]) -> None:
        for word, value in found.items():
            if self.bytes > self.most // 2:
                self.older, self.bytes = dict(self), 0
                self.clear()
            if len(word) <= LONGEST_KEPT and word not in self:
                self._add(word, value)

    def _add(self, word: str | bytes, value: T) -> None:
        self[word] = value
        self.bytes += ENTRY_BYTES + sys.getsizeof(word) + sys.getsizeof(value)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process keeps from task to task: one operator's state at a time, so that the tables of several don't
    add up where workers are used again."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def spread_blocks(rows: DataFrame, keys: list[str], member: str, block: int, few: int = 10_000) -> DataFrame:
    """Rows sorted by keys, i, j, so that all pairs of rows with equal keys meet: a key with over `block` rows has its
    rows hashed to blocks (`own`), and a group (keys, i, j) for each two blocks; other keys have the one group (0, 0).

    The keys with many rows are broadcast if they are at most `few`, else joined by a shuffle.
    """
    big = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block), "big-keys")
    known = F.broadcast(big) if big.count() <= few else big
    zero = F.lit(0).cast("long")
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("long")
    dealt = rows.join(known, keys, "left").withColumn("_n", blocks).withColumn("own", F.pmod(F.xxhash64(member), F.col("_n")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(zero, F.col("_n") - 1)))
    dealt = dealt.select(*rows.columns, "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))
    # a pair within a block counts in the group of that block alone
    return dealt.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", member)


def starts_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the groups of a batch, sorted by integer keys, start."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        values = batch.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end where a group ends."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield joined()
            held = []
        cut = int(starts_of(batch, keys)[-1])
        if cut:
            held.append(batch.slice(0, cut))
            yield joined()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined()


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each group of at least two rows."""
    for batch in whole_groups(batches, keys):
        starts = starts_of(batch, keys)
        sizes = np.diff(np.append(starts, batch.num_rows))
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield batch.slice(start, size)
