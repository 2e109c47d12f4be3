"""Compression of vectors to short codes (product quantisation with codebooks of integers).

A component x becomes floor(SCALE x). Vectors are cut into equal parts, each with a codebook that starts as that part of the first
vectors by vec_id. A round assigns each part to its nearest entry and replaces entries by the means of their parts, rounded down.

Codebooks are broadcast: entries times components, whatever the number of vectors. Tasks take distances to all entries by the
expansion |x|^2 - 2 x c + |c|^2 in 64-bit integers, exactly, and the first of the smallest. A task sums the parts of each entry
first, so a round shuffles one row for each task, part and entry, however many vectors an entry has. Vectors are read once a round.

Rows whose vector is null, has no components or has a null, NaN or infinite one are dropped. Rows that repeat a vec_id count
each; they are ordered by their components, and a null vec_id comes last. A vector of another length than the first one has a null
code and error. A null label is a label. With fewer rows than entries a codebook is that much smaller. Extra columns are ignored;
without rows the result is empty. A length that parts don't divide, and components so large that distances would pass 64 bits
(2^17 in vectors of 64), raise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import lookup, materialise, slices

SCALE = 1024
#: Vectors that are compared at once.
ROWS = 2048


def integers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a usable vector, which of these have `dim` components, and those components as integers."""
    there = np.flatnonzero(pc.is_valid(batch.column("embedding")).to_numpy(zero_copy_only=False))
    column = batch.column("embedding").take(pa.array(there))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    odd, ends = np.append(0, np.cumsum(~np.isfinite(values))), np.cumsum(sizes)
    good = (odd[ends] == odd[ends - sizes]) & (sizes > 0)
    usable = np.zeros(batch.num_rows, bool)
    usable[there[good]] = True
    kept = np.floor(SCALE * values[np.repeat(good & (sizes == dim), sizes)])
    if len(kept) and np.abs(kept).max() >= most(dim):
        raise ValueError(f"components times {SCALE} must be below {most(dim)} for exact distances")
    return usable, sizes[good] == dim, kept.astype(np.int64).reshape(-1, dim)


def most(dim: int) -> int:
    """Below it, distances of `dim` components and all on the way to them fit 64 bits."""
    return math.isqrt((1 << 61) // dim)


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, and the sum of the squared distances."""
    parts, _, width = books.shape
    nearest, error = np.empty((len(block), parts), np.int64), np.zeros(len(block), np.int64)
    for k in range(parts):
        x, book = block[:, k * width : (k + 1) * width], books[k]
        away = (book * book).sum(1) - 2 * (x @ np.ascontiguousarray(book.T))
        nearest[:, k] = away.argmin(1)
        error += away[np.arange(len(x)), nearest[:, k]] + (x * x).sum(1)
    return nearest, error


def entry_sums(vectors: DataFrame, books: Broadcast) -> DataFrame:
    """part, entry, n and the components' sums s0, s1 ... of the parts that are nearest to each entry."""
    parts, entries, width = books.value.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in slices(batches, ROWS):
            _, _, block = integers(batch, parts * width)
            nearest, _ = assign(block, books.value)
            for k in range(parts):
                order = np.argsort(nearest[:, k], kind="stable")
                found, starts, n = np.unique(nearest[order, k], return_index=True, return_counts=True)
                if len(found):
                    count[k, found] += n
                    total[k, found] += np.add.reduceat(block[order, k * width : (k + 1) * width], starts, axis=0)
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    told = vectors.mapInArrow(add, "part long, entry long, n long, sums array<long>")
    return told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks that the first vectors make: (part, entry, component). None without vectors."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where((F.size("embedding") > 0) & ~odd).select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    first = [b for b in rows.toArrow().combine_chunks().to_batches() if b.num_rows]
    if not first:
        return None
    dim = len(first[0].column("embedding")[0])
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    _, _, block = integers(first[0], dim)
    return np.ascontiguousarray(block.reshape(len(block), parts, dim // parts).transpose(1, 0, 2))


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray | None:
    """The codebooks after all rounds: (part, entry, component)."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        # as many rows as the codebooks have entries
        for row in entry_sums(vectors, sent).collect():
            books[row["part"], row["entry"]] = np.array(row[3:], np.int64) // row["n"]
        sent.unpersist()
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part's entry) and error of each kept row."""
    sent, dim = vectors.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            usable, fits, block = integers(batch, dim)
            nearest, error = assign(block, sent.value)
            codes, errors = np.full(len(fits), None), np.zeros(len(fits), np.int64)
            codes[fits], errors[fits] = [bytes(row).hex() for row in nearest.astype(np.uint8)], error
            kept = batch.filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code, error, label_error (the errors of all rows of the label) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    vectors = vectors.select("vec_id", "embedding", "label")
    books = train(vectors, parts, entries, rounds)
    if books is None:
        empty = vectors.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = materialise(encode(vectors, books).withColumn("_key", key), "vector-codes")
    sums = materialise(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")), "label-errors")
    total = sums.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    return lookup(coded, sums, "_key", "_rows", total).drop("_key").withColumn("codebooks_sha256", F.lit(fingerprint(books)))
