"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the document's word
shingles, repeats included. Two fingerprints are linked if at most `most` = 3 bits differ. Then at most 3 of the 8
bytes differ, so at least 5 bytes agree position by position: the count filter.

The inverted index has fingerprints under bytes at fixed positions. A list for a single position and byte would hold
1/256 of all fingerprints, so that its pairs grow with the square of the input; the index therefore has a list for
each three bytes of either half. Of any 5 agreeing positions at least 3 are in one half, so every pair that can pass
meets in a list. Pairs of a list are tallied (how many bytes agree), pairs with fewer than 5 go, and the rest is
verified bit by bit. A list yields its components, as links to the smallest member, rather than its pairs.

A list of over BLOCK members is split into lists for each two of the other five bytes besides (a pair that passes agrees in
at least two of them); a list that is still as long is dealt to tasks as pairs of blocks.

Only distinct fingerprints are indexed, so exact copies cost nothing here.

A null text has no words, like an empty one: its fingerprint is zero, linked like any other. A row with a null doc_id gets
its fingerprint but no component, and links nothing. Rows that repeat a doc_id each get a result. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations, islice, tee

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import lookup, materialise, may_be_in, slices, spread_blocks, starts_of, whole_groups
from segmill.llm.graph import components

#: Members of a list that one task compares with each other, or with as many of another block.
BLOCK = 2048
#: Hashes whose bits are counted at once, and bytes of a text whose words aren't all held at once.
CHUNK, LONG = 1 << 16, 1 << 22
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def _words(data: bytes) -> Iterator[bytes]:
    # of bytes, split() takes 0x20 and 0x09 to 0x0D as white space
    return iter(data.split()) if len(data) <= LONG else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0d]+", data))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number. A long text's words, shingles and hashes are made as they are used."""
    words = _words((text or "").encode().lower())  # of bytes, lower() changes A-Z only
    head = list(islice(words, shingle))
    if not head:
        return 0
    if len(head) < shingle:
        shingles = iter([b" ".join(head)])
    else:
        shingles = map(b" ".join, zip(*(islice(w, i, None) for i, w in enumerate(tee(chain(head, words), shingle))), strict=False))
    hashes = (xxhash.xxh64_intdigest(s, 42) for s in shingles)
    ones, n = np.zeros(64, np.int64), 0
    while len(part := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones, n = ones + bits.sum(axis=0, dtype=np.int64), n + len(part)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


def _bytes_at(key: Column, positions: tuple[int, ...]) -> Column:
    """A number followed by the fingerprint's bytes at the positions."""
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def _list_keys(number: int) -> Column:
    return _bytes_at(F.lit(number).cast("long"), TRIPLES[number])


def _finer_keys(number: int) -> Column:
    """The keys of the lists that a list of the triple is split into: the triple, its bytes, the two positions, their bytes."""
    others = combinations([p for p in range(8) if p not in TRIPLES[number]], 2)
    return F.array(*(_bytes_at(F.shiftleft("key", 4).bitwiseOR(F.lit(i + 1)), two) for i, two in enumerate(others)))


def smallest_linked(keys: np.ndarray, fps: np.ndarray, most: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links found between members of the same list, as (member, a smaller member of the same component).

    keys are sorted. Member i is compared with i + 1, then all with i + 2, and so on; with `apart`, only members for which it
    differs are.
    """
    a, b = [], []
    values = fps.view(np.uint64)
    at = np.arange(len(fps))
    for step in range(1, len(fps)):
        at = at[at + step < len(fps)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        some = at if apart is None else at[apart[at] != apart[at + step]]
        differ = values[some] ^ values[some + step]
        agree = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        differ, near = differ[agree >= 8 - most], some[agree >= 8 - most]
        near = near[np.bitwise_count(differ) <= most]
        a.append(near)
        b.append(near + step)
    if not a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    label = fps.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    changed = label != fps
    return fps[changed], label[changed]


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """a, b: links that connect the fingerprints (column fp, without repeats) that differ in at most `most` bits."""
    if not 0 <= most <= 3:
        raise ValueError("the lists find up to 3 differing bits")
    lists = distinct.select("fp", F.explode(F.array(*(_list_keys(i) for i in range(len(TRIPLES))))).alias("key"))
    long = materialise(lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key"), "long-lists")
    # of 8 lists of each fingerprint at most 1/BLOCK can be long
    if n_long := long.count():
        marked = lists.join(F.broadcast(long.withColumn("long", F.lit(True))) if n_long <= 100_000 else long.withColumn("long", F.lit(True)), "key", "left")
        finer = F.coalesce(*(F.when(F.shiftright("key", 24) == i, _finer_keys(i)) for i in range(len(TRIPLES))))
        lists = marked.select("fp", F.explode(F.when(F.col("long"), finer).otherwise(F.array("key"))).alias("key"))
    members = spread_blocks(lists, ["key"], "fp", BLOCK)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["key", "i", "j"]):
            starts = starts_of(batch, ["key", "i", "j"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            fps, own = batch.column("fp").to_numpy(), batch.column("own").to_numpy()
            crossed = batch.column("i").to_numpy() != batch.column("j").to_numpy()
            for across in (False, True):
                at = np.flatnonzero(crossed == across)
                # where two blocks meet, pairs inside either count elsewhere
                a, b = smallest_linked(group[at], fps[at], most, own[at] if across else None)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return members.mapInArrow(find, "a long, b long").distinct()


def _named(groups: DataFrame, most: int) -> DataFrame:
    """groups (fp, first, n) with component_id, the smallest `first` that links lead to."""
    found = components(links(groups.select("fp"), most))
    # the roots are nodes of their own components
    members = found.unionByName(found.select("root").distinct().select(F.col("root").alias("node"), "root"))
    members = materialise(groups.join(members, F.col("fp") == F.col("node")).select("fp", "root", "first"), "members")
    roots = members.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    linked = lookup(members, roots, "root", "size", max(1, members.count())).select("fp", "component")
    return groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to) of each row."""
    rows = materialise(fingerprints(docs), "fingerprints")
    known = rows.where(F.col("doc_id").isNotNull())
    groups = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    result = lookup(rows, _named(groups, most), "fp", "n", max(1, rows.count()))
    return result.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _row_prints(docs: DataFrame) -> DataFrame:
    """id, h (a hash of the text) and fp of the rows with a doc_id."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["id", "h", "fp"])

    return docs.where(F.col("doc_id").isNotNull()).select(*_row_key(), "text").mapInArrow(compute, "id long, h long, fp long")


def _row_key() -> tuple[Column, Column]:
    return F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row of each component: that with the smallest (doc_id, hash of the text), so it is rows that are grouped, not ids.
    Of rows that agree in both, one stays. Rows with a null doc_id can't be grouped and stay.

    Only rows that may go are shuffled; the others are told by a map of bits. Texts are read three times: for fingerprints, for
    the rows that may go, which are written once, and for the others.
    """
    rows = materialise(_row_prints(docs), "fingerprints")
    groups = materialise(rows.groupBy("fp").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("n")), "groups")
    found = components(links(groups.select("fp"), most))
    members = found.unionByName(found.select("root").distinct().select(F.col("root").alias("node"), "root"))
    rooted = groups.join(members, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("key")).select("key", F.lit(True).alias("stays"))
    keys = rows.groupBy(F.struct("id", "h").alias("key")).agg(F.count("*").alias("n"))
    judged = keys.join(kept, "key", "left").select("key", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    odd = materialise(judged.where(~F.col("stays") | (F.col("n") > 1)), "going")
    # a struct of the row can't clash with names used here
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.struct(*_row_key()).alias("key"))
    told = may_be_in(whole, odd, "key", "may_go").withColumn("may_go", F.col("may_go") & F.col("key.id").isNotNull())
    asked = materialise(told.where("may_go").select("row", "key"), "may-go")
    checked = lookup(asked, odd, "key", "n", max(1, rows.count()))
    once = checked.where("stays").dropDuplicates(["key"])
    stay = told.where("not may_go").select("row").unionByName(checked.where("stays is null").select("row")).unionByName(once.select("row"))
    return stay.select("row.*")
