"""URL filtering by a trie over reversed host labels and path segments.

An entry (host, path, verdict) fits a URL if the URL's host is the entry's host or a subdomain of it and the URL's path
starts with the entry's path. Of the entries that fit, the one with most host labels wins, then the one with the longest
path; of two equal entries, block wins. A list of up to MAX_ENTRIES is a trie that is broadcast. A longer one, or a table of
entries, is joined instead (judge_urls_by_join) with the same verdicts. A URL without `://`, or a null one, has an empty host and path and fits nothing; it gets the default verdict.
Extra columns are kept unless one is named like a result, which then replaces it; repeated rows stay; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.llm.common import lookup, materialise

#: Entries of a trie that is broadcast; at about 300 bytes each it stays below 100 MB.
MAX_ENTRIES = 300_000
HOST, PATH = r"^[\s\S]*?://([^/?#]*)", r"^[\s\S]*?://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class Entry:
    host: str
    path: str
    verdict: str

    @property
    def rule(self) -> str:
        return self.host + self.path


class Node:
    __slots__ = ("children", "entries", "longest", "paths")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.paths: Node | None = None
        self.entries: dict[str, Entry] = {}
        self.longest = 0


class Trie:
    """Host labels from the last to the first, then below each host a trie of whole path segments, whose nodes hold the
    beginnings of a next segment at which an entry's path ends."""

    def __init__(self, entries: Iterable[Entry]) -> None:
        self.root = Node()
        for e in entries:
            node = self.root
            for label in reversed(e.host.split(".")):
                node = node.children.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, part = e.path.split("/")
            for segment in whole:
                node = node.children.setdefault(segment, Node())
            if part not in node.entries or e.verdict == "block":
                node.entries[part] = e
            node.longest = max(node.longest, len(part))

    def match(self, host: str, path: str) -> Entry | None:
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.children.get(label)) is None:
                break
            if node.paths is not None:
                found = self._longest(node.paths, segments) or found
        return found

    @staticmethod
    def _longest(node: Node, segments: list[str]) -> Entry | None:
        found = None
        for segment in segments:
            for n in range(min(len(segment), node.longest), -1, -1):
                if e := node.entries.get(segment[:n]):
                    found = e
                    break
            if (node := node.children.get(segment)) is None:
                break
        return found


def _parts(pages: DataFrame, url: str) -> DataFrame:
    # Spark's names ignore case
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    text = F.coalesce(F.col(url), F.lit(""))
    # A-Z only: lower() would also change other letters
    lowered = F.translate(F.regexp_extract(text, HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(*kept, lowered.alias("host"), F.regexp_extract(text, PATH, 1).alias("path"))


def _fresh(columns: list[str], name: str) -> str:
    """The name, longer if there is a column of that name."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def _looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left (a table) with what right, which has each key once, has for their key; keys with many rows are broadcast."""
    counts = left.groupBy(key).agg(F.count("*").alias("_rows"))
    known = materialise(right.join(counts, key), "url-keys")
    return lookup(left, known, key, "_rows", max(1, left.count()))


def judge_urls_by_join(pages: DataFrame, entries: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls with a table of entries (host, path, verdict) of any size: a host's suffixes are looked up among the entries'
    hosts, and of a path those beginnings that are as long as a path of an entry there. Only equal keys are joined, of distinct
    URLs; keys that many rows have (a common ending of hosts, URLs without a host) are broadcast and their rows not shuffled."""
    parts = _parts(pages, url)
    key, entry = _fresh(parts.columns, "segmill_url"), _fresh(parts.columns, "segmill_entry")
    # a path is empty or begins with the first slash, so host and path together are a key
    parts = parts.withColumn(key, F.concat("host", "path"))
    best = F.max(F.struct(F.col("verdict") == "block", "verdict")).alias("best")
    known = entries.groupBy(F.col("host").alias("e_host"), F.col("path").alias("e_path")).agg(best).select("e_host", "e_path", "best.verdict")
    lengths = known.groupBy("e_host").agg(F.collect_set(F.length("e_path")).alias("lengths"))
    urls = materialise(parts.groupBy(F.col(key).alias("url")).agg(F.min("host").alias("host"), F.min("path").alias("path"), F.count("*").alias("rows")), "urls")
    suffixes = F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> substring_index(host, '.', -i))")
    near = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("e_host"))
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    begun = _looked_up(near, lengths, "e_host").select("url", "e_host", "path", F.explode(fits).alias("n"))
    begun = materialise(begun.select("url", F.struct(F.size(F.split("e_host", r"\.")), "n").alias("rank"), F.struct("e_host", F.expr("left(path, n)").alias("e_path")).alias("e_key")), "url-beginnings")
    hits = _looked_up(begun, known.select(F.struct("e_host", "e_path").alias("e_key"), F.concat("e_host", "e_path").alias("rule"), "verdict"), "e_key").where("verdict is not null")
    found = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), "rank").alias(entry))
    found = materialise(found.join(urls.select("url", "rows"), "url").withColumnRenamed("url", key), "url-entries")
    total = urls.agg(F.coalesce(F.sum("rows"), F.lit(1))).first()[0]
    kept = [c for c in parts.columns if c != key]
    joined = lookup(parts, found.withColumnRenamed("rows", rows := _fresh([*parts.columns, entry], "segmill_rows")), key, rows, total)
    return joined.select(*kept, F.col(f"{entry}.rule").alias("rule"), F.coalesce(f"{entry}.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, entries: list[Entry], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    if len(entries) > MAX_ENTRIES:
        table = pages.sparkSession.createDataFrame([(e.host, e.path, e.verdict) for e in entries], "host string, path string, verdict string")
        return judge_urls_by_join(pages, table, url, default)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(entries))
    parts = _parts(pages, url)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in parts.schema] + [T.StructField(c, T.StringType()) for c in ("rule", "verdict")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hits = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([e and e.rule for e in hits], pa.string())
            verdict = pa.array([e.verdict if e else default for e in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(judge, schema)
