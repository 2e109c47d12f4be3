"""Transcripts, sets of finished work and feeds in files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.functions.columns import iso_text, iso_time
from segmill.schemas import TRANSCRIPT

REQUIRED = ("id", "text", "start", "end", "is_ad")
KEYS = "key string"


def _missing(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _rows(whole: DataFrame) -> DataFrame:
    rows = whole.select("tid", F.col("time").alias("processed_at"), F.posexplode("segments").alias("pos", "s"))
    return rows.select("tid", "processed_at", F.col("pos").cast("bigint").alias("pos"), "s.id", "s.text", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.is_ad")


def _whole(files: DataFrame) -> tuple[DataFrame, dict]:
    """Transcripts with their time, and what each must have."""
    tid = F.element_at(F.split(F.input_file_name(), "/"), -1)
    named = files.withColumn("tid", F.coalesce("tid", tid)) if "tid" in files.columns else files.withColumn("tid", tid)
    complete = F.col("segments").isNotNull() & F.col("processed_at").isNotNull()
    lacks = F.exists("segments", lambda s: F.greatest(*(s[k].isNull() for k in REQUIRED)))
    checks = {"a transcript lacks a key": complete, "a segment lacks a key": ~lacks, "processed_at is no ISO time": F.col("time").isNotNull()}
    return named.withColumn("time", iso_time(F.col("processed_at"))), checks


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Segments of the transcripts below a path: a file each, whose name is tid, or lines of JSON as write_transcripts
    writes them. Every key is required and processed_at must be an ISO time: malformed JSON or a missing key raises."""
    reader = spark.read.schema(f"tid string, {TRANSCRIPT}" if lines else TRANSCRIPT).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST")
    whole, checks = _whole(reader.json(path))
    for says, check in checks.items():
        whole = whole.withColumn("_ok", F.assert_true(F.coalesce(check, F.lit(False)), says)).where("_ok is null")
    return _rows(whole)


def readable_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Like read_transcripts, but what can't be read is left out, and a missing path has none: a cache."""
    schema = f"tid string, {TRANSCRIPT}" if lines else TRANSCRIPT
    if _missing(spark, path):
        return _rows(_whole(spark.createDataFrame([], f"tid string, {TRANSCRIPT}"))[0])
    whole, checks = _whole(spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").json(path))
    for check in checks.values():
        whole = whole.where(F.coalesce(check, F.lit(False)))
    return _rows(whole)


def write_transcripts(segments: DataFrame, path: str, processed_at: str) -> None:
    """A line of JSON for each transcript, with the given time. The lines are in as many files as there are partitions."""
    entry = F.struct("pos", "id", "text", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "is_ad")
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.dropFields("pos"))
    time = iso_text(F.lit(processed_at).cast("timestamp"))
    segments.groupBy("tid").agg(ordered.alias("segments")).withColumn("processed_at", time).write.mode("append").json(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """The keys of a set; none if it is missing. Files that can't be read count as none, so their work is done again."""
    if _missing(spark, path):
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).option("ignoreCorruptFiles", "true").parquet(path).where("key is not null").distinct()


def write_processed(keys: DataFrame, path: str) -> None:
    """Add keys to a set; those that it has already stay as they are."""
    new = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    new.join(read_processed(keys.sparkSession, path), "key", "left_anti").write.mode("append").parquet(path)


def import_processed(spark: SparkSession, path: str) -> DataFrame:
    """The keys of JSON lists, one in each file; a missing path or a file that is no list has none."""
    if _missing(spark, path):
        return spark.createDataFrame([], KEYS)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("key")).where("key is not null").distinct()


def feed_entries(xml: DataFrame, feed: str, column: str) -> DataFrame:
    """Entries of RSS feeds in a column of XML: title, description, published and links. Malformed feeds have no entries.

    An enclosure becomes a link with rel `enclosure`; what a feed lacks is an empty string.
    """
    parsed = _parsed(xml, feed, column)
    return _entries(parsed.select(feed, F.posexplode("x.channel.item").alias("pos", "e")), feed)


def _entries(rows: DataFrame, feed: str) -> DataFrame:
    """feed, pos and parsed items e as entries."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias
    links = F.transform(F.coalesce("e.enclosure", F.array()), lambda x: F.struct(F.lit("enclosure").alias("rel"), x["_type"].alias("type"), x["_url"].alias("href")))
    return rows.select(feed, "pos", blank(F.col("e.title"))("title"), blank(F.col("e.description"))("description"), blank(F.col("e.pubDate"))("published"), links.alias("links"))


def feed_channels(xml: DataFrame, feed: str, column: str) -> DataFrame:
    """Title, link and description of RSS feeds; null where a feed lacks one."""
    return _parsed(xml, feed, column).select(feed, "x.channel.title", "x.channel.link", "x.channel.description")


ITEM = "title string, description string, pubDate string, enclosure array<struct<_url: string, _type: string>>"
ITEMS = "array<struct<title: string, description: string, pubDate: string, enclosure: array<struct<_url: string, _type: string>>>>"
CHANNEL = "channel struct<title: string, link: string, description: string{item}>"


def _parsed(xml: DataFrame, feed: str, column: str) -> DataFrame:
    return xml.select(feed, F.from_xml(column, CHANNEL.format(item=f", item: {ITEMS}"), {"mode": "PERMISSIVE"}).alias("x"))


@dataclass(frozen=True)
class FeedFiles:
    """entries: as feed_entries has them. channels: title, link and description of each feed. warnings: feed, pos and what is wrong
    with it there; what could be read of such a feed is in the others all the same."""

    entries: DataFrame
    channels: DataFrame
    warnings: DataFrame


def read_feed_files(spark: SparkSession, path: str) -> FeedFiles:
    """RSS feeds in files of UTF-8, whose paths are their names.

    Files are split at the ends of items, so a large feed is read by many tasks and no task holds more than an item at once. An
    item's place is the number of items before it, from counts of each block. An item that isn't well formed, and a feed that has
    no channel or doesn't end, give a warning.
    """
    text = spark.read.option("lineSep", "</item>").text(path).withColumns({"feed": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()})
    start = F.regexp_instr("value", F.lit(r"<item[\s>/]"))
    item = F.when(start > 0, F.concat(F.substr("value", start), F.lit("</item>")))
    rows = text.select("feed", "block", "at", item.alias("item"), F.when(start > 0, F.left("value", start - 1)).otherwise(F.col("value")).alias("rest"))
    # of a file's blocks, how many items are before each; then the number within the block
    counts = rows.where("item is not null").groupBy("feed", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feed").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).drop("n")
    within = F.row_number().over(Window.partitionBy("feed", "block").orderBy("at")) - 1
    parsed = F.from_xml("item", f"{ITEM}, _wrong string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"})
    items = rows.where("item is not null").withColumn("within", within).join(offsets, ["feed", "block"]).select("feed", (F.col("before") + F.col("within")).cast("int").alias("pos"), parsed.alias("e"))
    wrong = F.col("e").isNull() | F.col("e._wrong").isNotNull()
    # what is around the items: the head with the channel, and the end
    rest = rows.where("rest like '%<channel%'").select("feed", "block", "at", F.concat("rest", F.lit("</channel></rss>")).alias("xml"))
    first = rest.groupBy("feed").agg(F.min_by("xml", F.struct("block", "at")).alias("xml"))
    channels = first.select("feed", F.from_xml("xml", CHANNEL.format(item=""), {"mode": "PERMISSIVE"}).alias("x")).select("feed", "x.channel.title", "x.channel.link", "x.channel.description")
    has = lambda mark: F.max(F.col("rest").contains(mark))
    whole = rows.groupBy("feed").agg(has("<channel").alias("begins"), has("</channel>").alias("ends"))
    of_feed = whole.select("feed", F.lit(None).cast("int").alias("pos"), F.when(~F.col("begins"), "no channel").when(~F.col("ends"), "the channel has no end").alias("warning")).where("warning is not null")
    of_items = items.where(wrong).select("feed", "pos", F.lit("the item is not well formed").alias("warning"))
    return FeedFiles(_entries(items.where(~wrong), "feed"), channels, of_feed.unionByName(of_items))
