"""Podcast feeds: episodes with audio, rewritten URLs, and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.columns import process_url, xml_attribute, xml_text


def episodes(entries: DataFrame) -> DataFrame:
    """Entries with a `links` array and the URL of their first audio enclosure; entries without one go."""
    audio = F.filter("links", lambda x: (x["rel"] == "enclosure") & F.startswith(F.coalesce(x["type"], F.lit("")), F.lit("audio/")))
    return entries.withColumn("audio_url", F.get(audio, F.lit(0))["href"]).where("audio_url <> ''").drop("links")


def rewritten(found: DataFrame, base: str) -> DataFrame:
    """Episodes whose audio_url leads to the processing service; original_url keeps the old one."""
    return found.withColumns({"original_url": F.col("audio_url"), "audio_url": process_url(base, F.col("audio_url"))})


def _tag(name: str, column: Column) -> Column:
    text = xml_text(F.coalesce(column, F.lit("")))
    return F.when(text == "", f"<{name} />").otherwise(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")))


def _item() -> Column:
    date = F.when(F.coalesce(F.col("published"), F.lit("")) == "", "").otherwise(F.concat(F.lit("<pubDate>"), xml_text(F.col("published")), F.lit("</pubDate>")))
    enclosure = F.when(F.coalesce(F.col("audio_url"), F.lit("")) == "", "").otherwise(F.concat(F.lit('<enclosure url="'), xml_attribute(F.col("audio_url")), F.lit('" type="audio/mpeg" />')))
    return F.concat(F.lit("<item>"), _tag("title", F.col("title")), _tag("description", F.col("description")), date, enclosure, F.lit("</item>"))


def _heads(feeds: DataFrame, feed: str, channels: DataFrame | None, title: str, description: str) -> DataFrame:
    """feed and _head of each row of feeds. What a channel lacks gets the default; what is empty stays so."""
    named = feeds
    if channels is None:
        named = named.withColumns({"_title": F.lit(None).cast("string"), "_link": F.lit(None).cast("string"), "_description": F.lit(None).cast("string")})
    else:
        named = named.join(channels.select(feed, F.col("title").alias("_title"), F.col("link").alias("_link"), F.col("description").alias("_description")), feed, "left")
    head = F.concat(F.lit('<rss version="2.0"><channel>'), _tag("title", F.coalesce("_title", F.lit(title))), _tag("link", F.coalesce("_link", F.lit(""))), _tag("description", F.coalesce("_description", F.lit(description))))
    return named.withColumn("_head", head).drop("_title", "_link", "_description")


TAIL = "</channel></rss>"


def _joined(order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), _item().alias("item")))), lambda x: x["item"]), "")


def feed_xml(found: DataFrame, feed: str, order: str, channels: DataFrame | None = None, title: str = "Episodes", description: str = "Episodes without advertisements") -> DataFrame:
    """The XML of each feed: found has the columns feed, order, title, description, published and audio_url; channels has
    feed (unique), title, link and description, with the defaults for what is null.

    A feed is one value here, as its readers want it; feed_xml_parts has no such bound.
    """
    whole = found.groupBy(feed).agg(_joined(order).alias("_items"))
    return _heads(whole, feed, channels, title, description).select(feed, F.concat("_head", "_items", F.lit(TAIL)).alias("xml"))


def feed_xml_parts(found: DataFrame, feed: str, order: str, channels: DataFrame | None = None, title: str = "Episodes", description: str = "Episodes without advertisements", partitions: int | None = None) -> DataFrame:
    """The same XML as rows (feed, part, xml), which one after another are the text. Rows are dealt by ranges of feed and
    order, so a feed with a third of all episodes has many parts and no task has all of them."""
    n = partitions or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(n, feed, order).withColumn("_part", F.spark_partition_id().cast("bigint"))
    items = dealt.groupBy(feed, "_part").agg(_joined(order).alias("xml")).select(feed, F.col("_part").alias("part"), "xml")
    feeds_ = found.select(feed).distinct()
    heads = _heads(feeds_, feed, channels, title, description).select(feed, F.lit(-1).cast("bigint").alias("part"), F.col("_head").alias("xml"))
    tails = feeds_.select(feed, F.lit(n).cast("bigint").alias("part"), F.lit(TAIL).alias("xml"))
    return heads.unionByName(items).unionByName(tails)


def last_written(cache: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of each key the value that was written last."""
    return cache.groupBy(key).agg(F.max_by(value, order).alias(value))
