"""Advertisement blocks: expansion by rules, and sessions of flagged segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions.columns import contains_any
from segmill.operators.transcripts import in_order
from segmill.parameters import DEFAULT, Parameters


def expand_ads(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Flag unflagged transitions, and what follows them for as long as it belongs to the block.

    A segment belongs if it is flagged, promotional, or a bridge: the next one is flagged and starts within bridge_gap.
    Segments that don't belong start a new run, so a transition reaches to the end of its run. A transcript without
    flags stays as it is.
    """
    w = in_order()
    bridge = F.lead("is_ad").over(w) & (F.lead("start_s").over(w) - F.col("end_s") <= p.bridge_gap)
    belongs = F.col("is_ad") | contains_any(F.col("text"), p.promotions) | F.coalesce(bridge, F.lit(False))
    rows = segments.withColumns({"_belongs": belongs, "_starts": contains_any(F.col("text"), p.transitions) & ~F.col("is_ad")})
    rows = rows.withColumn("_run", F.sum((~F.col("_belongs")).cast("bigint")).over(w))
    reached = F.max("_starts").over(Window.partitionBy("tid", "_run").orderBy("pos"))
    any_ad = F.max("is_ad").over(Window.partitionBy("tid"))
    return rows.withColumn("is_ad", F.col("is_ad") | (any_ad & reached)).select(*segments.columns)


def with_blocks(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """The flagged segments with the number of their block (`block`, from 1): a block ends at a segment that isn't flagged,
    or at a silence of over block_gap."""
    rows = segments.withColumn("_new", starts_block(p))
    return rows.withColumn("block", F.sum(F.col("_new").cast("bigint")).over(in_order())).where("is_ad").drop("_new")


def ad_blocks(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Of each block: first and last id, start of the first, end of the last, duration, and ids in order."""
    blocks = with_blocks(segments, p).groupBy("tid", "block").agg(
        F.min_by("id", "pos").alias("first_id"),
        F.max_by("id", "pos").alias("last_id"),
        F.min_by("start_s", "pos").alias("start_s"),
        F.max_by("end_s", "pos").alias("end_s"),
        F.count("*").alias("n_segments"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"),
    )
    return blocks.withColumn("duration_s", F.round(F.col("end_s") - F.col("start_s"), 6))


def segment_report(segments: DataFrame) -> DataFrame:
    return segments.select("tid", "id", "start_s", "end_s", "is_ad", F.round(F.col("end_s") - F.col("start_s"), 6).alias("duration_s"))


def starts_block(p: Parameters = DEFAULT) -> Column:
    """Whether a segment is the first of a block."""
    w = in_order()
    goes_on = F.lag("is_ad").over(w) & (F.col("start_s") - F.lag("end_s").over(w) <= p.block_gap)
    return F.col("is_ad") & ~F.coalesce(goes_on, F.lit(False))


def transcript_report(segments: DataFrame, p: Parameters = DEFAULT, errors: DataFrame | None = None) -> DataFrame:
    """Of each transcript: segments, flagged ones, and blocks; with errors (tid, chunk_id, error) also these, in order."""
    counted = segments.withColumn("_new", starts_block(p)).groupBy("tid").agg(F.count("*").alias("n_segments"), F.count_if("is_ad").alias("n_ads"), F.count_if("_new").alias("n_blocks"))
    if errors is None:
        return counted
    said = F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string"), F.lit(": "), F.col("error"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", said.alias("said")))), lambda x: x["said"])
    return counted.join(errors.groupBy("tid").agg(listed.alias("errors")), "tid", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
