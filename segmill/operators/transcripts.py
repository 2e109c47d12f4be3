"""Operators on transcripts, which are ordered, timed text segments: one row per segment, `pos` is its place.

All windows are per transcript (tid), so the operators share one shuffle by tid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions.columns import contains_any, strip
from segmill.parameters import DEFAULT, Parameters


def in_order() -> Window:
    return Window.partitionBy("tid").orderBy("pos")


def segments_from_model(answers: DataFrame) -> DataFrame:
    """One row per segment of a speech model's answer (tid, segments): numbered from 0, stripped, not flagged."""
    rows = answers.select("tid", F.posexplode("segments").alias("pos", "s"))
    place = F.col("pos").cast("bigint")
    return rows.select("tid", place.alias("id"), place.alias("pos"), strip(F.col("s.text")).alias("text"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.lit(False).alias("is_ad"))


def ad_segments(segments: DataFrame) -> DataFrame:
    return segments.where("is_ad")


def non_ad_segments(segments: DataFrame) -> DataFrame:
    return segments.where("not is_ad")


def promo_segments(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    return segments.where(contains_any(F.col("text"), p.promotions))


def transition_segments(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    return segments.where(contains_any(F.col("text"), p.transitions))


def last_of_each_id(segments: DataFrame, arrival: str = "ingest_pos") -> DataFrame:
    """Of the segments with the same tid and id, the one that arrived last."""
    latest = F.row_number().over(Window.partitionBy("tid", "id").orderBy(F.desc(arrival)))
    return segments.withColumn("_n", latest).where("_n = 1").drop("_n")


def chunks(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Segments with chunk_id: each chunk has chunk_size of them in order, the last one the rest."""
    place = F.row_number().over(in_order()) - 1
    return segments.withColumn("chunk_id", F.floor(place / p.chunk_size).cast("bigint"))


def chunk_prompts(chunked: DataFrame) -> DataFrame:
    """The segments of each chunk as lines for a classifier."""
    line = F.concat(F.lit("ID: "), F.col("id").cast("string"), F.lit(" Text: "), F.col("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return chunked.groupBy("tid", "chunk_id").agg(F.array_join(lines, "\n").alias("prompt"))


def first_answers(answers: DataFrame) -> DataFrame:
    """Of the answers of a chunk for the same id, the first."""
    return answers.groupBy("tid", "chunk_id", "id").agg(F.min_by("ad", "apos").alias("ad"))


def merge_answers(chunked: DataFrame, answers: DataFrame) -> DataFrame:
    """Segments with a chunk_id, flagged as the first answer for their id says that was given for their chunk; without one
    they keep their flag. `matched` tells whether there was one. Answers for ids that their chunk doesn't have are dropped."""
    found = first_answers(answers).withColumn("_found", F.lit(True))
    joined = chunked.join(found, ["tid", "chunk_id", "id"], "left")
    matched = F.coalesce("_found", F.lit(False))
    return joined.withColumns({"is_ad": F.coalesce("ad", "is_ad"), "matched": matched}).select(*chunked.columns, "matched")


def chunk_stats(merged: DataFrame) -> DataFrame:
    """Of each chunk: segments, those with an answer, and those of them that are ads."""
    return merged.groupBy("tid", "chunk_id").agg(
        F.count("*").alias("n_total"),
        F.count_if("matched").alias("n_updated"),
        F.count_if(F.col("matched") & F.col("is_ad")).alias("n_ads"),
    )
