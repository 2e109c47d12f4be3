"""Interval union and complement: what is cut from an episode's audio, and what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions.columns import to_ms
from segmill.operators.ads import starts_block
from segmill.parameters import DEFAULT, Parameters


def merged_intervals(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Union of the flagged segments' intervals: an interval that starts within max_gap of the end so far joins it. Unions
    shorter than min_duration go. Segments that end before they start are left out."""
    w = Window.partitionBy("tid").orderBy("start_s", "end_s")
    ads = segments.where(F.col("is_ad") & (F.col("end_s") >= F.col("start_s"))).select("tid", "start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_s") > before + p.max_gap, F.lit(True))
    islands = ads.withColumn("_new", new.cast("bigint"))
    islands = islands.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("tid", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return merged.where(F.col("end_s") - F.col("start_s") >= p.min_duration).drop("island")


def merge_counts(segments: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Intervals of each transcript before and after merging."""
    before = segments.where(F.col("is_ad") & (F.col("end_s") >= F.col("start_s"))).groupBy("tid").agg(F.count("*").alias("n_before"))
    after = merged_intervals(segments, p).groupBy("tid").agg(F.count("*").alias("n_after"))
    return before.join(after, "tid", "left").select("tid", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


def kept_spans(merged: DataFrame, audio: DataFrame) -> DataFrame:
    """The complement of the merged intervals in each episode's audio (tid, len_ms), in milliseconds. Without intervals the
    whole audio stays."""
    w = Window.partitionBy("tid").orderBy("a_ms", "b_ms")
    cuts = merged.select("tid", to_ms(F.col("start_s")).alias("a_ms"), to_ms(F.col("end_s")).alias("b_ms"))
    rows = audio.select("tid", "len_ms").join(cuts, "tid", "left")
    rows = rows.withColumns({"_from": F.lag("b_ms", 1, 0).over(w), "_last": F.lead("a_ms").over(w).isNull()})
    whole = F.col("a_ms").isNull()
    gap = F.struct(F.col("_from").alias("from_ms"), F.col("a_ms").alias("to_ms"), (F.col("_from") < F.col("a_ms")).alias("keep"))
    tail = F.struct(F.coalesce("b_ms", F.lit(0)).alias("from_ms"), F.col("len_ms").alias("to_ms"), (whole | (F.col("_last") & (F.col("b_ms") < F.col("len_ms")))).alias("keep"))
    return rows.select("tid", "len_ms", F.explode(F.array(gap, tail)).alias("s")).where("s.keep").select("tid", "s.from_ms", "s.to_ms", "len_ms")


def reduction_report(segments: DataFrame, audio: DataFrame, p: Parameters = DEFAULT) -> DataFrame:
    """Of each episode: segments, flagged ones, blocks, milliseconds cut and kept, and percent saved.

    One frame of windows by tid gives blocks and unions together: a segment that is in no union is counted with the union
    before it. What stays is the audio but for the parts of the unions inside it.
    """
    cut = F.col("is_ad") & (F.col("end_s") >= F.col("start_s"))
    # cuts come first, so that other segments don't stand between them
    w = Window.partitionBy("tid").orderBy(F.desc("_cut"), "start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.select("tid", "pos", "is_ad", "start_s", "end_s").withColumns({"_new_block": starts_block(p), "_cut": F.coalesce(cut, F.lit(False))})
    rows = rows.withColumn("_new", (F.col("_cut") & F.coalesce(F.col("start_s") > before + p.max_gap, F.lit(True))).cast("bigint"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    unions = rows.groupBy("tid", "_island").agg(
        F.count("*").alias("n"), F.count_if("is_ad").alias("ads"), F.count_if("_new_block").alias("blocks"),
        F.min(F.when(F.col("_cut"), F.col("start_s"))).alias("a"), F.max(F.when(F.col("_cut"), F.col("end_s"))).alias("b"),
    )
    # the audio ends where it ends, whatever the transcript says
    within = lambda c: F.least(to_ms(F.col(c)), F.col("len_ms"))
    long = F.coalesce(F.col("b") - F.col("a") >= p.min_duration, F.lit(False))
    rows = unions.join(audio.select("tid", "len_ms"), "tid").withColumn("_long", long)
    totals = rows.groupBy("tid", "len_ms").agg(
        F.sum("n").alias("n_segments"), F.sum("ads").alias("n_ads"), F.sum("blocks").alias("n_blocks"),
        F.sum(F.when(F.col("_long"), (F.col("b") - F.col("a")) * 1000)).alias("removed"),
        F.sum(F.when(F.col("_long"), within("b") - within("a"))).alias("cut"),
        F.min(F.when(F.col("_long"), within("a"))).alias("first"),
    )
    # nothing is kept before 0
    kept_ms = F.col("len_ms") - F.coalesce("cut", F.lit(0)) - F.least(F.coalesce("first", F.lit(0)), F.lit(0))
    percent = F.when(F.col("len_ms") > 0, F.round((F.col("len_ms") - kept_ms).cast("double") / F.col("len_ms").cast("double") * 100, 6))
    return totals.select("tid", "n_segments", "n_ads", "n_blocks", F.coalesce(F.round("removed", 3), F.lit(0.0)).alias("removed_ms"), kept_ms.alias("kept_ms"), percent.alias("reduction_percent"))
