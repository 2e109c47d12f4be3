"""Detection of advertisements and what follows from it, as one call.

A classifier costs much, so its answers are kept as they come: a call on the same folder after one that was killed asks only
for what lacks an answer. Every step's table stays in the folder as a record of what was asked and answered. Counts are observed
while the tables are written, so they need no second scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from segmill.operators.ads import ad_blocks, expand_ads, segment_report, transcript_report
from segmill.operators.classifier import Classifier, Transcriber, answer_rows, ask, errors, transcribe
from segmill.operators.intervals import kept_spans, merged_intervals, reduction_report
from segmill.operators.transcripts import chunk_prompts, chunk_stats, chunks, last_of_each_id, merge_answers, segments_from_model
from segmill.parameters import DEFAULT, Parameters


@dataclass(frozen=True)
class Detection:
    """segments: the transcripts with flags. merged: as the answers say, before rules and repeated ids. The rest are reports.
    figures: n_total, n_updated and n_answered_ads of the merge, n_segments and n_ads of the result, over all transcripts."""

    segments: DataFrame
    merged: DataFrame
    blocks: DataFrame
    errors: DataFrame
    chunks: DataFrame
    report: DataFrame
    segment_report: DataFrame
    figures: dict[str, int]


@dataclass(frozen=True)
class Cleaning:
    """What is cut from each episode's audio and what stays. figures: n_intervals of the cuts and their seconds, over all."""

    detection: Detection
    cuts: DataFrame
    kept: DataFrame
    report: DataFrame
    figures: dict[str, int | float]


def _written(df: DataFrame, path: str, figures: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The table that was written, and aggregates of its rows that were taken on the way."""
    seen = Observation()
    observed = df.observe(seen, *(c.alias(name) for name, c in figures.items())) if figures else df
    observed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if figures else {}


def detect_ads(segments: DataFrame, make_classifier: Callable[[], Classifier], folder: str, p: Parameters = DEFAULT, attempts: int = 3, pause_s: float = 2.0) -> Detection:
    """Chunk, ask, merge the answers, take the last segment of each id, order by id, expand, and report.

    The folder gets the tables prompts, answers, merged and segments. A chunk that had no answer keeps its flags and has
    an error.
    """
    chunked = chunks(segments, p)
    prompts, _ = _written(chunk_prompts(chunked), f"{folder}/prompts")
    answered = ask(prompts, make_classifier, f"{folder}/answers", attempts, pause_s)
    of_merge = {"n_total": F.count("*"), "n_updated": F.count_if("matched"), "n_answered_ads": F.count_if(F.col("matched") & F.col("is_ad"))}
    merged, merge_figures = _written(merge_answers(chunked, answer_rows(answered)), f"{folder}/merged", of_merge)
    failed = errors(answered)
    # from here on a transcript is in the order of its ids
    unique = last_of_each_id(merged, "pos").drop("chunk_id", "matched").withColumn("pos", F.col("id"))
    final, final_figures = _written(expand_ads(unique, p), f"{folder}/segments", {"n_segments": F.count("*"), "n_ads": F.count_if("is_ad")})
    return Detection(final, merged, ad_blocks(final, p), failed, chunk_stats(merged), transcript_report(final, p, failed), segment_report(final), merge_figures | final_figures)


def clean(segments: DataFrame, audio: DataFrame, make_classifier: Callable[[], Classifier], folder: str, p: Parameters = DEFAULT, attempts: int = 3, pause_s: float = 2.0) -> Cleaning:
    """Detect advertisements in transcripts and plan the cuts of their audio (tid, len_ms). The folder gets the table cuts too."""
    found = detect_ads(segments, make_classifier, folder, p, attempts, pause_s)
    cuts, figures = _written(merged_intervals(found.segments, p), f"{folder}/cuts", {"n_intervals": F.count("*"), "cut_s": F.coalesce(F.sum(F.col("end_s") - F.col("start_s")), F.lit(0.0))})
    return Cleaning(found, cuts, kept_spans(cuts, audio), reduction_report(found.segments, audio, p), figures)


def transcribe_new(audio: DataFrame, cached: DataFrame, make_model: Callable[[], Transcriber]) -> DataFrame:
    """Segments of the audio (tid, content) that the cache has no readable transcript of."""
    new = audio.join(cached.select("tid").distinct(), "tid", "left_anti")
    return segments_from_model(transcribe(new, make_model))
