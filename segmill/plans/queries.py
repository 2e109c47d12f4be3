"""The registered queries on transcripts, messages and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import columns as C
from segmill.operators import ads, feeds, intervals, messages, transcripts
from segmill.parameters import Parameters
from segmill.plans import fixtures as X

DOC_CHUNKS = Parameters(chunk_size=6)


def segments_from_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.doc_segments(spark, sf_dir)
    padded = F.concat(F.lit(" \t\u00a0\u2003\x1f"), "text", F.lit("\n\u3000 \x85"))
    answer = F.transform(F.sort_array(F.collect_list(F.struct("pos", padded.alias("text"), "start_s", "end_s"))), lambda x: F.struct(x["text"].alias("text"), x["start_s"].alias("start"), x["end_s"].alias("end")))
    return transcripts.segments_from_model(rows.groupBy("tid").agg(answer.alias("segments")))


def ad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.ad_segments(X.doc_segments(spark, sf_dir))


def non_ad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.non_ad_segments(X.doc_segments(spark, sf_dir))


def promo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.promo_segments(X.doc_segments(spark, sf_dir)).select("tid", "id")


def transition_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transition_segments(X.doc_segments(spark, sf_dir)).select("tid", "id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chunks(X.doc_segments(spark, sf_dir), DOC_CHUNKS).select("tid", "id", "chunk_id")


def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chunk_prompts(transcripts.chunks(X.doc_segments(spark, sf_dir), DOC_CHUNKS))


def dedup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.doc_segments(spark, sf_dir).withColumn("ingest_pos", F.col("pos"))
    again = rows.where("(tid + id) % 5 = 0").withColumns({"text": F.concat("text", F.lit(" v2")), "ingest_pos": F.col("pos") + 100000})
    return transcripts.last_of_each_id(rows.unionByName(again)).drop("ingest_pos")


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.expand_ads(X.doc_segments(spark, sf_dir))


def _expanded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.expand_ads(X.event_segments(spark, sf_dir), X.EVENT_PARAMETERS)


def expand_ad_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select("tid", "id", "is_ad")


def ad_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.ad_blocks(_expanded(spark, sf_dir))


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_intervals(_expanded(spark, sf_dir))


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_counts(_expanded(spark, sf_dir))


def kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _expanded(spark, sf_dir)
    return intervals.kept_spans(intervals.merged_intervals(rows), X.audio(rows)).drop("len_ms")


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.segment_report(_expanded(spark, sf_dir))


def transcript_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.transcript_report(_expanded(spark, sf_dir))


def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _expanded(spark, sf_dir)
    return intervals.reduction_report(rows, X.audio(rows))


def ad_blocks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.ad_blocks(_expanded_events(spark, sf_dir), X.EVENT_PARAMETERS)


def merged_intervals_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_intervals(_expanded_events(spark, sf_dir), X.EVENT_PARAMETERS)


def kept_spans_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _expanded_events(spark, sf_dir)
    return intervals.kept_spans(intervals.merged_intervals(rows, X.EVENT_PARAMETERS), X.audio(rows)).drop("len_ms")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = transcripts.chunks(X.conversation_segments(spark, sf_dir), Parameters(chunk_size=X.CONVERSATION_CHUNK))
    return transcripts.merge_answers(chunked, X.conversation_answers(spark, sf_dir))


def merge_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("tid", "id", "is_ad", "matched")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chunk_stats(_merged(spark, sf_dir))


def message_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages.from_envelopes(X.envelopes(spark, sf_dir))
    return found.select("seq", "topic", "correlation_id", "data", F.get_json_object("data", "$.file_path").alias("file_path"))


def next_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.next_requests(X.message_log(spark, sf_dir))


def invalid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.invalid_requests(X.message_log(spark, sf_dir))


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.request_status(X.message_log(spark, sf_dir), X.submissions(spark, sf_dir))


def request_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.request_steps(X.message_log(spark, sf_dir), X.submissions(spark, sf_dir))


def unknown_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.unknown_updates(X.message_log(spark, sf_dir), X.submissions(spark, sf_dir))


def claim_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.claim_outcome(X.claims(X.message_log(spark, sf_dir)), busy="in_progress")


def _work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = X.claims(X.message_log(spark, sf_dir))
    requests = events.where("event = 'request'").select("seq", "key")
    # few items are done
    return requests, events.where("event = 'done' and seq % 29 = 0"), requests.where("seq % 4 <> 0").select("key")


def new_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, done, _ = _work(spark, sf_dir)
    return messages.new_work(requests, done).select("seq", "key")


def already_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.already_processed(*_work(spark, sf_dir)).select("seq", "key")


def feed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("rss_url"))
    return messages.feed_requests(pages, pages.where("page_id % 13 = 0")).select("page_id", "already_processed")


def serve_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("url"))
    return messages.serve_decision(requests, X.produced_files(spark, sf_dir), X.stored_objects(spark, sf_dir))


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.page_targets(spark, sf_dir)
    name, value = C.route(F.col("target")), C.query_value(F.col("target"), "url")
    lacks = F.col("route").isin("process", "rss") & F.col("url_value").isNull()
    code = F.when(F.col("route").isNull(), 404).when(lacks, 400).otherwise(200)
    return rows.withColumns({"route": name, "url_value": value}).select("page_id", "route", "url_value", code.alias("status"))


def feed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.rewritten(feeds.episodes(X.page_entries(spark, sf_dir)), "http://localhost:8080").select("page_id", "host", "title", "audio_url", "original_url")


def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_xml(feeds.episodes(X.page_entries(spark, sf_dir)), "host", "page_id", X.channels(spark, sf_dir))


def feed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.last_written(X.page_entries(spark, sf_dir), "host", "page_id", "title")


def storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return X.table(spark, sf_dir, "pages").select("page_id", C.key_of_path(url).alias("path_key"), C.key_of_url(url).alias("url_key"), C.clean_name(C.base_name(url)).alias("clean_name"))


def existing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = X.table(spark, sf_dir, "pages").select("page_id", F.concat(C.key_of_url(F.col("url")), F.lit(".mp3")).alias("key"))
    return keys.join(X.stored_objects(spark, sf_dir), "key", "left_semi").select("page_id", "key")


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("url", F.element_at(F.array(F.lit(".mp3"), F.lit(".wav"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))
    return X.table(spark, sf_dir, "pages").select("page_id", C.content_type(name).alias("content_type"))


QUERIES = (
    segments_from_model, ad_segments, non_ad_segments, promo_segments, transition_segments, chunks, chunk_prompts, dedup_segments,
    expand_ad_blocks, ad_blocks, merged_intervals, merge_counts, kept_spans, segment_report, transcript_report, reduction_report,
    ad_blocks_events, merged_intervals_events, kept_spans_events, merge_classifications, chunk_stats,
    message_envelopes, next_requests, invalid_requests, request_status, request_steps, unknown_updates, claim_outcome, new_work, already_processed, feed_requests,
    serve_decision,
    route_requests, feed_episodes, feed_xml, feed_cache, storage_keys, existing_objects, content_type,
)
