"""Registered queries that go through streams, logs, object stores and files: what a table holds is written in parts, taken by the
operator under test, and its last state is the result. Their SQL is that of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import classifier, feeds, transcripts
from segmill.operators import messages as M
from segmill.plans import fixtures as X
from segmill.plans import queries as Q
from segmill.plans.oracle import SQL
from segmill.sources.files import read_feed_files
from segmill.sources.objects import ObjectStore
from segmill.sources.shared import new_shared_folder
from segmill.streaming import log, lookups
from segmill.streaming import messages as S

PARTS = 4
#: Files of a part, which tasks write side by side.
FILES = 8


def _in_parts(df: DataFrame, folder: str, order: str, files: int = 1) -> str:
    """The rows as JSON files in the order of a column, some files for each part, so that a stream takes several batches."""
    # the ranges of a sorted column are the parts' order, and so are the files' names
    df.repartitionByRange(PARTS * files, order).write.json(folder)
    return folder


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last changes of all requests, from streams of messages and submissions."""
    spark.conf.set(*S.STATE_STORE)
    folder = new_shared_folder(spark, "requests")
    told = _in_parts(X.message_log(spark, sf_dir), f"{folder}/messages", "seq", FILES)
    opened = _in_parts(X.submissions(spark, sf_dir), f"{folder}/submissions", "seq", FILES)
    # parts of the two streams end at different numbers, and files of a stream may change places, so messages may overtake a submission
    changes = S.request_changes_stream(S.read_messages(spark, told, FILES), S.read_submissions(spark, opened, FILES), hold=True)
    S.to_table(changes, f"{folder}/changes", f"{folder}/checkpoint", "update").awaitTermination()
    return S.latest_changes(spark.read.parquet(f"{folder}/changes"))


def request_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changed_requests(_folded(spark, sf_dir)).select("correlation_id", "type", "url", "status", "n_steps", "last_seq")


def request_steps_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changed_steps(_folded(spark, sf_dir)).drop("batch")


def serve_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """serve_decision, with the produced files in stream state."""
    spark.conf.set(*S.STATE_STORE)
    folder = new_shared_folder(spark, "produced")
    writes = X.produced_files(spark, sf_dir).select(F.col("url").alias("key"), F.col("file").alias("value"), "seq")
    stream = spark.readStream.schema(lookups.MAPPED).option("maxFilesPerTrigger", 1).json(_in_parts(writes, f"{folder}/in", "seq"))
    S.to_table(lookups.last_written_stream(stream, buckets=16), f"{folder}/changes", f"{folder}/checkpoint", "update").awaitTermination()
    requests = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("url"))
    return M.serve_decision(requests, lookups.produced_files(spark, f"{folder}/checkpoint"), X.stored_objects(spark, sf_dir))


def logged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """next_requests of messages that come from a log and go to another as JSON."""
    folder = new_shared_folder(spark, "log")
    told, sent = log.FileLog.at(spark, f"{folder}/in"), log.FileLog.at(spark, f"{folder}/out")
    rows = X.message_log(spark, sf_dir).select("topic", F.to_json(F.struct("file_path")).alias("data"), F.col("seq").cast("string").alias("message_id"), "correlation_id")
    M.to_envelopes(rows).select("value").write.text(f"{folder}/texts")
    log.write_log(spark.readStream.text(f"{folder}/texts"), told, f"{folder}/c1").awaitTermination()
    messages = M.from_envelopes(log.read_log(spark, told, most=5000))
    requests = M.next_requests(M.log_of(messages.withColumn("seq", F.col("message_id").cast("bigint"))))
    data = F.to_json(F.struct("file_path", "seq")).alias("data")
    log.write_log(M.to_envelopes(requests.select("topic", data, F.lit("m").alias("message_id"), "correlation_id")), sent, f"{folder}/c2").awaitTermination()
    return M.from_envelopes(log.log_table(spark, sent)).select(F.get_json_object("data", "$.seq").cast("bigint").alias("seq"), "topic", "correlation_id", F.get_json_object("data", "$.file_path").alias("file_path"))


def listed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put under their keys by tasks, then listed by a prefix, with the sizes of what is there."""
    store = ObjectStore(spark, new_shared_folder(spark, "objects"))
    pages = X.table(spark, sf_dir, "pages").where("url <> ''")
    store.put_all(pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("key"), F.col("html").cast("binary").alias("content")))
    return store.list_by_prefix("pages/1").select("key", "size")


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds' XML in a file for each, read back as entries: of each feed the places, titles (without spaces at the ends, as
    XML is read) and URLs of its episodes."""
    folder = new_shared_folder(spark, "feeds")
    episodes = feeds.episodes(X.page_entries(spark, sf_dir))
    whole = feeds.feed_xml(episodes, "host", "page_id", X.channels(spark, sf_dir)).where("host <> ''")
    ObjectStore(spark, folder).put_all(whole.select(F.col("host").alias("key"), F.col("xml").cast("binary").alias("content")))
    found = feeds.episodes(read_feed_files(spark, folder).entries)
    return found.select(F.element_at(F.split("feed", "/"), -1).alias("host"), F.col("pos").cast("bigint").alias("pos"), "title", "audio_url")


def asked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents asked of a classifier that takes lines with "Tickets" for advertising, and its answers merged."""
    folder = new_shared_folder(spark, "asked")
    chunked = transcripts.chunks(X.doc_segments(spark, sf_dir), Q.DOC_CHUNKS)
    transcripts.chunk_prompts(chunked).write.parquet(f"{folder}/prompts")
    answered = classifier.ask(spark.read.parquet(f"{folder}/prompts"), lambda: _tickets, f"{folder}/answers", together=1000, per_task=2000)
    merged = transcripts.merge_answers(chunked, classifier.answer_rows(answered))
    return merged.select("tid", "id", "is_ad", "matched")


def _tickets(messages: list[dict[str, str]]) -> dict:
    lines = [line for line in messages[1]["content"].split("\n") if line.startswith("ID: ")]
    return {"segments": [{"id": int(line[4:].split(" ", 1)[0]), "ad": "Tickets" in line} for line in lines if "e" in line]}


QUERIES = (request_status_stream, request_steps_stream, serve_from_state, logged_requests, listed_objects, feed_files, asked_chunks)

STREAM_SQL = {
    "request_status_stream": SQL["request_status"],
    "request_steps_stream": SQL["request_steps"],
    "serve_from_state": SQL["serve_decision"],
    "logged_requests": SQL["next_requests"],
    "listed_objects": """
SELECT 'pages/' || CAST(page_id AS VARCHAR) AS key, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages
WHERE url <> '' AND CAST(page_id AS VARCHAR) LIKE '1%'""",
    "feed_files": """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) - 1 AS pos,
       trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, url AS audio_url
FROM pages WHERE page_id % 3 IN (0, 2) AND url <> '' AND regexp_extract(url, '^https?://([^/]+)', 1) <> ''""",
    "asked_chunks": f"""
WITH {X.DOC_SEGMENTS_SQL},
asked AS (SELECT *, 'ID: ' || CAST(id AS VARCHAR) || ' Text: ' || text AS line FROM segments)
SELECT tid, id, CASE WHEN contains(line, 'e') THEN contains(line, 'Tickets') ELSE is_ad END AS is_ad, contains(line, 'e') AS matched FROM asked""",
}
