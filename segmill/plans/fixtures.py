"""Inputs of the registered queries, derived from the driver's tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.functions.columns import key_of_url
from segmill.operators.messages import to_envelopes
from segmill.parameters import Parameters

#: Events of a user lie hours apart.
EVENT_PARAMETERS = Parameters(bridge_gap=21600.0, block_gap=21600.0, max_gap=43200.0, min_duration=600.0)
#: Conversations are short.
CONVERSATION_CHUNK = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments; phrases, gaps and flags follow from the numbers of document and line."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("tid"), F.posexplode(F.split("text", "\n")).alias("id", "line")).where("line <> ''")
    lines = lines.withColumn("id", F.col("id").cast("bigint"))
    tid, n = F.col("tid"), F.col("id")
    text = F.concat("line", F.when((tid * 7 + n * 3) % 11 == 0, " Bleiben Sie dran.").otherwise(""), F.when((tid + n * 5) % 7 == 0, " Alle Infos und Tickets.").otherwise(""))
    w = Window.partitionBy("tid").orderBy("id")
    length = F.length("line") * 60
    gap = (tid * 13 + n * 29) % 40 * 500
    rows = lines.select("tid", "id", text.alias("text"), length.cast("bigint").alias("dur"), gap.alias("gap"))
    rows = rows.withColumns({"pos": (F.row_number().over(w) - 1).cast("bigint"), "end_ms": F.sum(F.col("dur") + F.col("gap")).over(w)})
    start, end = (F.col("end_ms") - F.col("dur")).cast("double") / 1000, F.col("end_ms").cast("double") / 1000
    return rows.select("tid", "id", "pos", "text", start.alias("start_s"), end.alias("end_s"), ((tid * 5 + n * 11) % 4 == 0).alias("is_ad"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as segments, which overlap."""
    events = table(spark, sf_dir, "events").withColumn("tid", F.col("user_id"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    # by tid, as the operators' windows are: one shuffle serves all
    place = (F.row_number().over(Window.partitionBy("tid").orderBy("ts", "event_id")) - 1).cast("bigint")
    start = micros.cast("double") / 1000000
    return events.withColumn("pos", place).select(
        "tid", F.col("event_id").alias("id"), "pos", F.col("event_type").alias("text"),
        start.alias("start_s"), (start + F.col("value") * 60).alias("end_s"), F.col("event_type").isin("error", "purchase").alias("is_ad"),
    )


def audio(segments: DataFrame) -> DataFrame:
    return segments.groupBy("tid").agg(((F.max("end_s") * 1000).cast("bigint") + 1500).alias("len_ms"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("double")
    return rows.select(F.col("conv_id").alias("tid"), F.col("turn").alias("id"), F.col("turn").alias("pos"), "text", turn.alias("start_s"), (turn + 1).alias("end_s"), (F.col("role") == "system").alias("is_ad"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tid"), "turn")
    odd, chunk = F.col("turn") % 2 == 1, F.floor(F.col("turn") / CONVERSATION_CHUNK).cast("bigint")

    def part(those: DataFrame, chunk_id: Column, after: int, id_: Column, ad: Column) -> DataFrame:
        return those.select("tid", chunk_id.alias("chunk_id"), (F.col("turn") + after).alias("apos"), id_.alias("id"), ad.alias("ad"))

    one = part(rows.where((F.col("tid") + F.col("turn")) % 3 != 0), chunk, 0, F.col("turn"), odd)
    again = part(rows.where("turn % 4 = 0"), chunk, 1000, F.col("turn"), ~odd)
    unknown = part(rows, chunk, 2000, F.col("turn") + 100, F.lit(True))
    # answers for segments of the other chunk, before and after those of their own
    foreign = part(rows.where("turn % 5 < 3"), 1 - chunk, -1000, F.col("turn"), ~odd)
    return one.unionByName(again).unionByName(unknown).unionByName(foreign)


TOPICS = {
    "view": "podcast.download.complete",
    "click": "podcast.transcribe.complete",
    "signup": "podcast.ad_detection.complete",
    "purchase": "podcast.audio_processing.complete",
    "error": "podcast.download.failed",
}


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    name = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in TOPICS.items()))
    path = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("podcasts/"), F.md5(F.col("user_id").cast("string"))))
    return events.select(F.col("event_id").alias("seq"), name.alias("topic"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("correlation_id"), path.alias("file_path"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of users: some before all messages, some again in between, some never."""
    events = table(spark, sf_dir, "events").where("user_id % 5 <> 0")
    first = events.where("user_id % 3 <> 0").groupBy("user_id").agg(F.lit(-1).cast("bigint").alias("seq"))
    again = events.where("event_id % 97 = 0").select("user_id", F.col("event_id").alias("seq"))
    user = F.col("user_id").cast("string")
    return first.unionByName(again).select("seq", F.concat(F.lit("u"), user).alias("correlation_id"), F.when(F.col("user_id") % 2 == 0, "download").otherwise("rss").alias("type"), F.concat(F.lit("http://h/"), user, F.lit("/"), F.col("seq").cast("string")).alias("url"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages in JSON: seq and value. Data is an object, a text, a number in a text, a list or null. Every 7th is
    no JSON, every 11th lacks a key, every 13th has text behind it."""
    rows = table(spark, sf_dir, "events")
    n = F.col("event_id")
    whole = F.to_json(F.struct(F.concat(F.lit('fi "'), F.col("event_type")).alias("file_path"), F.col("user_id").alias("user")))
    data = F.when(n % 5 == 0, '"plain \\"text\\" \\\\ "').when(n % 5 == 1, '"5"').when(n % 5 == 2, F.concat(F.lit("[1,{\"a\":null},"), n.cast("string"), F.lit("]"))).when(n % 5 == 3, whole)
    sent = to_envelopes(rows.select(n, F.concat(F.lit("podcast."), F.col("event_type")).alias("topic"), data.alias("data"), F.concat(F.lit("m"), n.cast("string")).alias("message_id"), F.when(n % 3 != 0, F.col("user_id").cast("string")).alias("correlation_id")), keep=("event_id",))
    value = F.when(n % 7 == 0, F.substr("value", F.lit(2))).when(n % 11 == 0, F.replace("value", F.lit('"message_id"'), F.lit('"id"'))).when(n % 13 == 0, F.concat("value", F.lit(' ,"end":"x"} trailing'))).otherwise(F.col("value"))
    return sent.select(n.alias("seq"), value.alias("value"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hosts say of their feeds; some say nothing of one thing, or an empty text."""
    hosts = page_entries(spark, sf_dir).groupBy("host").agg(F.min("page_id").alias("n"))
    title = F.when(F.col("n") % 3 != 0, F.when(F.col("n") % 5 != 0, F.concat(F.lit("Feed & "), "host")).otherwise(""))
    return hosts.where("n % 7 <> 0").select("host", title.alias("title"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://"), "host")).alias("link"), F.lit(None).cast("string").alias("description"))


def claims(log: DataFrame) -> DataFrame:
    """The log as requests for files, and how work on them ended."""
    event = F.when(F.col("topic") == TOPICS["purchase"], "done").when(F.col("topic") == TOPICS["error"], "failed").otherwise("request")
    return log.where("file_path is not null").select("seq", F.col("file_path").alias("key"), event.alias("event"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries; the first link is no enclosure."""
    pages = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "audio/mpeg").when(F.col("page_id") % 3 == 1, "text/html").otherwise("audio/x-m4a")
    links = F.array(F.struct(F.lit("alternate").alias("rel"), F.lit("audio/none").alias("type"), F.lit("x").alias("href")), F.struct(F.lit("enclosure").alias("rel"), kind.alias("type"), F.col("url").alias("href")))
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("description"), F.lit("").alias("published"), links.alias("links"))


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request targets made from pages."""
    pages = table(spark, sf_dir, "pages")
    n, url = F.col("page_id") % 6, F.col("url")
    target = (
        F.when(n == 0, F.concat(F.lit("/process?url="), url)).when(n == 1, F.concat(F.lit("/rss?a=1&url="), url))
        .when(n == 2, F.concat(F.lit("/status?request_id=r"), F.col("page_id").cast("string"))).when(n == 3, F.concat(F.lit("/download/"), F.md5(url)))
        .when(n == 4, "/process?url=").otherwise("/health")
    )
    return pages.select("page_id", target.alias("target"))


def produced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order seq in which they were produced; some URLs have two."""
    pages = table(spark, sf_dir, "pages").where("page_id % 3 = 0")
    name = lambda ending: F.concat(key_of_url(F.col("url")), ending)
    first = pages.select("url", name(F.when(F.col("page_id") % 2 == 0, ".mp3").otherwise(".wav")).alias("file"), F.col("page_id").alias("seq"))
    again = pages.where("page_id % 5 = 0").select("url", name(F.when(F.col("page_id") % 2 == 0, ".wav").otherwise(".mp3")).alias("file"), (F.col("page_id") + 1_000_000_000).alias("seq"))
    return first.unionByName(again)


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 4 <> 1").select(F.concat(key_of_url(F.col("url")), F.lit(".mp3")).alias("key")).distinct()


DOC_SEGMENTS_SQL = """
lines AS (
  SELECT doc_id AS tid, unnest(range(len(string_split(text, chr(10))))) AS id, unnest(string_split(text, chr(10))) AS line FROM documents),
timed AS (
  SELECT tid, id, line, length(line) * 60 AS dur, ((tid * 13 + id * 29) % 40) * 500 AS gap FROM lines WHERE line <> ''),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tid ORDER BY id) - 1 AS pos,
         CAST(sum(dur + gap) OVER (PARTITION BY tid ORDER BY id) AS BIGINT) AS end_ms FROM timed),
segments AS (
  SELECT tid, id, pos,
         line || CASE WHEN (tid * 7 + id * 3) % 11 = 0 THEN ' Bleiben Sie dran.' ELSE '' END
              || CASE WHEN (tid + id * 5) % 7 = 0 THEN ' Alle Infos und Tickets.' ELSE '' END AS text,
         CAST(end_ms - dur AS DOUBLE) / 1000 AS start_s, CAST(end_ms AS DOUBLE) / 1000 AS end_s,
         (tid * 5 + id * 11) % 4 = 0 AS is_ad FROM placed)"""

EVENT_SEGMENTS_SQL = """
segments AS (
  SELECT user_id AS tid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS text,
         CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS start_s, CAST(epoch_us(ts) AS DOUBLE) / 1000000 + value * 60 AS end_s,
         event_type IN ('error', 'purchase') AS is_ad FROM events)"""

AUDIO_SQL = """
audio AS (SELECT tid, CAST(trunc(max(end_s) * 1000) AS BIGINT) + 1500 AS len_ms FROM segments GROUP BY tid)"""

CONVERSATION_SQL = """
segments AS (
  SELECT conv_id AS tid, turn AS id, turn AS pos, text, CAST(turn AS DOUBLE) AS start_s, CAST(turn AS DOUBLE) + 1 AS end_s, role = 'system' AS is_ad
  FROM conversations),
chunked AS (SELECT *, (row_number() OVER (PARTITION BY tid ORDER BY pos) - 1) // 4 AS chunk_id FROM segments),
answers AS (
  SELECT conv_id AS tid, turn // 4 AS chunk_id, turn AS apos, turn AS id, turn % 2 = 1 AS ad FROM conversations WHERE (conv_id + turn) % 3 <> 0
  UNION ALL SELECT conv_id, turn // 4, turn + 1000, turn, turn % 2 <> 1 FROM conversations WHERE turn % 4 = 0
  UNION ALL SELECT conv_id, turn // 4, turn + 2000, turn + 100, true FROM conversations
  UNION ALL SELECT conv_id, 1 - turn // 4, turn - 1000, turn, turn % 2 <> 1 FROM conversations WHERE turn % 5 < 3),
merged AS (
  SELECT c.*, a.ad AS answer
  FROM chunked c LEFT JOIN LATERAL (
    SELECT ad FROM answers a WHERE a.tid = c.tid AND a.chunk_id = c.chunk_id AND a.id = c.id ORDER BY a.apos LIMIT 1) a ON true)"""

LOG_SQL = """
log AS (
  SELECT event_id AS seq,
         CASE event_type WHEN 'view' THEN 'podcast.download.complete' WHEN 'click' THEN 'podcast.transcribe.complete'
              WHEN 'signup' THEN 'podcast.ad_detection.complete' WHEN 'purchase' THEN 'podcast.audio_processing.complete'
              WHEN 'error' THEN 'podcast.download.failed' END AS topic,
         'u' || CAST(user_id AS VARCHAR) AS correlation_id,
         CASE WHEN event_id % 17 <> 0 THEN 'podcasts/' || md5(CAST(user_id AS VARCHAR)) END AS file_path FROM events)"""

ENTRIES_SQL = """
entries AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS audio_url
  FROM pages WHERE page_id % 3 IN (0, 2) AND url <> '')"""

SUBMISSIONS_SQL = """
submissions AS (
  SELECT seq, 'u' || CAST(user_id AS VARCHAR) AS correlation_id, CASE WHEN user_id % 2 = 0 THEN 'download' ELSE 'rss' END AS type,
         'http://h/' || CAST(user_id AS VARCHAR) || '/' || CAST(seq AS VARCHAR) AS url
  FROM (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS seq FROM events WHERE user_id % 5 <> 0 AND user_id % 3 <> 0
        UNION ALL SELECT user_id, event_id FROM events WHERE user_id % 5 <> 0 AND event_id % 97 = 0))"""
