"""Pipeline messages: routing, request state and work claims, folded from a log (seq, topic, correlation_id, file_path).

A request exists from its submission on (SUBMISSIONS: seq, correlation_id, type, url; seq is one order with the messages').
Messages of an id that wasn't submitted before them are of no request, and a new submission of an id starts it anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The keys of a message as it is sent; data may be any JSON.
ENVELOPE = ("topic", "data", "message_id", "correlation_id")

# The four stages and other topics.
STAGES = ("download", "transcribe", "ad_detection", "audio_processing")
FEED_PREFIX, STATUS_UPDATE = "podcast.rss.download.", "api.status.update"


def from_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages in a column of JSON texts: topic, data (as JSON text; null for null), message_id and correlation_id, beside the
    other columns. What is no single JSON object, has text behind it, has no topic, lacks one of these keys or repeats a key is
    dropped; the values of the ids may be null. Numbers of over 38 digits become floating."""
    # a parser stops where a value ends; the text's own digest behind it is only read if nothing else is
    text = F.concat(F.lit('{"message":'), column, F.lit(',"end":"'), F.md5(column), F.lit('"}'))
    field = lambda name, kind: F.expr(f"try_variant_get(_m.parsed, '$.message.{name}', '{kind}')")
    kept = [c for c in raw.columns if c not in (column, *ENVELOPE)]
    # a generated row is made once, so nothing is parsed again for each field
    rows = raw.select(*kept, F.explode(F.array(F.struct(F.md5(column).alias("digest"), F.try_parse_json(text).alias("parsed")))).alias("_m"))
    whole = F.expr("try_variant_get(_m.parsed, '$.end', 'string') = _m.digest")
    for name in ENVELOPE:
        whole &= field(name, "variant").isNotNull()
    return rows.where(whole & field("topic", "string").isNotNull()).select(
        *kept, field("topic", "string").alias("topic"), F.nullif(F.to_json(field("data", "variant")), F.lit("null")).alias("data"),
        field("message_id", "string").alias("message_id"), field("correlation_id", "string").alias("correlation_id"),
    )


def to_envelopes(messages: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """topic and the JSON text of each message (topic, data as JSON text, message_id or null, correlation_id or null)."""

    def quoted(name: str) -> Column:
        listed = F.to_json(F.array(name))
        return listed.substr(F.lit(2), F.length(listed) - 2)

    text = F.concat(F.lit('{"topic":'), quoted("topic"), F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit(',"message_id":'), quoted("message_id"), F.lit(',"correlation_id":'), quoted("correlation_id"), F.lit("}"))
    return messages.select(*keep, "topic", text.alias(column))


def log_of(messages: DataFrame, seq: str = "seq") -> DataFrame:
    """The log that the operators here take, from messages with an order."""
    field = lambda name: F.get_json_object("data", f"$.{name}")
    path = F.when(F.col("topic").startswith(FEED_PREFIX), field("rss_url")).otherwise(field("file_path"))
    return messages.select(F.col(seq).alias("seq"), "topic", "correlation_id", path.alias("file_path"), field("status").alias("new_status"), field("step").alias("new_step"))


def topic(stage: str, kind: str) -> str:
    return f"podcast.{stage}.{kind}"


def missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def stage_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^podcast\.([a-z_]+)\.[a-z]+$", 1)


def kind_of(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([a-z_]+)$", 1)


def next_requests(log: DataFrame) -> DataFrame:
    """The request that each complete message leads to: the next stage's, for the same file and correlation_id. Messages
    without either lead to none."""
    following = {topic(a, "complete"): topic(b, "request") for a, b in zip(STAGES, STAGES[1:], strict=False)}
    request = F.coalesce(*(F.when(F.col("topic") == a, b) for a, b in following.items()))
    rows = log.withColumn("next_topic", request).where(F.col("next_topic").isNotNull() & ~missing(F.col("correlation_id")) & ~missing(F.col("file_path")))
    return rows.select("seq", F.col("next_topic").alias("topic"), "correlation_id", "file_path")


def invalid_requests(log: DataFrame) -> DataFrame:
    """The failure that is sent for each message without a file."""
    return log.where(missing(F.col("file_path"))).select("seq", F.regexp_replace("topic", r"[^.]+$", "failed").alias("topic"), "correlation_id", F.lit("Missing file_path").alias("error"))


def status_updates(log: DataFrame) -> DataFrame:
    """Messages that change a request's state, with its status after them and the step that they add.

    A feed's download completes its request at once; its message has the feed's URL as file_path. If the log has the
    columns new_status and new_step, a message of STATUS_UPDATE sets that status, and adds that step if it has one.
    """
    name, kind, ok = F.col("topic"), kind_of(F.col("topic")), ~missing(F.col("file_path"))
    of_feed = name.startswith(FEED_PREFIX)
    last = of_feed | (stage_of(name) == STAGES[-1])
    status = F.when(kind == "failed", "failed").when((kind == "complete") & ok, F.when(last, "completed").otherwise("processing"))
    step = F.when(of_feed, "rss_download").otherwise(stage_of(name))
    if {"new_status", "new_step"} <= set(log.columns):
        external = name == STATUS_UPDATE
        status = F.when(external, F.nullif("new_status", F.lit(""))).otherwise(status)
        step = F.when(external, F.col("new_step")).otherwise(step)
    rows = log.where(~missing(F.col("correlation_id"))).withColumns({"status": status, "step": step})
    step_status = F.when(F.col("step").isNull(), None).when(F.col("status") == "failed", "failed").otherwise("completed")
    return rows.where("status is not null").select("seq", "correlation_id", "status", "step", step_status.alias("step_status"))


def _placed(log: DataFrame, submissions: DataFrame) -> DataFrame:
    """Updates and submissions (kind) of each id, with the number of the id's last submission up to them (since) and at all
    (last). Both are dealt by id once."""
    told = status_updates(log).withColumns({"kind": F.lit(1), "type": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    nothing = F.lit(None).cast("string")
    opened = submissions.where(~missing(F.col("correlation_id"))).select("seq", "correlation_id", F.lit("processing").alias("status"), F.lit("submitted").alias("step"), F.lit("completed").alias("step_status"), F.lit(0).alias("kind"), F.coalesce("type", nothing).alias("type"), F.coalesce("url", nothing).alias("url"))
    own, number = Window.partitionBy("correlation_id"), F.when(F.col("kind") == 0, F.col("seq"))
    # at an equal number the submission comes first
    return told.unionByName(opened).withColumns({"since": F.max(number).over(own.orderBy("seq", "kind")), "last": F.max(number).over(own.orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def _current(log: DataFrame, submissions: DataFrame) -> DataFrame:
    """The last submission of each id and the updates after it."""
    return _placed(log, submissions).where("since = last")


def request_status(log: DataFrame, submissions: DataFrame) -> DataFrame:
    """Of each request: its type and URL, the status after its last message (none is final), its number of steps with the
    submission, and the number of what came last. If an id has two submissions of one number, either counts."""
    rows = _current(log, submissions)
    order = F.struct("seq", "kind")
    latest = rows.groupBy("correlation_id").agg(
        F.min_by("type", order).alias("type"), F.min_by("url", order).alias("url"), F.max_by("status", order).alias("status"),
        (F.count(F.when(F.col("kind") == 1, F.col("step"))) + 1).alias("n_steps"), F.max("seq").alias("last_seq"),
    )
    return latest


def request_steps(log: DataFrame, submissions: DataFrame) -> DataFrame:
    """The steps of each request in order; number 0 is the submission."""
    place = (F.row_number().over(Window.partitionBy("correlation_id").orderBy("seq", "kind")) - 1).cast("bigint")
    return _current(log, submissions).where("step is not null").select("correlation_id", place.alias("step_no"), "step", "step_status")


def unknown_updates(log: DataFrame, submissions: DataFrame) -> DataFrame:
    """Updates of ids that weren't submitted before them, which change no request."""
    return _placed(log, submissions).where("since is null").select("seq", "correlation_id", "status", "step", "step_status")


def claim_outcome(events: DataFrame, busy: str = "failed") -> DataFrame:
    """What a worker answers to each request of a log (seq, key, event: request, done or failed): `claimed` if the key is
    free, `already_processed` once it is done, `busy` while it is worked on. A failure frees the key again.

    busy is "in_progress" for the stage that detects advertisements and "failed" for the others.
    """
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumns({"_done": F.coalesce(F.max(F.col("event") == "done").over(w), F.lit(False)), "_freed": F.coalesce(F.count_if(F.col("event") == "failed").over(w), F.lit(0))})
    held = F.row_number().over(Window.partitionBy("key", "_freed").orderBy("seq"))
    requests = rows.where("event = 'request'").withColumn("_held", held)
    outcome = F.when(F.col("_done"), "already_processed").when(F.col("_held") > 1, busy).otherwise("claimed")
    return requests.select("seq", "key", outcome.alias("outcome"))


def new_work(requests: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(done.select(key).distinct(), key, "left_anti")


def already_processed(requests: DataFrame, done: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """Requests whose key is done and whose object exists."""
    return requests.join(done.select(key).distinct(), key, "left_semi").join(objects.select(key).distinct(), key, "left_semi")


def feed_requests(requests: DataFrame, seen: DataFrame, key: str = "rss_url") -> DataFrame:
    """Requests for feeds, all of which are fetched again; already_processed marks those fetched before."""
    known = seen.select(key).distinct().withColumn("already_processed", F.lit(True))
    return requests.join(known, key, "left").withColumn("already_processed", F.coalesce("already_processed", F.lit(False)))


def serve_decision(requests: DataFrame, produced: DataFrame, objects: DataFrame) -> DataFrame:
    """requests (request_id, url) answered: 400 without a URL, 200 with the file if it was produced and exists, else 202.
    Of the files produced (url, file, seq) for a URL the last one counts."""
    last = produced.groupBy("url").agg(F.max_by("file", "seq").alias("file"))
    rows = requests.join(last, "url", "left").join(objects.select(F.col("key").alias("file"), F.lit(True).alias("_there")).distinct(), "file", "left")
    code = F.when(missing(F.col("url")), 400).when(F.col("_there"), 200).otherwise(202)
    return rows.select("request_id", code.alias("status"), F.when(F.col("_there"), F.col("file")).alias("file"))
