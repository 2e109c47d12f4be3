"""The message operators on streams.

Messages carry no event time, so the order of a request's messages is their number (seq), and state is kept until a
request is dropped by its time to live, which is a choice of this library.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from segmill.operators.messages import from_envelopes, missing, next_requests, status_updates
from segmill.schemas import MESSAGES, SUBMISSIONS

CHANGES = (
    "kind string, correlation_id string, type string, url string, status string, n_steps bigint, last_seq bigint, "
    "steps array<struct<step: string, step_status: string>>, seq bigint, step string, step_status string"
)
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_submissions(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(SUBMISSIONS).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_envelopes(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages in lines of JSON with any data; what is no message is dropped."""
    return from_envelopes(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


class RequestState(StatefulProcessor):
    """A request from its submission on: a value with its type, URL, status and last message, and the list of its steps.

    A message that was overtaken puts its step in its place and leaves the status. A new submission starts the request anew; what
    has a smaller number is of its earlier life. Messages of an id that wasn't submitted open no state and come out as `unknown`;
    with `hold` they are kept for a submission that they overtook.
    """

    def __init__(self, ttl_ms: int | None = None, hold: bool = False) -> None:
        self.ttl_ms, self.hold = ttl_ms, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", "first bigint, since bigint, type string, url string, status string, last_seq bigint", self.ttl_ms)
        self.steps = handle.getListState("steps", "seq bigint, step string, step_status string", self.ttl_ms)
        self.early = handle.getListState("early", "seq bigint, status string, step string, step_status string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = ["seq", "kind", "status", "step", "step_status", "type", "url"]
        # numbers and kinds tell all rows of an id apart, so None is never compared
        events = sorted((tuple(None if pd.isna(x) else x for x in r) for batch in rows for r in batch[columns].itertuples(index=False)), key=lambda e: e[:2])
        request = self.request.get() if self.request.exists() else None
        steps = list(self.steps.get()) if request else []
        n_old, kept, changed, unknown, early = len(steps), True, False, [], []
        while events:
            seq, kind, status, step, step_status, type_, url = events.pop(0)
            seq = int(seq)
            if kind == 0:
                first, since, *_, last_status, last_seq = request or (seq, seq, None, None, None, seq - 1)
                if seq >= since:
                    steps, kept = [s for s in steps if s[0] >= seq], False
                    request = (min(first, seq), seq, type_, url, *((last_status, last_seq) if last_seq >= seq else ("processing", seq)))
                    if self.hold and (early or self.early.exists()):
                        events = sorted([*((s, 1, *rest, None, None) for s, *rest in chain(self.early.get(), early) if s >= seq), *events], key=lambda e: e[:2])
                        self.early.clear()
                        early = []
                else:
                    request = (min(first, seq), *request[1:])
                changed = True
            elif request is None and self.hold:
                early.append((seq, status, step, step_status))
            elif request is None or seq < request[0]:
                unknown.append((seq, status, step, step_status))
            elif seq >= request[1]:
                if step is not None:
                    kept &= not steps or steps[-1][0] <= seq
                    steps.append((seq, step, step_status))
                    if not kept:
                        steps.sort(key=lambda s: s[0])
                if seq >= request[5]:
                    request = (*request[:4], status, seq)
                changed = True
        if early:
            self.early.appendList(early)
        if changed:
            self.request.update(request)
            if not kept:
                self.steps.put(steps) if steps else self.steps.clear()
            elif len(steps) > n_old:
                self.steps.appendList(steps[n_old:])
            yield self._frame([("request", key[0], *request[2:5], len(steps) + 1, request[5], [{"step": "submitted", "step_status": "completed"}, *({"step": s, "step_status": t} for _, s, t in steps)], None, None, None)])
        if unknown:
            yield self._frame([("unknown", key[0], None, None, status, None, None, None, seq, step, step_status) for seq, status, step, step_status in unknown])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.replace("array<struct<step: string, step_status: string>>", "x").split(", ")], dtype=object)
        return frame.astype({"n_steps": "Int64", "last_seq": "Int64", "seq": "Int64"})

    def close(self) -> None:
        pass


def request_changes_stream(messages: DataFrame, submissions: DataFrame, ttl_ms: int | None = None, hold: bool = False) -> DataFrame:
    """Rows of two kinds (update mode): `request`, each request that a batch changed, with all of its steps; and `unknown`, each
    update of an id that no submission opened. With `hold` streams may arrive in any order, and there are no unknown rows.

    Held requests without a time to live follow from what has arrived, whatever its order, so their state is a streaming
    aggregation; other requests are RequestState's, in Python."""
    nothing = F.lit(None).cast("string")
    told = status_updates(messages).select("seq", "correlation_id", F.lit(1).alias("kind"), "status", "step", "step_status", nothing.alias("type"), nothing.alias("url"))
    opened = submissions.where(~missing(F.col("correlation_id"))).select("seq", "correlation_id", F.lit(0).alias("kind"), nothing.alias("status"), nothing.alias("step"), nothing.alias("step_status"), "type", "url")
    if hold and ttl_ms is None:
        return _held_requests(told.unionByName(opened))
    return told.unionByName(opened).groupBy("correlation_id").transformWithStateInPandas(RequestState(ttl_ms, hold), CHANGES, "update", "processingTime" if ttl_ms else "none")


def _held_requests(events: DataFrame) -> DataFrame:
    """CHANGES of all ids that batches touch and that are submitted. The state of an id has its last submission and its messages,
    also those of earlier lives."""
    of = F.col("kind") == 0
    held = events.groupBy("correlation_id").agg(
        F.max(F.when(of, F.struct("seq", "type", "url"))).alias("opened"),
        F.collect_list(F.when(~of, F.struct("seq", "status", "step", "step_status"))).alias("told"),
    )
    # by number, as it is the first field
    current = F.array_sort(F.filter("told", lambda m: m["seq"] >= F.col("opened.seq")))
    rows = held.where("opened is not null").select("correlation_id", "opened", current.alias("current"))
    last = F.try_element_at("current", F.lit(-1))
    rows = rows.select("*", F.filter("current", lambda m: m["step"].isNotNull()).alias("with_step"), last.alias("last"))
    steps = F.transform("with_step", lambda m: F.struct(m["step"].alias("step"), m["step_status"].alias("step_status")))
    submitted = F.array(F.struct(F.lit("submitted").alias("step"), F.lit("completed").alias("step_status")))
    none = F.lit(None)
    return rows.select(
        F.lit("request").alias("kind"), "correlation_id", "opened.type", "opened.url", F.coalesce("last.status", F.lit("processing")).alias("status"),
        (F.size("with_step") + 1).cast("bigint").alias("n_steps"), F.coalesce("last.seq", "opened.seq").alias("last_seq"), F.concat(submitted, steps).alias("steps"),
        none.cast("bigint").alias("seq"), none.cast("string").alias("step"), none.cast("string").alias("step_status"),
    )


def changed_requests(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'request'").drop("kind", "seq", "step", "step_status")


def changed_steps(changes: DataFrame) -> DataFrame:
    """The steps of changed requests, all of them."""
    rows = changed_requests(changes)
    return rows.select(*[c for c in ("batch", "correlation_id") if c in rows.columns], F.posexplode("steps").alias("step_no", "s")).select("*", "s.*").drop("s").withColumn("step_no", F.col("step_no").cast("bigint"))


def unknown_changes(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'unknown'").select("seq", "correlation_id", "status", "step", "step_status")


def latest_changes(changes: DataFrame) -> DataFrame:
    """Of a table that to_table wrote in update mode, the last change of each request, and all unknown messages."""
    last = F.max("batch").over(Window.partitionBy("correlation_id", "kind"))
    return changes.withColumn("_last", last).where("kind <> 'request' or batch = _last").drop("_last")


def request_status_stream(messages: DataFrame, submissions: DataFrame, ttl_ms: int | None = None, hold: bool = False) -> DataFrame:
    """The state of each request that a batch changed (update mode)."""
    return changed_requests(request_changes_stream(messages, submissions, ttl_ms, hold)).drop("steps")


def request_steps_stream(messages: DataFrame, submissions: DataFrame, ttl_ms: int | None = None, hold: bool = False) -> DataFrame:
    """All steps of each request that a batch changed (update mode)."""
    return changed_steps(request_changes_stream(messages, submissions, ttl_ms, hold))


CLAIMS = "seq bigint, key string, outcome string"


class ClaimState(StatefulProcessor):
    """Whether the work on a key is running or done; a failure makes it free again unless it was done before."""

    def __init__(self, busy: str, ttl_ms: int | None = None) -> None:
        self.busy, self.ttl_ms = busy, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("claim", "status string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status = self.state.get()[0] if self.state.exists() else "new"
        answers = []
        for seq, event in sorted((s, e) for batch in rows for s, e in zip(batch["seq"], batch["event"], strict=True)):
            if event == "request":
                answers.append((seq, key[0], {"new": "claimed", "running": self.busy, "done": "already_processed"}[status]))
                status = "running" if status == "new" else status
            elif status != "done":
                status = "done" if event == "done" else "new"
        self.state.update((status,))
        yield pd.DataFrame(answers, columns=["seq", "key", "outcome"])

    def close(self) -> None:
        pass


def claim_outcome_stream(events: DataFrame, busy: str = "failed", ttl_ms: int | None = None) -> DataFrame:
    """claim_outcome on a stream of (seq, key, event): the answer to each request, with the state of each key kept from batch
    to batch. Within a batch events count in the order of seq."""
    keyed = events.where("key is not null").select("seq", "key", "event").groupBy("key")
    return keyed.transformWithStateInPandas(ClaimState(busy, ttl_ms), CLAIMS, "append", "processingTime" if ttl_ms else "none")


def next_requests_stream(messages: DataFrame) -> DataFrame:
    """Routing keeps no state."""
    return next_requests(messages)


def first_claims_stream(requests: DataFrame, key: str = "file_path") -> DataFrame:
    """The first request for each key."""
    return requests.where(f"{key} is not null").dropDuplicates([key])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there and stop. In update mode each batch is a set of rows marked with its number."""
    if mode == "append":
        return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
