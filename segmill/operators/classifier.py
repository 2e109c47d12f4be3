"""Slots for models: a classifier of transcript chunks and a speech model, called in the workers.

A classifier takes the messages of a prompt and returns the parsed answer {"segments": [{"id": int, "ad": bool}]}. A chunk
is tried `attempts` times; the answer of an attempt counts as a whole or not at all. The last error of a chunk that never
succeeded is returned with it, and its segments keep their flags.

Prompts are dealt to tasks by number, as a call costs time whatever its bytes, and a task has a bounded number of calls under
way. `ask` also keeps answers as they come, in files that are whole or absent: a task that runs again, or a later run, asks only
for what has no answer yet.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice
from threading import local
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.sources.objects import ObjectStore, open_store

Classifier = Callable[[list[dict[str, str]]], dict[str, Any]]
Transcriber = Callable[[bytes], list[dict[str, Any]]]

INSTRUCTION = (
    "Decide for each segment of a podcast transcript whether it is advertising. A block of advertising may begin with a "
    "transition and end with a phrase of return; mark all of its segments. Answer with JSON only."
)
REQUEST = 'Segments:\n{lines}\n\nAnswer as {{"segments": [{{"id": <id>, "ad": true or false}}, ...]}}.'

ANSWERED = "chunk_id bigint, answers array<struct<id: bigint, ad: boolean>>, error string"


def prompt(lines: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": REQUEST.format(lines=lines)}]


class Asker:
    """Up to `calls` prompts under way at once, each thread with a classifier of its own."""

    def __init__(self, make_classifier: Callable[[], Classifier], attempts: int, pause_s: float, calls: int) -> None:
        self.make_classifier, self.attempts, self.pause_s, self.calls = make_classifier, attempts, pause_s, calls
        self.own = local()

    def one(self, lines: str) -> tuple[list[dict[str, Any]], str | None]:
        """The answer to a prompt, or the error of the last attempt."""
        if not hasattr(self.own, "call"):
            self.own.call = self.make_classifier()
        error = None
        for n in range(self.attempts):
            if n:
                time.sleep(self.pause_s)
            try:
                return [{"id": int(x["id"]), "ad": bool(x["ad"])} for x in self.own.call(prompt(lines))["segments"]], None
            except Exception as e:  # whatever a model's client raises is the chunk's error
                error = str(e) or type(e).__name__
        return [], error

    def all(self, rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple[list[dict[str, Any]], str | None]]]:
        """Rows, whose last value is the prompt, with what was answered, in order."""
        with ThreadPoolExecutor(self.calls) as pool:
            under_way: deque[tuple[tuple, Future]] = deque()
            try:
                while True:
                    under_way.extend((row, pool.submit(self.one, row[-1])) for row in islice(rows, self.calls - len(under_way)))
                    if not under_way:
                        return
                    row, answer = under_way.popleft()
                    yield row, answer.result()
            finally:
                for _, answer in under_way:
                    answer.cancel()


def _dealt(prompts: DataFrame, per_task: int) -> DataFrame:
    """About per_task prompts for each task, whatever their bytes."""
    return prompts.repartition(max(1, -(-prompts.count() // per_task)))


def classify(prompts: DataFrame, make_classifier: Callable[[], Classifier], attempts: int = 3, pause_s: float = 2.0, calls: int = 4, per_task: int = 16) -> DataFrame:
    """prompts (tid, chunk_id, prompt) with the answers or the error. prompts is counted first and should be a table;
    make_classifier runs once for each of a task's `calls` threads."""
    asker = (make_classifier, attempts, pause_s, calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(Asker(*asker).all(batch[["tid", "chunk_id", "prompt"]].itertuples(index=False, name=None)))
            # a dict keeps the columns' kinds
            yield pd.DataFrame({"tid": batch["tid"], "chunk_id": batch["chunk_id"]}).assign(answers=[a for _, (a, _) in found], error=[e for _, (_, e) in found])

    kind = prompts.schema["tid"].dataType.simpleString()
    return _dealt(prompts, per_task).mapInPandas(run, f"tid {kind}, {ANSWERED}")


KEPT = "tid {kind}, chunk_id bigint, digest string, answers array<struct<id: bigint, ad: boolean>>, error string, asked_at timestamp"
ANSWERS = pa.list_(pa.struct([("id", pa.int64()), ("ad", pa.bool_())]))


def kept_answers(prompts: DataFrame, folder: str) -> DataFrame:
    """What the folder has for the prompts as they are now (tid, chunk_id, answers, error): the first answer of each, or else the
    last error. None if the folder is missing."""
    spark, kind = prompts.sparkSession, prompts.schema["tid"].dataType.simpleString()
    if not ObjectStore(spark, folder).exists(""):
        return prompts.where("false").selectExpr("tid", "chunk_id", "cast(null as array<struct<id: bigint, ad: boolean>>) as answers", "cast(null as string) as error")
    rows = spark.read.schema(KEPT.format(kind=kind)).option("recursiveFileLookup", "true").parquet(folder)
    asked = prompts.select("tid", "chunk_id", F.md5("prompt").alias("digest"))
    answered, age = F.col("error").isNull(), F.unix_micros("asked_at")
    best = F.max_by(F.struct("answers", "error"), F.struct(answered, F.when(answered, -age).otherwise(age)))
    return rows.join(asked, ["tid", "chunk_id", "digest"], "left_semi").groupBy("tid", "chunk_id").agg(best.alias("a")).select("tid", "chunk_id", "a.answers", "a.error")


def ask(prompts: DataFrame, make_classifier: Callable[[], Classifier], folder: str, attempts: int = 3, pause_s: float = 2.0, calls: int = 4, per_task: int = 16, together: int = 8) -> DataFrame:
    """Like classify, but answers are kept in the folder, `together` in a file, as they come. Prompts (with their text) that have
    an answer there aren't asked again; errors are. prompts should be a table, with one row for each tid and chunk_id."""
    store = ObjectStore(prompts.sparkSession, folder)
    (root, settings), run, asker = store.for_tasks(), uuid.uuid4().hex, (make_classifier, attempts, pause_s, calls)
    left = prompts.join(kept_answers(prompts, folder).where("error is null"), ["tid", "chunk_id"], "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(root, settings)
        own = f"{base}/run={run}/task={TaskContext.get().partitionId()}"
        done: set[tuple] = set()
        for info in store.get_file_info(fs.FileSelector(own, allow_not_found=True)):
            # an attempt of this task that was lost has answered these
            if info.base_name.endswith(".parquet"):
                with store.open_input_file(info.path) as source:
                    told = pq.read_table(source, columns=["tid", "chunk_id"]).to_pydict()
                done.update(zip(told["tid"], told["chunk_id"], strict=True))
        n = 0
        for batch in batches:
            kinds = batch.schema
            rows = (r for r in zip(*(batch.column(c).to_pylist() for c in ("tid", "chunk_id", "digest", "prompt")), strict=True) if r[:2] not in done)
            found = Asker(*asker).all(rows)
            while some := list(islice(found, together)):
                keys, answers = zip(*some, strict=True)
                columns = [*zip(*(k[:3] for k in keys), strict=True), [a for a, _ in answers], [e for _, e in answers], [time.time_ns() // 1000] * len(some)]
                types = [kinds.field("tid").type, pa.int64(), pa.string(), ANSWERS, pa.string(), pa.timestamp("us", "UTC")]
                table = pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["tid", "chunk_id", "digest", "answers", "error", "asked_at"])
                store.create_dir(own, recursive=True)
                name = uuid.uuid4().hex
                with store.open_output_stream(f"{own}/.{name}") as out:
                    pq.write_table(table, out)
                store.move(f"{own}/.{name}", f"{own}/{name}.parquet")
                n += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    asked = left.select("tid", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.md5("prompt").alias("digest"), "prompt")
    _dealt(asked, per_task).mapInArrow(work, "n bigint").agg(F.sum("n")).collect()
    return kept_answers(prompts, folder)


def answer_rows(answered: DataFrame) -> DataFrame:
    """One row per answer; apos is its place among the answers for its chunk."""
    rows = answered.selectExpr("tid", "chunk_id", "posexplode(answers) as (apos, a)")
    return rows.selectExpr("tid", "chunk_id", "cast(apos as bigint) as apos", "a.id as id", "a.ad as ad")


def errors(answered: DataFrame) -> DataFrame:
    return answered.where("error is not null").select("tid", "chunk_id", "error")


def transcribe(audio: DataFrame, make_model: Callable[[], Transcriber]) -> DataFrame:
    """audio (tid, content) with the speech model's segments. make_model runs once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield batch[["tid"]].assign(segments=[model(c) for c in batch["content"]])

    kind = audio.schema["tid"].dataType.simpleString()
    return audio.select("tid", "content").mapInPandas(run, f"tid {kind}, segments array<struct<text: string, start: double, end: double>>")
