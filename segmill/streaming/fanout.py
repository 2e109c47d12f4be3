"""Several subscribers of one stream of messages, each with its own progress.

A batch is read once and given to each subscriber in turn. One that raises keeps the others from nothing: its batch is put aside
as a table, and is given to it again, alone and before later ones, until it succeeds. What was delivered is recorded by batch
number, so a batch that Spark runs again after a stop is not given twice to those that had it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from segmill.sources.objects import ObjectStore

Handler = Callable[[DataFrame, int], None]


@dataclass
class Subscriber:
    """A handler of (messages, batch number) and the topics that it takes; None is all."""

    name: str
    handler: Handler
    topics: tuple[str, ...] | None = None


@dataclass
class Progress:
    """The last batch that a subscriber had or has put aside, those put aside, and the last error."""

    last: int = -1
    aside: list[int] = field(default_factory=list)
    error: str | None = None


class FanOut:
    """Delivers batches to subscribers; the folder keeps progress and batches put aside."""

    def __init__(self, spark: SparkSession, folder: str, subscribers: list[Subscriber]) -> None:
        if len({s.name for s in subscribers}) < len(subscribers):
            raise ValueError("subscribers need names of their own")
        self.store, self.subscribers = ObjectStore(spark, folder), subscribers

    def progress(self, name: str) -> Progress:
        for key in (f"{name}/progress", f"{name}/progress-new"):
            if self.store.exists(key):
                return Progress(**json.loads(self.store.get(key)))
        return Progress()

    def _record(self, name: str, progress: Progress) -> None:
        # one of the two is whole at any moment
        text = json.dumps(progress.__dict__).encode()
        self.store.put(f"{name}/progress-new", text)
        self.store.delete(f"{name}/progress")
        self.store.put(f"{name}/progress", text)

    def _aside(self, name: str, number: int) -> str:
        return f"{self.store.root}/{name}/aside/{number}"

    def deliver(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        batch.persist()
        try:
            for s in self.subscribers:
                progress = self.progress(s.name)
                if number <= progress.last:
                    continue
                mine = batch.where(F.col("topic").isin(*s.topics)) if s.topics is not None else batch
                self.retry(s, batch.sparkSession)
                progress = self.progress(s.name)
                if not progress.aside and self._given(s, mine, number, progress):
                    self._record(s.name, Progress(number, [], None))
                else:
                    # what comes after a batch put aside waits behind it
                    mine.write.mode("overwrite").parquet(self._aside(s.name, number))
                    self._record(s.name, Progress(number, [*progress.aside, number], progress.error))
        finally:
            batch.unpersist()

    @staticmethod
    def _given(s: Subscriber, messages: DataFrame, number: int, progress: Progress) -> bool:
        try:
            s.handler(messages, number)
        except Exception as e:  # whatever a subscriber raises is its own
            progress.error = f"{type(e).__name__}: {e}"
            return False
        return True

    def retry(self, s: Subscriber, spark: SparkSession) -> bool:
        """Give a subscriber what was put aside, in order; True if nothing is left."""
        progress = self.progress(s.name)
        while progress.aside:
            number = progress.aside[0]
            if not self._given(s, spark.read.parquet(self._aside(s.name, number)), number, progress):
                self._record(s.name, progress)
                return False
            progress = Progress(progress.last, progress.aside[1:], None)
            self._record(s.name, progress)
            self.store.delete(f"{s.name}/aside/{number}")
        return True

    def start(self, messages: DataFrame, checkpoint: str) -> StreamingQuery:
        """Deliver all that is there and stop. messages has the column topic."""
        return messages.writeStream.foreachBatch(self.deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
