"""Lookups in stream state: of each key the value that was written last, for feeds (T10) and produced files alike.

Keys are dealt to buckets, each with a map in its state, so no key's state is larger than its value and a bucket's rows of a batch
go to one task; the number of buckets stays with the checkpoint. The maps are read as a table at any batch of the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAPPED = "key string, value string, seq bigint"


class LastWritten(StatefulProcessor):
    """Maps key to value and number; a write with a smaller number than the one that is there is late and changes nothing."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "key string", "value string, seq bigint", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            newest = batch.sort_values("seq", kind="stable").drop_duplicates("key", keep="last")
            changed = []
            for k, value, seq in newest[["key", "value", "seq"]].itertuples(index=False):
                value, seq = None if pd.isna(value) else value, int(seq)
                if not self.last.containsKey((k,)) or self.last.getValue((k,))[1] <= seq:
                    self.last.updateValue((k,), (value, seq))
                    changed.append((k, value, seq))
            if changed:
                yield pd.DataFrame(changed, columns=["key", "value", "seq"])

    def close(self) -> None:
        pass


def last_written_stream(writes: DataFrame, buckets: int = 200, ttl_ms: int | None = None) -> DataFrame:
    """Writes (key, value, seq) that changed a key's value (update mode); null keys are left out."""
    dealt = writes.where("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "value", "seq")
    return dealt.groupBy("bucket").transformWithStateInPandas(LastWritten(ttl_ms), MAPPED, "update", "processingTime" if ttl_ms else "none")


def read_last_written(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """key, value and seq as they are in the state after a batch, or after the last one."""
    reader = spark.read.format("statestore").option("stateVarName", "last")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("user_map_key.key", "user_map_value.value", "user_map_value.seq")


def produced_files(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The state as the table of produced files (url, file, seq) that serve_decision takes."""
    return read_last_written(spark, checkpoint, batch).select(F.col("key").alias("url"), F.col("value").alias("file"), "seq")
