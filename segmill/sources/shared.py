"""A folder that driver and executors share, for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_shared_folder(spark: SparkSession, what: str) -> str:
    """A new place below spark.checkpoint.dir; a local one only where that is unset and all work is done on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="segmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
