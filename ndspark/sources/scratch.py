"""A folder that driver and executors share, for what a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import ArgumentError


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one if the
    master is local, else an error: executors would not see it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = set_before.get() if set_before.isDefined() else None
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ArgumentError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(top)
    top = f"file://{top[5:]}" if top.startswith("file:/") and not top.startswith("file://") else top
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
