"""Folders that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. A session that names none gets a temporary one if it runs in one process,
    as in tests; a cluster is refused, as its machines would not see a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='lodeseam-')}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
