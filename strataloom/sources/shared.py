"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else, where all runs in one process, a temporary folder of the
    session. On a cluster such a folder would be one machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strataloom.shared", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("strataloom.shared", found)
    return found.rstrip("/")
