"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster sets it, else, on one machine alone (in tests), a temporary folder of this process, removed at its
    end. A cluster without that setting is refused: its executors would each write to a disk of their own."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="stripelore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")
