"""Where a plan is cut: rows that several later steps read are computed once and kept in the shared folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import DataFrame


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="lodestrata-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir, which a cluster must set; a local session without one uses a folder of its own process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = _local_dir()
        context.setCheckpointDir(base)
    return df.checkpoint()
