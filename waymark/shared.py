"""The folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only where all of Spark is one process, and no folder is named, is it one of our own."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        d = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = _own_dir()
    return d


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="waymark-")
