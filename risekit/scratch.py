"""Scratch paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted when the application ends: under spark.checkpoint.dir, where that is unset under the warehouse.

    On one machine (master local) without that setting it is under the machine's temporary folder.
    Elsewhere a warehouse on a machine's own disk is an error, for executors don't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if not base:
        context = spark.sparkContext
        if context.master == "local" or context.master.startswith("local["):
            base = tempfile.gettempdir()
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{base}/rise-{context.applicationId}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = hadoop(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
