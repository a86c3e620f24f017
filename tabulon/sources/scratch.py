"""Folders for intermediate files that every executor can read."""
from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name inside spark.checkpoint.dir.  Where that is unset, a local temporary folder that goes at
    exit, which serves a single machine only: on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sys, "_tabulon_scratch", None)
        if not base:
            base = sys._tabulon_scratch = tempfile.mkdtemp(prefix="tabulon-")
            atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/tabulon/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
