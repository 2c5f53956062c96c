"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (master ``local``)
    may go without: it gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.leadloom.shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.leadloom.shared", found)
    return found.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this session writes to, until ``drop_run``."""
    name = spark.conf.get("spark.leadloom.run", None)
    if not name:
        name = f"run-{uuid.uuid4().hex}"
        spark.conf.set("spark.leadloom.run", name)
    return f"{shared_dir(spark)}/{name}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run(spark: SparkSession) -> None:
    """Remove all tables that the session has written in between, once its results are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.conf.unset("spark.leadloom.run")
