"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "newsloom", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    s = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NEWSLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, the bench) a temporary
    folder takes its place, which goes when the process ends; on a cluster without
    the setting this fails instead of writing to one machine's disk.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint ``df`` into the shared folder.

    Spark deletes a checkpoint when nothing refers to it any more, if the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``local_session`` does.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder: for large rows of which later steps read a few columns each. They stay as long as the folder."""
    at = scratch(df.sparkSession, "stored")
    df.write.option("parquet.block.size", 32 << 20).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
