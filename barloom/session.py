"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "barloom") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediates and streaming checkpoints.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Where that is
    unset, a folder of our own serves a master on one machine; executors
    elsewhere would not see it, so any other master is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "barloom-work")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """What is run inside frees its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def persist_table(df, label: str):
    """Write an intermediate to the shared folder and read it back.

    Used where one result feeds several branches: the written files survive the
    loss of any executor, so the lineage behind them is never replayed. Nor are its
    shuffles read again, so Spark may free their files at once.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    with _shuffles_freed(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
