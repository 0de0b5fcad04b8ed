"""Running a stream to completion over what has arrived, and its settings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from barloom.session import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB provider; it is a setting read at query start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(
    stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None
) -> DataFrame:
    """Process everything available into a parquet table, ``out`` if named, and return that table."""
    spark = stream.sparkSession
    out = out or work_dir(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or work_dir(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:
    """Process everything available through ``apply(batch, batch_id)``."""
    query = (
        stream.writeStream.foreachBatch(apply)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


@contextmanager
def _state_partitions(spark: SparkSession):
    """A stream started inside has no more state partitions than the cluster runs tasks.

    Every batch opens and writes the stores of every partition, however little is in them.
    """
    key, most = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(table: DataFrame, label: str) -> str:
    """The folder of a table, written by as many tasks as it has."""
    path = work_dir(table.sparkSession, label)
    table.write.parquet(path)
    return path


def run_arrivals(spark: SparkSession, arrivals: Iterable[Sequence[DataFrame]], build, label: str) -> DataFrame:
    """Batches of tables, each written by as many tasks as it has and then taken by the stream before the next comes.

    ``build`` makes the stream of one streaming input for each table of a batch.
    """
    arrivals = iter(arrivals)
    first = next(arrivals)
    folders = ([written(t, f"{label}-staged") for t in tables] for tables in chain([first], arrivals))
    return run_folders(spark, folders, [t.schema for t in first], build, label)


def run_folders(
    spark: SparkSession, arrivals: Iterable[Sequence[str | None]], schemas: Sequence[StructType], build, label: str
) -> DataFrame:
    """Batches of written folders (None: no rows), one for each input, each batch taken before the next comes.

    A folder comes to its input whole, by a rename. One query runs from the first batch to the last, so its state
    stays with the executors and is not read from the checkpoint again for each batch.
    """
    out, checkpoint = work_dir(spark, label), work_dir(spark, f"{label}-checkpoint")
    inboxes, query = [work_dir(spark, f"{label}-inbox") for _ in schemas], None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for inbox in inboxes:
        fs.mkdirs(path(inbox))
    streams = [spark.readStream.schema(schema).parquet(f"{inbox}/*") for schema, inbox in zip(schemas, inboxes, strict=True)]
    stream = build(*streams)
    try:
        for n, folders in enumerate(arrivals):
            for folder, inbox in zip(folders, inboxes, strict=True):
                if folder and not fs.rename(path(folder), path(f"{inbox}/{n:05d}")):
                    raise OSError(f"cannot move {folder} to {inbox}")
            if query is None:
                with _state_partitions(spark):
                    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    return spark.read.schema(stream.schema).parquet(out)
