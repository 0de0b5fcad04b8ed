"""Sinks: gated bar writes, append-only partitions, one table per record kind."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_bars(bars: DataFrame, report: DataFrame, last_completed: Column, path: str) -> None:
    """Store completed bars of securities that passed quality, each security as a whole.

    What was stored of a security that is written goes, sessions that the new bars lack included. Refused and
    absent securities keep theirs: their rows are carried into the rewritten years. Years in which no written
    security has or had bars are left alone; a year without rows afterwards is removed.
    """
    spark = bars.sparkSession
    accepted = report.where("ok").select("security_id")
    fresh = bars.where(F.col("session") <= last_completed).join(accepted, "security_id", "left_semi")
    out = fresh.withColumn("year", F.year("session"))
    emptied = []
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        written = fresh.select("security_id").distinct()
        years = out.select("year").unionByName(stored.join(written, "security_id", "left_semi").select("year")).distinct()
        kept = stored.join(F.broadcast(years), "year", "left_semi").join(written, "security_id", "left_anti")
        merged = out.unionByName(kept.select(out.columns))
        staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
        touched = {r["year"] for r in years.collect()}  # one value a year
        merged.write.mode("overwrite").partitionBy("year").parquet(staged)
        out = spark.read.schema(merged.schema).parquet(staged)
        emptied = sorted(touched - {r["year"] for r in out.select("year").distinct().collect()})
    (
        out.repartition("year", "security_id")
        .sortWithinPartitions("security_id", "session")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )
    for year in emptied:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/year={year}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def read_bars(spark: SparkSession, path: str, until: Column | None = None) -> DataFrame:
    """Stored bars; unreadable files are skipped, the date bound reaches the scan."""
    bars = spark.read.option("ignoreCorruptFiles", "true").parquet(path).drop("year")
    return bars if until is None else bars.where(F.col("session") < until)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON text; nulls are kept, so a value moved between columns changes it."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def checksum(columns: list[str]) -> Column:
    """Order-free sum of two halves of the rows' digests, as text."""
    digest = row_digest(columns)
    halves = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return F.concat_ws(":", *[F.coalesce(h, F.lit(0)).cast("string") for h in halves])


def content_digest(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free checksum, computed by the executors."""
    row = df.agg(F.count(F.lit(1)).alias("n"), checksum(df.columns).alias("h")).first()
    return int(row["n"]), row["h"]


def publish_once(df: DataFrame, path: str) -> str:
    """Append-only publish: equal content is a no-op, unequal content is refused."""
    spark = df.sparkSession
    if _exists(spark, path):
        if content_digest(spark.read.schema(df.schema).parquet(path)) == content_digest(df):
            return "unchanged"
        raise ValueError(f"{path} already holds different content")
    df.write.mode("errorifexists").parquet(path)
    return "written"


def write_records(path: str, **kinds: DataFrame) -> None:
    """One JSON-lines table per record kind."""
    for kind, df in kinds.items():
        df.write.mode("errorifexists").json(f"{path}/{kind}")
