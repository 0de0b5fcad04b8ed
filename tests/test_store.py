from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from barloom.session import FREE_SHUFFLES, persist_table
from barloom.sources import sinks

D = dt.date


def test_a_written_security_is_replaced_as_a_whole(spark, tmp_path):
    path, until = str(tmp_path / "store"), F.lit(D(2024, 12, 31))
    schema = "security_id string, session date, close double"
    days = [D(2021, 6, 1), D(2022, 6, 1), D(2023, 6, 1), D(2023, 6, 2)]
    first = spark.createDataFrame([(s, d, 1.0) for s in ("A", "B") for d in days if (s, d.year) != ("B", 2021)] + [("B", D(2019, 6, 3), 1.0)], schema)
    ok = lambda *names: spark.createDataFrame([(n, n in names) for n in ("A", "B")], "security_id string, ok boolean")
    sinks.write_bars(first, ok("A", "B"), until, path)
    untouched = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "store" / "year=2019").iterdir())}
    second = spark.createDataFrame([("A", D(2023, 6, 2), 2.0), ("A", D(2024, 6, 3), 2.0), ("B", D(2023, 6, 2), 2.0)], schema)
    sinks.write_bars(second, ok("A"), until, path)
    got = sorted(tuple(r) for r in sinks.read_bars(spark, path).select("security_id", "session", "close").collect())
    assert got == sorted(
        [("A", D(2023, 6, 2), 2.0), ("A", D(2024, 6, 3), 2.0), ("B", D(2019, 6, 3), 1.0), ("B", days[1], 1.0), ("B", days[2], 1.0), ("B", days[3], 1.0)]
    )
    assert not (tmp_path / "store" / "year=2021").exists()
    assert {f: os.stat(f).st_mtime_ns for f in untouched} == untouched


def test_shuffles_behind_a_written_intermediate_are_freed(spark):
    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if f.endswith(".data") and "shuffle" in f}

    before, setting = kept(), spark.conf.get(FREE_SHUFFLES, None)
    counts = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count()
    assert persist_table(counts, "counts").count() == 997
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
    left = kept() - before
    assert len(left) <= 1  # of the count of the rows that were read again
