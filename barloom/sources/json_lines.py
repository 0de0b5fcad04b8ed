"""JSON lines: tolerant reads for views, strict reads for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that parse as objects; blank, malformed and non-object lines are skipped."""
    return parse_tolerant(spark.read.text(path), "value", schema)


def parse_tolerant(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parsed fields of a text column, rows that are not JSON objects dropped."""
    wide = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    text = F.trim(F.col(column))
    parsed = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(F.startswith(text, F.lit("{"))).withColumn("_r", parsed)
    kept = [c for c in lines.columns if c != column]
    return rows.where(F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull()).select(
        *kept, *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields]
    )


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must parse; anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def inline_rows(docs: DataFrame, column: str, row_schema: str) -> DataFrame:
    """Documents of the form {"rows": [...]} as one row per entry."""
    kept = [c for c in docs.columns if c != column]
    parsed = F.from_json(column, f"rows array<{row_schema}>")
    return docs.select(*kept, F.inline(parsed["rows"]))


def flatten_batches(docs: DataFrame, column: str, row_schema: str) -> DataFrame:
    """Archived lists of batches of responses, one row per response in archive order."""
    kept = [c for c in docs.columns if c != column]
    batches = docs.select(*kept, F.posexplode(F.from_json(column, f"array<array<{row_schema}>>")).alias("batch", "_b"))
    return batches.select(*kept, "batch", F.posexplode("_b").alias("position", "_r")).select(
        *kept, "batch", "position", "_r.*"
    )
