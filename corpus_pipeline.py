"""From raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import pii, quality_rules
from barloom.llm.decontamination import decontaminate
from barloom.llm.minhash import near_duplicates
from barloom.llm.packing import pack
from barloom.session import persist_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule learned from the labels go."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.passing(docs, rules).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    alone = docs.filter("doc_id IS NULL")
    return docs.dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi").select(*COLUMNS).union(alone.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which no word is left goes."""
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("lang", "source", "n_chars"))
    touched = F.col("n_removed") > 0
    return clean.filter(~touched | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", "text", "lang", "source",
        F.when(touched, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    crf = pii.train(pii.labelled_table(docs))
    found = pii.find_personal_data(docs, crf, mask=True, carry=("lang", "source", "n_chars"))
    return found.select(
        "doc_id", F.col("masked").alias("text"), "lang", "source",
        F.when(F.size("spans") > 0, F.char_length("masked").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut into sequences of 2048 tokens with their ids."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Training, signatures and tokens are no SQL: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
