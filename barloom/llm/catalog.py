"""Registered queries of this package, each with its check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm import pii, quality_rules, secret_scan
from barloom.llm.common import span_text
from barloom.llm.decontamination import find_contamination
from barloom.llm.hard_negatives import hard_negatives
from barloom.llm.html_extraction import main_texts
from barloom.llm.licenses import find_licenses
from barloom.llm.merkle import manifest
from barloom.llm.minhash import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.sharding import kd_shards
from barloom.llm.substring_dedup import near_duplicate_passages
from barloom.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def base_sha256(spans: str) -> Column:
    return F.sha2(span_text(F.filter(spans, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256")


def labels_of(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query
def op1_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE["op2_fm_index_decontamination"] = f"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {_LETTERS}), '{_ALNUM}') AS w
    FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
    SELECT item, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS words FROM item_windows
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_ALNUM}') AS w FROM documents
), places AS (
    SELECT d.doc_id, s.size, d.w, unnest(range(1, len(d.w) - s.size + 2)) AS i
    FROM docs d JOIN (SELECT DISTINCT size FROM windows) s ON len(d.w) >= s.size
), hits AS (
    SELECT p.doc_id, p.i, p.size, x.item
    FROM places p JOIN windows x ON x.size = p.size AND x.words = list_aggregate(p.w[p.i : p.i + p.size - 1], 'string_agg', ' ')
), hit_words AS (
    SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n_items, sha256(coalesce(b.items, '')) AS items_sha256,
       coalesce(a.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words a USING (doc_id) LEFT JOIN hit_items b USING (doc_id)
"""


@query
def op3_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document under rules learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_of("spans", k) for k in secret_scan.KINDS], base_sha256("spans"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op5_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = find_licenses(table(spark, sf_dir, "documents"))
    words = F.transform("phrases", lambda p: p["word"])
    exact, more = F.transform("phrases", lambda p: p["label"]), F.transform("notices", lambda n: n["label"])
    like = F.array_max(F.concat(F.transform("notices", lambda n: n["likeness"]), F.transform("phrases", lambda _: F.lit(1.0))))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels_of(exact).alias("base_labels"), labels_of(F.concat(exact, more)).alias("labels"),
        F.coalesce(like, F.lit(0.0)).alias("score"),
    )


@query
def op6_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.train(pii.labelled_table(docs)))
    return found.select(
        "doc_id", *[count_of("spans", k) for k in pii.KINDS], base_sha256("spans"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents."""
    return near_duplicate_passages(table(spark, sf_dir, "documents"))


@query
def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query
def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))


@query
def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op11_rotated_code_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


ORACLE["op11_rotated_code_hard_negatives"] = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scores AS (
    SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op12_postorder_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document; a fifth of them is folded with its text lower-cased."""
    return manifest(
        table(spark, sf_dir, "documents"),
        ("doc_id", "source", "lang", "n_chars", "text"),
        altered={"text": F.translate("text", _UPPER, _LOWER)},
        when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
        with_proof=False,
    ).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "leaf_index", "log_position")


def _merkle_sql(document_levels: int = 6, source_levels: int = 3) -> str:
    """All levels spelled out: 16^6 documents of a source, 16^3 sources."""

    def levels(name: str, start: str, n: int) -> str:
        out = [f"{name}_0 AS ({start})"]
        for k in range(n + 1):
            # A run's digests in one text; a tree of one node stays as it is.
            out.append(
                f"{name}_runs_{k} AS (SELECT tree, i // 16 AS i, string_agg(d, '' ORDER BY i) AS run, any_value(n) AS n "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_{k}) GROUP BY tree, i // 16)"
            )
            if k < n:
                out.append(f"{name}_{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d FROM {name}_runs_{k})")
        return ",\n".join(out)

    def climb(name: str, walk: str, tree: str, start: str, n: int) -> str:
        out = [f"{walk}_0 AS ({start})"]
        for k in range(n):
            left = f"CASE WHEN r.n = 1 THEN '' ELSE substr(r.run, 1, CAST(64 * (w.i % 16) AS BIGINT)) END"
            right = f"CASE WHEN r.n = 1 THEN '' ELSE substr(r.run, CAST(64 * (w.i % 16) + 65 AS BIGINT)) END"
            out.append(
                f"{walk}_{k + 1} AS (SELECT w.* REPLACE (w.i // 16 AS i, proof || {left} || {right} AS proof, "
                f"CASE WHEN r.n = 1 THEN node ELSE sha256({left} || node || {right}) END AS node) "
                f"FROM {walk}_{k} w JOIN {name}_runs_{k} r ON r.tree = {tree} AND r.i = w.i // 16)"
            )
        return ",\n".join(out)

    text = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(text, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    position = " + ".join(["rn"] + [f"CASE WHEN n > {16 ** (k - 1)} THEN rn // {16**k} ELSE 0 END" for k in range(1, document_levels + 1)])
    return f"""
WITH RECURSIVE table_steps(i, k, v) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM table_steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tab FROM table_steps WHERE k = 8),
documents_crc AS (
    SELECT d.*, coalesce('=' || source, '') AS tree,
           xor(4294967295, list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]))) AS crc
    FROM documents d, crc_table
), leaves AS (
    SELECT doc_id, tree, {leaf("text")} AS leaf,
           CASE WHEN crc % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
    FROM documents_crc
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rn, count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
),
{levels("doc", "SELECT tree, rn AS i, leaf AS d FROM placed", document_levels)},
subroots AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, d FROM doc_{document_levels}),
{levels("src", "SELECT 0 AS tree, i, d FROM subroots", source_levels)},
{climb("doc", "low", "w.tree", "SELECT *, rn AS i, '' AS proof, coalesce(other, leaf) AS node FROM placed", document_levels)},
{climb("src", "high", "0", f"SELECT w.* REPLACE (s.i AS i), s.d AS subroot FROM low_{document_levels} w JOIN subroots s USING (tree)", source_levels)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = d AS verified,
       rn AS leaf_index, CAST({position} AS BIGINT) AS log_position
FROM high_{source_levels}, src_{source_levels} AS top
"""


ORACLE["op12_postorder_merkle_manifest"] = _merkle_sql()


@query
def op13_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
