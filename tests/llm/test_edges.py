"""Every operator on nulls, empty and long texts, repeats, ties, clashing columns and empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import pii, quality_rules, secret_scan
from barloom.llm.common import id_and_text
from barloom.llm.decontamination import decontaminate, find_contamination
from barloom.llm.html_extraction import main_texts
from barloom.llm.licenses import find_licenses
from barloom.llm.minhash import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.sharding import kd_shards
from barloom.llm.substring_dedup import _windows, live_windows, near_duplicate_passages

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, spans string, key string, node bigint, size int"


@pytest.fixture(scope="module")
def edges(spark):
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "no id here"), (None, None),
        (6, "of " * 300), (7, "of " * 290), (8, "\x1cé\x85ß 日本語 password=abcdef1234 a@b.cd"), (9, "x" * 30_000),
    ]
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s", None, 1, "s", "k", 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "two three"), (4, "of " * 40)], "item_id bigint, text string")


def _labels(spark):
    return spark.createDataFrame([(4, 1), (4, 1), (5, None), (6, 0), (None, 0)], "doc_id bigint, quality int")


PER_ROW = {
    "shards": lambda s, d, b: kd_shards(d, shards=3),
    "contamination": lambda s, d, b: find_contamination(d, b),
    "contamination in blocks": lambda s, d, b: find_contamination(d, b, block_bytes=60),
    "decontaminate": lambda s, d, b: decontaminate(d, b, carry=("lang", "n_chars")),
    "judge": lambda s, d, b: quality_rules.judge(d, quality_rules.learn(d, _labels(s))),
    "secrets": lambda s, d, b: secret_scan.find_secrets(d),
    "licenses": lambda s, d, b: find_licenses(d),
    "personal data": lambda s, d, b: pii.find_personal_data(d, pii.train(pii.labelled_table(d)), mask=True, carry=("lang",)),
    "near duplicates": lambda s, d, b: near_duplicates(d),
    "pages": lambda s, d, b: main_texts(d.withColumnRenamed("text", "html").withColumn("url", F.col("lang")), id_col="doc_id"),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_input_row(spark, edges, items, name):
    assert PER_ROW[name](spark, edges, items).count() == edges.count()


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables_give_no_rows(spark, edges, items, name):
    assert PER_ROW[name](spark, edges.limit(0), items.limit(0)).count() == 0


def test_pieces_of_edges_cover_every_document(edges):
    pieces = pack(edges)
    assert pieces.filter("doc_id = 1").select("doc_tokens", "length").collect() == [(1, 1)]
    assert pieces.filter("doc_id = 5").count() == 2
    assert pieces.select(F.sum("length")).first()[0] == pieces.filter("start = 0").select(F.sum("doc_tokens")).first()[0]
    assert pack(edges.limit(0)).count() == 0


def test_passages_of_edges(edges):
    found = near_duplicate_passages(edges).select("doc_id", "source_doc_id").distinct().collect()
    assert found == [(7, 6)]
    assert near_duplicate_passages(edges.limit(0)).count() == 0


def test_groups_of_edges(edges):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(edges).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 1, None, True)} <= got


def test_verdict_of_texts_without_words(spark, edges):
    judged = quality_rules.judge(edges, []).filter("doc_id IN (1, 2, 3)").select("n_words", "base_failed", "kept").distinct()
    assert judged.collect() == [(0, True, False)]


def test_blocks_of_the_benchmark_agree_with_one_pass(edges, items):
    columns = ["doc_id", "n_words", "spans", "items"]
    one = sorted(map(str, find_contamination(edges, items).select(columns).collect()))
    many = sorted(map(str, find_contamination(edges, items, block_bytes=60).select(columns).collect()))
    assert one == many


def test_cut_texts(spark, items):
    docs = spark.createDataFrame([(1, "Say: one, TWO! three.", "en")], "doc_id bigint, text string, lang string")
    row = decontaminate(docs, items.filter("item_id = 3"), carry=("lang",)).first()
    assert (row.text, row.n_words, row.n_removed, row.lang) == ("Say: ! three.", 4, 2, "en")


def test_texts_are_searched_and_cut_in_one_python_step(edges, items):
    clean = decontaminate(edges, items, carry=("lang", "n_chars"))
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    many = decontaminate(edges, items, carry=("lang", "n_chars"), block_bytes=60)
    assert sorted(map(str, clean.collect())) == sorted(map(str, many.collect()))


def test_a_notice_in_many_texts_makes_no_windows(spark):
    """Thirteen words that many documents have are no passage; before, their windows paired all of these documents."""
    rng = np.random.default_rng(23)

    def others(n):
        return " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))

    notice, passage = others(13), others(60)
    rows = [(k, f"{others(60)} {notice} {others(60)}") for k in range(40)]
    rows += [(k, f"{others(40)} {passage} {others(40)}") for k in (100, 101)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    windows = _windows(id_and_text(docs, "doc_id", "text"), 5, 46, 4, 80).collect()
    assert {r.doc for r in windows} == {100, 101}
    assert [(r.doc_id, r.source_doc_id) for r in near_duplicate_passages(docs).collect()] == [(101, 100)]


def test_windows_are_live_around_stretches_that_do_not_fall():
    rng = np.random.default_rng(29)
    for _ in range(200):
        n, least = int(rng.integers(1, 50)), int(rng.integers(1, 12))
        spare = np.concatenate(([0], np.cumsum(rng.choice([-80, 20], n))))
        low, at, high = np.sort(rng.integers(0, n, (20, 3))).T
        want = [
            any(spare[y + 1] >= spare[x] for x in range(a, c + 1) for y in range(max(c, x + least - 1), b + 1))
            for a, c, b in zip(low, at, high, strict=True)
        ]
        assert live_windows(spare, low, at, high, least).tolist() == want


def test_copies_have_one_row_each_and_lose_no_link(spark):
    """Before, a copy also had a row for each passage of the text it copies."""
    rng = np.random.default_rng(31)

    def others(n):
        return " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))

    one, two = others(60), others(60)
    texts = {1: f"{one} {others(40)}", 2: f"{others(40)} {two}"}
    texts[3] = texts[4] = texts[5] = f"{one} {others(30)} {two}"
    texts[6] = texts[7] = others(49)
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (8, None)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in near_duplicate_passages(docs).collect())
    assert found == [(3, 0, 60, 1), (3, 90, 150, 2), (4, 0, 150, 3), (5, 0, 150, 3)]
