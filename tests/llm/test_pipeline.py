"""The stages one after the other on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

import brute
import corpus_pipeline as P
from barloom.llm.minhash import near_duplicates
from barloom.session import persist_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(persist_table(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == list(P.COLUMNS)
        assert df.dtypes == stages[0].dtypes


def test_quality_stage_drops_what_fails_the_base(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept
    for r in stages[0].collect():
        if brute.quality_base(r.text)[5]:
            assert r.doc_id not in kept


def test_one_document_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    want = {k for k, c in brute.near_groups(before, 5).items() if k == c}
    assert {r.doc_id for r in stages[2].collect()} == want
    assert near_duplicates(stages[2]).filter("NOT kept").count() == 0


def test_no_benchmark_window_is_left_inside_a_kept_stretch(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = brute.ALNUM.findall(brute.lower(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        w = brute.ALNUM.findall(brute.lower(r.text))
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
        if r.text == before[r.doc_id]:
            continue
        assert r.n_chars == len(r.text) < len(before[r.doc_id])


def test_personal_data_is_masked(stages):
    for r in stages[4].collect():
        assert not [s for s in brute.personal(r.text) if s[0] in ("email", "phone")]
    masked = [r for r in stages[4].collect() if re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)]
    assert masked


def test_run_gives_the_pieces_of_what_is_left(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(P.run(spark, SF).select(columns).collect()) == sorted(stages[5].select(columns).collect())
