"""Hard negatives, manifest and token counts against plain versions, with their edges."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barloom.llm import hard_negatives as hn, merkle
from barloom.llm.catalog import QUERIES
from barloom.llm.token_counts import counter, default_vocabulary, token_counts

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


# Hard negatives


def plain_negatives(rows, every=100, k=5):
    fine = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in fine:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fine if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0, 0.2, size).tolist()) for i in range(n)]
    hot = rng.normal(0, 0.3, size).tolist()
    return [(i, label, hot if i % 4 == 1 else v) for i, label, v in rows]


@pytest.mark.parametrize("size", [1, 7, 64, 130])
def test_negatives_equal_brute_force(spark, size):
    rows = vectors(420, size, size)
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5)
    got = sorted(map(tuple, hn.hard_negatives(frame, every=20).collect()))
    assert got == plain_negatives(rows, every=20) and got


def test_negatives_of_odd_rows(spark):
    good = vectors(60, 5, 3)
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, 1, [0.1] * 5), (500, None, [0.1] * 5), (501, 1, None), (502, 1, [0.1, None, 0.2, 0.3, 0.1]), (503, 1, [nan] * 5),
        (504, 1, [inf, 0.0, 0.0, 0.0, 0.0]), (510, 1, [0.2, 0.2]), (511, 2, [0.2, 0.2]), (512, 1, [0.2, 0.3]), (520, 1, []), (521, 2, []),
        (20, 0, [0.0] * 5), (530, 0, [-0.1] * 5), (540, 9, [0.3] * 5), *good[:3], good[20],
    ]
    rows = good + odd
    schema = "vec_id bigint, label int, embedding array<double>"
    frame = spark.createDataFrame(rows, schema).withColumns({"size": F.lit(1), "rank": F.lit("x"), "copies": F.lit(None)})
    assert sorted(map(tuple, hn.hard_negatives(frame, every=10).collect())) == plain_negatives(rows, every=10)
    assert hn.hard_negatives(frame.limit(0)).count() == 0


def test_anchors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hn, "BLOCKS_AT_ONCE", 3)
    rows = vectors(200, 16, 8)
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert sorted(map(tuple, hn.hard_negatives(frame, every=5).collect())) == plain_negatives(rows, every=5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 1 << 30), st.floats(0.01, 3000))
def test_intervals_hold_every_score(size, seed, scale):
    rng = np.random.default_rng(seed)
    rows = np.floor(rng.normal(0, scale, (40, size)))
    rows[:3] = 0
    codes, anchors = hn.Codes(rows), hn.Anchors(rows[:6])
    for k in range(6):
        low, high = anchors.interval(k, codes.bits, codes.aligned, codes.rest, np.sqrt((rows**2).sum(1)))
        exact = rows @ rows[k]
        assert (low <= exact).all() and (exact <= high).all()


def test_codes_leave_most_rows_unscored():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 32, (5000, 64)))
    codes, anchors = hn.Codes(rows), hn.Anchors(rows[:5])
    lengths = np.sqrt((rows**2).sum(1))
    for k in range(5):
        bar = np.sort(rows @ rows[k])[-6]
        _, high = anchors.interval(k, codes.bits, codes.aligned, codes.rest, lengths)
        assert (high >= bar).mean() < 0.2


# Manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of digests, from the leaves to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_path(levels, index):
    out = []
    for level in levels[:-1]:
        first = index - index % 16
        run = level[first : first + 16]
        out.append(("".join(run[: index - first]), "".join(run[index - first + 1 :])))
        index //= 16
    return out


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    lower = {c: c + 32 for c in range(65, 91)}
    trees = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        leaf = digest("".join(map(plain_field, r)))
        other = digest("".join(map(plain_field, (*r[:4], r[4].translate(lower) if r[4] is not None else None)))) if changed else leaf
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, other))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        trees[name].sort()
        built[name] = plain_tree([x[2] for x in trees[name]])
    top = plain_tree([built[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (known, doc_id, leaf, other) in enumerate(trees[name]):
            path = plain_path(built[name], i) + plain_path(top, k)
            node = other
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((doc_id if known else None, leaf, built[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def engine_manifest(frame):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(frame, COLUMNS, altered={"text": low}, when=changed)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = found.select(*columns, "proof").collect()
    assert all(digest(r.proof) == r.proof_sha256 for r in rows)
    return sorted((tuple(r[:7]) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4113])
def test_manifest_equals_plain_trees(spark, n):
    names = ["hot", None, "", "é", "a", "Z", "=", "日"] + [f"s{i}" for i in range(20)]
    rows = [(i * 3, names[0 if i < n - 40 or n < 50 else i % len(names)], None if i % 5 else "en", i, f"Text {i}") for i in range(n)]
    random.Random(n).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert engine_manifest(frame) == plain_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i % 300}", "en", 1, "A") for i in range(700)]
    assert engine_manifest(spark.createDataFrame(rows, SCHEMA)) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "s", "en", 2, LONG), (1, "s", "en", 2, LONG), (1, "s", None, 2, ""), (2, "s", "", None, None)]
    rows += [(5, "s", "en", 2, "Same ROW")] * 40
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "leaf": F.lit(1), "index": F.lit(None), "n": F.lit(2.0), "key": F.lit(1)})
    assert engine_manifest(frame) == plain_manifest(rows)
    assert merkle.manifest(frame.limit(0), COLUMNS).count() == 0


@given(st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_addresses_are_the_order_of_completion(n):
    levels = merkle.height(n)
    log = merkle.append_log([f"{i:064x}" for i in range(n)], levels)
    tree = plain_tree([f"{i:064x}" for i in range(n)])
    places = [merkle.address(level, i, n, levels) for level, nodes in enumerate(tree) for i in range(len(nodes))]
    assert sorted(places) == list(range(len(log)))
    assert all(log[merkle.address(level, i, n, levels)] == node for level, nodes in enumerate(tree) for i, node in enumerate(nodes))


def test_address_column_is_the_address(spark):
    pairs = [(i, n) for n in (1, 15, 16, 17, 255, 256, 257, 5000) for i in {0, 1, 15, 16, 17, 255, 256, n - 1} if i < n]
    frame = spark.createDataFrame(pairs, "i bigint, n bigint")
    for row in frame.withColumn("at", merkle.address_column(0, F.col("i"), F.col("n"), 12)).collect():
        assert row["at"] == merkle.address(0, row.i, row.n, merkle.height(row.n))


def test_manifest_notices_every_change(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}") for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(frame, COLUMNS, altered={"n_chars": F.col("n_chars") + 1}, when=F.col("doc_id") % 7 == 0).collect()
    assert {r.doc_id for r in found if not r.verified} == {i for i in range(90) if i % 7 == 0}


# Token counts


def library(texts):
    return [len(e.ids) for e in counter(default_vocabulary()).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


SIGNS = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "日", "　", " ", "՘", "\U00031350", "<|endoftext|>", "<|endo", "​", "😀", "́", "\x00", "\x1c", "\x85", "₏", "Ⅷ", "²", "\t", "'ll", "!", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=40).map("".join) | st.text(max_size=60))
def test_counts_are_the_librarys(text):
    assert counter(default_vocabulary()).of([text]) == library([text])


def test_whole_tokens_are_proved():
    own = counter(default_vocabulary())
    assert len(own.whole) > 40_000 and "<|endoftext|>" not in own.whole
    some = random.Random(1).sample(sorted(own.whole), 2000)
    assert set(library(some)) == {1}


def test_long_texts_are_counted_in_parts(monkeypatch):
    from barloom.llm import token_counts as tc

    monkeypatch.setattr(tc, "_PART_CHARS", 50)
    texts = [LONG[:20_000], " " * 3000, "x" * 3000, "a  b   c " * 400, "<|endoftext|> " * 200, "日本 語՘ " * 200, "\n \n" * 500]
    assert counter(default_vocabulary()).of(texts) == library(texts)


def test_token_counts_of_edges(spark):
    rows = [(1, None), (2, ""), (3, LONG), (4, "one"), (4, "one"), (None, "é"), (5, "a <|endoftext|> b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit(1)})
    got = sorted(map(tuple, token_counts(frame).collect()), key=str)
    n = library([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n)), key=str)
    assert token_counts(frame.limit(0)).count() == 0


def test_token_counts_of_the_given_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op13_whole_token_counts"](spark, SF).collect()}
    assert got == dict(zip(texts, library(list(texts.values()))))
