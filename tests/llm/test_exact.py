"""Operators against plain versions, round trips, and exact parts under random texts."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from barloom.llm import pii
from barloom.llm.catalog import QUERIES
from barloom.llm.common import alnum_words
from barloom.llm.decontamination import Phrases, Shard, find_contamination
from barloom.llm.fm_index import FMIndex
from barloom.llm.html_extraction import extract, induce, induce_wrappers, main_texts, references, simple_tree_matching
from barloom.llm.html_tree import parse
from barloom.llm.licenses import NOTICES, find_licenses, scanner
from barloom.llm.minhash import Sketcher, near_duplicates
from barloom.llm.packing import default_vocabulary, encoder
from barloom.llm.substring_dedup import alike_stretches, compact_windows, near_duplicate_passages

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@given_tables
def test_shards_have_equal_bytes_and_gapless_slots(spark, texts):
    rows = QUERIES["op1_kd_tree_shards"](spark, SF).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


@given_tables
def test_quality_counts(spark, texts):
    for r in QUERIES["op3_decision_list_quality"](spark, SF).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.quality_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.rule == 0)


@given_tables
def test_secret_spans(spark, texts):
    for r in QUERIES["op4_markov_secrets"](spark, SF).collect():
        want = brute.secrets(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


@given_tables
def test_license_phrases(spark, texts):
    for r in QUERIES["op5_license_notices"](spark, SF).collect():
        n, places = brute.licenses(texts[r.doc_id])
        first, last = (places[0][0], max(p for p, _ in places)) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), first, last)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@given_tables
def test_personal_data_spans(spark, texts):
    for r in QUERIES["op6_crf_personal_data"](spark, SF).collect():
        want = brute.personal(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r.spans.split(",")))


@given_tables
def test_pieces_give_back_every_token(spark, texts):
    from tokenizers import Tokenizer

    from barloom.llm.packing import pack

    plain = Tokenizer.from_file(default_vocabulary())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in pack(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32
    for k, text in texts.items():
        own = sorted(pieces[k], key=lambda r: r.start)
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(r.ids for r in own) == ids.tobytes()
        assert {r.doc_tokens for r in own} == {len(ids)}
    for k, rows in sequences.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == max(sequences)


@given_tables
def test_near_duplicate_groups(spark, texts):
    want = brute.near_groups(texts, 4)
    for r in QUERIES["op10_minhash_near_duplicates"](spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(brute.shingles(texts[r.doc_id], 4)), want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


@given_tables
def test_every_repeated_passage_is_found(spark, texts):
    owners = defaultdict(set)
    words = {k: brute.SPACED.findall(brute.lower(t)) for k, t in texts.items()}
    for k, w in words.items():
        for i in range(len(w) - 49):
            owners[tuple(w[i : i + 50])].add(k)
    want = {k for v in owners.values() if len(v) > 1 for k in v}
    found = QUERIES["op7_compact_windows"](spark, SF).collect()
    assert want <= {r.doc_id for r in found} | {r.source_doc_id for r in found}
    for r in found:
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.source_doc_id][r.source_start : r.source_end]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert min(len(a), len(b)) >= 50
        assert abs(len(one & two) / len(one | two) - r.similarity) < 1e-5
        assert r.similarity >= 0.8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_index_finds_every_occurrence(text, phrase):
    index = FMIndex(np.array(text), 5, sample=3)
    low, high = index.search(np.array([phrase]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab cD.", max_size=40), max_size=5), st.lists(st.text("ab cd", max_size=30), min_size=1, max_size=4))
def test_hits_of_a_shard(docs, items):
    shard = Shard(Phrases([(str(k), t.encode()) for k, t in enumerate(items)], 3))
    for k, t in enumerate(docs):
        shard.add(None, k, t.encode(), None)
    for _, k, n, spans, names, _, _ in shard.results():
        words = [w.decode() for w in alnum_words(docs[k].encode())]
        hit, want = set(), set()
        for name, item in enumerate(items):
            own = [w.decode() for w in alnum_words(item.encode())]
            size = min(3, len(own))
            for j in range(len(own) - size + 1) if size else ():
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[j : j + size]:
                        hit |= set(range(i, i + size))
                        want.add(str(name))
        assert n == len(words)
        assert {i for s in spans for i in range(s["start"], s["stop"])} == hit
        assert names == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.text("a1.@- 2_+()0", max_size=40))
def test_exact_personal_data(text):
    assert pii.base_spans(text) == brute.personal(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 6))
def test_a_window_stands_for_every_stretch(values, least):
    tokens = np.array([0, *values, 0], np.uint64)
    windows = list(zip(*(x.tolist() for x in compact_windows(tokens, least)), strict=True))
    for i in range(1, len(values) + 1):
        for j in range(i + least - 1, len(values) + 1):
            c = i + int(np.argmin(tokens[i : j + 1]))
            earlier = [x for x in range(max(1, c - least + 1), c) if tokens[x] == tokens[c] and tokens[x:c].min() >= tokens[c]]
            assert earlier or any(a <= i and c == at and j <= b for a, at, b in windows)


def test_stretches_skip_what_differs():
    a, b = np.arange(1, 201, dtype=np.uint64), np.arange(1, 201, dtype=np.uint64)
    b[100:130] = np.arange(900, 930, dtype=np.uint64)
    assert [x[:4] for x in alike_stretches(a, b, 5, 50, 80)] == [(0, 99, 0, 99), (130, 199, 130, 199)]


def test_stretches_with_words_put_in_are_tested_whole():
    whole = np.arange(1, 65, dtype=np.uint64)
    b = np.concatenate([whole[:30], np.arange(900, 910, dtype=np.uint64), whole[34:]])
    for one, two in ((whole, b), (b, whole)):
        assert [(x, y, u, v) for x, y, u, v, _ in alike_stretches(one, two, 5, 50, 80)] == [(0, len(one) - 1, 0, len(two) - 1)]


def test_a_passage_behind_unrelated_smaller_ids_is_found(spark):
    rng = np.random.default_rng(7)

    def others(n):
        return [f"w{k}" for k in rng.integers(0, 10**9, n)]

    passage, rows = others(60), []
    for k in range(45):  # every ninth word differs: shared shingles head the groups, no passage is alike
        broken = [others(1)[0] if i % 9 == k % 9 else w for i, w in enumerate(passage)]
        rows.append((k, " ".join(others(30) + broken + others(30))))
    rows += [(k, " ".join(others(40) + passage + others(40))) for k in (100, 101)]
    found = near_duplicate_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in found] == [(101, 40, 100, 100)]


def test_links_between_classes_that_never_were_centre_are_found(spark):
    rng, sketcher = np.random.default_rng(11), Sketcher(5, 1, 1)

    def others(n):
        return " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))

    # One bucket for all: the phrase has the smallest hash of each text.
    phrase = min((others(5) for _ in range(20_000)), key=lambda t: sketcher.shingles(t.encode())[0])
    alike = others(60)
    texts = [others(30), others(30), f"{alike} y", f"{alike} z"]
    docs = spark.createDataFrame([(k, f"{phrase} {t}") for k, t in enumerate(texts, 1)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, bands=1, rows=1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_notices_with_edits():
    scan = scanner(NOTICES)
    assert [(m[2], m[3] < 1) for m in scan.matches(b"x licensed under teh apache licence version 2 0 y")] == [("apache-2", True)]
    assert scan.matches(b"the mit of public version and work") == []
    for words, label, edits in NOTICES:
        spoiled = words[: len(words) // 2] + words[len(words) // 2 + 1 :]
        assert label in [m[2] for m in scan.matches(spoiled.encode())] or edits == 1


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    coder = encoder(default_vocabulary())
    odd = ["a\x1cb c", "İstanbul ΣΑΣ’s don't I'm", "日本語 テスト", "éa é", "", "  ", "x" * 3000, "12.5% a--b's '' 's", "a​b c\x85d"]
    for text, got in zip(odd, coder.encode(odd), strict=True):
        assert got == np.array(plain.encode(text, add_special_tokens=False).ids, coder.kind).tobytes()


def test_template_text_is_left_out_without_an_article():
    def page(k):
        return f"<body><div class=top>Welcome to the site</div><div><p>Story {k} begins<br>here.</div><div>All rights kept</div></body>"

    wrapper = induce([page(k) for k in "abcd"])
    assert extract(page("e"), wrapper) == "Story e begins\nhere."
    assert extract("<article><h1>T &amp; U</h1><nav>x</nav><p>a  b<div class='comment-list'>no</div></article><p>out", wrapper) == "T & U\na b"


def test_tree_matching_is_the_largest_mapping():
    a, b = parse("<ul><li>1<li>2<p>x</p></ul>"), parse("<ul><li>1<p>x</p></ul>")
    assert simple_tree_matching(a, b)[0] == 4
    assert simple_tree_matching(parse("<p>"), parse("<div>"))[0] == 1
    assert re.sub(r"\s", "", extract("<div><p>a<p>b</div>", {})) == "ab"


def test_a_notice_with_edits_next_to_exact_ones_is_found():
    scan = scanner(NOTICES)
    near, exact = b"released umder the mit license", b"released under the mit license"
    found = scan.matches(b" ".join((near, exact, near, b"some other words", exact)))
    assert [(a, m == 1.0) for a, _, label, m in found if label == "mit"] == [(0, False), (31, True), (62, False), (110, True)]
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_seeds_met_out_of_order_keep_the_whole_stretch():
    scan = scanner((("alpha beta gamma delta", "x", 3),))
    text = b"alpha beta gamma delta"
    for cut in range(len(text)):
        spoiled = text[:cut] + b"#" + text[cut + 1 :]
        for lead in (b"", b"alpha ", b"alpha alpha beta ", b"gamma "):
            spans = [(a, b) for a, b, _, _ in scan.matches(lead + spoiled)]
            assert any(a <= len(lead) + 3 and b >= len(lead) + len(text) - 3 for a, b in spans), (cut, lead)


def test_many_notices_in_one_text_are_all_found_where_they_stand(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "word released under the mit license " * n)], "doc_id bigint, text string")
    row = find_licenses(docs).first()
    assert [p.word for p in row.phrases] == list(range(2, 6 * n, 6))
    assert [(x.start, x.end) for x in row.notices] == [(i, i + 5) for i in range(1, 6 * n, 6)]


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_an_item_in_several_rows_is_listed_once(spark, block):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("7", passage), ("7", passage + " twelve"), ("8", "apart")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {passage} twelve y"), (2, "nothing")], "doc_id bigint, text string")
    got = {r.doc_id: (r["items"], r.spans) for r in find_contamination(docs, items, block_bytes=block).collect()}
    assert got[1][0] == ["7"] and [(s.start, s.stop) for s in got[1][1]] == [(1, 13)] and got[2][0] == []


def _share_page(k, story, tail="<p>Share this story<ul><li>by mail<li>by post</ul>"):
    words = [f"{story}{i}" for i in range(40)]
    return f"<body><article><h1>About</h1><p>{' '.join(words[:20])} <b>now</b></p><p>{' '.join(words[20:])}</p>{tail}</article><p>{k}"


def test_template_blocks_within_articles_are_left_out(spark):
    """Pages with an article were read without the wrapper, so the host's template text in it stayed."""
    own = lambda s: f"About\n{' '.join(f'{s}{i}' for i in range(20))} now\n{' '.join(f'{s}{i}' for i in range(20, 40))}"
    share = "\nShare this story\nby mail\nby post"
    rows = [(k, "http://a.org/x", _share_page(k, s)) for k, s in enumerate("abcdef")]
    # Copies of one article are no template, nor is a line of few of the host's articles or of too few articles.
    rows += [(k, "http://b.org/x", _share_page(k, "z")) for k in range(10, 20)]
    rows += [(k, "http://c.org/x", _share_page(k, s)) for k, s in zip(range(20, 23), "abc")]
    rows += [(k, "http://d.org/x", _share_page(k, f"s{k}x", "<p>rare line" if k % 3 else "<p>other line")) for k in range(30, 60)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == own(s) for k, s in enumerate("abcdef"))
    assert all(got[k] == own("z") + share for k in range(10, 20))
    assert all(got[k] == own(s) + share for k, s in zip(range(20, 23), "abc"))
    assert all(got[k] == own(f"s{k}x") + ("\nrare line" if k % 3 else "\nother line") for k in range(30, 60))


def test_varying_text_below_template_text_stays():
    def page(k):
        return f"<body><div>By <p>Author {k}</p></div><div><p>Story {k} here</div>"

    assert extract(page("e"), {**induce([page(k) for k in "abcd"]), "content": None}) == "By\nAuthor e\nStory e here"


def test_template_text_deep_in_a_tree_is_known():
    def page(k):
        return "<div>" * 12 + f"<p>Story {k}</p><p>All rights kept</p>" + "</div>" * 12

    assert extract(page("e"), induce([page(k) for k in "abcd"])) == "Story e"


def test_a_passage_like_an_explained_one_but_not_like_its_source_is_found(spark):
    """The second of three is like the first and the third like the second only: once the second was explained, they never met."""
    rng, rows = np.random.default_rng(17), []

    def others(n):
        return [f"w{k}" for k in rng.integers(0, 10**9, n)]

    def changed(words, places):
        return [others(1)[0] if k in places else w for k, w in enumerate(words)]

    for k in range(0, 90, 3):
        one = others(120)
        two = changed(one, {24, 72})
        for n, words in enumerate((one, two, changed(two, {48, 96}))):
            rows.append((k + n, " ".join(others(30) + words + others(30))))
    found = {(r.doc_id, r.source_doc_id) for r in near_duplicate_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any((k + 2, k) in found for k in range(0, 90, 3))
    for n in (1, 2):
        assert sum((k + n, k + n - 1) in found for k in range(0, 90, 3)) >= 27


def _first_by_hash(spark, rows, n):
    """The rows whose id and address come first in the order that once chose a host's sample."""
    order = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").orderBy(F.xxhash64("page_id", "url")).limit(n)
    return {r.page_id for r in order.collect()}


def test_wrappers_are_induced_from_all_pages_of_a_host(spark):
    """Wrappers came from six pages of a host: what these did not show was never template."""
    ids = [(k, "http://a.org/x") for k in range(40)] + [(k, "http://b.org/x") for k in range(100, 140)]
    early = _first_by_hash(spark, ids[:40], 6) | _first_by_hash(spark, ids[40:], 6)

    def plain(k, banner):
        return f"<body>{'<div class=top>Welcome to the site</div>' if banner else ''}<div class=main><p>Story {k} begins here</p></div>"

    # The first six pages of a.org are copies of one article, and those of b.org have no banner.
    html = {k: _share_page(k, "z" if k in early else f"s{k}x") if k < 100 else plain(k, k not in early) for k, _ in ids}
    pages = spark.createDataFrame([(k, url, html[k]) for k, url in ids], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert not any("Share this story" in got[k] or "by mail" in got[k] for k in range(40))
    assert [got[k] for k in range(100, 140)] == [f"Story {k} begins here" for k in range(100, 140)]


def test_counted_wrappers_equal_those_of_all_pages_at_once(spark):
    rng, rows = np.random.default_rng(23), []
    for host in "abcdefgh":
        layout = [f"l{i}" for i in rng.integers(0, 3, 4)]
        for k in range(int(rng.integers(1, 14))):
            kind, some = "article" if host > "d" and rng.random() < 0.7 else "div", lambda n: " ".join(map(str, rng.integers(0, n, 5)))  # noqa: B023
            parts = "".join(f"<div class={c}><p>{some(2 + 50 * (i % 2))}</p><p>Rights</p></div>" for i, c in enumerate(layout))
            rows.append((len(rows), f"http://{host}.org/{k}", f"<body><div>Top {host}</div><{kind}><h1>T</h1><p>{some(1000)}</p>{parts}<p>Share</p></{kind}>"))
    frame = spark.createDataFrame(rows, "page_id long, host string, html string").selectExpr("page_id", "substring(host, 8, 5) AS host", "host AS url", "html")
    got = {r.host: json.loads(r.wrapper) for r in induce_wrappers(frame).collect()}
    first = {r.host: r.reference for r in references(frame).collect()}
    asked = [r.host for r in frame.where("html NOT LIKE '%<article>%'").select("host").distinct().collect()]
    for host in first:
        pages = [r[2] for r in rows if r[1][7:12] == host and r[2] != first[host]]
        want = induce([first[host], *pages])
        assert sorted(got.get(host, {}).get("inside") or []) == want["inside"]
        if host in asked:
            assert (got[host].get("template") or [], got[host].get("content")) == (want["template"], want["content"])
    assert any(w.get("template") for w in got.values()) and any(w.get("inside") for w in got.values())
