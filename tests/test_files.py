from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.sources import files as FI

SCHEMA = "folder string, path string, length bigint, sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(spark, rows):
    return spark.createDataFrame([(f, p, len(c), sha(c)) for f, p, c in rows], SCHEMA)


def plain_digest(pairs, per_bucket):
    """Digest of one folder by recursion over the hash trie."""
    digits = 0
    while len(pairs) > per_bucket * 16**digits:
        digits += 1

    def of(node, own):
        if not own:
            return ""
        if len(node) == digits:
            return sha("\n".join(sorted(f"{p}:{sha(c)}" for p, c in own)))
        return sha("".join(of(node + d, [x for x in own if sha(x[0]).startswith(node + d)]) for d in "0123456789abcdef"))

    return of("", pairs)


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_digest_tree_equals_recursion(spark, n):
    rows = [("a", f"p{i}", f"c{i}") for i in range(n)] + [("b", "é", ""), ("b", "é", "")]
    got = {r.folder: (r.files, r.bytes, r.fingerprint) for r in FI.digest_tree(tree(spark, rows), per_bucket=3, depth=4).collect()}
    assert got["a"] == (n, sum(len(c) for _, _, c in rows), plain_digest([r[1:] for r in rows[:n]], 3))
    assert got["b"] == (2, 0, plain_digest([("é", ""), ("é", "")], 3))


def test_one_changed_file_changes_one_folder(spark):
    rows = [(f, f"p{i}", f"c{i}") for f in "ab" for i in range(60)]
    one = {r.folder: r.fingerprint for r in FI.digest_tree(tree(spark, rows), 4).collect()}
    two = {r.folder: r.fingerprint for r in FI.digest_tree(tree(spark, [*rows[:-1], ("b", "p59", "other")]), 4).collect()}
    assert one["a"] == two["a"] and one["b"] != two["b"]
    assert FI.digest_tree(tree(spark, rows).limit(0)).count() == 0


def test_every_state_of_a_manifest(spark):
    there = tree(spark, [("a", "same", "1"), ("a", "other", "2"), ("a", "more", "3"), ("c", "x", "4"), ("d", "y", "5"), ("e", "t", "6"), ("e", "t", "7")])
    wanted = tree(spark, [("a", "same", "1"), ("a", "other", "0"), ("a", "gone", "1"), ("b", "gone", "1"), ("d", "y", "5"), ("e", "t", "6")])
    got = {(r.folder, r.path): r.state for r in FI.reconcile(wanted, there).collect()}
    assert got == {
        ("a", "same"): "ok", ("a", "other"): "changed", ("a", "gone"): "missing", ("a", "more"): "extra", ("b", "gone"): "missing",
        ("c", "x"): "unavailable", ("d", "y"): "ok", ("e", "t"): "ambiguous",
    }
    status = {r.folder: r.status for r in FI.manifest_status(wanted, there).collect()}
    assert status == {"a": "degraded", "b": "partial", "c": "unavailable", "d": "ok", "e": "degraded"}


@pytest.mark.parametrize("wrong", [("a", "p1", "changed"), ("a", "p9", "extra"), None])
def test_a_violated_manifest_stops_the_job(spark, wrong):
    rows = [("a", f"p{i}", f"c{i}") for i in range(3)]
    there = [r for r in rows if wrong is None or r[1] != wrong[1]] + ([wrong] if wrong else [])
    declared = tree(spark, rows)
    if wrong is None:
        assert FI.verified(declared, tree(spark, there)).count() == 3
        there = there[:-1]
    with pytest.raises(Exception, match="manifest violated"):
        FI.verified(declared, tree(spark, there)).collect()


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "one.txt").write_text("one")
    (tmp_path / "x" / "y" / "two.txt").write_text("two")
    found = FI.file_inventory(spark, str(tmp_path)).orderBy("path")
    assert [(r.folder, r.path, r.length, r.sha256) for r in found.collect()] == [("x", "x/one.txt", 3, sha("one")), ("x/y", "x/y/two.txt", 3, sha("two"))]
    assert FI.digest_tree(found).count() == 2
