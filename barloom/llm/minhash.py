"""Near-duplicates by one-permutation hashing with optimal densification."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import WordHashes, id_and_text, in_batches, mix64, rows_of, shingle_hashes, spaced_words
from barloom.llm.graphs import components
from barloom.session import persist_table

BANDS = 40
ROWS = 6
SIMILAR = 80  # percent

SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
    ]
)


class Sketcher:
    """Shingle set, its digest and its banded one-permutation signature, for one text at a time.

    Every shingle is hashed once. The hash range is cut into ``bands * rows``
    bins and a bin keeps the smallest hash in it. A bin without a shingle takes
    the value of a filled bin, chosen by a hash of the two bins, so that each
    empty bin draws its donor independently and sets agree on a bin with
    probability equal to their Jaccard similarity, however small they are.
    """

    def __init__(self, width: int, bands: int, rows: int) -> None:
        self.width, self.bands, self.rows = width, bands, rows
        self.bins = bands * rows
        self.hashes = WordHashes()
        pairs = np.arange(self.bins * self.bins, dtype=np.uint64) + np.uint64(1)
        self.order = mix64(pairs * np.uint64(0x9E3779B97F4A7C15)).reshape(self.bins, self.bins)
        self.band_salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def shingles(self, text: bytes | None) -> np.ndarray:
        return np.unique(shingle_hashes(self.hashes.of(spaced_words(text or b"")), self.width))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        own = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
        filled = own[first].astype(np.int64)
        values = np.empty(self.bins, np.uint64)
        values[filled] = shingles[first]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            donors = filled[np.argmin(self.order[np.ix_(empty, filled)], axis=1)]
            values[empty] = values[donors]
        return values

    def band_keys(self, shingles: np.ndarray) -> list[int]:
        parts = self.signature(shingles).reshape(self.bands, self.rows)
        key = self.band_salt.copy()
        for k in range(self.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return key.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width, bands, rows)

        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                own = sketcher.shingles(text)
                if len(own):
                    yield doc_id, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sketcher.band_keys(own)
                else:
                    yield doc_id, 0, None, None

        return in_batches(each(), SKETCH)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    )


def confirmed(pairs: DataFrame, used: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are at least ``percent`` alike."""
    sides = pairs.join(used.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        used.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, recent = Sketcher(width, 1, 1), OrderedDict()

        def of(doc_id: int, text: bytes) -> np.ndarray:
            found = recent.get(doc_id)
            if found is None:
                found = recent[doc_id] = sketcher.shingles(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return found

        def rows():
            for a, b, text_a, text_b in rows_of(batches, "a", "b", "text_a", "text_b"):
                one, two = of(a, text_a), of(b, text_b)
                small, large = min(len(one), len(two)), max(len(one), len(two))
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        yield a, b

        return in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return sides.mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of their shingle sets.

    Words are split at ASCII white space with A-Z lower-cased; a set holds the
    distinct ``width``-word shingles, or the whole text as one when it has
    fewer words. Documents with equal sets are one class before any pairing, so
    copies never meet pairwise. Classes are banded over a one-permutation
    signature (``bands`` x ``rows`` bins, densified); a pair at the threshold
    misses every band with probability ``(1 - s^rows)^bands``, 5e-6 by default.

    In a bucket one class is the centre and all others are compared with it: a
    star has as many edges as members. The centre is the class that shares
    most buckets with others, which in a family of copies is their original.
    Links are confirmed on whole sets, then components are found. Buckets that
    still hold several components choose a centre of another component and are
    tried again, until a round joins nothing new. Classes of buckets that are
    still mixed are then paired by rare shingles: with the shingles of each set in
    the order of their number of sets, two sets alike enough share one of the first
    ``n - ceil(percent / 100 * n) + 1``. Passages common to many sets come last in that
    order, so families that share less than the threshold make no pairs. Sets whose
    sizes alone rule a link out are never compared.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest id reachable), ``kept``. Null and empty texts have no shingles
    and stand alone. Equal rows give equal rows. A row without an id stands
    alone with a null component and is kept. An empty table gives no rows;
    further columns are ignored.
    """
    coded = persist_table(sketches(docs, width, bands, rows, id_col, text_col), "sketches")
    named = coded.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    banded = named.join(classes, "digest").filter("doc_id = node").select("node", F.col("n_shingles").alias("size"), "bands").dropDuplicates(["node"])
    slots = banded.select("node", "size", F.explode("bands").alias("key"))
    shared = slots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = persist_table(slots.join(shared, "key"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    weight = persist_table(weight, "weights")
    buckets = persist_table(buckets.join(weight, "node").select("key", "node", "size", "weight"), "buckets")
    texts = id_and_text(docs, id_col, text_col).select("doc_id", "text").filter("text IS NOT NULL")
    # One merge join at every size: only texts that share a bucket go further, and rounds read just those.
    nodes = weight.select(F.col("node").alias("doc_id"))
    texts = persist_table(texts.join(nodes.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    centres = buckets.groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("weight", -F.col("node"))).alias("c"))
    centres = centres.select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"))
    tried = persist_table(_star(buckets.join(centres, "key"), percent), "pairs")
    centres = centres.drop("centre_size")
    links = persist_table(confirmed(tried, texts, width, percent), "confirmed")
    labels = components(links)
    while True:
        marked = buckets.join(labels, "node", "left").select("key", "node", "size", "weight", F.coalesce("label", "node").alias("label"))
        mixed = marked.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1")
        buckets = persist_table(marked.join(mixed.select("key"), "key", "left_semi"), "buckets")
        used = centres.join(labels, centres.centre == labels.node, "left").select("key", F.coalesce("label", "centre").alias("label"))
        fresh = buckets.join(used.distinct(), ["key", "label"], "left_anti").groupBy("key").agg(
            F.max_by(F.struct("node", "label", "size"), F.struct("weight", -F.col("node"))).alias("c")
        )
        fresh = fresh.select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("own"), F.col("c.size").alias("centre_size"))
        fresh = persist_table(fresh, "centres")
        more = _star(buckets.join(fresh, "key").filter("label <> own"), percent).join(tried, ["a", "b"], "left_anti")
        more = persist_table(more, "pairs")
        found = persist_table(confirmed(more, texts, width, percent), "confirmed")
        if found.isEmpty():
            break
        tried, links = tried.union(more), links.union(found)
        centres = centres.union(fresh.select("key", "centre"))
        labels = components(links)
        buckets = buckets.select("key", "node", "size", "weight")
    left = buckets.select("node", "label").distinct()
    rest = persist_table(_by_rare_shingles(left, texts, width, percent).join(tried.union(more), ["a", "b"], "left_anti"), "pairs")
    found = persist_table(confirmed(rest, texts, width, percent), "confirmed")
    if not found.isEmpty():
        labels = components(links.union(found))

    members = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"))
    placed = coded.select("doc_id", "n_shingles", "digest").join(members, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _star(rows: DataFrame, percent: int) -> DataFrame:
    alike = F.lit(100) * F.least("size", "centre_size") >= F.lit(percent) * F.greatest("size", "centre_size")
    pairs = rows.filter(alike & (F.col("node") != F.col("centre")))
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _by_rare_shingles(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) of different labels that share one of their rarest shingles.

    No pair at or above ``percent`` is lost, whatever the order, as long as it is the same for all sets: two
    sets that share ``need`` shingles have their first common one before fewer than ``need`` are left in either.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width, 1, 1)
        schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("shingles", pa.list_(pa.int64()))])

        def rows():
            for node, text in rows_of(batches, "doc_id", "text"):
                own = sketcher.shingles(text).view(np.int64)
                yield node, len(own), own

        return in_batches(rows(), schema, 500)

    own = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    sets = persist_table(own.mapInArrow(run, "node bigint, size bigint, shingles array<bigint>"), "sets")
    each = sets.select("node", "size", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = each.join(common, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    # A shingle of one set alone pairs nothing: such fill the first places and are not carried.
    first = F.expr(f"int(size - (size * {percent} + 99) div 100 + 1 - (size - size(s)))")
    heads = ranked.withColumn("first", first).filter("first > 0").select(
        "node", "size", (F.col("size") - F.size("s")).alias("alone"), F.posexplode(F.expr("slice(s, 1, first).shingle")).alias("at", "shingle")
    )
    heads = persist_table(heads.withColumn("at", F.col("at") + F.col("alone")).drop("alone").join(nodes, "node"), "heads")

    def side(name: str) -> DataFrame:
        return heads.select("shingle", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "at", "label")])

    # Linked sets share at least ``need`` shingles; from their first common one on, both must hold that many.
    need = f"({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent}"
    small = side("a").filter(f"size_a - at_a >= (2 * {percent} * size_a + {99 + percent}) div {100 + percent}")
    fits = (
        "(size_a < size_b OR size_a = size_b AND node_a < node_b) AND label_a <> label_b "
        f"AND 100 * size_a >= {percent} * size_b AND least(size_a - at_a, size_b - at_b) >= {need}"
    )
    pairs = small.join(side("b"), "shingle").filter(fits)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
