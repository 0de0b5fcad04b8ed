"""Hard negatives by rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import in_batches, rows_of
from barloom.session import persist_table

SCALE = 256
#: A row with a larger component has no score that fits a long, and takes no part.
LARGEST = 1 << 26
LAYERS = 4
PLANES = 6
BLOCK_ROWS = 4096
ANCHOR_BLOCK = 512
ANCHOR_BLOCK_BYTES = 1 << 20
#: Anchor blocks that meet all rows in one pass: about 32 MB of vectors at most are broadcast.
BLOCKS_AT_ONCE = 32
_SLACK = 1e-6

BLOCKS = pa.schema(
    [
        ("size", pa.int32()),
        ("ids", pa.binary()),
        ("labels", pa.binary()),
        ("vectors", pa.binary()),
        ("codes", pa.binary()),
        ("aligned", pa.binary()),
        ("rest", pa.binary()),
    ]
)
_BLOCKS = "size int, ids binary, labels binary, vectors binary, codes binary, aligned binary, rest binary"


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """The same random rotation in every task: orthogonal, from a generator seeded by the size."""
    turned, corner = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return turned * np.sign(np.diag(corner))


def _words(size: int) -> int:
    return max(1, -(-size // 64))


class Codes:
    """One-bit codes of rotated vectors, in layers, with what is needed to bound inner products.

    A layer keeps the signs of what the layers before have left of the rotated vector; its code vector is
    those signs divided by the root of the size, and its alignment is the inner product of the rest with
    that unit vector. Taking the aligned part away leaves a rest at right angles to it, so the vector is
    the sum of aligned code vectors and a last rest whose length is kept.
    """

    def __init__(self, vectors: np.ndarray, layers: int = LAYERS) -> None:
        size = vectors.shape[1]
        rest = vectors @ rotation(size) if size else vectors.astype(float)
        root, words = np.sqrt(max(size, 1)), _words(size)
        self.bits = np.zeros((layers, len(vectors), words), "<u8")
        self.aligned = np.zeros((layers, len(vectors)))
        for layer in range(layers):
            up = rest >= 0
            self.aligned[layer] = np.abs(rest).sum(1) / root
            rest = rest - np.where(up, 1.0, -1.0) * (self.aligned[layer] / root)[:, None]
            packed = np.zeros((len(vectors), words * 8), np.uint8)
            packed[:, : -(-size // 8)] = np.packbits(up, axis=1, bitorder="little")
            self.bits[layer] = packed.view("<u8")
        self.rest = np.sqrt((rest**2).sum(1))


class Anchors:
    """Bit planes of rotated anchors: each component as a whole number of steps above the anchor's least."""

    def __init__(self, vectors: np.ndarray, planes: int = PLANES) -> None:
        turned = vectors @ rotation(vectors.shape[1]) if vectors.shape[1] else vectors.astype(float)
        self.size = vectors.shape[1]
        self.low = turned.min(1, initial=0.0)
        self.step = np.maximum((turned.max(1, initial=0.0) - self.low) / ((1 << planes) - 1), 1e-300)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = steps.sum(1)
        # By Cauchy-Schwarz: what the steps miss of the anchor, against any vector, and the anchor against any rest.
        self.missed = np.sqrt(((turned - self.low[:, None] - steps * self.step[:, None]) ** 2).sum(1))
        self.length = np.sqrt((turned**2).sum(1))
        words = _words(self.size)
        self.planes = []
        for plane in range(planes):
            packed = np.zeros((len(vectors), words * 8), np.uint8)
            packed[:, : -(-self.size // 8)] = np.packbits((steps >> plane & 1).astype(bool), axis=1, bitorder="little")
            self.planes.append(packed.view("<u8"))

    def interval(self, k: int, bits: np.ndarray, aligned: np.ndarray, rest: np.ndarray, lengths: np.ndarray):
        """Bounds of the inner products of anchor ``k`` with coded rows; never wrong, only wide.

        For signs s and steps u: sum(s * u) = 2 * (u over set bits) - sum(u), and the sum over set bits is
        the popcount of code AND plane, weighted by the plane.
        """
        root = np.sqrt(max(self.size, 1))
        guess = np.zeros(len(rest))
        for layer in range(len(bits)):
            ones = np.zeros(len(rest), np.int64)
            for plane, own in enumerate(self.planes):
                ones += np.bitwise_count(bits[layer] & own[k]).sum(1, dtype=np.int64) << plane
            signs = 2 * np.bitwise_count(bits[layer]).sum(1, dtype=np.int64) - self.size
            guess += aligned[layer] * (self.low[k] * signs + self.step[k] * (2 * ones - self.total[k])) / root
        # The coded part is at most a vector's length and its rest together.
        width = self.length[k] * rest + self.missed[k] * (lengths + rest)
        width += _SLACK * (1 + self.length[k] * lengths)
        return guess - width, guess + width


class Block:
    """One row of the coded table, as arrays."""

    def __init__(self, size: int, ids: bytes, labels: bytes, vectors: bytes, codes: bytes, aligned: bytes, rest: bytes) -> None:
        self.size = size
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        n = len(self.ids)
        self.vectors = np.frombuffer(vectors, "<i4").reshape(n, size).astype(np.int64)
        words = _words(size)
        self.aligned = np.frombuffer(aligned, "<f8").reshape(-1, n)
        self.bits = np.frombuffer(codes, "<u8").reshape(len(self.aligned), n, words)
        self.rest = np.frombuffer(rest, "<f8")
        self.lengths = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles do for numbers they hold exactly."""
        if self.size * self.largest * int(np.abs(anchor).max(initial=0)) < 1 << 53:
            return (self.vectors[rows].astype(float) @ anchor.astype(float)).astype(np.int64)
        return (self.vectors[rows] * anchor).sum(1)


def coded_blocks(items: DataFrame, id_col: str, vector_col: str, label: str = "label") -> DataFrame:
    """Every row that takes part, in blocks of one vector size: integer vectors and their codes, written once."""
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) * SCALE < LARGEST))  # NaN and infinity are larger
    rows = items.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(rows: list[tuple]) -> tuple:
            ids, labels, vectors = zip(*rows, strict=True)
            whole = np.floor(SCALE * np.array(vectors, float).reshape(len(ids), -1)).astype("<i4")
            codes = Codes(whole.astype(float))
            return (
                whole.shape[1], np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), whole.tobytes(),
                codes.bits.tobytes(), codes.aligned.astype("<f8").tobytes(), codes.rest.astype("<f8").tobytes(),
            )

        def rows():
            for row in rows_of(batches, "id", "label", "vector"):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) >= BLOCK_ROWS:
                    yield block(held.pop(len(row[2])))
                elif len(held) > 64:  # many sizes: the fullest goes first
                    yield block(held.pop(max(held, key=lambda k: len(held[k]))))
            for own in held.values():
                yield block(own)

        return in_batches(rows(), BLOCKS, 1)

    return persist_table(rows.mapInArrow(run, _BLOCKS), "coded")


def _anchors(blocks: DataFrame, every: int) -> DataFrame:
    """(size, id, label, vector bytes) of rows whose id is divisible by ``every``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("size", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

        def rows():
            for size, ids, labels, vectors in rows_of(batches, "size", "ids", "labels", "vectors"):
                numbers, kinds = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                for at in np.flatnonzero(numbers % every == 0).tolist():
                    yield size, int(numbers[at]), int(kinds[at]), vectors[4 * size * at : 4 * size * (at + 1)]

        return in_batches(rows(), schema)

    return blocks.select("size", "ids", "labels", "vectors").mapInArrow(run, "size int, id bigint, label bigint, vector binary")


def _in_anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Rows (size, lane, anchors): about ``ANCHOR_BLOCK`` anchors of one size each, fewer where vectors are long."""
    total, longest = anchors.agg(F.count("*"), F.max("size")).first()
    share = max(1, min(ANCHOR_BLOCK, ANCHOR_BLOCK_BYTES // (4 * max(longest or 0, 1))))
    lanes = -(-total // share)
    dealt = anchors.withColumn("lane", F.expr(f"pmod(xxhash64(id, label, vector), {max(lanes, 1)}L)"))
    fields = [c for c in anchors.columns if c != "size"]
    packed = dealt.groupBy("size", "lane").agg(F.collect_list(F.struct(*fields)).alias("anchors"))
    return persist_table(packed, "anchors")


def _meet(blocks: DataFrame, anchor_blocks: DataFrame, work, result: str, schema: pa.Schema) -> DataFrame:
    """Every block of rows against every block of anchors of its size.

    Anchor blocks go to the executors a bounded number at a time, ``BLOCKS_AT_ONCE``, in a join by size
    and lane; rows stay where they are. Each pass reads all rows once, and results are united.
    """
    lanes = anchor_blocks.agg(F.max("lane")).first()[0]
    out = None
    for start in range(0, (lanes if lanes is not None else -1) + 1, BLOCKS_AT_ONCE):
        stop = min(start + BLOCKS_AT_ONCE, lanes + 1)
        some = anchor_blocks.filter(f"lane >= {start} AND lane < {stop}")
        spread = blocks.withColumn("lane", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(stop - 1).cast("bigint"))))
        part = spread.join(F.broadcast(some), ["size", "lane"]).mapInArrow(work, result)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else blocks.sparkSession.createDataFrame([], result)


_FIELDS = ("size", "ids", "labels", "vectors", "codes", "aligned", "rest")


def _pairs_of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Block, list[dict], Anchors, np.ndarray]]:
    for *row, anchors in rows_of(batches, *_FIELDS, "anchors"):
        block = Block(*row)
        vectors = np.array([np.frombuffer(a["vector"], "<i4") for a in anchors]).reshape(len(anchors), block.size).astype(np.int64)
        yield block, anchors, Anchors(vectors.astype(float)), vectors


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, highest first, then by id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def positives(blocks: DataFrame, anchor_blocks: DataFrame, k: int) -> DataFrame:
    """(anchor, label, vector, size, copies, positive, score, place): the first ``k`` other rows of the anchor's label."""
    schema = pa.schema(
        [
            ("size", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("copies", pa.int64()),
            ("positive", pa.int64()), ("score", pa.int64()),
        ]
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block, anchors, planes, vectors in _pairs_of_blocks(batches):
                for a, anchor in enumerate(anchors):
                    own = np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["id"]))
                    if len(own) > k:
                        low, high = planes.interval(a, block.bits[:, own], block.aligned[:, own], block.rest[own], block.lengths[own])
                        own = own[high >= np.partition(low, len(low) - k)[len(low) - k]]
                    scores = block.scores(own, vectors[a])
                    for at in _best(scores, block.ids[own], k).tolist():
                        yield (
                            block.size, anchor["id"], anchor["label"], anchor["vector"], anchor["copies"],
                            int(block.ids[own[at]]), int(scores[at]),
                        )

        return in_batches(rows(), schema)

    found = _meet(
        blocks, anchor_blocks, work, "size int, id bigint, label bigint, vector binary, copies bigint, positive bigint, score bigint", schema
    )
    order = Window.partitionBy("size", "id", "label", "vector").orderBy(F.desc("score"), "positive")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    items: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 100,
    k: int = 5,
    share: int = 80,
) -> DataFrame:
    """For each anchor and each of its positives, the first ``k`` rows of other labels that score nearly as high.

    Components become ``floor(256 * x)``; a score is an integer inner product; higher scores come first, ties
    by smaller id. Anchors are the rows whose id is divisible by ``every``; positives are the first ``k`` rows
    with another id and the anchor's label; negatives have another label and
    ``share * positive <= 100 * negative <= 100 * positive`` in scores.

    Every row is coded once into rotated one-bit codes (:class:`Codes`) and the codes are written with the
    integer vectors. Two passes hold all rows against all anchors, block by block: popcounts of codes and
    the anchor's bit planes estimate each inner product, and the Cauchy-Schwarz bound on what codes and
    planes leave out makes an interval that cannot be wrong. Rows whose interval cannot reach the first
    ``k`` (first pass) or cannot meet the range of any positive (second pass) are left out, all others get
    their integer score. So the result is exact: recall is 1. At most ``k`` rows of a block remain for
    each anchor and positive, and the rest is a rank.

    One row per anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. Rows with a null id, label or vector, with a null or non-finite
    component, or with one of 2^18 or more in absolute value take no part. Vectors of different lengths
    have no score together. Repeated anchors repeat their rows; a repeated row is a positive or negative
    as often as it occurs. An anchor without positives, or with negative scores only, has no rows. An empty
    table gives no rows; further columns are ignored.
    """
    blocks = coded_blocks(items, id_col, vector_col, label_col)
    # A repeated anchor is asked once and its rows are repeated at the end.
    anchors = _anchors(blocks, every).groupBy("size", "id", "label", "vector").agg(F.count("*").alias("copies"))
    anchor_blocks = _in_anchor_blocks(anchors)
    ranged = positives(blocks, anchor_blocks, k).withColumn("positives", F.struct("place", "positive", "score"))
    asked = ranged.groupBy("size", "id", "label", "vector", "copies").agg(F.sort_array(F.collect_list("positives")).alias("positives"))
    asked = persist_table(asked, "positives")
    asking = _in_anchor_blocks(asked)
    schema = pa.schema(
        [
            ("id", pa.int64()), ("vector", pa.binary()), ("copies", pa.int64()), ("label", pa.int64()), ("place", pa.int32()),
            ("positive", pa.int64()), ("positive_score", pa.int64()), ("negative", pa.int64()), ("score", pa.int64()),
        ]
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block, anchors, planes, vectors in _pairs_of_blocks(batches):
                for a, anchor in enumerate(anchors):
                    tops = [p["score"] for p in anchor["positives"]]
                    least, most = min(tops), max(tops)
                    if most < 0:
                        continue
                    own = np.flatnonzero(block.labels != anchor["label"])
                    low, high = planes.interval(a, block.bits[:, own], block.aligned[:, own], block.rest[own], block.lengths[own])
                    own = own[(high >= share * max(least, 0) / 100) & (low <= most)]
                    scores = block.scores(own, vectors[a])
                    for p in anchor["positives"]:
                        fit = np.flatnonzero((100 * scores >= share * p["score"]) & (scores <= p["score"]))
                        for at in fit[_best(scores[fit], block.ids[own[fit]], k)].tolist():
                            yield (
                                anchor["id"], anchor["vector"], anchor["copies"], anchor["label"], p["place"],
                                p["positive"], p["score"], int(block.ids[own[at]]), int(scores[at]),
                            )

        return in_batches(rows(), schema)

    found = _meet(
        blocks, asking, work,
        "id bigint, vector binary, copies bigint, label bigint, place int, positive bigint, positive_score bigint, "
        "negative bigint, score bigint", schema,
    )
    order = Window.partitionBy("id", "label", "vector", "place").orderBy(F.desc("score"), "negative")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = F.explode(F.expr("sequence(1L, copies)"))
    return ranked.withColumn("copy", each).select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
