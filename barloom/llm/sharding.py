"""K-d tree shards: recursive splits at weighted medians of the widest metadata dimension."""

from __future__ import annotations
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.llm.common import let
from barloom.session import persist_table

BUCKETS = 512
ROWS_PER_SLOT_BUCKET = 1 << 16



@dataclass
class Split:
    """Rows of ``node`` at or below ``key`` go left (node ``2 n``), the rest right (``2 n + 1``)."""

    node: int
    dimension: str
    key: tuple[int, ...]


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang"):
    """One narrow row per document: sizes, checksum and the dimensions of the tree, as integers.

    Missing columns and nulls become 0 in their dimension.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))

    def number(name: str) -> Column:
        if name not in docs.columns:
            return F.lit(0).cast("bigint")
        return F.when(F.col(f"`{name}`").isNull(), F.lit(0)).otherwise(F.crc32(F.col(f"`{name}`").cast("string"))).cast("bigint")

    def of_text(t: Column) -> Column:
        return F.struct(
            (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t).cast("bigint").alias("text_crc32")
        )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        number(source_col).alias("d_source"),
        number(lang_col).alias("d_lang"),
        F.inline(F.array(let(text, of_text))),
    )
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", "d_source", "d_lang",
        (F.log2("size") * 1_000_000).cast("bigint").alias("d_size"),
        F.coalesce("id", F.lit(0)).cast("bigint").alias("d_id"),
    )


DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


def _written_out(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows as one literal of the plan, at most one per shard, without a Python source."""
    names = [c.split()[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{columns.replace(' ', ':').replace(',:', ',')}>>")))


def _at(rows: DataFrame, splits: list[list[Split]]) -> DataFrame:
    """``node`` of each row: one lookup a level in the splits of that level, at most one row per shard."""
    spark = rows.sparkSession
    out = rows.withColumn("node", F.lit(1).cast("bigint"))
    for level in splits:
        if not level:
            continue
        names = sorted({s.dimension for s in level})
        table = _written_out(
            spark, [(s.node, names.index(s.dimension), *s.key) for s in level], "s_node bigint, s_dim int, s0 bigint, s1 bigint, s2 bigint"
        )
        value = F.coalesce(*[F.when(F.col("s_dim") == k, F.col(n)) for k, n in enumerate(names)])
        own = F.struct(value.alias("a"), F.col("text_crc32").alias("b"), F.col("d_id").alias("c"))
        cut = F.struct(F.col("s0").alias("a"), F.col("s1").alias("b"), F.col("s2").alias("c"))
        step = F.when(F.col("s_node").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(own <= cut, 0).otherwise(1))
        out = out.join(F.broadcast(table), F.col("node") == F.col("s_node"), "left").select(*rows.columns, step.alias("node"))
    return out


def _cuts(rows: DataFrame, wanted: dict[int, tuple[str, float]], slack: int) -> dict[int, tuple[int, ...]]:
    """For each node its weighted quantile in the order (dimension, checksum, id), by narrowing histograms.

    Each pass counts bytes in ``BUCKETS`` ranges of the value still in
    question and goes on inside the range that holds the quantile; when one
    value is left, its rows are told apart by the next value in the order. All nodes
    of a level share a pass, which is one aggregation with at most nodes times
    ``BUCKETS`` groups. Once the remaining error is below ``slack`` bytes, the
    cut falls between values, which keeps equal texts together.
    """
    parts = {n: [d, "text_crc32", "d_id"] for n, (d, _) in wanted.items()}
    fixed: dict[int, list[int]] = {n: [] for n in wanted}
    target = {n: t for n, (_, t) in wanted.items()}
    bounds: dict[int, tuple[int, int]] = {}
    done: dict[int, tuple[int, ...]] = {}
    most = (1 << 62,)
    while len(done) < len(wanted):
        active = [n for n in wanted if n not in done]
        guide = []
        for n in active:
            lo, hi = bounds.get(n, (None, None))
            step = None if lo is None else (hi - lo) // BUCKETS + 1
            at = [*fixed[n], None, None][:2]
            guide.append((n, DIMENSIONS.index(parts[n][0]), len(fixed[n]), *at, lo, hi, step, float(target[n])))
        table = _written_out(
            rows.sparkSession, guide, "g_node bigint, dim int, depth int, f0 bigint, f1 bigint, lo bigint, hi bigint, step bigint, goal double"
        )
        own = F.coalesce(*[F.when(F.col("dim") == k, F.col(d)) for k, d in enumerate(DIMENSIONS)])
        value = F.when(F.col("depth") == 0, own).when(F.col("depth") == 1, F.col("text_crc32")).otherwise(F.col("d_id"))
        inside = (F.col("f0").isNull() | (own == F.col("f0"))) & (F.col("f1").isNull() | (F.col("text_crc32") == F.col("f1")))
        inside &= F.col("lo").isNull() | value.between(F.col("lo"), F.col("hi"))
        led = rows.join(F.broadcast(table), F.col("node") == F.col("g_node")).filter(inside)
        held = led.select("node", "size", value.alias("v"), F.col("lo").alias("low"), "step", "goal")
        if any(n not in bounds for n in active):
            for r in held.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                bounds.setdefault(r.node, (r.lo, r.hi))
            continue
        counted = held.groupBy("node", "goal", F.floor((F.col("v") - F.col("low")) / F.col("step")).cast("int").alias("bucket")).agg(
            F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        upto = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("upto", F.sum("bytes").over(upto))
        first = summed.withColumn("over", F.col("upto") >= F.col("goal")).filter("over").groupBy("node").agg(
            F.min_by(F.struct("bytes", "lo", "hi", "upto"), "bucket").alias("b")
        )
        for r in first.collect():
            n, b = r.node, r.b
            before = b.upto - b.bytes
            level = len(fixed[n])
            rest = most * (2 - level)
            if b.upto - target[n] <= slack and (b.lo == b.hi or b.bytes <= slack):
                done[n] = (*fixed[n], b.hi, *rest)
            elif target[n] - before <= slack and b.lo > bounds[n][0]:
                done[n] = (*fixed[n], b.lo - 1, *rest)
            elif b.lo < b.hi:
                bounds[n], target[n] = (b.lo, b.hi), target[n] - before
            elif level == 2:
                nearer = b.upto - target[n] <= target[n] - before
                done[n] = (*fixed[n], b.hi if nearer else b.lo - 1)
            else:
                fixed[n], target[n] = [*fixed[n], b.lo], target[n] - before
                bounds.pop(n, None)
    return done


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """Shards of nearly equal bytes as the leaves of a k-d tree over document metadata.

    A node that stands for several shards is split along its widest dimension
    (size on a log scale, source, language, id; width as a share of the whole
    range) at the weighted quantile that gives each side its share of shards;
    leaves hold the target bytes. ``shards`` fixes their number, else it is
    total bytes over ``target_bytes``. A document counts its UTF-8 bytes plus 8.

    Rows of equal place in the split dimension are ordered by the checksum of
    their text and then by id, so equal texts stay together except where a cut
    has to fall among them; a group of copies larger than a shard is cut.
    The driver holds the tree alone: at most one row per shard.

    Columns: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless
    from 0 in each shard). Null texts have no bytes (size 8, checksum 0); null
    ids are ordered as 0; rows equal in all of this cannot be told apart and
    stay in one shard. Empty tables give no rows, missing source or language columns count
    as one value, further columns are ignored.
    """
    table = persist_table(metadata(docs, id_col, text_col, source_col, lang_col), "metadata")
    ranges = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    whole = table.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ranges).first()
    total, count = whole["bytes"] or 0, whole["rows"]
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    spread = {d: max(1, (whole[f"max_{d}"] or 0) - (whole[f"min_{d}"] or 0)) for d in DIMENSIONS}
    slack = total // shards // 500

    leaves = {1: shards}
    splits: list[list[Split]] = []
    while count and any(n > 1 for n in leaves.values()):
        open_ = [k for k, n in leaves.items() if n > 1 and k.bit_length() == len(splits) + 1]
        placed = _at(table, splits).filter(F.col("node").isin(open_))
        wide = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
        wanted = {}
        for k in open_:
            n, left = leaves[k], leaves[k] // 2
            if k in wide:
                r = wide[k]
                d = max(DIMENSIONS, key=lambda d, r=r: ((r[f"max_{d}"] - r[f"min_{d}"]) / spread[d], d == "d_id"))
                wanted[k] = (d, r["bytes"] * left / n)
        cuts = _cuts(placed, wanted, slack)
        splits.append([Split(k, d, cuts[k]) for k, (d, _) in wanted.items()])
        for k in open_:
            n = leaves.pop(k)
            leaves[2 * k], leaves[2 * k + 1] = n // 2, n - n // 2
    order = sorted(leaves, key=lambda k: bin(k)[2:])
    numbers = _written_out(docs.sparkSession, [(k, i) for i, k in enumerate(order)], "leaf bigint, shard int")
    sharded = _at(table, splits).join(F.broadcast(numbers), F.col("node") == F.col("leaf"))
    return _with_slots(sharded.select("doc_id", "size", "text_crc32", "d_id", "shard"), count)


def _with_slots(rows: DataFrame, count: int) -> DataFrame:
    """Gapless positions in each shard: a rank in small buckets plus the rows of earlier buckets."""
    buckets = max(1, -(-count // ROWS_PER_SLOT_BUCKET)) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("d_id", "text_crc32"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("shard", "bucket").orderBy("d_id", "text_crc32")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("before")).cast("bigint").alias("slot")
    )
