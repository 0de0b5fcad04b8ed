"""Merkle manifest of a dataset as a postorder append log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import in_batches, rows_of
from barloom.session import persist_table

WAYS = 16
#: Levels that one builder closes: an aligned block of WAYS ** LEVELS nodes below one node.
LEVELS = 2
BLOCK = WAYS**LEVELS
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Postorder addresses ------------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WAYS), levels + 1
    return levels


def address(level: int, index: int, n: int, levels: int) -> int:
    """Place in the log, from 0, of node ``index`` of ``level`` in a tree of ``n`` leaves and ``levels`` levels.

    A node is written once its last leaf is, so what stands before it is every leaf up to its end, the
    nodes up to its own level that end there or earlier, and the higher ones that ended before it began.
    """
    start = index * WAYS**level
    end = min(start + WAYS**level, n)
    at = end - 1
    for k in range(1, levels + 1):
        width = WAYS**k
        at += -(-end // width) if k <= level else start // width
    return at


def address_column(level: int, index: Column, n: Column, levels: int) -> Column:
    """:func:`address` as an expression; ``levels`` may be more than a tree has, only its own count."""

    def whole(value: Column, width: int) -> Column:
        return F.call_function("div", value, F.lit(width).cast("bigint"))

    start = index * F.lit(WAYS**level).cast("bigint")
    end = F.least(start + F.lit(WAYS**level).cast("bigint"), n)
    at = end - 1
    for k in range(1, levels + 1):
        term = whole(end + (WAYS**k - 1), WAYS**k) if k <= level else whole(start, WAYS**k)
        at += F.when(n > F.lit(WAYS ** (k - 1)).cast("bigint"), term).otherwise(0)
    return at


def append_log(leaves: list[str], levels: int) -> list[str]:
    """Nodes of one aligned block in the order in which they are complete."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels)]

    def add(level: int, node: str) -> None:
        log.append(node)
        if level < levels:
            open_runs[level].append(node)
            if len(open_runs[level]) == WAYS:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        add(level + 1, sha("".join(run)))

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: str, index: int, n: int, levels: int) -> list[tuple[str, str]]:
    """For each level below the block's top: digests left and right of the node above leaf ``index``."""
    out = []
    for level in range(levels):
        here = index // WAYS**level
        count = -(-n // WAYS**level)
        first = here - here % WAYS
        places = [address(level, i, n, levels) for i in range(first, min(first + WAYS, count))]
        run = [log[_HEX * p : _HEX * p + _HEX] for p in places]
        out.append(("".join(run[: here - first]), "".join(run[here - first + 1 :])))
    return out


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    for left, right in path:
        node = sha(left + node + right)
    return node


# Order ---------------------------------------------------------------------------------------------


def placed_in_trees(leaves: DataFrame, label: str) -> DataFrame:
    """Adds ``index`` (from 0 in its tree, by ``key``, then ``leaf``) and ``n`` (leaves of the tree).

    Rows are dealt by ranges of (tree, key, leaf, number), so a hot tree, key or repeated row lies in many
    partitions; one count for each tree in a partition gives the offsets. Two integers of a partition and
    tree are joined back, no list of rows.
    """
    order = ["tree", F.col("key").asc_nulls_first(), "leaf", "number"]
    spread = leaves.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = persist_table(
        spread.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).drop("number"), label
    )
    counts = dealt.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("c"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(of_tree).alias("n")
    )
    return dealt.join(offsets, ["tree", "part"]).withColumn("index", F.col("row") + F.col("shift")).drop("row", "shift", "part")


# Building ------------------------------------------------------------------------------------------


def _with_logs(packed: DataFrame) -> DataFrame:
    """Replaces ``leaves`` by the block's part of the log; other columns pass as they are."""
    kept = [f for f in packed.schema.fields if f.name != "leaves"]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {name: batch.column(batch.schema.get_field_index(name)) for name in [*names, "leaves"]}
            logs = [
                "".join(append_log(leaves, min(LEVELS, height(n))))
                for leaves, n in zip(of["leaves"].to_pylist(), of["n"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(of[n] for n in names), pa.array(logs, pa.string())], [*names, "log"])

    return packed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", log string")


_TOP = f"right(log, {_HEX})"


def build(placed: DataFrame, label: str, extra: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks of all trees over (tree, index, n, leaf), one written table for each round, lowest first.

    A builder takes one aligned block of at most ``BLOCK`` neighbouring nodes and writes its part of the
    log; the last node of each part is a leaf of the next round, until every tree has a single block.
    The number of rounds is the logarithm of the longest tree; only whether there is another round
    reaches the driver. Columns ``extra`` of the leaves are kept beside the lowest logs, in leaf order.
    """
    rounds = []
    while True:
        items = F.sort_array(F.collect_list(F.struct("index", "leaf", *extra)))  # one aligned block: BLOCK at most
        packed = placed.groupBy("tree", F.expr(f"index div {BLOCK}").alias("block"), "n").agg(items.alias("items"))
        packed = packed.select(
            "tree", "block", "n", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.col("items.leaf").alias("leaves"),
            *[F.col(f"items.{name}").alias(name) for name in extra],
        )
        rounds.append(persist_table(_with_logs(packed), f"{label}-log"))
        extra = ()
        placed = rounds[-1].filter("blocks > 1").select(
            "tree", F.col("block").alias("index"), F.col("blocks").alias("n"), F.expr(_TOP).alias("leaf")
        )
        if placed.isEmpty():
            return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top): the node that is left of each tree."""
    each = [blocks.filter("blocks = 1").select("tree", F.expr(_TOP).alias("top")) for blocks in rounds]
    for more in each[1:]:
        each[0] = each[0].union(more)
    return each[0]


# Proofs --------------------------------------------------------------------------------------------

_SIDES = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "array<struct<left:string,right:string>>"
_ABOVE = ("path", "subroot", "root")


def _member_paths(blocks: DataFrame) -> DataFrame:
    """(tree, unit, path, subroot, root) of every node directly under blocks that have these three."""
    schema = pa.schema([("tree", pa.string()), ("unit", pa.int64()), ("path", pa.list_(_SIDES)), ("subroot", pa.string()), ("root", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for tree, block, n, log, path, *heads in rows_of(batches, "tree", "block", "n", "log", *_ABOVE):
                own, levels = min(BLOCK, n - block * BLOCK), min(LEVELS, height(n))
                for index in range(own):
                    inner = [{"left": a, "right": b} for a, b in siblings(log, index, own, levels)]
                    yield tree, block * BLOCK + index, inner + path, *heads

        return in_batches(rows(), schema, 256)

    return blocks.mapInArrow(run, f"tree string, unit bigint, path {_PATH}, subroot string, root string")


def lowest_blocks(rounds: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """Lowest blocks of all trees with the path from each block's top to the root, top-down by rounds.

    ``above`` has (tree, path, subroot, root) for the tops of the trees. Every join is between one row of a
    block and one row of the node that it is.
    """
    under = None
    for blocks in reversed(rounds):
        placed = blocks.filter("blocks = 1").join(above, "tree")
        if under is not None:
            placed = placed.unionByName(blocks.filter("blocks > 1").join(under.withColumnRenamed("unit", "block"), ["tree", "block"]))
        if blocks is not rounds[0]:
            under = persist_table(_member_paths(placed.select("tree", "block", "n", "log", *_ABOVE)), f"{label}-paths")
    return placed


def _proofs(blocks: DataFrame, key_type: str, with_proof: bool) -> DataFrame:
    """One row for each leaf of the blocks: its proof, and the fold of its changed form, or else of itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key"))
            rows = rows_of([batch], "tree", "block", "n", "log", "changed", *_ABOVE)
            for k, (tree, block, n, log, changed, path, subroot, root) in enumerate(rows):
                levels, own = min(LEVELS, height(n)), len(changed)
                above = [(p["left"], p["right"]) for p in path]
                beyond = "".join(left + right for left, right in above)
                folded: dict[str, str] = {}  # of tops of this block; unchanged leaves all lead to the same one
                leaves, places, proofs, digests, ends = [], [], [], [], []
                for index, other in enumerate(changed):
                    inner = siblings(log, index, own, levels)
                    place = address(0, index, own, levels) * _HEX
                    leaf = log[place : place + _HEX]
                    proof = "".join(left + right for left, right in inner) + beyond
                    top = fold(leaf if other is None else other, inner)
                    if top not in folded:
                        folded[top] = fold(top, above)
                    leaves.append(leaf)
                    places.append(block * BLOCK + index)
                    proofs.append(proof if with_proof else None)
                    digests.append(sha(proof))
                    ends.append(folded[top])
                text = pa.string()
                yield pa.RecordBatch.from_arrays(
                    [
                        keys[k].values, pa.array([tree] * own, text), pa.array(leaves, text), pa.array(places, pa.int64()),
                        pa.array([n] * own, pa.int64()), pa.array([subroot] * own, text), pa.array([root] * own, text),
                        pa.array(proofs, text), pa.array(digests, text), pa.array(ends, text),
                    ],
                    ["key", "tree", "leaf", "leaf_index", "n", "subroot", "root", "proof", "proof_sha256", "folded_root"],
                )

    return blocks.mapInArrow(
        run,
        f"key {key_type}, tree string, leaf string, leaf_index bigint, n bigint, subroot string, root string, "
        "proof string, proof_sha256 string, folded_root string",
    )


# The manifest of a table ----------------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value: joined without separators, still one-to-one."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def manifest(
    rows: DataFrame,
    columns: tuple[str, ...],
    key: str = "doc_id",
    tree: str = "source",
    altered: dict[str, Column] | None = None,
    when: Column | None = None,
    with_proof: bool = True,
) -> DataFrame:
    """Leaf, subroot, root and inclusion proof of every row.

    A leaf is the SHA-256 of the row's ``columns``. Leaves of one ``tree`` value ascend by ``key`` (nulls
    first, ties by digest); runs of ``WAYS`` become the digest of their hex texts, level by level, until
    one is left: the subroot. Subroots in the order of their tree value (null first, then by UTF-8 bytes)
    give the root in the same way.

    Nodes are kept as an append log in completion order. Builders own aligned blocks of ``BLOCK`` leaves and
    write their part by themselves; where a node stands follows from the sizes of the subtrees before it
    (:func:`address`), and proofs read siblings at those places. Blocks above are built from the last
    nodes of the parts below, and paths travel down the same way, so no task sees more than one block
    and no tree passes through one task.

    ``altered`` replaces columns of the rows for which ``when`` is true in a second leaf, as if the data
    had changed after the manifest was made. The fold of that leaf with the original siblings is
    ``folded_root``; without alteration it is the fold of the leaf itself.

    One row per input row: ``key``, ``tree`` (null for null), ``leaf``, ``leaf_index`` and ``log_position`` (in
    its tree), ``subroot``, ``root``, ``proof`` (sibling digests from leaf to root, left to right; null without
    ``with_proof``), ``proof_sha256``, ``folded_root``, ``verified``. Equal rows have leaves of their own; null
    and empty values differ. An empty table gives no rows; further columns are ignored.
    """
    leaf = leaf_digest(F.col(f"`{c}`") for c in columns)
    other = leaf_digest((altered or {}).get(c, F.col(f"`{c}`")) for c in columns)
    changed = F.when(when, other) if when is not None else F.lit(None).cast("string")
    # A letter in front keeps null apart from, and before, every other value.
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    leaves = rows.select(name.alias("tree"), F.col(f"`{key}`").alias("key"), leaf.alias("leaf"), changed.alias("changed"))
    documents = build(placed_in_trees(persist_table(leaves, "merkle-leaves"), "merkle-order"), "merkle", ("key", "changed"))

    subroots = tops(documents).select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("leaf"))
    ordered = persist_table(placed_in_trees(persist_table(subroots, "merkle-tops"), "merkle-sources"), "merkle-placed")
    sources = build(ordered, "merkle-root")
    nothing = F.array().cast(_PATH)
    root = tops(sources).select("tree", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("top").alias("root"))
    paths = _member_paths(lowest_blocks(sources, root, "merkle-root")).withColumnRenamed("unit", "index").select("index", "path", "root")
    above = ordered.join(paths, "index").select(F.col("key").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")

    blocks = lowest_blocks(documents, persist_table(above, "merkle-above"), "merkle")
    done = _proofs(blocks, leaves.schema["key"].dataType.simpleString(), with_proof)
    return done.select(
        F.col("key").alias(key), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("tree"), "leaf", "leaf_index",
        address_column(0, F.col("leaf_index"), F.col("n"), 12).alias("log_position"), "subroot", "root", "proof", "proof_sha256",
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
