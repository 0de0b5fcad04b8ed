"""File inventories, manifests and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Relative path, folder, length and SHA-256 of every file below ``root``.

    Whole files are read by the tasks that hash them; a file must be under the
    2 GB limit of the binary source.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    prefix = root.rstrip("/") + "/"
    path = F.substring_index("path", prefix, -1)
    return files.select(
        path.alias("path"),
        F.regexp_replace(path, r"/?[^/]*$", "").alias("folder"),
        F.col("length").alias("length"),
        F.sha2("content", 256).alias("sha256"),
    )


def row_files(rows: DataFrame, folder, path, content) -> DataFrame:
    """Rows as files of a tree: folder, path, length in bytes and SHA-256 of the content; null content is empty."""
    body = F.coalesce(content.cast("binary"), F.lit(b""))
    return rows.select(
        folder.cast("string").alias("folder"), path.cast("string").alias("path"), F.octet_length(body).cast("bigint").alias("length"),
        F.sha2(body, 256).alias("sha256"),
    )


def digest_tree(files: DataFrame, per_bucket: int = 256, depth: int = 8) -> DataFrame:
    """Digest of every folder over its (path, hash) pairs, built from the leaves of a hash trie.

    A file belongs to the bucket named by the first hex digits of its path's hash; a folder takes as many
    digits as it needs for about ``per_bucket`` files in a bucket. A bucket's digest is the SHA-256 of its
    sorted ``path:hash`` lines, and digests of up to sixteen neighbours are joined and hashed again, one
    digit less each time, until the folder's is left. So no task holds more than a bucket or sixteen
    digests, a changed file changes the digests on one path only, and the result depends on nothing
    but the pairs. Repeated paths count as often as they occur. Columns: folder, files, bytes, fingerprint.
    """
    sizes = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    digits = F.lit(0)
    for k in range(1, depth + 1):
        digits += F.when(F.col("files") > per_bucket * 16 ** (k - 1), 1).otherwise(0)
    # One join row per folder.
    placed = files.join(sizes.select("folder", digits.alias("digits")), "folder")
    line = F.concat_ws(":", "path", "sha256")
    nodes = (
        placed.groupBy("folder", "digits", F.expr("left(sha2(path, 256), digits)").alias("node"))
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        .select("folder", F.col("digits").alias("level"), "node", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))
    )
    for level in range(depth, 0, -1):
        ready = nodes.where(F.col("level") == level)
        joined = ready.groupBy("folder", F.expr(f"left(node, {level - 1})").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("runs")
        )
        above = joined.select("folder", F.lit(level - 1).alias("level"), "node", F.sha2(F.array_join("runs.digest", ""), 256).alias("digest"))
        nodes = nodes.where(F.col("level") < level).unionByName(above)
    return sizes.join(nodes.select("folder", F.col("digest").alias("fingerprint")), "folder")


def reconcile(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every declared or present (folder, path) with its state.

    ``ok``, ``changed`` (another hash), ``missing`` (declared, not present), ``extra`` (present in a folder
    that has a manifest, not declared) or ``unavailable`` (present in a folder without any). A path declared or
    present more than once is ``ambiguous``.
    """
    wanted = manifest.groupBy("folder", "path").agg(F.count(F.lit(1)).alias("_w"), F.min("sha256").alias("_want"))
    there = inventory.groupBy("folder", "path").agg(F.count(F.lit(1)).alias("_h"), F.min("sha256").alias("_have"))
    declared = manifest.select("folder").distinct().withColumn("_declared", F.lit(True))
    state = (
        F.when((F.col("_w") > 1) | (F.col("_h") > 1), "ambiguous")
        .when(F.col("_h").isNull(), "missing")
        .when(F.col("_w").isNull() & F.col("_declared").isNull(), "unavailable")
        .when(F.col("_w").isNull(), "extra")
        .when(F.col("_want") == F.col("_have"), "ok")
        .otherwise("changed")
    )
    both = wanted.join(there, ["folder", "path"], "full_outer").join(declared, "folder", "left")
    return both.select("folder", "path", state.alias("state"))


def manifest_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per folder: counts of each state and one status.

    ``degraded`` if a file is changed, extra or ambiguous, ``partial`` if files are only missing, ``ok`` if all
    match, ``unavailable`` without a manifest.
    """
    states = ("ok", "changed", "missing", "extra", "ambiguous", "unavailable")
    counts = [F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states]
    per = reconcile(manifest, inventory).groupBy("folder").agg(*counts)
    bad = F.col("n_changed") + F.col("n_extra") + F.col("n_ambiguous")
    status = F.when(F.col("n_unavailable") > 0, "unavailable").when(bad > 0, "degraded").when(F.col("n_missing") > 0, "partial").otherwise("ok")
    return per.withColumn("status", status)


def verified(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """The declared files, or a failed job: any state but ``ok`` raises, naming folder, path and state.

    The check is part of the plan of what is returned, so nothing can be read without it.
    """
    said = F.concat_ws(" ", F.lit("manifest violated:"), "folder", "path", "state")
    checked = reconcile(manifest, inventory).withColumn("state", F.when(F.col("state") == "ok", "ok").otherwise(F.raise_error(said)))
    return checked.where("state = 'ok'").select("folder", "path")
