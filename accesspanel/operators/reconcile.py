"""Whole-table comparison of two stored tables by a tree of hashes over key buckets: only
buckets whose hashes differ are read again, and those are compared row by row."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesspanel.sources import versions
from accesspanel.sources.tables import layer_path

BUCKET = "_key_bucket"
#: Children of a node of the tree.
FANOUT = 16
LEAVES = 1024


def _digest(columns: Sequence[str]) -> list[Column]:
    """Count, XOR and sum of row hashes: repeated rows do not cancel out."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])
    return [
        F.count("*").alias("n"),
        F.bit_xor(row).alias("x"),
        F.sum(row.cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"),
    ]


def hash_tree(df: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """Nodes (``level`` from the root at 0, ``node``, ``n``, ``x``, ``s``) over the buckets of a
    stored table; empty buckets have no node."""
    depth, width = 0, 1
    while width < leaves:
        depth, width = depth + 1, width * FANOUT
    columns = [c for c in df.columns if c != BUCKET]
    level = df.groupBy(F.col(BUCKET).cast("bigint").alias("node")).agg(*_digest(columns))
    tree = None
    for k in range(depth, -1, -1):
        rows = level.select(F.lit(k).alias("level"), "node", "n", "x", "s")
        tree = rows if tree is None else tree.unionByName(rows)
        up = F.floor(F.col("node") / FANOUT).cast("bigint").alias("node")
        level = level.groupBy(up).agg(
            F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s")
        )
    return tree


def write_hashed(
    df: DataFrame, root: str, layer: str, name: str, keys: Sequence[str], leaves: int = LEAVES
) -> None:
    """Stores a table in folders by key bucket, with its tree of hashes beside it, as one
    version. A bucket is a few files; ``leaves`` is the same for tables to be compared."""
    spark, path = df.sparkSession, layer_path(root, layer, name)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(leaves)).cast("int")
    dealt = df.withColumn(BUCKET, bucket).repartition(BUCKET)
    written, version = versions.stage_version(dealt, path, partition_by=[BUCKET])
    versions.write_text(spark, f"{versions.version_folder(path, version)}/_schema", written.schema.json())
    hash_tree(written, leaves).coalesce(1).write.parquet(f"{versions.version_folder(path, version)}/_tree")
    versions.publish(spark, path, version)


def read_hashed(spark: SparkSession, root: str, layer: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The table with its bucket column, and its tree."""
    folder = versions.current_path(spark, layer_path(root, layer, name))
    schema = T.StructType.fromJson(json.loads(versions.read_text(spark, f"{folder}/_schema")))
    return spark.read.schema(schema).parquet(folder), spark.read.parquet(f"{folder}/_tree")


def differing_buckets(earlier: DataFrame, later: DataFrame) -> list[int]:
    """Buckets whose hashes differ, found from the root down: below a node that agrees
    nothing is looked at. At most one number per bucket reaches the driver."""
    depth = earlier.unionByName(later).agg(F.max("level")).first()[0]
    if depth is None:
        return []
    open_nodes = [0]
    for level in range(depth + 1):
        here = F.col("level") == level
        if level:
            here = here & F.floor(F.col("node") / FANOUT).isin(open_nodes)
        a = earlier.where(here).select("node", F.struct("n", "x", "s").alias("a"))
        b = later.where(here).select("node", F.struct("n", "x", "s").alias("b"))
        unlike = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        open_nodes = sorted(r["node"] for r in unlike.select("node").collect())
        if not open_nodes:
            return []
    return open_nodes


def reconcile(
    spark: SparkSession, earlier: tuple[str, str, str], later: tuple[str, str, str], keys: Sequence[str]
) -> DataFrame:
    """The keys whose rows differ between two tables stored by :func:`write_hashed` (root,
    layer, name), with ``change``: added, removed or changed. NULL is a key like any other;
    a repeated key is compared with all its rows. Only differing buckets are read."""
    (a, tree_a), (b, tree_b) = read_hashed(spark, *earlier), read_hashed(spark, *later)
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    buckets = differing_buckets(tree_a, tree_b)
    columns = [c for c in a.columns if c != BUCKET]

    def part(df: DataFrame, side: str) -> DataFrame:
        rows = df.where(F.col(BUCKET).isin(buckets)) if buckets else df.limit(0)
        named = [F.col(f"`{k}`").alias(f"{side}{i}") for i, k in enumerate(keys)]
        return rows.groupBy(*named).agg(F.struct(*_digest(columns)).alias(f"{side}_h"))

    left, right = part(a, "a"), part(b, "b")
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
    both = left.join(right, same, "full").where(~F.col("a_h").eqNullSafe(F.col("b_h")))
    gone, new = F.col("b_h").isNull(), F.col("a_h").isNull()
    change = F.when(new, "added").when(gone, "removed").otherwise("changed")
    return both.select(
        *[F.when(new, F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(k) for i, k in enumerate(keys)], change.alias("change")
    )
