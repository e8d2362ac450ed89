"""Reading text files, writing layers, exporting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesspanel.functions.predicates import ends_with_cr
from accesspanel.sources import versions


def _csv_reader(spark: SparkSession, line_sep: str | None):
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("mode", "FAILFAST")
    )
    return reader.option("lineSep", line_sep) if line_sep else reader


def load_raw_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    line_sep: str | None = None,
) -> DataFrame:
    """All-text load of a delimited file with quoted fields. Columns bind by
    position to ``columns``; without it the header gives the names. A row with
    too few or too many fields fails the read. Files split across tasks, so
    line breaks inside quotes are not supported."""
    # Column pruning would skip parsing the unread fields and so hide bad rows.
    reader = _csv_reader(spark, line_sep).option("columnPruning", False)
    if columns is None:
        return reader.option("inferSchema", False).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return reader.schema(schema).csv(path)


def strip_trailing_cr(df: DataFrame, column: str) -> DataFrame:
    """Remove carriage returns left by a line-feed-only split."""
    c = F.col(column)
    return df.withColumn(
        column, F.when(ends_with_cr(c), F.regexp_replace(c, "\r", "")).otherwise(c)
    )


def periods(spark: SparkSession, start: int, end: int, name: str = "period") -> DataFrame:
    """One row per period start..end."""
    return spark.range(start, end + 1).select(F.col("id").cast("int").alias(name))


def layer_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}"


def write_layer(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """Replace ``{root}/{layer}/{name}`` and return it as read back, so that
    everything downstream starts from the written files. ``cluster_by`` orders
    rows inside each file, which tightens the min/max statistics scans prune by.
    Readers see the old table until the new one is complete (:mod:`versions`)."""
    path = layer_path(root, layer, name)
    written, version = versions.stage_version(df, path, partition_by, cluster_by)
    versions.publish(df.sparkSession, path, version)
    return written


def read_layer(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    return spark.read.parquet(versions.current_path(spark, layer_path(root, layer, name)))


def export_csv(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Header CSV. With ``order_by`` the part files are range-partitioned, so
    read in name order they are one total order."""
    out = df.orderBy(*order_by) if order_by else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def staging_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: the session's
    ``spark.checkpoint.dir``. A temporary folder is used only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    # an unset master counts as a cluster, and local-cluster has executors of its own
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    created = tempfile.mkdtemp(prefix="accesspanel-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once to the shared folder and return it as read back:
    everything after it sees the same rows in the same files, and a lost
    executor does not replay what came before."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{staging_root(spark)}/accesspanel/{app}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
