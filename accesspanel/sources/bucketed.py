"""Tables stored by the key they are joined on: rows of one key lie in one bucket file, so
joins and groupings on the key need no exchange. The layout is kept beside the files, so a
later session can register the table again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesspanel.sources import versions
from accesspanel.sources.tables import layer_path

LAYOUT = "LAYOUT"


def _name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def write_bucketed(
    df: DataFrame, root: str, layer: str, name: str, key: str, buckets: int, aligned: bool = False
) -> DataFrame:
    """Replaces a table, stored in ``buckets`` files by ``key`` and sorted by it, as a new
    version; returns it as a table Spark knows the layout of. ``aligned`` says that the frame
    already comes from tables of this key and number of buckets, so nothing is moved."""
    spark, path = df.sparkSession, layer_path(root, layer, name)
    version = versions.new_name()
    folder = versions.version_folder(path, version)
    dealt = df if aligned else df.repartition(buckets, key)
    table = _name()
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(table)
    layout = {"key": key, "buckets": buckets, "schema": json.loads(df.schema.json())}
    versions.write_text(spark, f"{folder}/_{LAYOUT}", json.dumps(layout))
    versions.publish(spark, path, version)
    return spark.table(table)


def read_bucketed(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """The current version, registered with its layout, in any session."""
    folder = versions.current_path(spark, layer_path(root, layer, name))
    layout = json.loads(versions.read_text(spark, f"{folder}/_{LAYOUT}"))
    table, key = _name(), "`" + layout["key"].replace("`", "``") + "`"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]).fields)
    place = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
        f"INTO {layout['buckets']} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)


def colocated_join(left: DataFrame, right: DataFrame, key: str, others: Sequence[str] = ()) -> DataFrame:
    """Left join on ``key`` and ``others`` (integers) of two tables stored by ``key``. The
    others are compared within the rows of a key, of which there are few (years, say), so
    that the buckets serve the join as they are; a NULL matches nothing."""
    names = {c: f"_right_{c}" for c in (key, *others)}
    named = right.withColumnsRenamed(names)
    same = F.col(key) == F.col(names[key])
    for c in others:
        same = same & ((F.col(c) - F.col(names[c])) == 0)
    return left.join(named, same, "left").drop(*names.values())
