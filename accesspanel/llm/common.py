"""Helpers shared by the operators: typed inputs, bounded samples, global ranks
and connected components. Every intermediate table goes to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesspanel.sources import tables

#: Bytes of text a worker handles at once, whatever the Arrow batch holds.
SLICE_BYTES = 2 << 20


T = TypeVar("T")
_HELD: dict = {}


def held(key: object, make: Callable[[], T]) -> T:
    """State that a Python worker keeps from task to task: tables, caches of words. A worker
    holds one at a time; what another operator left in a reused worker is given up first,
    and its memory handed back."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        _HELD[key] = make()
    return _HELD[key]


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they need
    not share the driver's import path."""
    context = spark.sparkContext
    if getattr(context, "_accesspanel_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        folder = tempfile.mkdtemp(prefix="run-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/accesspanel-package", "zip", package.parent, package.name))
    context._accesspanel_shipped = True


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the frame to the shared folder and returns it as read back. The
    shuffle files behind it are not needed any more and are given up at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return tables.materialize(df, label)
    finally:
        conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Removes the folders of written steps that a frame reads. Only for frames whose every
    reader has itself been written; other folders are left alone."""
    spark = df.sparkSession
    steps = f"/accesspanel/{spark.sparkContext.applicationId}/steps/"
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if steps in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` BIGINT and ``text`` STRING only, so that further columns of any
    name do not clash with the operators' own."""
    ship_package(docs.sparkSession)
    return docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows of one ``doc_id`` apart by their text; equal rows share it.
    Never NULL, so rows without an id can be joined too."""
    return F.xxhash64(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; NULL is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows holding about ``limit`` bytes of ``column``; a
    longer text comes alone."""
    start, size = 0, 0
    for i, b in enumerate(batch.column(column)):
        n = b.as_buffer().size if b.is_valid else 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def per_slice(
    fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return run


def hash_sample(df: DataFrame, group: str, key: str, buckets: int, max_groups: int = 512) -> DataFrame:
    """At most ``buckets`` rows (and their repeats) of each ``group``: of each
    of that many hash buckets, the row with the least key hash. Only ``max_groups * buckets``
    hashes reach the driver; more groups than that raise. Rows without a key are left out."""
    hashed = df.where(F.col(key).isNotNull()).withColumn("sample_hash", F.xxhash64(F.col(key)))
    least = (
        hashed.where(F.col(group).isNotNull())
        .groupBy(group, F.pmod("sample_hash", F.lit(buckets)).alias("bucket"))
        .agg(F.min("sample_hash").alias("h"))
        .limit(max_groups * buckets + 1)
        .collect()
    )
    if len(least) > max_groups * buckets:
        raise ValueError(f"more than {max_groups} values of {group}")
    return hashed.where(F.col("sample_hash").isin([r["h"] for r in least]))


def spread_text(text: Column, size: int, pieces: int = 8) -> Column:
    """The whole of a text of at most ``size`` characters; of a longer one, as many, in
    ``pieces`` taken at even distances from its start to its end."""
    one = size // pieces
    last = F.length(text) - one
    parts = [F.substring(text, F.floor(last * i / (pieces - 1)).cast("int") + 1, F.lit(one)) for i in range(pieces)]
    return F.when(F.length(text) <= size, text).otherwise(F.concat(*parts))


def with_rank(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds the 0-based rank of each row within its ``key``, by ``order``.

    Rows are range-partitioned on (key, order), so one key may fill any number
    of partitions; each is numbered where it lies and shifted by the rows of the
    same key before it. Only one count per partition and key is windowed.
    Rows tied in both columns get adjacent ranks in no set order."""
    ranged = df.repartitionByRange(F.col(key).asc(), F.col(order).asc_nulls_first(), F.xxhash64(*df.columns))
    placed = materialize(
        ranged.sortWithinPartitions(F.col(key).asc(), F.col(order).asc_nulls_first()).withColumn(
            "at", F.monotonically_increasing_id()
        ),
        name,
    )
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", key).agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = F.sum("n").over(_window(key, "part")) - F.col("n")
    starts = counts.select("part", key, "first_at", before.alias("before"))
    return (
        placed.join(starts, ["part", key])
        .withColumn(name, (F.col("at") - F.col("first_at") + F.col("before")).cast("bigint"))
        .select(*df.columns, name)
    )


def _window(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of BIGINT edges (``a``, ``b``): one row (``node``,
    ``root``) per node with an edge, ``root`` being the least node reachable.

    Alternates the two star steps on edges: each node first hands its larger
    neighbours its least one, then its smaller ones. A step is an aggregate with
    map-side combine and one equi-join, so a hub is never gathered; each round
    is written to the shared folder."""
    e = materialize(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # e's own downward edges are covered: v > u of the reversed pair
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select("x.u", F.col("x.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        e = materialize(small, "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(e: DataFrame) -> tuple[int, int | None, int | None]:
    r = e.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.bit_xor(F.xxhash64("v", "u")).alias("y"),
    ).first()
    return r["n"], r["x"], r["y"]
