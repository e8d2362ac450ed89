"""Tables kept as versions: each write goes to a folder of its own, and one small pointer
file, replaced last and at once, names the version that readers see. A run that dies in a
write, or whose checks fail, leaves the table as it was."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
#: Versions kept: the current one and the one before, which running readers may still use.
KEPT = 2
#: A layer is written once and read whole a few times: fewer bytes are worth the time.
CODEC = "zstd"


def version_folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}"


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_name() -> str:
    """Name of a version to be written; later ones sort after earlier ones."""
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stage_version(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()
) -> tuple[DataFrame, str]:
    """Writes the frame as a version that no reader sees yet; returns it as read back, and its name."""
    version = new_name()
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    df.write.option("compression", CODEC).partitionBy(*partition_by).parquet(version_folder(path, version))
    return df.sparkSession.read.schema(df.schema).parquet(version_folder(path, version)), version


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that readers see, None before the first."""
    fs, pointer = file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return read_text(spark, f"{path.rstrip('/')}/{POINTER}").strip()


def current_path(spark: SparkSession, path: str) -> str:
    """Folder of the current version; the folder itself where it holds a table without versions."""
    version = current_version(spark, path)
    return path if version is None else version_folder(path, version)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions in the folder, oldest first."""
    fs, folder = file_system(spark, f"{path.rstrip('/')}/versions")
    if not fs.exists(folder):
        return []
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n for n in names if fs.exists(jvm_path(f"{version_folder(path, n)}/_SUCCESS")))


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a staged version the current one and removes versions older than the one
    before it. The pointer is written beside and renamed over, which the file system does
    at once. One writer at a time per table."""
    if version not in versions(spark, path):
        raise ValueError(f"{path} has no complete version {version}")
    before = current_version(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, target = file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    beside = f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}"
    write_text(spark, beside, version)
    fresh = jvm.org.apache.hadoop.fs.Path(beside)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fresh, target, options)
    _remove_old(spark, path, {version, before})


def _remove_old(spark: SparkSession, path: str, needed: set[str | None]) -> None:
    """Removes versions, complete or not, that are older than all of the newest KEPT and not needed."""
    fs, folder = file_system(spark, f"{path.rstrip('/')}/versions")
    keep = {*versions(spark, path)[-KEPT:], *needed}
    oldest = min(v for v in keep if v)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name not in keep and name < oldest:
            fs.delete(status.getPath(), True)


def restore_previous(spark: SparkSession, path: str) -> str:
    """Makes the version before the current one current again, and returns its name."""
    current = current_version(spark, path)
    older = [v for v in versions(spark, path) if current and v < current]
    if not older:
        raise ValueError(f"{path} has no earlier version")
    publish(spark, path, older[-1])
    return older[-1]
