"""Delimited files whose bad rows are set aside with their reason, beside the load that
stops at the first one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesspanel.sources import versions
from accesspanel.sources.tables import layer_path

#: Names of the added columns; an input column of such a name is refused.
FILE, TEXT, REASON = "source_file", "row_text", "reject_reason"
_BROKEN = "_corrupt_record"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def parse_raw_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, line_sep: str | None = None
) -> DataFrame:
    """All rows of delimited files: their fields as text, and for a bad row the file it is
    in, the row as it stands and the reason (NULL for a good row, whose fields alone count).

    Bad are rows with an unbalanced quote and rows with too few or too many fields. The
    header, the first line of the first file, is left out wherever it recurs; blank lines are no
    rows. ``columns`` bind by position; without it the header gives the names."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    lines = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias(FILE))
    first = reader.text(path).first()
    header = first["value"] if first else ""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    if columns is None:
        width = spark.range(1).select(F.size(F.split(F.lit(header), ","))).first()[0]
        names = ", ".join(f"c{i} string" for i in range(width))
        columns = [c for c in spark.range(1).select(F.from_csv(F.lit(header.rstrip("\r")), names, options).alias("h")).first()["h"] if c]
    taken = {c.lower() for c in columns} & {FILE, TEXT, REASON, _BROKEN}
    if taken:
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
    schema = ", ".join(f"{_quoted(c)} string" for c in [*columns, _BROKEN])
    rows = lines.where((F.col("line") != header) & F.col("line").rlike(r"[^\x00-\x20]"))
    parsed = rows.withColumn("f", F.from_csv("line", schema, options))
    reason = F.when(_quotes(F.col("line")) % 2 == 1, "unbalanced quote").when(
        F.col(f"f.{_BROKEN}").isNotNull(), "wrong number of fields"
    )
    bad = reason.isNotNull()
    return parsed.select(
        *[F.when(~bad, F.col(f"f.{_quoted(c)}")).alias(c) for c in columns],
        F.when(bad, F.col(FILE)).alias(FILE),
        F.when(bad, F.col("line")).alias(TEXT),
        reason.alias(REASON),
    )


def load_with_rejects(
    spark: SparkSession,
    path: str,
    root: str,
    name: str,
    columns: Sequence[str] | None = None,
    line_sep: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Loads files into ``raw/{name}`` in one pass, and returns the good rows (the columns
    alone) and the reject table (file, row text, reason), both as written. The two are parts
    of one table version, so they always belong together."""
    parsed = parse_raw_csv(spark, path, columns, line_sep)
    folder = layer_path(root, "raw", name)
    written, version = versions.stage_version(
        parsed.withColumn("rejected", F.col(REASON).isNotNull()), folder, partition_by=["rejected"]
    )
    versions.publish(spark, folder, version)
    good = written.where(~F.col("rejected")).drop(FILE, TEXT, REASON, "rejected")
    return good, written.where("rejected").select(FILE, TEXT, REASON)


def reject_report(rejects: DataFrame) -> DataFrame:
    """Rejected rows per file and reason."""
    return rejects.groupBy(FILE, REASON).agg(F.count("*").alias("n"))
