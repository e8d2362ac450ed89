"""Data-quality checks as jobs that return rows, so they can gate or report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import (
    BLANK,
    SUPPRESSED,
    cast_reason,
    text_length,
)
from accesspanel.functions.predicates import select_columns
from accesspanel.operators.aggregates import (
    average,
    completeness,
    count_where,
    distribution,
    length_profile,
    summary,
)
from accesspanel.operators.joins import folded_key, join_coverage, unmatched_sample
from accesspanel.operators.windows import dominant_row

__all__ = [
    "cast_audit",
    "check_not_null",
    "check_row_count",
    "check_unique",
    "completeness",
    "distribution",
    "flow_summary",
    "join_coverage",
    "length_profile",
    "load_report",
    "period_compare",
    "profile_columns",
    "range_check",
    "spot_check",
    "status_mismatch",
    "tie_back",
    "unmatched_sample",
    "verify_dominant",
]


class CheckFailed(Exception):
    """A gate found rows that break its rule."""


def require_empty(found: DataFrame, what: str, show: int = 5) -> None:
    """Gate: raise with a few examples unless the frame has no rows."""
    rows = found.limit(show).collect()
    if rows:
        raise CheckFailed(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def check_row_count(
    df: DataFrame, expected: int | DataFrame, tolerance: float = 0.0
) -> DataFrame:
    """One row: rows found, rows expected, 1 when within the tolerance. The expected
    number is given or is the one value of a one-row frame, which stays in the plan."""
    found = df.agg(F.count("*").alias("row_count"))
    if isinstance(expected, int):
        both = found.withColumn("expected", F.lit(expected).cast("bigint"))
    else:
        both = found.crossJoin(expected.toDF("expected").withColumn("expected", F.col("expected").cast("bigint")))
    slack = F.floor(F.abs("expected") * F.lit(tolerance))
    within = F.abs(F.col("row_count") - F.col("expected")) <= slack
    return both.withColumn("within", F.when(within, 1).otherwise(0))


def load_report(df: DataFrame, table: str, expected: int | None = None) -> DataFrame:
    """One row per load: table, rows loaded, rows expected, message."""
    n = F.count("*")
    text = F.concat(F.lit("Rows loaded into "), F.lit(table), F.lit(": "), n.cast("string"))
    return df.agg(
        F.lit(table).alias("table_name"),
        n.alias("row_count"),
        F.lit(expected).cast("bigint").alias("expected"),
        text.alias("message"),
    )


def check_unique(df: DataFrame, keys: Sequence[str], ci: bool = False) -> DataFrame:
    """Keys that occur more than once, with their row count; with ``ci`` text keys that
    differ in case or trailing blanks only are one key, shown folded."""
    if ci:
        df = df.withColumns({k: folded_key(k) for k in keys})
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: how many NULLs it has."""
    counts = df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column_name", "null_count")


def cast_audit(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Rows per (column, reason) for several casts in one pass: ok, suppressed,
    blank, unparseable. ``casts`` maps a text column to its target type."""
    reasons = df.select(*[cast_reason(c, t).alias(c) for c, t in casts.items()])
    return (
        reasons.unpivot([], list(casts), "column_name", "reason")
        .groupBy("column_name", "reason")
        .agg(F.count("*").alias("n"))
    )


def profile_columns(
    df: DataFrame,
    required: Sequence[str] = (),
    patterns: Sequence[str] = (".*",),
    exclude: Sequence[str] = (),
    markers: Sequence[str] = (SUPPRESSED, BLANK),
) -> DataFrame:
    """Pre-flight profile of the columns whose names match: position, type,
    rows, NULLs, marker values, distinct estimate, shortest and longest text.
    A missing required column fails before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise CheckFailed(f"required columns missing: {', '.join(missing)}")
    chosen = select_columns(df, patterns, exclude)
    if not chosen:
        raise CheckFailed("no column matches the patterns")
    position = {name: i for i, name in enumerate(df.columns, start=1)}
    types = dict(df.dtypes)
    text = {c: F.col(c).cast("string") for c in chosen}
    stats = []
    for c in chosen:
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(position[c]).alias("position"),
                F.lit(types[c]).alias("data_type"),
                F.count("*").alias("row_count"),
                count_where(F.col(c).isNull()).alias("null_count"),
                count_where(F.trim(text[c]).isin(list(markers))).alias("marker_count"),
                F.approx_count_distinct(c).alias("approx_distinct"),
                F.min(text_length(text[c])).alias("min_length"),
                F.max(text_length(text[c])).alias("max_length"),
            )
        )
    packed = df.agg(F.array(*stats).alias("columns"))
    return packed.select(F.inline("columns"))


def spot_check(df: DataFrame, predicate: Column, cols: Sequence[str]) -> DataFrame:
    """Known rows, to be read or compared."""
    return df.filter(predicate).select(*cols)


def tie_back(
    earlier: DataFrame, later: DataFrame, keys: Sequence[str], column: str
) -> DataFrame:
    """Keys of the later table whose value differs from the earlier table's."""
    a = earlier.select(*keys, F.col(column).alias("earlier_value"))
    b = later.select(*keys, F.col(column).alias("later_value"))
    return b.join(a, list(keys), "left").filter(
        ~F.col("later_value").eqNullSafe(F.col("earlier_value"))
    )


def range_check(
    df: DataFrame, column: str, by: Sequence[str] = (), mean_type: str = "decimal(18,4)"
) -> DataFrame:
    """Least, greatest and mean value and the NULL count, per group."""
    return summary(
        df,
        by,
        {
            "min_value": F.min(column),
            "max_value": F.max(column),
            "avg_value": average(column, mean_type),
            "null_count": count_where(F.col(column).isNull()),
        },
    )


def status_mismatch(
    entities: DataFrame, status: str, end: str, closed: str = "Closed"
) -> DataFrame:
    """Entities whose snapshot status says closed while the panel, which needs
    a readable end date, counts them as in business."""
    return entities.filter((F.col(status) == closed) & F.col(end).isNull())


def flow_summary(
    panel: DataFrame, period: str = "year_id", opened: str = "openings", closed: str = "closures"
) -> DataFrame:
    """Openings and closures per period."""
    return summary(
        panel, [period], {"total_openings": F.sum(opened), "total_closures": F.sum(closed)}
    )


def period_compare(
    panel: DataFrame,
    first: int,
    last: int,
    period: str = "year_id",
    active: str = "active",
    rate: str = "rate",
) -> DataFrame:
    """Totals and mean rate of the first and the last period."""
    return summary(
        panel.filter(F.col(period).isin(first, last)),
        [period],
        {
            "areas": F.count("*"),
            "total_active": F.sum(active),
            "avg_rate": average(rate, "decimal(8,4)"),
        },
    )


def verify_dominant(
    raw: DataFrame, clean: DataFrame, key: str, order: Sequence[str], tie: str
) -> DataFrame:
    """Keys whose clean row is not the top raw row, or that are missing."""
    best = dominant_row(raw.select(key, *order, tie), key, order, tie)
    expected = best.select(key, F.col(tie).alias("expected"))
    found = clean.select(key, F.col(tie).alias("found"))
    return expected.join(found, [key], "full").filter(
        ~F.col("expected").eqNullSafe(F.col("found"))
    )
