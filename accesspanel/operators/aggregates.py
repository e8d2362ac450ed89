"""Grouped summaries. All combine map-side before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import col, text_length


def percent(part: Column, whole: Column, dtype: str = "decimal(5,2)") -> Column:
    """100 * part / whole, NULL for an empty whole."""
    hundred = F.lit(100).cast("decimal(4,1)")
    return (hundred * part / F.nullif(whole, F.lit(0))).cast(dtype)


def count_where(cond: Column) -> Column:
    """Number of rows for which the condition holds; 0 for no rows."""
    return F.count(F.when(cond, F.lit(1)))


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def distribution(
    df: DataFrame,
    keys: Mapping[str, Column | str] | Sequence[str],
    count: str = "n",
    pct: str | None = None,
    dtype: str = "decimal(5,2)",
) -> DataFrame:
    """Row count per key. ``keys`` maps output names to columns or expressions.
    ``pct`` adds the share of all rows; the total is taken from the grouped
    counts and joined back as one row, which no single-task window is needed for."""
    named = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    grouped = df.groupBy(*[col(c).alias(k) for k, c in named.items()]).agg(
        F.count("*").alias(count)
    )
    if pct is None:
        return grouped
    total = grouped.agg(F.sum(count).alias("_total"))
    return grouped.crossJoin(F.broadcast(total)).select(
        *named, count, percent(F.col(count), F.col("_total"), dtype).alias(pct)
    )


def length_profile(
    df: DataFrame, column: Column | str, name: str = "length", count: str = "n"
) -> DataFrame:
    """Row count per text length, trailing blanks not counted."""
    return distribution(df, {name: text_length(column)}, count)


def key_multiplicity(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, rows, and rows beyond the first of each key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    counted = per_key.agg(
        F.count(key).alias("distinct_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")
    )
    return counted.withColumn("extra_rows", F.col("total_rows") - F.col("distinct_keys"))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def completeness(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    dtype: str = "decimal(5,2)",
) -> DataFrame:
    """Per group: rows, and for every column the non-null count, null count and
    null percentage."""
    total = F.count("*")
    aggs: list[Column] = [total.alias("total_rows")]
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_present"),
            (total - F.count(c)).alias(f"{c}_null"),
            percent(total - F.count(c), total, dtype).alias(f"{c}_pct_null"),
        ]
    return df.groupBy(*by).agg(*aggs)


def summary(df: DataFrame, by: Sequence[str], specs: Mapping[str, Column]) -> DataFrame:
    """Several named aggregates per group."""
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in specs.items()])


def average(c: Column | str, dtype: str) -> Column:
    """Mean with the result type stated."""
    return F.avg(col(c)).cast(dtype)


def weighted_mean(value: Column | str, weight: Column | str, where: Column | None = None) -> Column:
    """sum(value*weight)/sum(weight) as DOUBLE, NULL when the weights sum to 0.
    The sums stay in the input type, so DECIMAL inputs add up exactly in any
    order. A NULL value drops out of the numerator only."""
    v, w = col(value), col(weight)
    if where is not None:
        v, w = F.when(where, v), F.when(where, w)
    return F.sum(v * w).cast("double") / F.nullif(F.sum(w).cast("double"), F.lit(0.0))


def benchmark_gap(
    df: DataFrame,
    value: str,
    weight: str,
    target: Column,
    bench: Column,
    by: Sequence[str] = (),
    money: str = "decimal(10,2)",
    total: str = "decimal(18,0)",
) -> DataFrame:
    """Weighted mean of a target group against a benchmark group, the gap, and
    the gap times the target's weight, in one pass over the rows. Without
    ``by``, an empty group still gives one row (NULL means, zero count)."""
    rows = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    sums = rows.groupBy(*by).agg(
        count_where(target).alias("target_areas"),
        F.sum(F.when(target, F.col(weight))).alias("target_weight"),
        weighted_mean(value, weight, target).alias("_target"),
        weighted_mean(value, weight, bench).alias("_bench"),
    )
    gap = F.col("_target") - F.col("_bench")
    return sums.select(
        *by,
        "target_areas",
        "target_weight",
        F.col("_target").cast(money).alias("target_mean"),
        F.col("_bench").cast(money).alias("bench_mean"),
        gap.cast(money).alias("gap"),
        (gap * F.col("target_weight")).cast(total).alias("excess_total"),
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of an order: each task keeps k rows, one merges them.
    The order must end in a unique key for a repeatable result."""
    return df.orderBy(*order).limit(k)


def top_groups(
    df: DataFrame, key: str, k: int, count: str = "n", extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """The k most frequent keys, ties in key order."""
    grouped = df.groupBy(key).agg(
        F.count("*").alias(count), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    return top_k(grouped, [F.col(count).desc(), F.col(key).asc()], k)
