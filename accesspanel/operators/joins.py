"""Joins. All are equi-joins that keep the left side whole."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import zip5

# How many frequent keys a skewed join spreads out.
HOT_KEYS = 256
# Shuffle keys that the rows of one frequent key are spread over.
SALTS = 64
SKETCH_ITEMS = 16_384


def frequent_keys(df: DataFrame, keys: Sequence[str], k: int = HOT_KEYS, least: int = 0) -> list[int]:
    """Hashes of up to k of the most frequent key values (NULL included) with some
    ``least`` rows, from a bounded sketch: one pass, no shuffle of rows. Missing a key or
    naming a rare one costs speed only, never rows. The k numbers are fetched so that
    every branch of a plan sees the same list."""
    sketch = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {k}, {SKETCH_ITEMS})").alias("top")
    )
    top = sketch.first()["top"] or []
    return [item["item"] for item in top if item["item"] is not None and item["count"] >= least]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate puts the frame below its broadcast limit."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= _bytes(limit)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores before it where one of the frames has such a column."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _bytes(text: str) -> int:
    """Bytes of a Spark size setting such as 10485760, 10485760b or 10MB."""
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]*)", text.strip().lower()).groups()
    return int(number) * 1024 ** "bkmgtp".index((unit or "b")[0])


def folded_key(name: str) -> Column:
    """A key as a case-insensitive collation that ignores trailing blanks compares it. An
    expression over one side, so a join on it stays an equi-join."""
    return F.lower(F.rtrim(F.col(name).cast("string")))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    skewed: bool | None = None,
    null_is_key: bool = False,
    ci: bool = False,
) -> DataFrame:
    """Left join to a lookup that has at most one row per key; with ``null_is_key``
    NULL keys meet too, with ``ci`` text keys meet whatever their case and trailing blanks
    (the lookup then has one row per folded key).

    A lookup small enough to be broadcast is simply joined. Beside a larger one a few
    keys (a blank code, say) may hold much of the left rows. Rows of the frequent keys
    are then salted over ``SALTS`` shuffle keys by their content and the partition they
    come from, so equal rows are spread too and a repeated task deals its rows alike;
    each of the at most ``HOT_KEYS`` lookup rows they need is repeated for every salt.
    Each side is read once, beside the pass that finds the keys. A key beyond HOT_KEYS is
    left to adaptive skew handling. ``skewed`` forces the choice, which never changes the
    result: the left columns, whatever their names, then those of the lookup."""
    keys = [on] if isinstance(on, str) else list(on)
    if ci:
        hidden = {k: free_name(f"_folded_{k}", left, right) for k in keys}
        folded = {h: folded_key(k) for k, h in hidden.items()}
        joined = lookup_join(
            left.withColumns(folded), right.withColumns(folded).drop(*keys), list(hidden.values()), skewed, null_is_key
        )
        added = [c for c in right.columns if c not in keys]
        return joined.select(*keys, *[c for c in left.columns if c not in keys], *added)
    if skewed is None:
        skewed = not fits_broadcast(right)
    if not skewed:
        if not null_is_key:
            return left.join(right, keys, "left")
        return _joined(left, right, keys)
    salt = free_name("_salt", left, right)
    is_hot = F.xxhash64(*keys).isin(frequent_keys(left, keys))
    one = F.lit(0).cast("bigint")
    place = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(SALTS))
    salts = F.sequence(one, F.lit(SALTS - 1).cast("bigint"))
    salted = left.withColumn(salt, F.when(is_hot, place).otherwise(one))
    spread = right.withColumn(salt, F.explode(F.when(is_hot, salts).otherwise(F.array(one))))
    if null_is_key:
        return _joined(salted, spread, [*keys, salt]).drop(salt)
    return salted.join(spread, [*keys, salt], "left").drop(salt)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality, columns as in a join by name."""
    names: dict[str, str] = {}
    for k in keys:
        names[k] = free_name(f"_right_{k}", left, right)
    named = right.withColumnsRenamed(names)
    same = None
    for k, r in names.items():
        one = F.col(k).eqNullSafe(F.col(r))
        same = one if same is None else same & one
    rest = [c for c in left.columns if c not in keys]
    added = [c for c in right.columns if c not in keys]
    return left.join(named, same, "left").select(*keys, *rest, *added)


def attach_area(
    df: DataFrame,
    crosswalk: DataFrame,
    postal: str,
    zip_col: str = "zip5",
    area: str = "county_fips",
    crosswalk_zip: str = "zip",
    width: int = 5,
    skewed: bool | None = None,
) -> DataFrame:
    """Give each row the area of its normalised postal code; rows without a
    match keep a NULL area."""
    keyed = df.withColumn(zip_col, zip5(postal, width))
    ref = crosswalk.select(F.col(crosswalk_zip).alias(zip_col), area)
    return lookup_join(keyed, ref, zip_col, skewed)


def attach_denominator(
    panel: DataFrame,
    measures: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    only: Column | None = None,
) -> DataFrame:
    """Left join measure columns on a composite key. A condition on the measure
    side is applied before the join, so unmatched panel rows survive it."""
    right = measures if only is None else measures.filter(only)
    return panel.join(right.select(*keys, *cols), list(keys), "left")


def assemble_fact(
    base: DataFrame,
    panel: DataFrame,
    codes: DataFrame,
    area: str = "county_fips",
    period: str = "year_id",
) -> DataFrame:
    """Wide fact from the complete base: every base row once, NULLs where the
    panel or the codes have nothing. Periods are compared within the rows of an area, of
    which there are few, so the base is shuffled once, on the area, for both joins."""
    names = {c: free_name(f"_right_{c}", base, panel) for c in (area, period)}
    mine, its = F.col(period), F.col(names[period])
    # a range, as an equality would make the period part of the shuffle key
    same = (F.col(area) == F.col(names[area])) & (mine >= its) & (mine <= its)
    joined = base.join(panel.withColumnsRenamed(names), same, "left").drop(*names.values())
    rest = [c for c in joined.columns if c not in (area, period)]
    return joined.select(area, period, *rest).join(codes, [area], "left")


def unmatched(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Distinct left rows whose key is not in the right side."""
    ref = right.select(key).filter(F.col(key).isNotNull()).distinct()
    return left.select(*cols).distinct().join(ref, [key], "left_anti")


def unmatched_sample(
    left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], n: int = 10
) -> DataFrame:
    """First n of :func:`unmatched` in key order."""
    order = [key, *[c for c in cols if c != key]]
    return unmatched(left, right, key, cols).orderBy(*order).limit(n).select(*cols)


def join_coverage(
    left: DataFrame,
    right: DataFrame,
    key: str,
    distinct: bool = True,
    dtype: str = "decimal(5,2)",
    ci: bool = False,
) -> DataFrame:
    """One row: total, matched, unmatched, pct_matched. Left rows are counted
    per key before the join, so a frequent key is one row in the shuffle. With ``ci``
    keys are compared, and counted, as :func:`folded_key` has them."""
    if ci:
        left, right = (df.withColumn(key, folded_key(key)) for df in (left, right))
    n = F.lit(1) if distinct else F.count("*")
    per_key = left.groupBy(key).agg(n.cast("bigint").alias("_n"))
    ref = right.select(key).filter(F.col(key).isNotNull()).distinct()
    joined = per_key.join(ref.withColumn("_hit", F.lit(True)), [key], "left")
    total = F.coalesce(F.sum("_n"), F.lit(0))
    matched = F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0))
    counts = joined.agg(total.alias("total"), matched.alias("matched"))
    return counts.select(
        "total",
        "matched",
        (F.col("total") - F.col("matched")).alias("unmatched"),
        (F.lit(100.0).cast("decimal(4,1)") * F.col("matched") / F.nullif("total", F.lit(0)))
        .cast(dtype)
        .alias("pct_matched"),
    )


def cross_scalars(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of one-row frames. An empty frame gives NULLs; one
    with more rows fails when it is read, as it has no single value."""
    out = None
    several = F.raise_error(F.lit("cross_scalars: a frame has more than one row"))
    for frame in frames:
        counted = frame.agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in frame.columns])
        one = counted.select(
            *[F.when(F.col("_n") > 1, several.cast(t)).otherwise(F.col(c)).alias(c) for c, t in frame.dtypes]
        )
        out = one if out is None else out.crossJoin(one)
    return out
