"""Per-key and global ranking without putting a key, or the table, in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesspanel.operators.joins import lookup_join
from accesspanel.sources.tables import materialize

# monotonically_increasing_id puts the partition above this many bits of row number.
ROW_BITS = 33
# Bytes that a range of a global ranking should hold, and the most ranges it is cut
# into: each is a row of the table of offsets.
RANGE_BYTES = 256 << 20
MAX_RANGES = 1_000_000
# Rows of a group that one task may sort to pick its cut rows, and the rows that a
# larger group is sampled down to when a cut row is bracketed. A bracket spans some six
# square roots of the sample, so a sample of LEAST_SAMPLE leaves a fifth of the group.
CUT_ROWS = 1_000_000
SAMPLE_ROWS = 100_000
LEAST_SAMPLE = 1_000


def _nulls_last(name: str, descending: bool) -> list[Column]:
    """Sort fields that order a column inside an ascending struct: NULL last
    for a descending numeric column, NULL first for an ascending one."""
    c = F.col(name)
    if descending:
        return [c.isNull(), -c]
    return [c]


def dominant_row(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    tie: str,
    size: str | None = None,
) -> DataFrame:
    """The top row of each key by ``order`` descending (numeric, NULLs last)
    and ``tie`` ascending; ``size`` adds how many rows the key had.

    An aggregate, not a window: each task keeps one candidate and one count per
    key before the shuffle, so a key with most of the rows costs no more than
    any other."""
    payload = [c for c in df.columns if c != key]
    rank: list[Column] = []
    for name in order:
        rank += _nulls_last(name, descending=True)
    rank += _nulls_last(tie, descending=False)
    ranked = F.struct(
        *[r.alias(f"_r{i}") for i, r in enumerate(rank)], *[F.col(c) for c in payload]
    )
    aggs = [F.min(ranked).alias("_top")]
    if size:
        aggs.append(F.count("*").alias(size))
    best = df.groupBy(key).agg(*aggs)
    columns = [F.col("_top")[c].alias(c) if c != key else F.col(key) for c in df.columns]
    return best.select(*columns, *([size] if size else []))


def with_key_stats(
    df: DataFrame, key: str, stats: Sequence[Column], skewed: bool | None = None
) -> DataFrame:
    """Every row with aggregates of its key's rows (NULL is a key too). The
    aggregates combine map-side and are looked up, so the rows of one key need
    not meet in one task, as they would in a window."""
    per_key = df.groupBy(key).agg(*stats)
    return lookup_join(df, per_key, key, skewed, null_is_key=df.schema[key].nullable)


def group_size(
    df: DataFrame, key: str, name: str = "group_size", skewed: bool | None = None
) -> DataFrame:
    """Every row with the row count of its key."""
    sized = with_key_stats(df, key, [F.count("*").alias(name)], skewed)
    return sized.select(*df.columns, name)


def range_count(df: DataFrame) -> int:
    """Ranges of about RANGE_BYTES each by Spark's size estimate of the frame, and no
    fewer than the session's shuffle partitions."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(MAX_RANGES, -(-int(str(size)) // RANGE_BYTES)))


def range_numbered(
    df: DataFrame, order: str, tie: str, strata: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """The frame range partitioned and sorted on (strata, order, tie), NULLs first
    (last if ``descending``, which turns ``order`` alone), written once, with ``_part``
    (rises with the sort key) and ``_row`` (0, 1, ... inside the part)."""
    ordered = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    keys = [*[F.col(c).asc_nulls_first() for c in strata], ordered, F.col(tie).asc_nulls_first()]
    placed = df.repartitionByRange(range_count(df), *keys).sortWithinPartitions(*keys)
    written = materialize(placed.withColumn("_slot", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_slot", ROW_BITS)
    row = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return written.withColumns({"_part": part, "_row": row}).drop("_slot")


#: How running values combine: rows of a range, and the ranges before it.
COMBINE = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running_totals(
    df: DataFrame,
    measures: Mapping[str, str],
    order: str,
    tie: str,
    strata: Sequence[str] = (),
    descending: bool = False,
    totals: Mapping[str, str] | None = None,
    combine: str = "sum",
) -> DataFrame:
    """Every row with the running value of some columns, itself included, in the order of
    (order, tie), per stratum. ``measures`` maps output names to columns, ``totals`` to
    those whose value over the whole stratum is wanted; NULL counts as 0. ``combine`` is
    ``sum`` or ``xor`` (of integers, for hashes of a set).

    A prefix sum in two steps: each range of the sort key adds up its own rows, then the
    one total per range and stratum is added up over the ranges before it. A window over
    a whole stratum would put it in one task. Rows tied in (order, tie) come in any one
    order, the same for every reader."""
    fold, plus = COMBINE[combine]
    totals = totals or {}
    wanted = list(dict.fromkeys([*measures.values(), *totals.values()]))
    value = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in wanted}
    numbered = range_numbered(df, order, tie, strata, descending)
    inside = Window.partitionBy(*strata, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.withColumns({f"_in_{n}": fold(value[c]).over(inside) for n, c in measures.items()})
    pieces = numbered.groupBy(*strata, "_part").agg(*[fold(value[c]).alias(f"_of_{c}") for c in wanted])
    earlier = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata)
    offsets = pieces.select(
        *[F.col(c).alias(f"_s_{c}") for c in strata],
        F.col("_part").alias("_p"),
        *[fold(f"_of_{c}").over(earlier).alias(f"_before_{n}") for n, c in measures.items()],
        *[fold(f"_of_{c}").over(whole).alias(n) for n, c in totals.items()],
    )
    same = F.col("_part") == F.col("_p")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    running = [
        F.when(F.col(f"_before_{n}").isNull(), F.col(f"_in_{n}"))
        .otherwise(plus(F.col(f"_before_{n}"), F.col(f"_in_{n}")))
        .alias(n)
        for n in measures
    ]
    return rows.join(offsets, same, "inner").select(*df.columns, *running, *totals)


def global_rank(
    df: DataFrame,
    order: str,
    tie: str,
    name: str = "rank",
    total: str = "total",
    strata: Sequence[str] = (),
) -> DataFrame:
    """Row number 1..N by (order, tie), NULLs first, and N, per stratum.

    No task sees more than its range of the sort key: the rows are range
    partitioned and sorted on (strata, order, tie), numbered inside their
    partition and written once; the rows of the partitions before, one number
    per partition, are then added. As ``tie`` takes part in the ranges, one
    repeated ``order`` value still spreads over many. ``tie`` must be unique
    within a stratum. The write makes the numbering the same for every reader,
    whatever is recomputed later."""
    numbered = range_numbered(df, order, tie, strata)
    # A stratum's rows are consecutive, so there are at most partitions + strata pieces.
    pieces = numbered.groupBy(*strata, "_part").agg(
        F.count("*").alias("_rows"), F.min("_row").alias("_first")
    )
    whole = Window.partitionBy(*strata)
    earlier = Window.partitionBy(*strata).orderBy("_part")
    offsets = pieces.select(
        *[F.col(s).alias(f"_s_{s}") for s in strata],
        F.col("_part").alias("_p"),
        (F.sum("_rows").over(earlier) - F.col("_rows") - F.col("_first") + 1).alias("_offset"),
        F.sum("_rows").over(whole).alias(total),
    )
    same = F.col("_part") == F.col("_p")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    return numbered.join(offsets, same, "inner").select(
        *df.columns, (F.col("_row") + F.col("_offset")).alias(name), total
    )


def ntile_of(rank: Column, total: Column, n: int) -> Column:
    """Bucket 1..n of a rank among ``total`` rows: sizes differ by at most one,
    larger buckets first."""
    q = F.floor(total / F.lit(n))
    m = total % F.lit(n)
    head = m * (q + 1)
    in_head = F.floor((rank - 1) / (q + 1)) + 1
    in_tail = m + F.floor((rank - 1 - head) / F.nullif(q, F.lit(0))) + 1
    return F.when(rank <= head, in_head).otherwise(in_tail).cast("int")


def _points(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, level: int, small: int, sample: int) -> DataFrame:
    """The ``_point`` of rank ``_r`` among the rows of its group, for each group (``keys``)
    and cut (``_cut{level}``) of ``wanted``.

    A group of at most ``small`` rows is sorted by one task. Of a larger one a sample is
    sorted, which brackets each cut row between two sampled points; the rows in the
    bracket, a few hundredths of the group, are the next level's group, and how many lie
    below it is counted. A bracket that misses its row is widened until it does not."""
    cut = f"_cut{level}"
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "sizes")
    order = Window.partitionBy(*keys).orderBy("_point")
    sized = _with(rows, sizes, keys)

    def at(points: DataFrame, places: DataFrame, rank: str, name: str) -> DataFrame:
        """``places`` with the point of its ``rank``, NULL where there is none."""
        found = points.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_rank").alias("_at"), F.col("_point").alias(name))
        same = F.col(rank) == F.col("_at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return places.join(found, same, "left").select(*places.columns, name)

    ranked = sized.where(F.col("_n") <= small).select(*keys, "_point", F.row_number().over(order).alias("_rank"))
    few = _semi(wanted, sizes.where(F.col("_n") <= small), keys)
    done = at(ranked, few, "_r", "_point").select(*keys, cut, "_point")
    large = sizes.where(F.col("_n") > small)
    if large.isEmpty():
        return done
    many = _semi(wanted, large, keys)
    chosen = F.pmod(F.xxhash64(*keys, "_point"), F.col("_n")) < sample
    drawn = materialize(
        sized.where((F.col("_n") > small) & chosen).select(*keys, "_point", F.row_number().over(order).alias("_rank")),
        "sample",
    )
    per_group = drawn.groupBy(*keys).agg(F.max("_rank").alias("_s"))
    width = 3.0
    while True:
        placed = _with(_with(many, large, keys), per_group, keys)
        middle = F.col("_r") * F.col("_s") / F.col("_n")
        reach = F.lit(width) * F.sqrt("_s") + 1
        ends = placed.withColumns(
            {"_lo": F.floor(middle - reach).cast("int"), "_hi": F.ceil(middle + reach).cast("int")}
        )
        ends = at(drawn, at(drawn, ends, "_lo", "_from"), "_hi", "_to")
        brackets = materialize(ends.select(*keys, cut, "_r", "_from", "_to"), "brackets")
        packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct(cut, "_from", "_to")).alias("_b"))
        opened = _with(rows, packed, keys).where(F.col("_b").isNotNull()).select(*keys, "_point", F.inline("_b"))
        above = F.col("_from").isNull() | (F.col("_point") >= F.col("_from"))
        under = F.col("_to").isNull() | (F.col("_point") <= F.col("_to"))
        inside = materialize(opened.where(above & under).select(*keys, cut, "_point"), "inside")
        counts = inside.groupBy(*keys, cut).agg(F.count("*").alias("_in"))
        lower = opened.where(~above).groupBy(*keys, cut).agg(F.count("*").alias("_below"))
        checked = _with(_with(brackets, counts, [*keys, cut]), lower, [*keys, cut])
        below = F.coalesce(F.col("_below"), F.lit(0))
        found = materialize(
            checked.select(*keys, cut, (F.col("_r") - below).alias("_r"), F.coalesce("_in", F.lit(0)).alias("_in")), "found"
        )
        if found.where((F.col("_r") < 1) | (F.col("_r") > F.col("_in"))).isEmpty():
            break
        width *= 4
    inner = [*keys, cut]
    deeper = found.select(*inner, F.lit(0).alias(f"_cut{level + 1}"), "_r")
    rest = _points(inside, inner, deeper, level + 1, small, sample)
    return done.unionByName(rest.select(*keys, cut, "_point"))


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys to a frame with one row per key; without keys, to its one row."""
    return lookup_join(left, right, list(keys), null_is_key=True) if keys else left.crossJoin(F.broadcast(right))


def _semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = _with(left, right.select(*keys, F.lit(True).alias("_there")), keys)
    return marked.where("_there").drop("_there")


def cut_points(
    df: DataFrame,
    n: int,
    order: str,
    tie: str,
    strata: Sequence[str] = (),
    small: int = CUT_ROWS,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per stratum: ``_cuts``, the last point (order, tie) of each of the first
    n - 1 equal-count buckets. Exact, by distributed selection: the table is never
    sorted nor shuffled, only its narrow columns are read a few times."""
    rows = df.select(*strata, F.struct(F.col(order).alias("o"), F.col(tie).alias("t")).alias("_point"))
    totals = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    cut = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    # the first m buckets hold q + 1 rows, the others q
    i, q, m = F.col("_cut0"), F.floor(F.col("_n") / n), F.col("_n") % n
    wanted = materialize(
        totals.where("_n > 0").withColumn("_cut0", cut).select(*strata, "_cut0", (i * q + F.least(i, m)).alias("_r")), "cuts"
    )
    found = _points(rows, list(strata), wanted, 0, small, max(sample, LEAST_SAMPLE))
    ordered = F.sort_array(F.collect_list(F.struct("_cut0", "_point")))
    return found.groupBy(*strata).agg(F.transform(ordered, lambda x: x["_point"]).alias("_cuts"))


def ntile_bucket(
    df: DataFrame,
    n: int,
    order: str,
    tie: str,
    name: str = "bucket",
    strata: Sequence[str] = (),
    small: int = CUT_ROWS,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """Equal-count buckets 1..n of the ascending order (NULLs first), per stratum if given;
    ``tie`` is unique within a stratum. A row's bucket is one more than the number of cut
    points below it, so the rows themselves are neither sorted nor written."""
    if n == 1:
        return df.withColumn(name, F.lit(1))
    cuts = materialize(cut_points(df, n, order, tie, strata, small, sample), "cut_points")
    point = F.struct(F.col(order).alias("o"), F.col(tie).alias("t"))
    passed = [F.when(point > F.get("_cuts", F.lit(i)), 1).otherwise(0) for i in range(n - 1)]
    bucket = F.lit(1)
    for one in passed:
        bucket = bucket + one
    return _with(df, cuts, strata).select(*df.columns, bucket.cast("int").alias(name))


def first_last_delta(
    df: DataFrame,
    key: str,
    order: str,
    cols: Sequence[str],
    suffix: str = "_change",
    few_rows_per_key: bool = False,
    skewed: bool | None = None,
) -> DataFrame:
    """Every row with last-minus-first of each column over its key, by position
    in ``order`` (unique within the key): a NULL at either end gives NULL.
    ``few_rows_per_key`` says that a key cannot have more rows than, say, there
    are years; then a window, which reads the input once, is safe."""
    if few_rows_per_key:
        w = (
            Window.partitionBy(key)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        deltas = [(F.last(c).over(w) - F.first(c).over(w)).alias(f"{c}{suffix}") for c in cols]
        return df.select("*", *deltas)
    point = F.struct(order, *[F.col(c) for c in cols])
    ends = with_key_stats(
        df, key, [F.min(point).alias("_first"), F.max(point).alias("_last")], skewed
    )
    changes = [(F.col("_last")[c] - F.col("_first")[c]).alias(f"{c}{suffix}") for c in cols]
    return ends.select(*df.columns, *changes)
