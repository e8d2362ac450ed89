import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from accesspanel.operators import aggregates as a
from accesspanel.operators import joins as j
from accesspanel.operators import quality as q
from accesspanel.operators import windows as w


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- windows -----------------------------------------------------------------


def brute_ntile(keys, n):
    """Bucket of each position of a sorted list, by handing out the sizes."""
    size, extra = divmod(len(keys), n)
    out, at = {}, 0
    for bucket in range(1, n + 1):
        take = size + (1 if bucket <= extra else 0)
        for key in keys[at : at + take]:
            out[key] = bucket
        at += take
    return out


@pytest.mark.parametrize("count,n", [(0, 5), (1, 5), (3, 5), (5, 5), (23, 5), (1000, 7)])
def test_ntile_matches_brute_force(spark, count, n):
    rng = random.Random(count)
    data = [(i, rng.choice([None, 1.5, 2.5, *range(20)])) for i in range(count)]
    data = [(i, None if v is None else float(v)) for i, v in data]
    df = spark.createDataFrame(data, "id int, v double")
    got = {r["id"]: r["bucket"] for r in w.ntile_bucket(df, n, "v", "id").collect()}
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == brute_ntile([r[0] for r in order], n)


def test_rank_of_one_repeated_value_is_spread(spark):
    df = spark.range(20_000).select("id", F.lit(7).alias("v"))
    ranked = w.global_rank(df, "v", "id")
    assert ranked.filter(F.col("rank") != F.col("id") + 1).count() == 0
    assert ranked.filter("total <> 20000").count() == 0
    parts = w.range_numbered(df, "v", "id").groupBy("_part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5_000


def test_ntile_in_strata_with_null_stratum_and_hot_stratum(spark):
    df = spark.range(3_000).select(
        "id",
        F.when(F.col("id") < 2_000, "hot").when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("s"),
        (F.col("id") % 11).alias("v"),
    )
    got = w.ntile_bucket(df, 4, "v", "id", "b", strata=["s"])
    want = df.withColumn("b", F.ntile(4).over(Window.partitionBy("s").orderBy("v", "id")))
    assert rows(got) == rows(want.select(*got.columns))


def test_ntile_by_selection_through_several_levels(spark):
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") < 14_000, "hot").when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("s"),
        F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 1000 % 211).alias("v"),
        F.lit("x").alias("_n"),
    )
    got = w.ntile_bucket(df, 6, "v", "id", "b", strata=["s"], small=1500, sample=1000)
    want = df.withColumn("b", F.ntile(6).over(Window.partitionBy("s").orderBy("v", "id")))
    assert rows(got) == rows(want.select(*got.columns))
    text = plan_of(got)
    assert "rangepartitioning" not in text and "Sort " not in text and "Window" not in text
    whole = w.ntile_bucket(df, 3, "v", "id", "b", small=1500, sample=1000)
    assert rows(whole) == rows(df.withColumn("b", F.ntile(3).over(Window.orderBy("v", "id"))))


def test_ntile_by_selection_with_one_value_and_text_keys(spark):
    df = spark.range(3_000).select(F.format_string("k%05d", "id").alias("id"), F.lit(1.5).alias("v"))
    got = w.ntile_bucket(df, 4, "v", "id", "b", small=1000, sample=1000)
    assert rows(got.groupBy("b").agg(F.count("*"), F.min("id"), F.max("id"))) == [
        (i + 1, 750, f"k{750 * i:05d}", f"k{750 * i + 749:05d}") for i in range(4)
    ]


def test_running_totals_equal_a_window(spark):
    df = spark.range(5_000).select(
        "id", (F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 101).alias("v"),
        F.when(F.col("id") % 9 > 0, (F.col("id") % 13).cast("decimal(18,2)")).alias("m"),
    )
    got = w.running_totals(df, {"run": "m"}, "v", "id", ["s"], descending=True, totals={"all": "m"})
    over = Window.partitionBy("s")
    in_order = over.orderBy(F.col("v").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    m = F.coalesce("m", F.lit(0))
    want = df.withColumns({"run": F.sum(m).over(in_order), "all": F.sum(m).over(over)})
    assert rows(got) == rows(want.select(*got.columns))
    xor = w.running_totals(df, {"x": "v"}, "id", "id", combine="xor")
    last = xor.where("id = 4999").first()["x"]
    assert last == df.agg(F.bit_xor("v")).first()[0]
    assert xor.where("id = 1").first()["x"] == 7919 % 101
    assert w.running_totals(df.limit(0), {"run": "m"}, "v", "id").count() == 0


def test_lookup_keeps_every_column_and_spreads_equal_rows(spark):
    left = spark.range(4_000, numPartitions=8).select(F.lit(1).alias("k"), F.lit(5).alias("_salt"), F.lit(6).alias("_right_k"))
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for null_is_key in (False, True):
        out = j.lookup_join(left, right, "k", skewed=True, null_is_key=null_is_key)
        assert out.columns == ["k", "_salt", "_right_k", "v"]
        assert out.distinct().collect() == [(1, 5, 6, "a")] and out.count() == 4_000
        plain = j.lookup_join(left, right, "k", skewed=False, null_is_key=null_is_key)
        assert plain.columns == out.columns
    salt = F.pmod(F.xxhash64("k", "_salt", F.spark_partition_id()), F.lit(j.SALTS))
    assert left.select(salt).distinct().count() > 4


@pytest.mark.parametrize("skewed", [False, True])
def test_lookup_in_any_case(spark, skewed):
    left = spark.createDataFrame([("Ab ", 1), ("aB", 2), (" ab", 3), (None, 4), ("É", 5)], "k string, _folded_k int")
    right = spark.createDataFrame([("AB  ", "x"), ("é", "y"), (None, "z")], "k string, v string")
    out = j.lookup_join(left, right, "k", skewed=skewed, ci=True)
    assert out.columns == ["k", "_folded_k", "v"]
    assert rows(out) == [(None, 4, None), (" ab", 3, None), ("Ab ", 1, "x"), ("aB", 2, "x"), ("É", 5, "y")]
    text = plan_of(j.lookup_join(left, right, "k", skewed=skewed, null_is_key=True, ci=True))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert j.join_coverage(left, right, "k", ci=True).first()["matched"] == 2
    assert rows(q.check_unique(left, ["k"], ci=True)) == [("ab", 2)]


def test_ntile_never_uses_a_single_partition(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("v"))
    ranked = w.ntile_bucket(df, 5, "v", "id")
    final = plan_of(ranked)
    # Only the one-number-per-partition table may be in one task.
    assert final.count("SinglePartition") <= 1


def test_dominant_row_nulls_and_ties(spark):
    data = [
        ("a", "03", None, 9.0),
        ("a", "02", 0.5, None),
        ("a", "01", 0.5, 0.1),
        ("b", "09", 0.2, 0.2),
        ("b", "08", 0.2, 0.2),
        ("c", "05", None, None),
        (None, "07", 1.0, 1.0),
    ]
    df = spark.createDataFrame(data, "k string, t string, x double, y double")
    best = w.dominant_row(df, "k", ["x", "y"], "t", size="n")
    assert rows(best.select("k", "t", "n")) == [(None, "07", 1), ("a", "01", 3), ("b", "08", 2), ("c", "05", 1)]
    assert "Window" not in plan_of(best)


def test_dominant_row_equals_row_number(spark):
    df = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        F.col("id").alias("t"),
        (F.xxhash64("id") % 5).alias("x"),
        F.when(F.col("id") % 7 > 0, F.xxhash64(F.col("id") + 1) % 3).alias("y"),
    )
    order = Window.partitionBy("k").orderBy(F.desc_nulls_last("x"), F.desc_nulls_last("y"), "t")
    want = df.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    assert rows(w.dominant_row(df, "k", ["x", "y"], "t")) == rows(want)


@pytest.mark.parametrize("skewed", [False, True])
def test_group_size_counts_null_keys_too(spark, skewed):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    out = w.group_size(df, "k", skewed=skewed)
    assert rows(out.select("v", "group_size")) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 1)]


@pytest.mark.parametrize("few", [True, False])
def test_delta_is_by_position_and_keeps_nulls(spark, few):
    data = [("a", 1, 10), ("a", 2, None), ("a", 3, 4), ("b", 1, None), ("b", 2, 5)]
    df = spark.createDataFrame(data, "k string, y int, v int")
    out = w.first_last_delta(df, "k", "y", ["v"], few_rows_per_key=few)
    assert rows(out.select("k", "y", "v_change")) == [
        ("a", 1, -6), ("a", 2, -6), ("a", 3, -6), ("b", 1, None), ("b", 2, None),
    ]


# --- joins -------------------------------------------------------------------


def skewed_sides(spark):
    left = spark.range(9_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 2_000).cast("string")))
        .alias("k"),
    )
    right = spark.range(1_500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), "id")
    right = right.withColumnRenamed("id", "area").union(spark.sql("select 'hot', -1L"))
    return left, right


def test_skewed_lookup_equals_plain_lookup(spark):
    left, right = skewed_sides(spark)
    plain = j.lookup_join(left, right, "k").select("id", "k", "area")
    split = j.lookup_join(left, right, "k", skewed=True).select("id", "k", "area")
    assert split.count() == 9_000
    assert rows(plain) == rows(split)


def test_frequent_keys_are_bounded_and_find_the_hot_ones(spark):
    left, _ = skewed_sides(spark)
    hashes = j.frequent_keys(left, ["k"], k=10)
    hot = [r[0] for r in spark.sql("select xxhash64('hot') union all select xxhash64(cast(null as string))").collect()]
    assert len(hashes) <= 10 and set(hot) <= set(hashes)


def test_skewed_lookup_spreads_hot_rows_and_reads_each_side_once(spark, folder):
    left, right = skewed_sides(spark)
    left.write.parquet(f"{folder}/left")
    right.write.parquet(f"{folder}/right")
    left, right = spark.read.parquet(f"{folder}/left"), spark.read.parquet(f"{folder}/right")
    joined = j.lookup_join(left, right.hint("merge"), "k", skewed=True)
    assert plan_of(joined).count("FileScan") == 2
    hot = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(j.SALTS))).filter("k = 'hot'")
    most = hot.groupBy("_salt").count().agg(F.max("count")).first()[0]
    assert most < 3 * 3_000 / j.SALTS


@pytest.mark.parametrize("skewed", [False, True])
def test_null_keys_meet_when_asked(spark, skewed):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    out = j.lookup_join(left, right, "k", skewed=skewed, null_is_key=True)
    assert rows(out.select("v", "w")) == [(1, 10), (2, 20), (3, None)]


def test_key_stats_read_the_table_twice(spark, folder):
    skewed_sides(spark)[0].write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    assert plan_of(w.group_size(df, "k", skewed=False)).count("FileScan") == 2
    assert plan_of(w.group_size(df, "k", skewed=True)).count("FileScan") == 2


def test_ranges_follow_the_input_size(spark, monkeypatch):
    df = spark.range(100_000)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert w.range_count(df) == least
    monkeypatch.setattr(w, "RANGE_BYTES", 10_000)
    assert w.range_count(df) == 80


def test_right_condition_does_not_drop_left_rows(spark):
    panel = spark.createDataFrame([("a", 1), ("b", 1)], "k string, y int")
    measures = spark.createDataFrame([("a", 1, "All", 5), ("a", 1, "65+", 6)], "k string, y int, age string, n int")
    out = j.attach_denominator(panel, measures, ["k", "y"], ["n"], F.col("age") == "All")
    assert rows(out) == [("a", 1, 5), ("b", 1, None)]


def test_coverage_and_unmatched(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "k string")
    assert rows(j.join_coverage(left, right, "k")) == [(3, 1, 2, Decimal("33.33"))]
    assert rows(j.join_coverage(left, right, "k", distinct=False)) == [(4, 2, 2, Decimal("50.00"))]
    assert rows(j.unmatched_sample(left, right, "k", ["k"])) == [(None,), ("b",)]
    none = j.join_coverage(left.limit(0), right, "k").first()
    assert tuple(none) == (0, 0, 0, None)


def test_cross_scalars_keeps_one_row(spark):
    empty = spark.range(0).agg(F.sum("id").alias("s"))
    full = spark.range(4).agg(F.count("*").alias("n"))
    assert rows(j.cross_scalars(empty, full)) == [(None, 4)]
    two = spark.createDataFrame([(1, 9), (2, 3)], "a int, b int")
    with pytest.raises(Exception, match="more than one row"):
        j.cross_scalars(two, full).collect()


# --- aggregates --------------------------------------------------------------


def test_weighted_mean_and_gap(spark):
    data = [(0, "100.00", 10), (1, "200.00", 30), (2, "90.00", 100), (7, "110.00", 300), (None, "1.00", 5), (1, None, 9)]
    df = spark.createDataFrame(data, "n int, v string, w bigint").withColumn("v", F.col("v").cast("decimal(12,2)"))
    gap = a.benchmark_gap(df, "v", "w", F.col("n").isin(0, 1), F.col("n") >= 2).first()
    assert tuple(gap) == (2, 40, Decimal("175.00"), Decimal("105.00"), Decimal("70.00"), Decimal(2800))


def test_gap_of_nothing_is_one_row_of_nulls(spark):
    df = spark.createDataFrame([], "n int, v decimal(12,2), w bigint")
    gap = a.benchmark_gap(df, "v", "w", F.col("n") < 2, F.col("n") >= 2)
    assert rows(gap) == [(0, None, None, None, None, None)]


def test_zero_weight_is_null(spark):
    df = spark.createDataFrame([(5, 0)], "v int, w int")
    assert df.agg(a.weighted_mean("v", "w")).first()[0] is None


def test_distribution_with_share(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    out = a.distribution(df, ["k"], pct="p")
    assert rows(out) == [(None, 1, Decimal("33.33")), ("a", 2, Decimal("66.67"))]
    assert "Window" not in plan_of(out)


def test_multiplicity_completeness_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 3), (None, 4)], "k string, v int")
    assert rows(a.key_multiplicity(df, "k")) == [(2, 4, 2)]
    assert rows(a.completeness(df, ["v"])) == [(4, 3, 1, Decimal("25.00"))]
    assert [tuple(r) for r in a.top_groups(df, "k", 2).collect()] == [("a", 2), (None, 1)]
    assert "TakeOrderedAndProject" in plan_of(a.top_groups(df, "k", 2))


# --- quality -----------------------------------------------------------------


def test_row_count_gate_and_report(spark):
    df = spark.range(95)
    assert rows(q.check_row_count(df, 100, 0.1)) == [(95, 100, 1)]
    assert rows(q.check_row_count(df, 100)) == [(95, 100, 0)]
    assert rows(q.check_row_count(df, spark.range(50).agg(2 * F.count("*")), 0.1)) == [(95, 100, 1)]
    assert rows(q.load_report(df, "raw.t")) == [("raw.t", 95, None, "Rows loaded into raw.t: 95")]


def test_unique_and_not_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    assert rows(q.check_unique(df, ["k", "v"])) == [("a", 1, 2)]
    assert rows(q.check_not_null(df, ["k", "v"])) == [("k", 0), ("v", 1)]
    with pytest.raises(q.CheckFailed, match="twice"):
        q.require_empty(q.check_unique(df, ["k"]), "twice")


def test_profile(spark):
    df = spark.createDataFrame([("a ", "*"), ("bcd", None)], "ER_x string, other string")
    out = q.profile_columns(df, ["ER_x"])
    got = {r["column_name"]: r for r in out.collect()}
    assert (got["ER_x"]["min_length"], got["ER_x"]["max_length"]) == (1, 3)
    assert (got["other"]["null_count"], got["other"]["marker_count"], got["other"]["position"]) == (1, 1, 2)
    with pytest.raises(q.CheckFailed, match="missing: NOPE"):
        q.profile_columns(df, ["NOPE"])


def test_tie_back_and_dominant_check(spark):
    early = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    late = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, v int")
    assert rows(q.tie_back(early, late, ["k"], "v")) == [("b", 3, 2)]
    raw = spark.createDataFrame([("z", "1", 0.1), ("z", "2", 0.9), ("y", "1", 0.5)], "k string, t string, x double")
    good = w.dominant_row(raw, "k", ["x"], "t")
    assert q.verify_dominant(raw, good, "k", ["x"], "t").count() == 0
    bad = raw.filter("t = '1'")
    assert rows(q.verify_dominant(raw, bad, "k", ["x"], "t")) == [("z", "2", "1")]


def test_lookup_chooses_by_the_size_of_the_lookup(spark):
    left, right = skewed_sides(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert j._bytes("10485760b") == j._bytes("10MB") == 10485760 and j._bytes("-1") == -1
    assert j.fits_broadcast(right.filter("area < 5").limit(3))
    assert "xxhash64" not in plan_of(j.lookup_join(left, right.limit(3), "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "xxhash64" in plan_of(j.lookup_join(left, right, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_delta_of_null_key(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 2, 3), ("b", 1, 5)], "k string, y int, v int")
    out = w.first_last_delta(df, "k", "y", ["v"])
    assert rows(out.select("k", "y", "v_change")) == [(None, 1, -7), (None, 2, -7), ("b", 1, 0)]
