"""A panel kept up to date, and tables compared by their hashes."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from accesspanel.operators import lifecycle, reconcile

YEARS = (2019, 2020, 2021)
ENTITIES = "npi string, county_fips string, enumeration_date date, deactivation_date date, reactivation_date date"


def registry(rng, n):
    def day():
        return dt.date(2017, 1, 1) + dt.timedelta(days=rng.randrange(2000))

    return [
        (f"{i}", rng.choice(["a", "b", "c", None]), rng.choice([None, day(), day()]), rng.choice([None, day()]), rng.choice([None, day()]))
        for i in range(n)
    ]


def test_merged_panel_equals_a_rebuild(spark):
    rng = random.Random(2)
    old = registry(rng, 400)
    other = registry(rng, 400)
    new = [other[i] if rng.random() < 0.02 else r for i, r in enumerate(old) if rng.random() > 0.01]
    new += [("n1", "only new", dt.date(2018, 1, 1), None, None), (None, "a", dt.date(2018, 1, 1), None, None)]
    old += [("o1", "only old", dt.date(2018, 1, 1), None, None), old[5], (None, "b", dt.date(2018, 1, 1), None, None)]
    before_df, after_df = spark.createDataFrame(old, ENTITIES), spark.createDataFrame(new, ENTITIES)
    weights = spark.createDataFrame([(a, y, 100 + y) for a in "abc" for y in YEARS], "county_fips string, year_id int, benes_ffs_cnt int")
    before, after = lifecycle.snapshot_changes(before_df, after_df, "npi")
    assert 0 < before.count() < 60 and 0 < after.count() < 60
    merged = lifecycle.merge_partials(lifecycle.partial_counts(before_df, YEARS), before, after, YEARS)
    assert rows(merged.select(sorted(merged.columns))) == rows(
        lifecycle.partial_counts(after_df, YEARS).select(sorted(merged.columns))
    )
    assert rows(lifecycle.unfold_panel(merged, weights, YEARS)) == rows(lifecycle.build_panel(after_df, weights, YEARS))
    same = lifecycle.snapshot_changes(before_df, before_df, "npi")
    assert same[0].count() == same[1].count() == 0


def test_reconcile_names_all_changes_and_reads_their_buckets_only(spark, folder):
    df = spark.range(5_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") % 7).alias("v"), F.lit("t").alias("n"))
    later = df.where("k <> 44 OR k IS NULL").withColumn("v", F.when(F.coalesce("k", F.lit(0)).isin(0, 123, 4000), -1).otherwise(F.col("v")))
    later = later.union(spark.createDataFrame([(9_999, 1, "t"), (77, 0, "t")], "k bigint, v bigint, n string"))
    reconcile.write_hashed(df, folder, "raw", "a", ["k"], 200)
    reconcile.write_hashed(later, folder, "raw", "b", ["k"], 200)
    a, b = (folder, "raw", "a"), (folder, "raw", "b")
    found = reconcile.reconcile(spark, a, b, ["k"])
    assert rows(found) == [(None, "changed"), (44, "removed"), (77, "changed"), (123, "changed"), (4000, "changed"), (9999, "added")]
    trees = [reconcile.read_hashed(spark, *t)[1] for t in (a, b)]
    assert len(reconcile.differing_buckets(*trees)) <= 6
    assert "PartitionFilters: [_key_bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert reconcile.reconcile(spark, a, a, ["k"]).count() == 0
    reconcile.write_hashed(df.limit(0), folder, "raw", "none", ["k"], 200)
    gone = reconcile.reconcile(spark, a, (folder, "raw", "none"), ["k"])
    assert gone.where("change = 'removed'").count() == gone.count() == 5_000


def test_reconcile_refuses_other_columns(spark, folder):
    reconcile.write_hashed(spark.range(3), folder, "raw", "a", ["id"], 4)
    reconcile.write_hashed(spark.range(3).withColumn("x", F.lit(1)), folder, "raw", "b", ["id"], 4)
    with pytest.raises(ValueError, match="different columns"):
        reconcile.reconcile(spark, (folder, "raw", "a"), (folder, "raw", "b"), ["id"])
