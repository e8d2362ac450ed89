"""What the physical plans must look like, with broadcasts switched off where
the question is what happens to sides too large for one."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from accesspanel.catalogue import derived
from accesspanel.operators import joins, lifecycle
from accesspanel.plans import builders, questions

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")


@pytest.fixture
def large_sides(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fact(spark):
    return derived.staged(spark, SF_DIR, "curated.fact_county_year")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_of(questions.fragility_gap(fact(spark), derived.YEAR))
    assert "EqualTo(year_id,2000)" in text and "GreaterThanOrEqual(rucc_code,4)" in text
    assert "pqi03" not in text and "county_desc" not in text


def test_level_filter_reaches_the_raw_scan(spark):
    raw = derived.staged(spark, SF_DIR, "raw.medicare_spending")
    text = plan_of(builders.clean_medicare(raw, derived.CODE_WIDTH).select("county_fips", "year_id"))
    assert "EqualTo(BENE_GEO_LVL,County)" in text and "PQI" not in text


def test_gap_is_one_pass_with_one_exchange(spark):
    text = plan_of(questions.fragility_gap(fact(spark), derived.YEAR))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_panel_builder_shuffles_each_side_once(spark, large_sides):
    panel = builders.county_year_panel(
        derived.staged(spark, SF_DIR, "clean.pharmacies"),
        derived.staged(spark, SF_DIR, "clean.medicare_spending"),
        derived.YEARS,
        derived.CODE_WIDTH,
    )
    text = plan_of(panel)
    assert text.count("Exchange hashpartitioning") == 2
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["clean.zip_to_fips", "curated.county_year_panel", "curated.fact_county_year"])
def test_no_single_task_and_no_python(spark, large_sides, name):
    text = plan_of(derived.derive(spark, SF_DIR, name))
    assert "SinglePartition" not in text and "Python" not in text and "Cartesian" not in text


def test_top_lists_keep_k_rows_per_task(spark):
    text = plan_of(questions.highest_spend(fact(spark), derived.YEAR))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_summaries_combine_before_the_exchange(spark):
    text = plan_of(questions.tier_summary(fact(spark), derived.YEAR))
    assert "partial_sum" in text and text.count("Exchange hashpartitioning") == 1


def test_changed_files_are_read_anew(spark, folder):
    for name in derived.SOURCES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    before = derived.staged(spark, folder, "raw.rucc_codes").count()
    twice = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    twice.union(twice.withColumn("c_custkey", F.col("c_custkey") + 100_000)).write.mode("overwrite").parquet(
        f"{folder}/customer.parquet"
    )
    assert derived.staged(spark, folder, "raw.rucc_codes").count() == 2 * before


def scans(text):
    return text.count("FileScan")


def test_concentration_has_no_single_task_window(spark, large_sides):
    text = plan_of(questions.excess_concentration(fact(spark), derived.YEAR, None))
    # the areas are read from the written ranges: their rows and their one total per range
    assert scans(text) == 2 and "year_id" not in text
    assert "Window" in text and text.count("SinglePartition") <= 1  # totals per range only


def test_buckets_need_no_sort_of_the_year(spark):
    text = plan_of(questions.stratified_contrast(fact(spark), derived.YEAR))
    assert text.count("county_year") <= 1 and "Window" not in text
    assert text.count("rangepartitioning") <= 1  # the order of the result


def test_entry_runs_with_a_small_heap(folder):
    """The headline in a session of its own with 1 GB of driver heap."""
    import subprocess
    import sys

    code = (
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false')"
        ".config('spark.driver.memory', '1g').config('spark.sql.shuffle.partitions', '4')"
        f".config('spark.checkpoint.dir', '{folder}').getOrCreate()\n"
        "df = e.entry(s)\n"
        "print('rows', len(df.collect()), df._jdf.queryExecution().tracker().phases().apply('optimization').durationMs())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=280)
    words = done.stdout.split()
    assert words[:2] == ["rows", "1"], done.stderr[-2000:]
    assert int(words[2]) < 3_000


def test_bucketed_tables_are_joined_where_they_lie(spark, large_sides):
    from accesspanel.catalogue.table_queries import bucketed_layers
    from accesspanel.sources import bucketed

    root, medicare, codes, panel = bucketed_layers(spark, SF_DIR)
    pharmacies = bucketed.read_bucketed(spark, root, "clean", "pharmacies")
    again = builders.county_year_panel(pharmacies, medicare, derived.YEARS, derived.CODE_WIDTH)
    joined = builders.fact_from_buckets(medicare, panel, codes, derived.YEARS, derived.CODE_WIDTH)
    for df in (again, joined):
        text = plan_of(df)
        assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text
    want = derived.staged(spark, SF_DIR, "curated.fact_county_year")
    assert joined.exceptAll(want).isEmpty() and want.exceptAll(joined).isEmpty()
    # a table registered anew from its files knows its layout too
    text = plan_of(bucketed.read_bucketed(spark, root, "curated", "county_year_panel").groupBy("county_fips").count())
    assert "Exchange" not in text


def test_bucketed_rewrite_and_null_keys(spark, folder):
    from accesspanel.sources import bucketed

    left = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (None, 5, "c"), (2, None, "d")], "k int, y int, l string")
    right = spark.createDataFrame([(1, 5, "x"), (None, 5, "n"), (2, 7, "z")], "k int, y int, r string")
    bucketed.write_bucketed(right.limit(0), folder, "clean", "right", "k", 3)
    a = bucketed.write_bucketed(left, folder, "clean", "left", "k", 3)
    b = bucketed.write_bucketed(right, folder, "clean", "right", "k", 3)
    want = sorted([(1, 5, "a", "x"), (1, 6, "b", None), (None, 5, "c", None), (2, None, "d", None)], key=str)
    assert sorted(map(tuple, bucketed.colocated_join(a, b, "k", ["y"]).collect()), key=str) == want
    assert bucketed.read_bucketed(spark, folder, "clean", "right").count() == 3


def test_crosswalk_reads_the_lines_once(spark, large_sides):
    text = plan_of(derived.raw_crosswalk(spark, SF_DIR))
    # before, pairs and their totals were each built from the lines
    assert text.count("lineitem.parquet") == 1


def given(spark, folder):
    """A repeated customer, a line without a part, orders without a customer or with an unknown one."""
    tables = {
        "region": ([(0, "EAST")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(1, "c1", 0, 1.0, "X"), (1, "c1", 1, 1.0, "X"), (1, "c1", 1, 1.0, "X"), (2, "c2", 0, 2.0, "Y"), (None, "c", 0, 0.0, "Y")],
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "orders": ([(1, 1), (2, 2), (3, None), (4, 9)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": (
            [(1, 7, 1.0, 1.0, "R"), (1, 7, 2.0, 2.0, "N"), (2, 7, 1.0, 3.0, "A"), (3, 7, 4.0, 2.0, "R"), (4, 8, 3.0, 3.0, "N"),
             (2, None, 5.0, 5.0, "R"), (5, 7, 9.0, 9.0, "R"), (2, 8, None, 1.0, "R")],
            "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string",
        ),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("hot_lines", [1_000_000, 1])
def test_crosswalk_shares_of_repeated_and_unknown_keys(spark, folder, monkeypatch, hot_lines):
    monkeypatch.setattr(derived, "HOT_LINES", hot_lines)
    got = derived.raw_crosswalk(spark, given(spark, folder)).select("zip", "county_fips", "usps_zip_pref_state", "bus_ratio", "tot_ratio")
    one = (" 0.37500000", "0.50000000")
    assert rows(got) == [
        (None, " 2", "AE", None, None),
        ("7", None, None, " 0.50000000", "0.25000000"),
        ("7", " 1", "AE", *one),
        ("7", " 1", "BE", *one),
        ("7", " 1", "BE", *one),
        ("7", " 2", "AE", " 0.12500000", "0.25000000"),
        ("8", " 2", "AE", None, "0.50000000"),
        ("8", " 9", None, " 1.00000000", "0.50000000"),
    ]


def test_keys_of_orders_are_sought_before_a_join(spark, large_sides, monkeypatch):
    sought = []
    plain = joins.lookup_join
    monkeypatch.setattr(derived, "lookup_join", lambda left, *more: sought.append(plan_of(left)) or plain(left, *more))
    derived.raw_pharmacies(spark, SF_DIR)
    assert sought and not any("Exchange" in text for text in sought)


def test_fact_shuffles_each_side_once(spark, large_sides):
    base = spark.range(9).selectExpr("cast(id % 3 AS string) AS county_fips", "cast(id div 3 AS int) AS year_id", "id AS spend")
    panel = base.where("id <> 4").selectExpr("county_fips", "year_id", "spend * 2 AS active")
    codes = spark.range(2).selectExpr("cast(id AS string) AS county_fips", "id + 10 AS code")
    base, panel, codes = (df.repartition(2) for df in (base, panel, codes))
    got = joins.assemble_fact(base, panel, codes)
    assert plan_of(got).count("Exchange hashpartitioning") == 3
    assert got.columns == ["county_fips", "year_id", "spend", "active", "code"]
    expected = [(str(i % 3), i // 3, i, None if i == 4 else 2 * i, i % 3 + 10 if i % 3 < 2 else None) for i in range(9)]
    assert rows(got) == sorted(expected, key=lambda r: r[:2])


def test_stored_counts_are_one_aggregate(spark, large_sides):
    entities = derived.staged(spark, SF_DIR, "clean.pharmacies")
    text = plan_of(lifecycle.partial_counts(entities, derived.YEARS))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_changes_are_found_once(spark, large_sides):
    old = spark.range(100).selectExpr("id AS npi", "id % 7 AS v").repartition(2)
    new = old.selectExpr("npi", "if(npi = 5, 50, v) AS v")
    before, after = lifecycle.snapshot_changes(old, new, "npi")
    assert "bit_xor" not in plan_of(before) and rows(before) == [(5, 5)] and rows(after) == [(5, 50)]


def moved(spark, df):
    """Name and type of the columns of every shuffle by hash."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        open_nodes, found = [df.select("*")._jdf.queryExecution().executedPlan()], []
        while open_nodes:
            node = open_nodes.pop()
            if node.nodeName() == "Exchange" and "hashpartitioning" in node.outputPartitioning().toString():
                columns = node.output()
                found.append({columns.apply(i).name(): columns.apply(i).dataType().simpleString() for i in range(columns.size())})
            children = node.children()
            open_nodes += [children.apply(i) for i in range(children.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found
    return found


def test_orders_and_lines_are_moved_without_what_is_read_off_them(spark, large_sides):
    steps = (derived.raw_pharmacies, derived.lines, derived.part_lines)
    pharmacies, lines, part_lines = ({c for shuffle in moved(spark, step(spark, SF_DIR)) for c in shuffle} for step in steps)
    assert not pharmacies & {"o_totalprice", "o_orderdate"}
    assert "o_orderdate" not in lines
    assert "l_returnflag" not in part_lines


def test_providers_are_typed_before_they_are_moved(spark, large_sides):
    raw, crosswalk = (derived.staged(spark, SF_DIR, n) for n in ("raw.pharmacies", "clean.zip_to_fips"))
    dates = {"enumeration_date", "last_update_date", "deactivation_date", "reactivation_date"}
    providers = [m for m in moved(spark, builders.clean_pharmacies(raw, crosswalk, derived.CODE_WIDTH)) if "npi" in m]
    assert providers
    for columns in providers:
        assert {columns[d] for d in dates} == {"date"} and "postal_code" not in columns


def test_prices_at_the_limits_of_a_band(spark, folder):
    given(spark, folder)
    prices = [None, 1999.99, 2000.0, 2999.99, 3000.0, 495_000.0, 495_000.01, float("nan")]
    orders = spark.createDataFrame(
        [(i, 2, "F", p, "5-LOW") for i, p in enumerate(prices)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    )
    orders.withColumn("o_orderdate", F.lit("1996-03-01").cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    got = derived.raw_pharmacies(spark, folder).select(F.trim("npi").cast("int"), "enumeration_date", "deactivation_date")
    day, end = "03/01/1996", "09/17/1996"
    want = [(day, end), ("13/45/2001", end), (" ", end), (" ", end), (day, end), (day, end), (day, "unknown"), (day, "unknown")]
    assert rows(got) == [(i, *w) for i, w in enumerate(want)]
