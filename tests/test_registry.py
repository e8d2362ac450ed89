"""Every registered query against its SQL, on the smallest given tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as registry
from accesspanel.catalogue.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF_DIR}/{name}'")
    return con


#: Checks whose good result has no rows.
FINDS_NOTHING = {"v16_verify_clean_crosswalk"}


def tidy(row):
    return tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in row)


def order(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted((tidy(r[c] for c in cols) for r in df.collect()), key=order)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tidy(r[i] for i in at) for r in cursor.fetchall()), key=order)
    assert got == want
    assert got or name in FINDS_NOTHING


def test_every_query_has_sql():
    assert set(QUERIES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", ["s1_csv_round_trip", "s3_layer_rewrite", "s7_export_csv", "b4_raw_codes"])
def test_a_second_call_leaves_the_first_result(spark, name):
    first = registry.queries()[name](spark, SF_DIR)
    second = registry.queries()[name](spark, SF_DIR)
    assert first.count() == second.count()


def test_long_keys_stay_apart(spark):
    from accesspanel.catalogue.derived import CODE_WIDTH
    from accesspanel.functions.cleaning import zero_pad, zip5

    keys = ["1", "10000000001", str(2**63 - 1), str(10**18)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert df.select(zero_pad("k", CODE_WIDTH)).distinct().count() == len(keys)
    padded = df.withColumn("z", zip5("k", CODE_WIDTH))
    assert [int(r["z"]) for r in padded.collect()] == [int(k) for k in keys]


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 1
    staged = registry.queries()["q7_benchmark_gap"](spark, "/root/testdata/sf0.001").collect()
    assert rows == staged
