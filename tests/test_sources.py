import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from accesspanel.sources import tables
from accesspanel.sources.contracts import Contract, Field, conform, quarantine


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def test_quoted_comma_and_positional_names(spark, folder):
    path = put(folder, "a.csv", 'Name Of Org,Z\n"BIOSCRIP PHARMACY, INC.",1\n"say ""hi""",\nÅ,""\n')
    df = tables.load_raw_csv(spark, path, ["org", "zip"])
    assert df.schema.simpleString() == "struct<org:string,zip:string>"
    assert rows(df) == [("BIOSCRIP PHARMACY, INC.", "1"), ('say "hi"', None), ("Å", None)]


def test_header_names_when_no_columns_given(spark, folder):
    path = put(folder, "a.csv", "YEAR,LVL\r\n2020,County\r\n")
    assert rows(tables.load_raw_csv(spark, path)) == [("2020", "County")]


@pytest.mark.parametrize("bad", ["1\n", "1,2,3\n"])
def test_bad_row_fails_the_load(spark, folder, bad):
    path = put(folder, "a.csv", "a,b\n1,2\n" + bad)
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_raw_csv(spark, path, ["a", "b"]).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_raw_csv(spark, path, ["a", "b"]).select("a").collect()


def test_carriage_return_left_by_line_feed_split(spark, folder):
    path = put(folder, "a.csv", "a,b\r\n1,2\r\n3,\r\n")
    df = tables.load_raw_csv(spark, path, ["a", "b"], line_sep="\n")
    assert [r["b"] for r in df.collect()] == ["2\r", "\r"]
    assert rows(tables.strip_trailing_cr(df, "b")) == [("1", "2"), ("3", "")]


def test_periods(spark):
    assert rows(tables.periods(spark, 2019, 2021)) == [(2019,), (2020,), (2021,)]


def test_rewrite_replaces(spark, folder):
    tables.write_layer(spark.range(10), folder, "raw", "t")
    again = tables.write_layer(spark.range(3), folder, "raw", "t", cluster_by=["id"])
    assert again.count() == 3
    assert tables.read_layer(spark, folder, "raw", "t").count() == 3


def test_export_is_one_total_order(spark, folder):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit(" a,b ").alias("t"))
    path = os.path.join(folder, "out")
    tables.export_csv(df, path, order_by=["k"])
    seen = []
    for name in sorted(f for f in os.listdir(path) if f.endswith(".csv")):
        with open(os.path.join(path, name)) as f:
            lines = f.read().splitlines()
        assert lines[0] == "k,t"
        seen += [int(line.split(",")[0]) for line in lines[1:]]
    assert seen == list(range(1000))
    assert tables.load_raw_csv(spark, path).first()["t"] == " a,b "


RULE = Contract(
    "clean.t",
    (Field("k", "string", 3, True), Field("n", "smallint"), Field("d", "date")),
    ("k",),
)


def test_conform_casts_and_orders(spark):
    df = spark.createDataFrame([("2020-01-02", "7", "abc  ", 1)], "d string, n string, k string, extra int")
    out = conform(df, RULE)
    assert out.schema.simpleString() == "struct<k:string,n:smallint,d:date>"
    assert out.first()["n"] == 7


@pytest.mark.parametrize(
    "row,reason",
    [
        ((None, "1", None), "k: required value missing"),
        (("abcd", "1", None), "k: longer than 3"),
        (("a", "99999", None), "n: does not fit smallint"),
        (("a", "1", "junk"), "d: does not fit date"),
    ],
)
def test_bad_rows_fail_or_are_set_aside(spark, row, reason):
    df = spark.createDataFrame([row, ("ok", "1", None)], "k string, n string, d string")
    with pytest.raises(Exception, match="breaks the contract"):
        conform(df, RULE).collect()
    with pytest.raises(Exception, match="breaks the contract"):
        conform(df, RULE).select("d").collect()
    assert [r["k"] for r in conform(df, RULE, "drop").collect()] == ["ok"]
    assert [r["violation"] for r in quarantine(df, RULE).collect()] == [reason]


def test_conform_names_missing_columns(spark):
    with pytest.raises(ValueError, match="n, d"):
        conform(spark.createDataFrame([("a",)], "k string"), RULE)


def test_staging_uses_the_shared_folder(spark):
    assert tables.staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = tables.materialize(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].find(spark.conf.get("spark.checkpoint.dir")) >= 0


@pytest.mark.parametrize("master,local", [("", False), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_temporary_folders_are_for_local_mode_only(master, local):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": master} if master else {})

    if local:
        assert tables.staging_root(Session()) == Session.conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.staging_root(Session())


@pytest.mark.parametrize("columns", [None, ["a", "b"]])
def test_unread_columns_are_checked_too(spark, folder, columns):
    path = os.path.join(folder, "bad.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_raw_csv(spark, path, columns).select("a").collect()
