import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from accesspanel.functions import cleaning as c
from accesspanel.functions import measures as m
from accesspanel.functions import predicates as p


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text,expected",
    [(" * ", None), ("", None), ("   ", None), (None, None), (" 12 ", "12"), ("**", "**")],
)
def test_null_markers(spark, text, expected):
    assert one(spark, c.null_markers("x"), x=text) == expected


@pytest.mark.parametrize(
    "text,dtype,expected",
    [
        (" 12 ", "int", 12),
        ("12.5", "int", None),
        ("99999999999", "int", None),
        ("*", "int", None),
        ("", "bigint", None),
        ("1.005", "decimal(12,2)", Decimal("1.01")),
        ("1e3", "decimal(12,2)", None),
        ("-.5", "decimal(12,2)", Decimal("-0.50")),
        ("99999999999.00", "decimal(12,2)", None),
        ("7.5642e-05", "double", 7.5642e-05),
        ("NaN", "double", None),
        ("1d", "double", None),
        ("abc", "double", None),
        ("200", "ubyte", 200),
        ("255", "ubyte", 255),
        ("256", "ubyte", None),
        ("-1", "ubyte", None),
        ("007", "ubyte", 7),
    ],
)
def test_safe_cast(spark, text, dtype, expected):
    assert one(spark, c.safe_cast("x", dtype), x=text) == expected


def test_safe_cast_numeric_marker(spark):
    assert one(spark, c.safe_cast("x", "int", ("-99",)), x=" -99 ") is None
    assert one(spark, c.safe_cast("x", "int", ("-99",)), x="-98") == -98


@pytest.mark.parametrize(
    "text,expected",
    [("1.0", 1), (" 9.0 ", 9), ("1.7", 1), ("1.96", 2), ("", None), ("x", None), ("100.0", None), ("-1.0", None)],
)
def test_int_via_decimal(spark, text, expected):
    assert one(spark, c.safe_int_via_decimal("x"), x=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("03/19/2007", dt.date(2007, 3, 19)),
        (" 3/9/2007 ", dt.date(2007, 3, 9)),
        ("13/45/2001", None),
        ("02/30/2001", None),
        ("", None),
        (None, None),
        ("2007-03-19", None),
    ],
)
def test_safe_date(spark, text, expected):
    assert one(spark, c.safe_date("x"), x=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("1081", "01081"), (" 601 ", "00601"), ("1234567", "34567"), ("", "00000"), (None, None)],
)
def test_zero_pad_keeps_last(spark, text, expected):
    assert one(spark, c.zero_pad("x"), x=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("285572918", "28557"), ("28557", "28557"), ("1234", "01234"), (" 74960-3806 ", "74960"), ("", "00000")],
)
def test_zip5(spark, text, expected):
    assert one(spark, c.zip5("x"), x=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("FL-Miami-Dade", ("FL", "Miami-Dade")),
        ("TX- Upton ", ("TX", "Upton")),
        ("National", (None, "National")),
        (None, (None, None)),
    ],
)
def test_split_first(spark, text, expected):
    code, rest = c.split_first("x")
    assert (one(spark, code, x=text), one(spark, rest, x=text)) == expected


def test_text_helpers(spark):
    assert one(spark, c.code_prefix("x"), x=" Texas") == "Te"
    assert one(spark, c.clean_text("x"), x="  ") is None
    assert one(spark, c.text_length("x"), x="ab  ") == 2
    assert one(spark, c.label_null("x"), x=None) == "NULL"
    assert one(spark, c.match_label("x"), x=None) == "Unmatched"
    assert one(spark, c.fold_case("x"), x="AbC ") == "abc"


@pytest.mark.parametrize(
    "start,end,restart,expected",
    [
        ("", "01/01/2001", "", None),
        ("01/01/2000", " ", "", "Active"),
        ("01/01/2000", "01/01/2001", "", "Closed"),
        ("01/01/2000", "01/01/2001", "01/01/2002", "Active"),
        ("01/01/2000", "01/01/2001", "01/01/2000", "Closed"),
        ("01/01/2000", "unreadable", "", "Closed"),
        ("unreadable", "", "", "Active"),
    ],
)
def test_lifecycle_status(spark, start, end, restart, expected):
    assert one(spark, c.lifecycle_status("a", "b", "c"), a=start, b=end, c=restart) == expected


@pytest.mark.parametrize(
    "text,expected", [("5", "ok"), (" * ", "suppressed"), (" ", "blank"), (None, "blank"), ("5x", "unparseable")]
)
def test_cast_reason(spark, text, expected):
    assert one(spark, c.cast_reason("x", "int"), x=text) == expected


def test_first_match_slot(spark):
    code, slot = c.first_match_slot(["a", "b", "c"], "3336")
    values = dict(a="1835", b=None, c=" 3336C ")
    assert (one(spark, code, **values), one(spark, slot, **values)) == ("3336C", 3)
    none = dict(a="1", b="2", c=None)
    assert (one(spark, code, **none), one(spark, slot, **none)) == (None, None)


def test_ratio_and_rate(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 3), (5, None), (4, 1)], "n int, d int")
    out = df.select(m.safe_ratio("n", "d").alias("r"), m.rate_per("n", "d").alias("p")).collect()
    assert [r["r"] for r in out] == [Decimal("0.333333"), None, None, None, Decimal("4.000000")]
    assert [r["p"] for r in out] == [Decimal("3333.3333"), None, None, None, Decimal("40000.0000")]


def test_rate_that_does_not_fit_is_null(spark):
    assert one(spark, m.rate_per("n", "d"), n=1000, d=1) is None


@pytest.mark.parametrize(
    "count,expected",
    [
        (0, "0 - desert (acute)"),
        (1, "1 - fragile (1 closure from desert)"),
        (5, "2-5 pharmacies"),
        (6, "6+ pharmacies"),
    ],
)
def test_tiers(spark, count, expected):
    assert one(spark, m.tier_label("x"), x=count) == expected


def test_unknown_is_its_own_tier(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert df.select(m.tier_label("x")).first()[0] == "NULL / unknown"
    assert df.select(m.bin_label("x")).first()[0] is None


def test_predicates(spark):
    df = spark.createDataFrame([("ER_x",), ("ERAx",), ("ab\r",)], "x string")
    flags = df.select(p.starts_with("x", "ER_"), p.ends_with_cr("x"), p.contains_any("x", ["A.", "er_"]))
    assert [tuple(r) for r in flags.collect()] == [
        (True, False, True),
        (False, False, False),
        (False, True, False),
    ]
    assert one(spark, p.same_text("x", "all", ignore_case=True), x="ALL ") is True
    wide = spark.createDataFrame([(1, 2, 3)], "BENE_GEO int, BENES_CNT int, other int")
    assert p.select_columns(wide, ["^BENE"], ["^BENES"]) == ["BENE_GEO"]


def test_expressions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("1",)], "x string")
    plan = df.select(c.safe_cast("x", "decimal(12,2)"), c.safe_date("x"), c.zero_pad("x"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and F is not None
