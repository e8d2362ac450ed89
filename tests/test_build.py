"""The whole layered run on small files in the published raw layouts."""

import csv
import datetime as dt
import os
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from accesspanel.operators.quality import CheckFailed
from accesspanel.plans import builders, questions, schemas

PHARMACIES = [
    # npi, postal code, start, end, restart
    ("1000000001", "285572918", "03/19/2007", "", ""),
    ("1000000002", "28557", "06/01/2020", "", ""),
    ("1000000003", "1234", "01/01/2010", "05/05/2021", ""),
    ("1000000004", "01234", "01/01/2010", "05/05/2020", "02/02/2022"),
    ("1000000005", "01234", "01/01/2010", "05/05/2020", "01/01/2020"),
    ("1000000006", "99999", "01/01/2010", "", ""),
    ("1000000007", "28557", "", "", ""),
    ("1000000008", "28557", "13/45/2001", "", ""),
    ("1000000009", "01234", "01/01/2010", "not a date", ""),
    ("1000000010", "40361", "12/31/2024", "", ""),
]

CROSSWALK = [
    ("28557", "37031", "MOREHEAD CITY", "NC", "0.9", "0.9", "", "0.9"),
    ("28557", "37049", "MOREHEAD CITY", "NC", "0.1", "0.1", "", "0.1"),
    ("1234", "1001", "AUTAUGA", "AL", "0.5", "7.5642e-05", "0.1", "0.5"),
    ("40361", "21017", "PARIS, KY", "KY", "0.2", "0.4", "0.1", "0.3"),
    ("40361", "21181", "PARIS, KY", "KY", "0.2", "0.4", "0.1", "0.4"),
    ("40361", "21209", "PARIS, KY", "KY", "0.2", "bad", "0.1", "0.9"),
]

CODES = [
    ("1001", " AL ", "Autauga", "58805", "2.0", "Metro area"),
    ("37031", "NC", " Carteret", "67686", "4.0", "Nonmetro"),
    ("21181", "KY", "Nicholas", "", "9.0", "Rural, remote"),
    ("78010", "VI", "St. Croix", "41004", "", ""),
]


def medicare_rows():
    out = []
    for year in range(2018, 2024):
        for desc, fips, benes, total in (
            ("AL-Autauga", "1001", "2000", "10000.00"),
            ("NC-Carteret-Banks", "37031", "5000", "9000.00"),
            ("KY-Nicholas", "21181", "300", "12000.00"),
            ("TX-Glasscock", "48173", "*", "*"),
            ("VI-St. Croix", "78010", "100", "0"),
        ):
            out.append((year, "County", desc, fips, benes, total))
        out.append((year, "State", "AL", "01", "99", "9.99"))
        out.append((year, "National", "National", "", "999", "9.99"))
    return out


def write(folder, name, header, data, end="\r\n"):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(header)
        writer.writerows(data)
    return path


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sources"))
    pharmacies = [
        (n, "2", f"SHOP {n}, INC.", "1 MAIN", "X", "NC", z, s, "01/01/2024", "DQ" if e else "", e, r, "1835", "3336C", "", "3336C", "2")
        for n, z, s, e, r in PHARMACIES
    ]
    required = schemas.RAW_MEDICARE_REQUIRED
    extra = ["MA_PRTCPTN_RATE"]
    medicare = []
    for year, level, desc, fips, benes, total in medicare_rows():
        known = {
            "YEAR": year, "BENE_GEO_LVL": level, "BENE_GEO_DESC": desc, "BENE_GEO_CD": fips, "BENE_AGE_LVL": "All",
            "BENES_FFS_CNT": benes, "BENES_TOTAL_CNT": "7", "TOT_MDCR_STDZD_PYMT_PC": total,
            "IP_MDCR_STDZD_PYMT_PC": " 3000.00 ", "OP_MDCR_STDZD_PYMT_PC": "1500.00", "ER_VISITS_PER_1000_BENES": "600",
        }
        medicare.append([known.get(c, "*") for c in [*extra, *required]])
    return {
        "pharmacies": write(folder, "p.csv", schemas.RAW_PHARMACIES.columns, pharmacies),
        "medicare": write(folder, "m.csv", [*extra, *required], medicare),
        "codes": write(folder, "c.csv", schemas.RAW_CODES.columns, CODES),
        "crosswalk": write(folder, "z.csv", schemas.RAW_CROSSWALK.columns, CROSSWALK),
    }


@pytest.fixture(scope="module")
def tables(spark, inputs, tmp_path_factory):
    return builders.build_tables(spark, inputs, str(tmp_path_factory.mktemp("layers")))


def test_contracts_are_met(tables):
    for contract in (
        schemas.clean_medicare(), schemas.clean_codes(), schemas.clean_crosswalk(), schemas.clean_pharmacies(),
        schemas.curated_panel(), schemas.curated_fact(),
    ):
        df = tables[contract.name]
        assert dict(df.dtypes) == {f.name: f.dtype for f in contract.fields}
        assert df.columns == contract.columns
    assert [len(tables[t].columns) for t in ("clean.medicare_spending", "curated.county_year_panel", "curated.fact_county_year")] == [30, 10, 37]


def test_raw_is_source_loyal(tables):
    raw = tables["raw.pharmacies"]
    assert raw.count() == len(PHARMACIES)
    assert {t for _, t in raw.dtypes} == {"string"}
    assert rows(raw.select("pharmacy_taxonomy_position").distinct()) == [("2",)]
    assert raw.filter("org_name like '%, INC.'").count() == len(PHARMACIES)


def test_clean_medicare(tables):
    df = tables["clean.medicare_spending"]
    assert df.count() == 30
    banks = df.filter("county_fips = '37031' and year_id = 2023").first()
    assert (banks["state_abbrev"], banks["county_desc"]) == ("NC", "Carteret-Banks")
    assert banks["inpatient_spend_share"] == Decimal("0.333333")
    hidden = df.filter("county_fips = '48173'").first()
    assert hidden["benes_ffs_cnt"] is None and hidden["inpatient_spend_share"] is None
    assert df.filter("county_fips = '78010'").first()["inpatient_spend_share"] is None
    assert df.filter("county_fips = '01001'").count() == 6


def test_crosswalk_winner(tables):
    df = tables["clean.zip_to_fips"]
    assert rows(df.select("zip", "county_fips", "num_counties_in_zip")) == [
        ("01234", "01001", 1), ("28557", "37031", 2), ("40361", "21181", 3),
    ]
    assert df.filter("zip = '01234'").first()["bus_ratio"] == 7.5642e-05


def test_clean_pharmacies(tables):
    df = tables["clean.pharmacies"]
    got = {r["npi"][-2:]: (r["zip5"], r["county_fips"], r["most_recent_status"]) for r in df.collect()}
    assert got["01"] == ("28557", "37031", "Active")
    assert got["03"] == ("01234", "01001", "Closed")
    assert got["04"] == ("01234", "01001", "Active")
    assert got["05"] == ("01234", "01001", "Closed")
    assert got["06"] == ("99999", None, "Active")
    assert got["07"] == ("28557", "37031", None)
    assert got["09"] == ("01234", "01001", "Closed")
    assert df.filter("npi = '1000000001'").first()["enumeration_date"] == dt.date(2007, 3, 19)


def test_panel(tables):
    df = tables["curated.county_year_panel"].orderBy("county_fips", "year_id")
    got = {}
    for r in df.collect():
        got.setdefault(r["county_fips"], []).append((r["active_pharmacies"], r["openings_in_year"], r["closures_in_year"]))
    # Unreadable end date: closed by status, yet counted as in business here.
    assert got["01001"] == [(4, 0, 0), (2, 0, 1), (1, 0, 1), (2, 0, 0), (2, 0, 0)]
    assert got["37031"] == [(1, 0, 0), (2, 1, 0), (2, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert got["21181"] == [(0, 0, 0)] * 5
    assert set(got) == {"01001", "37031", "21181"}
    carteret = df.filter("county_fips = '37031'").first()
    assert carteret["pharmacies_per_10k_benes"] == Decimal("2.0000")
    assert carteret["pharmacy_count_change_2019_2023"] == 1
    assert carteret["pharmacy_density_change_2019_2023"] == Decimal("2.0000")


def test_fact_keeps_zero_and_unknown_apart(tables):
    df = tables["curated.fact_county_year"]
    assert df.count() == 25
    year = {r["county_fips"]: r for r in df.filter("year_id = 2023").collect()}
    assert year["21181"]["active_pharmacies"] == 0
    assert year["48173"]["active_pharmacies"] is None
    assert year["48173"]["rucc_code"] is None
    assert year["78010"]["rural_urban_group"] is None
    assert (year["01001"]["rucc_code"], year["01001"]["rural_urban_group"]) == (2, "Metro")


def test_headline(tables):
    gap = questions.fragility_gap(tables["curated.fact_county_year"], 2023).first()
    assert tuple(gap) == (1, 300, Decimal("12000.00"), Decimal("9000.00"), Decimal("3000.00"), Decimal(900000))


def test_report_and_rerun(spark, tables):
    report = {r["table_name"]: r for r in builders.build_report(tables, {"raw.pharmacies": 10}).collect()}
    assert report["raw.pharmacies"]["row_count"] == report["raw.pharmacies"]["expected"] == 10
    assert report["curated.fact_county_year"]["row_count"] == 25


def test_skewed_build_gives_the_same(spark, tables):
    xwalk, raw = tables["clean.zip_to_fips"], tables["raw.pharmacies"]
    assert rows(builders.clean_pharmacies(raw, xwalk, skewed=True)) == rows(tables["clean.pharmacies"])


def test_repeated_key_stops_the_run(spark, inputs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dup"))
    twice = write(folder, "c.csv", schemas.RAW_CODES.columns, [*CODES, CODES[0]])
    with pytest.raises(CheckFailed, match="rucc_codes: repeated key"):
        builders.build_tables(spark, {**inputs, "codes": twice}, folder)


def test_missing_column_is_named(spark, inputs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("short"))
    short = write(folder, "m.csv", ["YEAR", "BENE_GEO_LVL"], [("2020", "County")])
    with pytest.raises(CheckFailed, match="BENE_GEO_DESC"):
        builders.raw_medicare(spark, short)


def test_top_lists(tables):
    panel, medicare = tables["curated.county_year_panel"], tables["clean.medicare_spending"]
    low = questions.lowest_density(panel, medicare, 2023)
    assert [r["county_fips"] for r in low.collect()] == ["37031", "01001"]
    assert low.first()["medicare_spend_per_capita"] == Decimal("9000.00")
    top = questions.highest_spend(tables["curated.fact_county_year"], 2023, 2)
    assert [r["county_fips"] for r in top.collect()] == ["21181", "01001"]


def test_excess_shares_add_up(tables):
    fact = tables["curated.fact_county_year"].withColumn("active_pharmacies", F.col("active_pharmacies") % 2)
    extra = fact.filter("county_fips = '37031'").withColumn("active_pharmacies", F.lit(5))
    out = questions.excess_concentration(fact.filter("county_fips <> '37031'").union(extra), 2023)
    assert [(r["county_fips"], r["excess"], r["running_share"]) for r in out.collect()] == [
        ("21181", Decimal("900000.00"), Decimal("1.000000"))
    ]
