"""Sources, cleaning expressions and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesspanel.catalogue.derived import (
    CODE_WIDTH,
    MIN_WEIGHT,
    YEAR,
    YEARS,
    staged,
    table,
)
from accesspanel.catalogue.registry import doubles, query
from accesspanel.functions import cleaning, measures, predicates
from accesspanel.operators.aggregates import distribution
from accesspanel.operators.quality import profile_columns
from accesspanel.operators.windows import dominant_row
from accesspanel.plans import schemas
from accesspanel.plans.builders import typed_crosswalk
from accesspanel.sources import rejects, tables, versions
from accesspanel.sources.contracts import Contract, Field, conform

PHARMACIES, MEDICARE = "raw.pharmacies", "raw.medicare_spending"
CODES, CROSSWALK = "raw.rucc_codes", "raw.zip_to_fips"
FACT = "curated.fact_county_year"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, so that no frame loses its files to a later one."""
    app = spark.sparkContext.applicationId
    return f"{tables.staging_root(spark)}/accesspanel/{app}/files/{name}-{uuid.uuid4().hex}"


def csv_of(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Path of the frame written as delimited text."""
    path = scratch(spark, name)
    tables.export_csv(df, path)
    return path


# --- sources -----------------------------------------------------------------

_TEXT_COLUMNS = schemas.RAW_PHARMACIES.columns


@query(
    "s1_csv_round_trip",
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in _TEXT_COLUMNS) + " FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    path = csv_of(spark, staged(spark, sf_dir, PHARMACIES).select(*_TEXT_COLUMNS), "s1")
    # split on line feeds only: the last column carries carriage returns
    return tables.load_raw_csv(spark, path, _TEXT_COLUMNS, line_sep="\n")


@query(
    "s2_strip_trailing_cr",
    "SELECT npi, replace(pharmacy_taxonomy_position, chr(13), '') AS pharmacy_taxonomy_position "
    "FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, PHARMACIES).select("npi", "pharmacy_taxonomy_position")
    return tables.strip_trailing_cr(raw, "pharmacy_taxonomy_position")


@query(
    "s3_layer_rewrite",
    "SELECT state, count(*) AS n FROM raw_codes GROUP BY state",
    ("raw_codes",),
)
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, CODES)
    root = scratch(spark, "layers")
    tables.write_layer(raw, root, "raw", "rewritten")
    again = tables.write_layer(raw, root, "raw", "rewritten", cluster_by=["fips"])
    return distribution(again, ["state"])


_CODES_BY_STATE = "SELECT state, count(*) AS n FROM raw_codes GROUP BY state"


@query("s3_failed_rewrite", _CODES_BY_STATE, ("raw_codes",))
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, CODES)
    root = scratch(spark, "layers")
    tables.write_layer(raw, root, "raw", "codes")
    # a rewrite that stops in the middle of its rows
    stop = F.raise_error(F.lit("stopped")).cast("string")
    broken = raw.withColumn("fips", F.when(F.crc32(F.col("fips").cast("binary")) % 50 == 7, stop).otherwise(F.col("fips")))
    try:
        tables.write_layer(broken, root, "raw", "codes")
    except Exception as e:  # noqa: BLE001  (Spark's own, by kind of failure)
        if "stopped" not in str(e):
            raise
    return distribution(tables.read_layer(spark, root, "raw", "codes"), ["state"])


@query("s3_restored_version", _CODES_BY_STATE, ("raw_codes",))
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, CODES)
    root = scratch(spark, "layers")
    tables.write_layer(raw, root, "raw", "codes")
    tables.write_layer(raw.where("rucc_2023 > '5'"), root, "raw", "codes", cluster_by=["fips"])
    versions.restore_previous(spark, tables.layer_path(root, "raw", "codes"))
    return distribution(tables.read_layer(spark, root, "raw", "codes"), ["state"])


def _lines(spark, sf_dir):
    """Orders as delimited text; some rows lack a field or a closing quote."""
    key = F.col("o_orderkey").cast("string")
    short = F.concat(key, F.lit(",ORDER"))
    unclosed = F.concat(key, F.lit(',"ORDER '), key, F.lit(","), F.col("o_orderstatus"))
    good = F.concat(key, F.lit(',"ORDER ""'), key, F.lit('"", INC.",'), F.col("o_orderstatus"))
    line = F.when(F.col("o_orderkey") % 97 == 0, short).when(F.col("o_orderkey") % 89 == 0, unclosed).otherwise(good)
    path = scratch(spark, "lines")
    out = table(spark, sf_dir, "orders").select(line.alias("key,name,status"))
    out.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


_LINE_SQL = (
    "SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey || ',ORDER' WHEN o_orderkey % 89 = 0 "
    "THEN o_orderkey || ',\"ORDER ' || o_orderkey || ',' || o_orderstatus END AS row_text, CASE WHEN o_orderkey % 97 = 0 "
    "THEN 'wrong number of fields' WHEN o_orderkey % 89 = 0 THEN 'unbalanced quote' END AS reject_reason FROM orders"
)


@query("s1_rejected_rows", f"SELECT row_text, reject_reason FROM ({_LINE_SQL}) WHERE reject_reason IS NOT NULL")
def _(spark, sf_dir):
    _, bad = rejects.load_with_rejects(spark, _lines(spark, sf_dir), scratch(spark, "layers"), "orders", ["key", "name", "status"])
    return bad.select("row_text", "reject_reason")


@query(
    "s1_rows_beside_rejects",
    "SELECT o_orderkey::VARCHAR AS \"key\", 'ORDER \"' || o_orderkey || '\", INC.' AS name, o_orderstatus AS status "
    f"FROM ({_LINE_SQL}) WHERE reject_reason IS NULL",
)
def _(spark, sf_dir):
    good, _ = rejects.load_with_rejects(spark, _lines(spark, sf_dir), scratch(spark, "layers"), "orders")
    return good


@query(
    "s1_reject_counts",
    f"SELECT reject_reason, count(*) AS n FROM ({_LINE_SQL}) WHERE reject_reason IS NOT NULL GROUP BY 1",
)
def _(spark, sf_dir):
    _, bad = rejects.load_with_rejects(spark, _lines(spark, sf_dir), scratch(spark, "layers"), "orders")
    return rejects.reject_report(bad).groupBy("reject_reason").agg(F.sum("n").alias("n"))


_TYPED = Contract(
    "typed.measures",
    (
        Field("geo", "string", 20, True),
        Field("year_id", "int", required=True),
        Field("people", "bigint", required=True),
        Field("returned_pct", "decimal(8,4)"),
    ),
)


@query(
    "s4_conform",
    'SELECT BENE_GEO_LVL AS geo, "YEAR"::INTEGER AS year_id, BENES_TOTAL_CNT::BIGINT AS people, '
    "ACUTE_HOSP_READMSN_PCT::DECIMAL(8,4)::DOUBLE AS returned_pct FROM raw_medicare",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, MEDICARE).select(
        F.col("BENE_GEO_LVL").alias("geo"),
        F.col("YEAR").alias("year_id"),
        F.col("BENES_TOTAL_CNT").alias("people"),
        F.col("ACUTE_HOSP_READMSN_PCT").alias("returned_pct"),
    )
    return conform(raw, _TYPED)


@query(
    "s5_periods",
    "SELECT y::INTEGER AS period, count(o_orderkey) AS n FROM range(1993, 2004) t(y) "
    "LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    per_year = distribution(orders, {"period": F.year("o_orderdate")})
    grid = tables.periods(spark, 1993, 2003)
    return grid.join(per_year, ["period"], "left").select(
        "period", F.coalesce("n", F.lit(0)).alias("n")
    )


_LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


@query(
    "s6_schema_scan",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS \"position\", count(*) AS row_count FROM lineitem"
        for i, c in enumerate(_LINE_COLUMNS, start=1)
    ),
)
def _(spark, sf_dir):
    profile = profile_columns(table(spark, sf_dir, "lineitem"), required=_LINE_COLUMNS)
    return profile.select("column_name", "position", "row_count")


def _exported(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    fact = staged(spark, sf_dir, FACT).filter(F.col("year_id").between(first, last))
    path = scratch(spark, "fact_csv")
    tables.export_csv(fact, path, order_by=["county_fips", "year_id"])
    loaded = tables.load_raw_csv(spark, path)
    return loaded.select(
        "county_fips",
        F.col("year_id").cast("int").alias("year_id"),
        F.col("tot_mdcr_stdzd_pymt_pc").cast("double").alias("spend"),
    )


EXPORT_SQL = "SELECT county_fips, year_id, tot_mdcr_stdzd_pymt_pc::DOUBLE AS spend FROM fact WHERE year_id BETWEEN "


@query("s7_export_csv", f"{EXPORT_SQL}{YEARS[0]} AND {YEARS[-1]}", ("fact",))
def _(spark, sf_dir):
    return _exported(spark, sf_dir, YEARS[0], YEARS[-1])


@query("s7_export_one_year", f"{EXPORT_SQL}{YEAR} AND {YEAR}", ("fact",))
def _(spark, sf_dir):
    return _exported(spark, sf_dir, YEAR, YEAR)


# --- projections -------------------------------------------------------------


@query(
    "p1_null_markers",
    "SELECT BENE_GEO_DESC AS area, \"YEAR\" AS y, nullif(nullif(trim(TOT_MDCR_STDZD_PYMT_PC), '*'), '') AS spend_text "
    "FROM raw_medicare",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, MEDICARE).select(
        F.col("BENE_GEO_DESC").alias("area"),
        F.col("YEAR").alias("y"),
        cleaning.null_markers("TOT_MDCR_STDZD_PYMT_PC").alias("spend_text"),
    )


@query(
    "p2_safe_cast",
    "SELECT BENE_GEO_DESC AS area, \"YEAR\"::INTEGER AS y, "
    "TRY_CAST(nullif(trim(BENES_FFS_CNT), '*') AS BIGINT) AS people, "
    "TRY_CAST(nullif(nullif(trim(IP_MDCR_STDZD_PYMT_PC), '*'), '') AS DECIMAL(12,2))::DOUBLE AS inpatient "
    "FROM raw_medicare",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, MEDICARE).select(
        F.col("BENE_GEO_DESC").alias("area"),
        cleaning.safe_cast("YEAR", "int").alias("y"),
        cleaning.safe_cast("BENES_FFS_CNT", "bigint").alias("people"),
        cleaning.safe_cast("IP_MDCR_STDZD_PYMT_PC", "decimal(12,2)").alias("inpatient"),
    )


@query(
    "p2_safe_cast_float",
    "SELECT zip, county_fips, TRY_CAST(trim(res_ratio) AS DOUBLE) AS res_ratio, "
    "TRY_CAST(nullif(trim(oth_ratio), '') AS DOUBLE) AS oth_ratio FROM raw_crosswalk",
    ("raw_crosswalk",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, CROSSWALK).select(
        "zip",
        "county_fips",
        cleaning.safe_cast("res_ratio", "double").alias("res_ratio"),
        cleaning.safe_cast("oth_ratio", "double").alias("oth_ratio"),
    )


@query(
    "p3_int_via_decimal",
    "SELECT fips, trunc(TRY_CAST(nullif(trim(rucc_2023), '') AS DECIMAL(3,1)))::SMALLINT AS code FROM raw_codes",
    ("raw_codes",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, CODES).select(
        "fips", cleaning.safe_int_via_decimal("rucc_2023").alias("code")
    )


@query(
    "p4_safe_date",
    "SELECT trim(npi) AS npi, "
    "strftime(TRY_STRPTIME(nullif(trim(enumeration_date), ''), '%m/%d/%Y'), '%Y-%m-%d') AS started, "
    "strftime(TRY_STRPTIME(nullif(trim(deactivation_date), ''), '%m/%d/%Y'), '%Y-%m-%d') AS ended "
    "FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, PHARMACIES).select(
        F.trim("npi").alias("npi"),
        cleaning.safe_date("enumeration_date").alias("started"),
        cleaning.safe_date("deactivation_date").alias("ended"),
    )


@query(
    "p5_zero_pad",
    "SELECT fips, right('00000' || trim(fips), 5) AS five, right('000' || trim(fips), 3) AS three FROM raw_codes",
    ("raw_codes",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, CODES).select(
        "fips", cleaning.zero_pad("fips", 5).alias("five"), cleaning.zero_pad("fips", 3).alias("three")
    )


@query(
    "p6_zip5",
    "SELECT trim(npi) AS npi, right('00000' || left(trim(postal_code), 5), 5) AS zip5 FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, PHARMACIES).select(
        F.trim("npi").alias("npi"), cleaning.zip5("postal_code").alias("zip5")
    )


@query(
    "p7_split_first",
    "SELECT \"YEAR\" AS y, BENE_GEO_DESC AS area, CASE WHEN instr(BENE_GEO_DESC, '-') > 0 "
    "THEN split_part(BENE_GEO_DESC, '-', 1) END AS state, "
    "trim(substr(BENE_GEO_DESC, instr(BENE_GEO_DESC, '-') + 1)) AS county FROM raw_medicare",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    state, county = cleaning.split_first("BENE_GEO_DESC")
    return staged(spark, sf_dir, MEDICARE).select(
        F.col("YEAR").alias("y"),
        F.col("BENE_GEO_DESC").alias("area"),
        state.alias("state"),
        county.alias("county"),
    )


@query(
    "p8_code_prefix",
    "SELECT fips, left(trim(state), 2) AS state_abbrev, left(trim(county_name), 8) AS name_prefix FROM raw_codes",
    ("raw_codes",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, CODES).select(
        "fips",
        cleaning.code_prefix("state").alias("state_abbrev"),
        cleaning.code_prefix("county_name", 8).alias("name_prefix"),
    )


@query(
    "p9_clean_text",
    "SELECT trim(npi) AS npi, nullif(trim(deactivation_reason_code), '') AS reason, "
    "nullif(trim(taxonomy_code_3), '') AS third FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, PHARMACIES).select(
        F.trim("npi").alias("npi"),
        cleaning.clean_text("deactivation_reason_code").alias("reason"),
        cleaning.clean_text("taxonomy_code_3").alias("third"),
    )


@query(
    "p10_rename_prune",
    'SELECT BENE_GEO_CD AS county_code, "YEAR" AS year_text, BENES_TOTAL_CNT AS people FROM raw_medicare',
    ("raw_medicare",),
)
def _(spark, sf_dir):
    wanted = {"BENE_GEO_CD": "county_code", "YEAR": "year_text", "BENES_TOTAL_CNT": "people"}
    return staged(spark, sf_dir, MEDICARE).select(
        *[F.col(source).alias(name) for source, name in wanted.items()]
    )


@query(
    "p11_safe_ratio",
    "SELECT county_fips, year_id, inpatient_spend_share::DOUBLE AS inpatient_share FROM clean_medicare",
    ("clean_medicare",),
)
def _(spark, sf_dir):
    share = measures.safe_ratio("ip_mdcr_stdzd_pymt_pc", "tot_mdcr_stdzd_pymt_pc")
    return staged(spark, sf_dir, "clean.medicare_spending").select(
        "county_fips", "year_id", share.alias("inpatient_share")
    )


@query(
    "p12_rate_per",
    "SELECT county_fips, year_id, CASE WHEN benes_ffs_cnt > 0 THEN "
    "round(active_pharmacies * 10000.0::DOUBLE / benes_ffs_cnt, 4) END AS density FROM panel",
    ("panel",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, "curated.county_year_panel").select(
        "county_fips",
        "year_id",
        measures.rate_per("active_pharmacies", "benes_ffs_cnt").alias("density"),
    )


@query(
    "p13_bin_label",
    "SELECT county_fips, CASE WHEN rucc_code BETWEEN 1 AND 3 THEN 'Metro' "
    "WHEN rucc_code BETWEEN 4 AND 9 THEN 'Nonmetro' END AS area_group FROM clean_codes",
    ("clean_codes",),
)
def _(spark, sf_dir):
    return staged(spark, sf_dir, "clean.rucc_codes").select(
        "county_fips", measures.bin_label("rucc_code").alias("area_group")
    )


TIER_SQL = (
    "CASE WHEN active_pharmacies = 0 THEN '0 - desert (acute)' "
    "WHEN active_pharmacies = 1 THEN '1 - fragile (1 closure from desert)' "
    "WHEN active_pharmacies BETWEEN 2 AND 5 THEN '2-5 pharmacies' "
    "WHEN active_pharmacies >= 6 THEN '6+ pharmacies' ELSE 'NULL / unknown' END"
)


@query("p14_tier_label", f"SELECT county_fips, year_id, {TIER_SQL} AS tier FROM fact", ("fact",))
def _(spark, sf_dir):
    return staged(spark, sf_dir, FACT).select(
        "county_fips", "year_id", measures.tier_label("active_pharmacies").alias("tier")
    )


@query("p15_lifecycle_status", "SELECT npi, most_recent_status FROM clean_pharmacies", ("clean_pharmacies",))
def _(spark, sf_dir):
    return staged(spark, sf_dir, PHARMACIES).select(
        F.trim("npi").alias("npi"),
        cleaning.lifecycle_status("enumeration_date", "deactivation_date", "reactivation_date").alias(
            "most_recent_status"
        ),
    )


@query(
    "p16_label_null",
    "SELECT coalesce(rucc_code::VARCHAR, 'NULL') AS rucc_code, count(*) AS num_counties "
    "FROM clean_codes GROUP BY 1",
    ("clean_codes",),
)
def _(spark, sf_dir):
    codes = staged(spark, sf_dir, "clean.rucc_codes")
    return distribution(codes, {"rucc_code": cleaning.label_null("rucc_code")}, "num_counties")


@query(
    "p17_match_label",
    "SELECT npi, CASE WHEN county_fips IS NULL THEN 'No county (foreign/territory)' "
    "ELSE 'Matched to US county' END AS fips_match FROM clean_pharmacies",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    label = cleaning.match_label("county_fips", "Matched to US county", "No county (foreign/territory)")
    return staged(spark, sf_dir, "clean.pharmacies").select("npi", label.alias("fips_match"))


@query(
    "p18_share_sum",
    "SELECT county_fips, year_id, (inpatient_spend_share + outpatient_spend_share)::DOUBLE AS combined "
    "FROM clean_medicare",
    ("clean_medicare",),
)
def _(spark, sf_dir):
    both = measures.share_sum("inpatient_spend_share", "outpatient_spend_share")
    return staged(spark, sf_dir, "clean.medicare_spending").select(
        "county_fips", "year_id", both.alias("combined")
    )


@query(
    "m20_text_length",
    "SELECT state, length(rtrim(state)) AS len, count(*) AS n FROM raw_pharmacies GROUP BY 1, 2",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, PHARMACIES)
    return distribution(raw, {"state": "state", "len": cleaning.text_length("state")})


# --- predicates --------------------------------------------------------------


@query(
    "f1_single_level",
    'SELECT "YEAR" AS y, BENE_GEO_DESC AS area, BENES_TOTAL_CNT AS people FROM raw_medicare '
    "WHERE BENE_GEO_LVL = 'County' AND BENE_AGE_LVL = 'All'",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    kept = predicates.same_text("BENE_GEO_LVL", "County") & predicates.same_text(
        "BENE_AGE_LVL", "all ", ignore_case=True
    )
    return staged(spark, sf_dir, MEDICARE).filter(kept).select(
        F.col("YEAR").alias("y"),
        F.col("BENE_GEO_DESC").alias("area"),
        F.col("BENES_TOTAL_CNT").alias("people"),
    )


@query(
    "f2_in_list",
    f"SELECT county_fips, year_id FROM clean_medicare WHERE year_id IN ({YEARS[0]}, {YEARS[-1]})",
    ("clean_medicare",),
)
def _(spark, sf_dir):
    rows = staged(spark, sf_dir, "clean.medicare_spending")
    return rows.filter(F.col("year_id").isin(YEARS[0], YEARS[-1])).select("county_fips", "year_id")


@query(
    "f3_between",
    "SELECT county_fips, year_id, rucc_code FROM fact WHERE rucc_code BETWEEN 4 AND 9 "
    f"AND year_id BETWEEN {YEARS[1]} AND {YEARS[3]}",
    ("fact",),
)
def _(spark, sf_dir):
    kept = F.col("rucc_code").between(4, 9) & F.col("year_id").between(YEARS[1], YEARS[3])
    return staged(spark, sf_dir, FACT).filter(kept).select("county_fips", "year_id", "rucc_code")


@query(
    "f4_present",
    "SELECT county_fips, year_id FROM fact WHERE pharmacies_per_10k_benes IS NOT NULL "
    "AND tot_mdcr_stdzd_pymt_pc IS NOT NULL",
    ("fact",),
)
def _(spark, sf_dir):
    kept = predicates.all_present("pharmacies_per_10k_benes", "tot_mdcr_stdzd_pymt_pc")
    return staged(spark, sf_dir, FACT).filter(kept).select("county_fips", "year_id")


@query(
    "f5_small_cell_guard",
    f"SELECT county_fips, benes_ffs_cnt FROM fact WHERE year_id = {YEAR} AND benes_ffs_cnt >= {MIN_WEIGHT}",
    ("fact",),
)
def _(spark, sf_dir):
    kept = (F.col("year_id") == YEAR) & predicates.at_least("benes_ffs_cnt", MIN_WEIGHT)
    return staged(spark, sf_dir, FACT).filter(kept).select("county_fips", "benes_ffs_cnt")


@query(
    "f6_text_patterns",
    "SELECT trim(npi) AS npi FROM raw_pharmacies WHERE pharmacy_taxonomy_code LIKE '3336%' "
    "AND pharmacy_taxonomy_position LIKE '%' || chr(13) AND (org_name ILIKE '%inc.%' OR org_name ILIKE '%llc%')",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    kept = (
        predicates.starts_with("pharmacy_taxonomy_code", "3336")
        & predicates.ends_with_cr("pharmacy_taxonomy_position")
        & predicates.contains_any("org_name", ["inc.", "llc"])
    )
    return staged(spark, sf_dir, PHARMACIES).filter(kept).select(F.trim("npi").alias("npi"))


@query(
    "f7_keep_rank_one",
    "SELECT zip, county_fips FROM clean_crosswalk",
    ("clean_crosswalk",),
)
def _(spark, sf_dir):
    typed = typed_crosswalk(staged(spark, sf_dir, CROSSWALK), CODE_WIDTH)
    best = dominant_row(typed, "zip", ["bus_ratio", "tot_ratio"], "county_fips")
    return best.select("zip", "county_fips")


@query(
    "f8_rural_stratum",
    f"SELECT county_fips, rucc_code FROM fact WHERE year_id = {YEAR} AND rural_urban_group = 'Nonmetro'",
    ("fact",),
)
def _(spark, sf_dir):
    kept = (F.col("year_id") == YEAR) & (F.col("rural_urban_group") == "Nonmetro")
    return staged(spark, sf_dir, FACT).filter(kept).select("county_fips", "rucc_code")


@query(
    "f9_point_lookup",
    f"SELECT county_fips, year_id, active_pharmacies, {doubles('tot_mdcr_stdzd_pymt_pc')} FROM fact "
    "WHERE county_fips = (SELECT max(county_fips) FROM fact WHERE active_pharmacies > 0)",
    ("fact",),
)
def _(spark, sf_dir):
    fact = staged(spark, sf_dir, FACT)
    known = fact.filter(F.col("active_pharmacies") > 0).agg(F.max("county_fips").alias("county_fips"))
    return fact.join(F.broadcast(known), ["county_fips"], "left_semi").select(
        "county_fips", "year_id", "active_pharmacies", "tot_mdcr_stdzd_pymt_pc"
    )
