"""The ten table builders, raw to curated, and the run that writes them all. Output
names and their order are fixed values: they follow the published layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import (
    clean_text,
    code_prefix,
    lifecycle_status,
    safe_cast,
    safe_date,
    safe_int_via_decimal,
    split_first,
    zero_pad,
)
from accesspanel.functions.measures import bin_label, safe_ratio
from accesspanel.functions.predicates import same_text
from accesspanel.operators.joins import assemble_fact, attach_area
from accesspanel.operators.lifecycle import build_panel
from accesspanel.operators.observed import WriteChecks, observed, report, results
from accesspanel.operators.quality import CheckFailed, check_unique, load_report, require_empty
from accesspanel.operators.windows import dominant_row
from accesspanel.plans import schemas
from accesspanel.sources import versions
from accesspanel.sources.bucketed import colocated_join
from accesspanel.sources.contracts import Contract, conform
from accesspanel.sources.tables import layer_path, load_raw_csv, strip_trailing_cr, write_layer

YEARS = (2019, 2020, 2021, 2022, 2023)


# --- raw -------------------------------------------------------------------


def raw_pharmacies(spark: SparkSession, path: str) -> DataFrame:
    """Provider registry, all text, split on line feeds."""
    columns = schemas.RAW_PHARMACIES.columns
    loaded = load_raw_csv(spark, path, columns, line_sep="\n")
    return conform(strip_trailing_cr(loaded, columns[-1]), schemas.RAW_PHARMACIES)


def raw_medicare(spark: SparkSession, path: str) -> DataFrame:
    """Yearly measures, all text, columns named by the file header."""
    loaded = load_raw_csv(spark, path)
    missing = [c for c in schemas.RAW_MEDICARE_REQUIRED if c not in loaded.columns]
    if missing:
        raise CheckFailed(f"raw.medicare_spending lacks {', '.join(missing)}")
    return conform(loaded, schemas.raw_medicare_contract(loaded.columns))


def raw_codes(spark: SparkSession, path: str) -> DataFrame:
    return conform(load_raw_csv(spark, path, schemas.RAW_CODES.columns), schemas.RAW_CODES)


def raw_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    loaded = load_raw_csv(spark, path, schemas.RAW_CROSSWALK.columns)
    return conform(loaded, schemas.RAW_CROSSWALK)


# --- clean -----------------------------------------------------------------


def clean_medicare(raw: DataFrame, code_width: int = 5, level: str = "County") -> DataFrame:
    """County rows only, typed, with the two spend shares."""
    state, county = split_first("BENE_GEO_DESC")
    total = "tot_mdcr_stdzd_pymt_pc"
    typed = raw.filter(same_text("BENE_GEO_LVL", level)).select(
        F.col("BENE_GEO_LVL").alias("geo_lvl"),
        state.alias("state_abbrev"),
        county.alias("county_desc"),
        zero_pad("BENE_GEO_CD", code_width).alias("county_fips"),
        safe_cast("YEAR", "int").alias("year_id"),
        F.col("BENE_AGE_LVL").alias("bene_age_lvl"),
        *[safe_cast(src, t).alias(name) for src, (name, t) in schemas.MEASURES.items()],
    )
    shares = {
        "inpatient_spend_share": safe_ratio("ip_mdcr_stdzd_pymt_pc", total),
        "outpatient_spend_share": safe_ratio("op_mdcr_stdzd_pymt_pc", total),
    }
    return conform(typed.withColumns(shares), schemas.clean_medicare(code_width))


def clean_codes(raw: DataFrame, code_width: int = 5) -> DataFrame:
    """One row per county: rural-urban code 1..9 and its two-way group."""
    code = safe_int_via_decimal("rucc_2023")
    typed = raw.select(
        zero_pad("fips", code_width).alias("county_fips"),
        code_prefix("state").alias("state_abbrev"),
        clean_text("county_name").alias("county_name"),
        safe_cast("population_2020", "int").alias("population_2020"),
        code.alias("rucc_code"),
        clean_text("description").alias("rucc_description"),
        bin_label(code).alias("rural_urban_group"),
    )
    return conform(typed, schemas.clean_codes(code_width))


def typed_crosswalk(raw: DataFrame, code_width: int = 5) -> DataFrame:
    """Typed crosswalk rows before the dominant county is picked. Codes are
    padded before grouping, so '601' and '00601' are one postal code."""
    ratios = ("bus_ratio", "res_ratio", "oth_ratio", "tot_ratio")
    return raw.select(
        zero_pad("zip", code_width).alias("zip"),
        zero_pad("county_fips", code_width).alias("county_fips"),
        code_prefix("usps_zip_pref_state").alias("state_abbrev"),
        clean_text("usps_zip_pref_city").alias("city_name"),
        *[safe_cast(r, "double").alias(r) for r in ratios],
    )


def clean_crosswalk(raw: DataFrame, code_width: int = 5) -> DataFrame:
    """One county per postal code: greatest business share, then greatest total
    share, then least county code."""
    best = dominant_row(
        typed_crosswalk(raw, code_width),
        key="zip",
        order=("bus_ratio", "tot_ratio"),
        tie="county_fips",
        size="num_counties_in_zip",
    )
    return conform(best, schemas.clean_crosswalk(code_width))


def clean_pharmacies(
    raw: DataFrame,
    crosswalk: DataFrame,
    code_width: int = 5,
    skewed: bool | None = None,
    npi_width: int = 10,
) -> DataFrame:
    """Every provider with typed dates, snapshot status and, where its postal
    code is known, its county. Values are typed first: the rows that are then moved to
    the crosswalk are narrower than their texts."""
    dates = ("enumeration_date", "last_update_date", "deactivation_date", "reactivation_date")
    parsed = raw.withColumns({f"_{d}": safe_date(d) for d in dates})
    typed = parsed.select(
        F.trim("npi").alias("npi"),
        safe_cast("entity_type_code", "ubyte").alias("entity_type_code"),
        *[F.trim(c).alias(c) for c in ("org_name", "city", "state")],
        "postal_code",
        *[F.col(f"_{d}").alias(d) for d in dates],
        clean_text("deactivation_reason_code").alias("deactivation_reason_code"),
        lifecycle_status(
            "enumeration_date",
            "deactivation_date",
            "reactivation_date",
            "_deactivation_date",
            "_reactivation_date",
        ).alias("most_recent_status"),
        clean_text("pharmacy_taxonomy_code").alias("pharmacy_taxonomy_code"),
        safe_cast("pharmacy_taxonomy_position", "ubyte").alias("pharmacy_taxonomy_pos"),
    )
    placed = attach_area(typed, crosswalk, "postal_code", width=code_width, skewed=skewed)
    return conform(placed, schemas.clean_pharmacies(code_width, npi_width))


# --- curated ---------------------------------------------------------------


def county_year_panel(
    pharmacies: DataFrame,
    medicare: DataFrame,
    years: Sequence[int] = YEARS,
    code_width: int = 5,
) -> DataFrame:
    """County-by-year counts and densities; counties without any provider are
    absent, counties whose providers all open later are present with 0."""
    panel = build_panel(
        pharmacies, medicare, years, weight="benes_ffs_cnt", only=F.col("bene_age_lvl") == "All"
    )
    first, last = min(years), max(years)
    named = panel.withColumnsRenamed(
        {
            "active": "active_pharmacies",
            "openings": "openings_in_year",
            "closures": "closures_in_year",
            "rate": "pharmacies_per_10k_benes",
            "closure_rate": "closures_per_10k_benes",
            "active_change": f"pharmacy_count_change_{first}_{last}",
            "rate_change": f"pharmacy_density_change_{first}_{last}",
        }
    )
    return conform(named, schemas.curated_panel(first, last, code_width))


def fact_county_year(
    medicare: DataFrame,
    panel: DataFrame,
    codes: DataFrame,
    years: Sequence[int] = YEARS,
    code_width: int = 5,
) -> DataFrame:
    """Wide fact: every county-year of the measures, with panel and codes."""
    base = medicare.filter(F.col("year_id").isin(list(years)) & (F.col("bene_age_lvl") == "All"))
    fact = assemble_fact(
        base,
        panel.drop("benes_ffs_cnt", "closures_per_10k_benes"),
        codes.select("county_fips", "rucc_code", "rural_urban_group", "rucc_description"),
    )
    return conform(fact, schemas.curated_fact(min(years), max(years), code_width))


def fact_from_buckets(
    medicare: DataFrame,
    panel: DataFrame,
    codes: DataFrame,
    years: Sequence[int] = YEARS,
    code_width: int = 5,
) -> DataFrame:
    """:func:`fact_county_year` of tables stored by county: no side is moved."""
    base = medicare.filter(F.col("year_id").isin(list(years)) & (F.col("bene_age_lvl") == "All"))
    counts = panel.drop("benes_ffs_cnt", "closures_per_10k_benes")
    labels = codes.select("county_fips", "rucc_code", "rural_urban_group", "rucc_description")
    joined = colocated_join(colocated_join(base, counts, "county_fips", ["year_id"]), labels, "county_fips")
    return conform(joined, schemas.curated_fact(min(years), max(years), code_width))


# --- the whole run -----------------------------------------------------------


def write_checked(
    df: DataFrame, root: str, contract: Contract, reports: list[DataFrame] | None = None
) -> DataFrame:
    """Write a table, with a gate on its key before any reader sees it: a repeated key stops
    the run and leaves the table as it was. ``reports`` gets the counts of the write: its
    rows and, by the contract, its missing values; they cost no scan of their own."""
    layer, name = contract.name.split(".")
    path = layer_path(root, layer, name)
    checks = WriteChecks(not_null=[f.name for f in contract.fields if f.required])
    counted, observation = observed(df, checks)
    written, version = versions.stage_version(counted, path, cluster_by=contract.keys)
    if contract.keys:
        require_empty(check_unique(written, contract.keys), f"{contract.name}: repeated key")
    versions.publish(df.sparkSession, path, version)
    if reports is not None:
        reports.append(report(df.sparkSession, contract.name, results(observation, checks)))
    return written


def build_tables(
    spark: SparkSession,
    inputs: Mapping[str, str],
    root: str,
    years: Sequence[int] = YEARS,
    skewed: bool | None = None,
    reports: list[DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Raw, clean and curated tables from the four source files (keys
    pharmacies, medicare, codes, crosswalk). Each table is written before the
    next starts from it, so a rerun replaces and a lost executor replays little. ``reports``
    gets one frame of counts per clean and curated table, taken while it was written."""
    loaders = {
        "pharmacies": (raw_pharmacies, "pharmacies"),
        "medicare": (raw_medicare, "medicare_spending"),
        "codes": (raw_codes, "rucc_codes"),
        "crosswalk": (raw_crosswalk, "zip_to_fips"),
    }
    raw = {
        key: write_layer(load(spark, inputs[key]), root, "raw", name)
        for key, (load, name) in loaders.items()
    }
    first, last = min(years), max(years)
    medicare = write_checked(clean_medicare(raw["medicare"]), root, schemas.clean_medicare(), reports)
    codes = write_checked(clean_codes(raw["codes"]), root, schemas.clean_codes(), reports)
    crosswalk = write_checked(clean_crosswalk(raw["crosswalk"]), root, schemas.clean_crosswalk(), reports)
    pharmacies = write_checked(
        clean_pharmacies(raw["pharmacies"], crosswalk, skewed=skewed),
        root,
        schemas.clean_pharmacies(),
        reports,
    )
    panel = write_checked(
        county_year_panel(pharmacies, medicare, years), root, schemas.curated_panel(first, last), reports
    )
    fact = write_checked(
        fact_county_year(medicare, panel, codes, years), root, schemas.curated_fact(first, last), reports
    )
    return {
        **{f"raw.{name}": raw[key] for key, (_, name) in loaders.items()},
        "clean.medicare_spending": medicare,
        "clean.rucc_codes": codes,
        "clean.zip_to_fips": crosswalk,
        "clean.pharmacies": pharmacies,
        "curated.county_year_panel": panel,
        "curated.fact_county_year": fact,
    }


def build_report(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """One load-report row per table."""
    report = None
    for name, df in tables.items():
        row = load_report(df, name, expected.get(name))
        report = row if report is None else report.unionByName(row)
    return report
