"""Table builders and analytical questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesspanel.catalogue.cleaning_queries import TIER_SQL, csv_of
from accesspanel.catalogue.derived import (
    CODE_WIDTH,
    DESERT_WEIGHT,
    MIN_WEIGHT,
    YEAR,
    YEARS,
    derive,
    staged,
)
from accesspanel.catalogue.operator_queries import (
    C_MED,
    DENSITY,
    FACT,
    FIRST,
    LAST,
    PANEL,
    SPEND,
    WEIGHT,
    gap_sql,
)
from accesspanel.catalogue.registry import doubles, mean_text, query
from accesspanel.plans import builders, questions, schemas
from accesspanel.sources import bucketed
from accesspanel.sources.tables import staging_root

# --- builders ----------------------------------------------------------------


def _from_csv(
    spark: SparkSession, sf_dir: str, name: str, load: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    return load(spark, csv_of(spark, staged(spark, sf_dir, name), name.replace(".", "_")))


def blank_is_null(columns) -> str:
    return ", ".join(f"nullif({c}, '') AS {c}" for c in columns)


@query(
    "b1_raw_pharmacies",
    f"SELECT {blank_is_null(schemas.RAW_PHARMACIES.columns[:-1])}, "
    "nullif(replace(pharmacy_taxonomy_position, chr(13), ''), '') AS pharmacy_taxonomy_position "
    "FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return _from_csv(spark, sf_dir, "raw.pharmacies", builders.raw_pharmacies)


@query(
    "b2_raw_medicare",
    "SELECT " + blank_is_null(['"YEAR"', *schemas.RAW_MEDICARE_REQUIRED[1:]]) + " FROM raw_medicare",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    return _from_csv(spark, sf_dir, "raw.medicare_spending", builders.raw_medicare)


@query(
    "b3_raw_crosswalk",
    f"SELECT {blank_is_null(schemas.RAW_CROSSWALK.columns)} FROM raw_crosswalk",
    ("raw_crosswalk",),
)
def _(spark, sf_dir):
    return _from_csv(spark, sf_dir, "raw.zip_to_fips", builders.raw_crosswalk)


@query("b4_raw_codes", f"SELECT {blank_is_null(schemas.RAW_CODES.columns)} FROM raw_codes", ("raw_codes",))
def _(spark, sf_dir):
    return _from_csv(spark, sf_dir, "raw.rucc_codes", builders.raw_codes)


def plain(contract) -> str:
    """Column list of a contract in types both engines print alike."""
    out = []
    for f in contract.fields:
        if f.dtype.startswith("decimal"):
            out.append(f"{f.name}::DOUBLE AS {f.name}")
        elif f.dtype == "date":
            out.append(f"{f.name}::VARCHAR AS {f.name}")
        else:
            out.append(f.name)
    return ", ".join(out)


@query(
    "b5_clean_medicare",
    f"SELECT {plain(schemas.clean_medicare())} FROM clean_medicare",
    ("clean_medicare",),
)
def _(spark, sf_dir):
    return derive(spark, sf_dir, "clean.medicare_spending")


@query("b6_clean_codes", f"SELECT {plain(schemas.clean_codes())} FROM clean_codes", ("clean_codes",))
def _(spark, sf_dir):
    return derive(spark, sf_dir, "clean.rucc_codes")


@query(
    "b7_clean_crosswalk",
    f"SELECT {plain(schemas.clean_crosswalk())} FROM clean_crosswalk",
    ("clean_crosswalk",),
)
def _(spark, sf_dir):
    return derive(spark, sf_dir, "clean.zip_to_fips")


@query(
    "b8_clean_pharmacies",
    f"SELECT {plain(schemas.clean_pharmacies())} FROM clean_pharmacies",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    return derive(spark, sf_dir, "clean.pharmacies")


@query(
    "b9_county_year_panel",
    f"SELECT {plain(schemas.curated_panel(FIRST, LAST))} FROM panel",
    ("panel",),
)
def _(spark, sf_dir):
    return derive(spark, sf_dir, "curated.county_year_panel")


@query(
    "b10_fact_county_year",
    f"SELECT {plain(schemas.curated_fact(FIRST, LAST))} FROM fact",
    ("fact",),
)
def _(spark, sf_dir):
    return derive(spark, sf_dir, "curated.fact_county_year")


def bucketed_layers(spark, sf_dir):
    """Clean tables stored by county, and the panel made of them, which is stored the same way."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = f"{staging_root(spark)}/accesspanel/{spark.sparkContext.applicationId}/files/buckets-{uuid.uuid4().hex}"

    def stored(name, df, aligned=False):
        return bucketed.write_bucketed(df, root, *name.split("."), "county_fips", buckets, aligned)

    medicare = stored("clean.medicare_spending", staged(spark, sf_dir, "clean.medicare_spending"))
    pharmacies = stored("clean.pharmacies", staged(spark, sf_dir, "clean.pharmacies"))
    codes = stored("clean.rucc_codes", staged(spark, sf_dir, "clean.rucc_codes"))
    panel = builders.county_year_panel(pharmacies, medicare, YEARS, CODE_WIDTH)
    return root, medicare, codes, stored("curated.county_year_panel", panel, aligned=True)


@query(
    "b9_panel_from_buckets",
    f"SELECT {plain(schemas.curated_panel(FIRST, LAST))} FROM panel",
    ("panel",),
)
def _(spark, sf_dir):
    root, *_ = bucketed_layers(spark, sf_dir)
    return bucketed.read_bucketed(spark, root, "curated", "county_year_panel")


@query(
    "b10_fact_from_buckets",
    f"SELECT {plain(schemas.curated_fact(FIRST, LAST))} FROM fact",
    ("fact",),
)
def _(spark, sf_dir):
    _, medicare, codes, panel = bucketed_layers(spark, sf_dir)
    return builders.fact_from_buckets(medicare, panel, codes, YEARS, CODE_WIDTH)


# --- questions ---------------------------------------------------------------


def bucket_sql(outcomes, required=(), where="", extremes=True, strata=""):
    """Equal-count density buckets and the means of ``outcomes`` in each."""
    present = "".join(f" AND {c} IS NOT NULL" for c in required)
    split = f"PARTITION BY {strata} " if strata else ""
    lead = f"{strata}, " if strata else ""
    ends = (
        f"round(min({DENSITY}), 2)::DOUBLE AS min_density, round(max({DENSITY}), 2)::DOUBLE AS max_density, "
        if extremes
        else ""
    )
    means = ", ".join(f"{mean_text(c, scale, 2)} AS {name}" for name, (c, scale) in outcomes.items())
    return (
        f"SELECT {lead}density_bucket, count(*) AS county_count, {ends}"
        f"{mean_text(DENSITY, 4, 2)} AS avg_density, {means} FROM (SELECT *, ntile(5) OVER ({split}"
        f"ORDER BY {DENSITY} ASC NULLS FIRST, county_fips)::INTEGER AS density_bucket FROM fact "
        f"WHERE year_id = {YEAR} AND {DENSITY} IS NOT NULL{present} AND {WEIGHT} >= {MIN_WEIGHT}{where}) "
        f"GROUP BY {lead}density_bucket"
    )


_SPEND_MEAN = {"avg_medicare_spend": (SPEND, 2)}


@query("q1_density_vs_spend", bucket_sql(_SPEND_MEAN, [SPEND]), ("fact",))
def _(spark, sf_dir):
    return questions.density_vs_spend(staged(spark, sf_dir, FACT), YEAR, MIN_WEIGHT)


@query(
    "q2_density_vs_spend_rural",
    bucket_sql(_SPEND_MEAN, [SPEND], " AND rural_urban_group = 'Nonmetro'"),
    ("fact",),
)
def _(spark, sf_dir):
    return questions.density_vs_spend_rural(staged(spark, sf_dir, FACT), YEAR, MIN_WEIGHT)


@query(
    "q3_density_vs_emergency",
    bucket_sql({"avg_er_visits_per_1000": ("er_visits_per_1000", 2)}, ["er_visits_per_1000"]),
    ("fact",),
)
def _(spark, sf_dir):
    return questions.density_vs_emergency(staged(spark, sf_dir, FACT), YEAR, MIN_WEIGHT)


@query(
    "q4_density_vs_preventable",
    bucket_sql(
        {
            "avg_hypertension_admissions": ("pqi07_hyprtnsn_age_65_74", 4),
            "avg_diabetes_admissions": ("pqi03_dbts_age_65_74", 4),
            "avg_medicare_spend": (SPEND, 2),
        },
        extremes=False,
    ),
    ("fact",),
)
def _(spark, sf_dir):
    return questions.density_vs_preventable(staged(spark, sf_dir, FACT), YEAR, MIN_WEIGHT)


@query(
    "q5_desert_list",
    "SELECT county_fips, state_abbrev, county_desc, rucc_code, rural_urban_group, active_pharmacies, "
    f"benes_ffs_cnt, {doubles(DENSITY, SPEND)}, pqi07_hyprtnsn_age_65_74::DOUBLE AS hypertension_admissions_65_74, "
    f"pqi03_dbts_age_65_74::DOUBLE AS diabetes_admissions_65_74, {doubles('er_visits_per_1000')} FROM fact "
    f"WHERE year_id = {YEAR} AND active_pharmacies <= 1 AND benes_ffs_cnt >= {DESERT_WEIGHT} AND {SPEND} IS NOT NULL",
    ("fact",),
)
def _(spark, sf_dir):
    return questions.desert_list(staged(spark, sf_dir, FACT), YEAR, min_weight=DESERT_WEIGHT)


@query(
    "q6_fragility_tiers",
    f"SELECT {TIER_SQL} AS pharmacy_tier, count(*) AS county_count, sum({WEIGHT})::BIGINT AS total_ffs_seniors, "
    f"round(avg({SPEND}::DOUBLE), 4) AS avg_total_pc_unweighted, "
    f"round(sum({SPEND} * {WEIGHT})::DOUBLE / nullif(sum({WEIGHT}), 0)::DOUBLE, 4) AS avg_total_pc_weighted, "
    "round(avg(ip_mdcr_stdzd_pymt_pc::DOUBLE), 4) AS avg_inpatient_pc_unweighted FROM fact "
    f"WHERE year_id = {YEAR} AND rucc_code BETWEEN 4 AND 9 AND {SPEND} IS NOT NULL GROUP BY 1",
    ("fact",),
)
def _(spark, sf_dir):
    tiers = questions.tier_summary(staged(spark, sf_dir, FACT), YEAR)
    means = [c for c in tiers.columns if c.startswith("avg_")]
    return tiers.withColumns({c: F.round(c, 4) for c in means})


@query("q7_benchmark_gap", gap_sql(f"year_id = {YEAR}"), ("fact",))
def _(spark, sf_dir):
    return questions.fragility_gap(staged(spark, sf_dir, FACT), YEAR)


@query(
    "q8_spend_by_group",
    f"SELECT rural_urban_group, count(*) AS county_count, {mean_text(SPEND, 2, 2)} AS avg_medicare_spend, "
    f"{mean_text(DENSITY, 4, 4)} AS avg_pharmacy_density, {mean_text('er_visits_per_1000', 2, 2)} "
    f"AS avg_er_visits_per_1000 FROM fact WHERE year_id = {YEAR} AND rural_urban_group IS NOT NULL "
    f"AND {SPEND} IS NOT NULL GROUP BY rural_urban_group",
    ("fact",),
)
def _(spark, sf_dir):
    return questions.spend_by_group(staged(spark, sf_dir, FACT), YEAR)


@query(
    "q9_spend_by_code",
    f"SELECT rucc_code, rural_urban_group, count(*) AS county_count, {mean_text(SPEND, 2, 2)} AS avg_medicare_spend, "
    f"{mean_text(DENSITY, 4, 4)} AS avg_pharmacy_density FROM fact WHERE year_id = {YEAR} "
    f"AND rucc_code IS NOT NULL AND {SPEND} IS NOT NULL GROUP BY rucc_code, rural_urban_group",
    ("fact",),
)
def _(spark, sf_dir):
    return questions.spend_by_code(staged(spark, sf_dir, FACT), YEAR)


@query(
    "q10_lowest_density",
    f"SELECT p.county_fips, p.active_pharmacies, p.benes_ffs_cnt, p.{DENSITY}::DOUBLE AS {DENSITY}, "
    f"m.{SPEND}::DOUBLE AS medicare_spend_per_capita FROM panel p LEFT JOIN clean_medicare m "
    f"ON p.county_fips = m.county_fips AND m.year_id = {YEAR} AND m.bene_age_lvl = 'All' "
    f"WHERE p.year_id = {YEAR} AND p.{DENSITY} IS NOT NULL AND p.active_pharmacies > 0 "
    f"ORDER BY p.{DENSITY}, p.county_fips LIMIT 10",
    ("panel", "clean_medicare"),
)
def _(spark, sf_dir):
    return questions.lowest_density(
        staged(spark, sf_dir, PANEL), staged(spark, sf_dir, C_MED), YEAR
    )


@query(
    "q11_highest_spend",
    "SELECT county_fips, state_abbrev, county_desc, rucc_code, rural_urban_group, active_pharmacies, "
    f"{DENSITY}::DOUBLE AS {DENSITY}, benes_ffs_cnt, {SPEND}::DOUBLE AS {SPEND} FROM fact f "
    f"WHERE year_id = {YEAR} AND {SPEND} IS NOT NULL ORDER BY f.{SPEND} DESC, county_fips LIMIT 10",
    ("fact",),
)
def _(spark, sf_dir):
    return questions.highest_spend(staged(spark, sf_dir, FACT), YEAR)


@query(
    "q12_yearly_totals",
    "SELECT year_id, count(*) AS county_count, sum(active_pharmacies)::BIGINT AS total_active, "
    "sum(openings_in_year)::BIGINT AS total_openings, sum(closures_in_year)::BIGINT AS total_closures, "
    + mean_text("active_pharmacies", 0, 1)
    + " AS avg_per_county FROM panel GROUP BY year_id",
    ("panel",),
)
def _(spark, sf_dir):
    return questions.yearly_totals(staged(spark, sf_dir, PANEL))


@query(
    "q13_anchor_years",
    "SELECT year_id, count(*) AS counties_with_pharmacies, sum(active_pharmacies)::BIGINT AS national_active_pharmacies, "
    f"{mean_text(DENSITY, 4, 4)} AS avg_national_density FROM panel WHERE year_id IN ({FIRST}, {LAST}) GROUP BY year_id",
    ("panel",),
)
def _(spark, sf_dir):
    return questions.anchor_years(staged(spark, sf_dir, PANEL), FIRST, LAST)


@query(
    "r1_gap_trend",
    gap_sql(f"year_id IN ({', '.join(map(str, YEARS))})", "year_id"),
    ("fact",),
)
def _(spark, sf_dir):
    return questions.gap_trend(staged(spark, sf_dir, FACT), YEARS)


_RUNNING = (
    "WITH rural AS (SELECT county_fips, active_pharmacies, tot_mdcr_stdzd_pymt_pc AS spend, benes_ffs_cnt AS w "
    f"FROM fact WHERE year_id = {YEAR} AND rucc_code BETWEEN 4 AND 9 AND {SPEND} IS NOT NULL AND {WEIGHT} IS NOT NULL), "
    "bench AS (SELECT sum(spend * w)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS pc FROM rural WHERE active_pharmacies >= 2), "
    "excess AS (SELECT county_fips, round((spend::DOUBLE - pc) * w, 2)::DECIMAL(18,2) AS excess FROM rural, bench "
    "WHERE active_pharmacies IN (0, 1)), "
    "ranked AS (SELECT *, row_number() OVER o AS pos, sum(excess) OVER o AS running, sum(excess) OVER () AS total "
    "FROM excess WINDOW o AS (ORDER BY excess DESC NULLS LAST, county_fips ROWS UNBOUNDED PRECEDING)) "
    "SELECT pos::INTEGER AS \"position\", county_fips, excess::DOUBLE AS excess, "
    "round(excess::DOUBLE / nullif(total::DOUBLE, 0), 6) AS share, "
    "round(running::DOUBLE / nullif(total::DOUBLE, 0), 6) AS running_share FROM ranked"
)


@query("r2_excess_concentration", f"{_RUNNING} WHERE pos <= 15", ("fact",))
def _(spark, sf_dir):
    return questions.excess_concentration(staged(spark, sf_dir, FACT), YEAR)


@query("r2_running_concentration", _RUNNING, ("fact",))
def _(spark, sf_dir):
    return questions.excess_concentration(staged(spark, sf_dir, FACT), YEAR, None)


_WHOLE = bucket_sql(_SPEND_MEAN, [SPEND], extremes=False)
_PARTS = bucket_sql(
    _SPEND_MEAN, [SPEND, "rural_urban_group"], extremes=False, strata="rural_urban_group"
)


@query(
    "r3_stratified_contrast",
    f"SELECT 'All' AS stratum, density_bucket, county_count, avg_density, avg_medicare_spend FROM ({_WHOLE}) UNION ALL "
    f"SELECT rural_urban_group, density_bucket, county_count, avg_density, avg_medicare_spend FROM ({_PARTS})",
    ("fact",),
)
def _(spark, sf_dir):
    return questions.stratified_contrast(staged(spark, sf_dir, FACT), YEAR, MIN_WEIGHT)


@query(
    "r4_spend_staircase",
    f"SELECT {TIER_SQL} AS pharmacy_tier, year_id, "
    f"round(sum({SPEND} * {WEIGHT})::DOUBLE / nullif(sum({WEIGHT}), 0)::DOUBLE, 4) AS weighted_spend FROM fact "
    f"WHERE rucc_code BETWEEN 4 AND 9 AND {SPEND} IS NOT NULL GROUP BY 1, 2",
    ("fact",),
)
def _(spark, sf_dir):
    fact = staged(spark, sf_dir, FACT)
    return questions.spend_staircase(fact, YEARS).withColumn(
        "weighted_spend", F.round("weighted_spend", 4)
    )
