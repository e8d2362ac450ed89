"""Analytical questions over the fact table. The names of the columns read and
returned are fixed values: they are those of the published results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.functions.measures import tier_label
from accesspanel.functions.predicates import all_present, at_least
from accesspanel.operators.aggregates import (
    average,
    benchmark_gap,
    summary,
    top_k,
    weighted_mean,
)
from accesspanel.operators.windows import ntile_bucket, running_totals

AREA = "county_fips"
PERIOD = "year_id"
DENSITY = "pharmacies_per_10k_benes"
SPEND = "tot_mdcr_stdzd_pymt_pc"
WEIGHT = "benes_ffs_cnt"
ACTIVE = "active_pharmacies"
GROUP = "rural_urban_group"
CODE = "rucc_code"


def rural(code: str = CODE) -> Column:
    return F.col(code).between(4, 9)


def bucket_profile(
    fact: DataFrame,
    year: int,
    outcomes: Mapping[str, str],
    required: Sequence[str] = (),
    min_weight: int = 500,
    buckets: int = 5,
    where: Column | None = None,
    extremes: bool = True,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Areas cut into equal-count density buckets, with density range and mean
    outcomes per bucket. ``outcomes`` maps output names to columns."""
    kept = (F.col(PERIOD) == year) & all_present(DENSITY, *required) & at_least(WEIGHT, min_weight)
    if where is not None:
        kept = kept & where
    rows = fact.filter(kept).select(AREA, *strata, DENSITY, *dict.fromkeys(outcomes.values()))
    bucketed = ntile_bucket(rows, buckets, DENSITY, AREA, "density_bucket", strata)
    specs: dict[str, Column] = {"county_count": F.count("*")}
    if extremes:
        specs["min_density"] = F.min(DENSITY).cast("decimal(8,2)")
        specs["max_density"] = F.max(DENSITY).cast("decimal(8,2)")
    specs["avg_density"] = average(DENSITY, "decimal(8,2)")
    for name, c in outcomes.items():
        specs[name] = average(c, "decimal(10,2)")
    return summary(bucketed, [*strata, "density_bucket"], specs).orderBy(*strata, "density_bucket")


def density_vs_spend(fact: DataFrame, year: int, min_weight: int = 500) -> DataFrame:
    return bucket_profile(fact, year, {"avg_medicare_spend": SPEND}, [SPEND], min_weight)


def density_vs_spend_rural(fact: DataFrame, year: int, min_weight: int = 500) -> DataFrame:
    return bucket_profile(
        fact,
        year,
        {"avg_medicare_spend": SPEND},
        [SPEND],
        min_weight,
        where=F.col(GROUP) == "Nonmetro",
    )


def density_vs_emergency(fact: DataFrame, year: int, min_weight: int = 500) -> DataFrame:
    er = "er_visits_per_1000"
    return bucket_profile(fact, year, {"avg_er_visits_per_1000": er}, [er], min_weight)


def density_vs_preventable(fact: DataFrame, year: int, min_weight: int = 500) -> DataFrame:
    outcomes = {
        "avg_hypertension_admissions": "pqi07_hyprtnsn_age_65_74",
        "avg_diabetes_admissions": "pqi03_dbts_age_65_74",
        "avg_medicare_spend": SPEND,
    }
    return bucket_profile(fact, year, outcomes, (), min_weight, extremes=False)


def desert_list(
    fact: DataFrame, year: int, max_active: int = 1, min_weight: int = 200
) -> DataFrame:
    """Areas with at most one provider, dearest first."""
    kept = fact.filter(
        (F.col(PERIOD) == year)
        & (F.col(ACTIVE) <= max_active)
        & at_least(WEIGHT, min_weight)
        & all_present(SPEND)
    )
    return kept.select(
        AREA,
        "state_abbrev",
        "county_desc",
        CODE,
        GROUP,
        ACTIVE,
        WEIGHT,
        DENSITY,
        SPEND,
        F.col("pqi07_hyprtnsn_age_65_74").alias("hypertension_admissions_65_74"),
        F.col("pqi03_dbts_age_65_74").alias("diabetes_admissions_65_74"),
        "er_visits_per_1000",
    ).orderBy(F.col(SPEND).desc(), F.col(AREA).asc())


def tier_summary(fact: DataFrame, year: int) -> DataFrame:
    """Rural areas by provider-count tier: areas, people, mean spend per area
    and per person."""
    kept = fact.filter((F.col(PERIOD) == year) & rural() & all_present(SPEND))
    return summary(
        kept.withColumn("pharmacy_tier", tier_label(ACTIVE)),
        ["pharmacy_tier"],
        {
            "county_count": F.count("*"),
            "total_ffs_seniors": F.sum(WEIGHT),
            "avg_total_pc_unweighted": F.avg(F.col(SPEND).cast("double")),
            "avg_total_pc_weighted": weighted_mean(SPEND, WEIGHT),
            "avg_inpatient_pc_unweighted": F.avg(F.col("ip_mdcr_stdzd_pymt_pc").cast("double")),
        },
    ).orderBy("pharmacy_tier")


def _gap_names(gap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return gap.select(
        *by,
        F.col("target_areas").alias("fragile_counties"),
        F.col("target_weight").alias("fragile_seniors"),
        F.col("target_mean").alias("fragile_spend_per_senior"),
        F.col("bench_mean").alias("rural_with_pharmacy_per_senior"),
        F.col("gap").alias("gap_per_senior"),
        F.col("excess_total").alias("annual_excess_dollars"),
    )


def fragility_gap(fact: DataFrame, year: int) -> DataFrame:
    """Rural areas with 0 or 1 provider against rural areas with 2 or more."""
    rows = fact.filter((F.col(PERIOD) == year) & rural())
    target, bench = F.col(ACTIVE).isin(0, 1), F.col(ACTIVE) >= 2
    return _gap_names(benchmark_gap(rows, SPEND, WEIGHT, target, bench))


def gap_trend(fact: DataFrame, years: Sequence[int]) -> DataFrame:
    """:func:`fragility_gap` for every year."""
    rows = fact.filter(F.col(PERIOD).isin(list(years)) & rural())
    target, bench = F.col(ACTIVE).isin(0, 1), F.col(ACTIVE) >= 2
    gaps = benchmark_gap(rows, SPEND, WEIGHT, target, bench, [PERIOD])
    return _gap_names(gaps, [PERIOD]).orderBy(PERIOD)


def excess_concentration(fact: DataFrame, year: int, k: int | None = 15) -> DataFrame:
    """The k fragile areas with the greatest excess (spend above the rural benchmark, times
    people), or all of them (``None``), each with its share of the total excess of all
    fragile areas and the running share. Two scans: the benchmark, then the areas, whose
    positions and running sums come from a prefix sum over ranges of the order."""
    rows = fact.filter((F.col(PERIOD) == year) & rural() & all_present(SPEND, WEIGHT))
    bench = rows.filter(F.col(ACTIVE) >= 2).agg(weighted_mean(SPEND, WEIGHT).alias("bench"))
    over = F.col(SPEND).cast("double") - F.col("bench")
    excess = (
        rows.filter(F.col(ACTIVE).isin(0, 1))
        .crossJoin(F.broadcast(bench))
        .select(AREA, (over * F.col(WEIGHT)).cast("decimal(18,2)").alias("excess"), F.lit(1).alias("one"))
    )
    summed = running_totals(
        excess,
        {"position": "one", "running": "excess"},
        "excess",
        AREA,
        descending=True,
        totals={"total_excess": "excess"},
    )
    share = F.nullif(F.col("total_excess").cast("double"), F.lit(0.0))
    out = summed.select(
        F.col("position").cast("int").alias("position"),
        AREA,
        "excess",
        (F.col("excess").cast("double") / share).cast("decimal(18,6)").alias("share"),
        (F.col("running").cast("double") / share).cast("decimal(18,6)").alias("running_share"),
    )
    return out if k is None else out.filter(F.col("position") <= k)


def stratified_contrast(fact: DataFrame, year: int, min_weight: int = 500) -> DataFrame:
    """Mean spend per density bucket over all areas beside the same within each
    rural-urban group: a trend that turns once the groups are held apart. All areas are
    one more stratum, so that all buckets come from the same passes over the year."""
    strata = F.array(F.struct(F.lit(True).alias("whole"), F.lit("All").alias("stratum")),
                     F.struct(F.lit(False).alias("whole"), F.col(GROUP).alias("stratum")))
    given = F.filter(strata, lambda s: s["stratum"].isNotNull())
    doubled = fact.select(PERIOD, AREA, DENSITY, SPEND, WEIGHT, F.inline(given))
    return bucket_profile(
        doubled, year, {"avg_medicare_spend": SPEND}, [SPEND], min_weight, extremes=False, strata=["whole", "stratum"]
    ).select("stratum", "density_bucket", "county_count", "avg_density", "avg_medicare_spend")


def spend_by_group(fact: DataFrame, year: int) -> DataFrame:
    kept = fact.filter((F.col(PERIOD) == year) & all_present(GROUP, SPEND))
    return summary(
        kept,
        [GROUP],
        {
            "county_count": F.count("*"),
            "avg_medicare_spend": average(SPEND, "decimal(10,2)"),
            "avg_pharmacy_density": average(DENSITY, "decimal(8,4)"),
            "avg_er_visits_per_1000": average("er_visits_per_1000", "decimal(8,2)"),
        },
    ).orderBy(F.col("avg_medicare_spend").desc(), GROUP)


def spend_by_code(fact: DataFrame, year: int) -> DataFrame:
    kept = fact.filter((F.col(PERIOD) == year) & all_present(CODE, SPEND))
    return summary(
        kept,
        [CODE, GROUP],
        {
            "county_count": F.count("*"),
            "avg_medicare_spend": average(SPEND, "decimal(10,2)"),
            "avg_pharmacy_density": average(DENSITY, "decimal(8,4)"),
        },
    ).orderBy(CODE)


def lowest_density(panel: DataFrame, medicare: DataFrame, year: int, k: int = 10) -> DataFrame:
    """The k areas of lowest density among those with a provider, with their
    spend of the same year. The k rows are picked before the join: it cannot
    change them, as (area, year) is unique on the measure side."""
    rows = panel.filter(
        (F.col(PERIOD) == year) & all_present(DENSITY) & (F.col(ACTIVE) > 0)
    ).select(AREA, ACTIVE, WEIGHT, DENSITY)
    picked = top_k(rows, [F.col(DENSITY).asc(), F.col(AREA).asc()], k)
    spend = medicare.filter((F.col(PERIOD) == year) & (F.col("bene_age_lvl") == "All"))
    spend = spend.select(AREA, F.col(SPEND).alias("medicare_spend_per_capita"))
    wanted = spend.join(F.broadcast(picked.select(AREA)), [AREA], "left_semi")
    joined = picked.join(F.broadcast(wanted), [AREA], "left")
    return joined.orderBy(F.col(DENSITY).asc(), F.col(AREA).asc())


def highest_spend(fact: DataFrame, year: int, k: int = 10) -> DataFrame:
    kept = fact.filter((F.col(PERIOD) == year) & all_present(SPEND))
    cols = [AREA, "state_abbrev", "county_desc", CODE, GROUP, ACTIVE, DENSITY, WEIGHT, SPEND]
    return top_k(kept.select(*cols), [F.col(SPEND).desc(), F.col(AREA).asc()], k)


def yearly_totals(panel: DataFrame) -> DataFrame:
    """Areas, stock and flows per year."""
    return summary(
        panel,
        [PERIOD],
        {
            "county_count": F.count("*"),
            "total_active": F.sum(ACTIVE),
            "total_openings": F.sum("openings_in_year"),
            "total_closures": F.sum("closures_in_year"),
            "avg_per_county": F.avg(F.col(ACTIVE).cast("double")).cast("decimal(6,1)"),
        },
    ).orderBy(PERIOD)


def anchor_years(panel: DataFrame, first: int, last: int) -> DataFrame:
    """First against last year, over all areas."""
    return summary(
        panel.filter(F.col(PERIOD).isin(first, last)),
        [PERIOD],
        {
            "counties_with_pharmacies": F.count("*"),
            "national_active_pharmacies": F.sum(ACTIVE),
            "avg_national_density": average(DENSITY, "decimal(8,4)"),
        },
    ).orderBy(PERIOD)


def spend_staircase(fact: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per-person spend of each provider-count tier, most providers to none,
    side by side over the years."""
    kept = fact.filter(F.col(PERIOD).isin(list(years)) & rural() & all_present(SPEND))
    return summary(
        kept.withColumn("pharmacy_tier", tier_label(ACTIVE)),
        ["pharmacy_tier", PERIOD],
        {"weighted_spend": weighted_mean(SPEND, WEIGHT)},
    ).orderBy(PERIOD, "pharmacy_tier")
