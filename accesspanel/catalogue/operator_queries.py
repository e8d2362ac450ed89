"""Joins, aggregates, windows, sorts, lifecycle and quality operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accesspanel.catalogue.derived import CODE_WIDTH, YEAR, YEARS, derive, staged, table
from accesspanel.catalogue.registry import doubles, mean_text, percent_text, query
from accesspanel.functions.cleaning import first_match_slot, match_label, safe_cast
from accesspanel.operators import aggregates, joins, lifecycle, observed, quality, reconcile, windows
from accesspanel.plans.builders import typed_crosswalk
from accesspanel.sources import tables
from accesspanel.sources.contracts import Contract, Field, quarantine

PHARMACIES, MEDICARE = "raw.pharmacies", "raw.medicare_spending"
CODES, CROSSWALK = "raw.rucc_codes", "raw.zip_to_fips"
C_PHARM, C_MED = "clean.pharmacies", "clean.medicare_spending"
C_CODES, C_XWALK = "clean.rucc_codes", "clean.zip_to_fips"
PANEL, FACT = "curated.county_year_panel", "curated.fact_county_year"
FIRST, LAST = YEARS[0], YEARS[-1]
SPEND, WEIGHT, DENSITY = "tot_mdcr_stdzd_pymt_pc", "benes_ffs_cnt", "pharmacies_per_10k_benes"

# --- joins -------------------------------------------------------------------

AREA_SQL = "SELECT npi, zip5, county_fips FROM clean_pharmacies"


def _attached(spark, sf_dir, skewed=None):
    raw, xwalk = staged(spark, sf_dir, PHARMACIES), staged(spark, sf_dir, C_XWALK)
    placed = joins.attach_area(raw, xwalk, "postal_code", width=CODE_WIDTH, skewed=skewed)
    return placed.select(F.trim("npi").alias("npi"), "zip5", "county_fips")


@query("j1_attach_area", AREA_SQL, ("clean_pharmacies",))
def _(spark, sf_dir):
    return _attached(spark, sf_dir)


@query("j1_attach_area_skewed", AREA_SQL, ("clean_pharmacies",))
def _(spark, sf_dir):
    return _attached(spark, sf_dir, skewed=True)


def _segments(spark, sf_dir):
    """Customers with their segment written in several ways, and a lookup of segments."""
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    seen = F.when(key == 0, F.concat(F.lower("c_mktsegment"), F.lit("  "))).when(key == 1, F.initcap("c_mktsegment"))
    lookup = customer.groupBy("c_mktsegment").agg(F.count("*").alias("customers")).select(
        F.concat(F.initcap("c_mktsegment"), F.lit(" ")).alias("segment"), "customers"
    )
    return customer.select("c_custkey", F.coalesce(seen, "c_mktsegment").alias("segment")), lookup


_SEGMENT_SQL = (
    "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || '  ' "
    "WHEN 1 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE c_mktsegment END"
)


@query(
    "j1_lookup_any_case",
    f"WITH c AS (SELECT c_custkey, {_SEGMENT_SQL} AS segment FROM customer), "
    "l AS (SELECT lower(c_mktsegment) AS name, count(*) AS customers FROM customer GROUP BY 1) "
    "SELECT c_custkey, segment, customers FROM c LEFT JOIN l ON lower(rtrim(segment)) = name",
)
def _(spark, sf_dir):
    return joins.lookup_join(*_segments(spark, sf_dir), "segment", ci=True).select("c_custkey", "segment", "customers")


@query(
    "v2_unique_key_any_case",
    f"SELECT lower(rtrim(segment)) AS segment, count(*) AS n FROM (SELECT {_SEGMENT_SQL} AS segment FROM customer) "
    "GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf_dir):
    return quality.check_unique(_segments(spark, sf_dir)[0], ["segment"], ci=True)


@query(
    "j2_attach_denominator",
    "SELECT c.county_fips, c.year_id, c.active, m.benes_ffs_cnt FROM counts c LEFT JOIN clean_medicare m "
    "ON c.county_fips = m.county_fips AND c.year_id = m.year_id AND m.bene_age_lvl = 'All'",
    ("counts", "clean_medicare"),
)
def _(spark, sf_dir):
    counts = lifecycle.period_counts(staged(spark, sf_dir, C_PHARM), YEARS)
    measures = staged(spark, sf_dir, C_MED)
    joined = joins.attach_denominator(
        counts, measures, ["county_fips", "year_id"], [WEIGHT], F.col("bene_age_lvl") == "All"
    )
    return joined.select("county_fips", "year_id", "active", WEIGHT)


@query(
    "j3_assemble_fact",
    "SELECT county_fips, year_id, active_pharmacies, rucc_code, benes_ffs_cnt FROM fact",
    ("fact",),
)
def _(spark, sf_dir):
    base = staged(spark, sf_dir, C_MED).filter(F.col("year_id").isin(*YEARS))
    panel = staged(spark, sf_dir, PANEL).drop(WEIGHT)
    codes = staged(spark, sf_dir, C_CODES).select("county_fips", "rucc_code")
    fact = joins.assemble_fact(base, panel, codes)
    return fact.select("county_fips", "year_id", "active_pharmacies", "rucc_code", WEIGHT)


@query(
    "j4_cross_periods",
    "SELECT y::INTEGER AS period, o_orderstatus, count(*) AS n FROM orders "
    f"CROSS JOIN range({FIRST}, {LAST + 1}) t(y) WHERE year(o_orderdate) <= y GROUP BY y, o_orderstatus",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    grid = orders.crossJoin(F.broadcast(tables.periods(spark, FIRST, LAST)))
    started = grid.filter(F.year("o_orderdate") <= F.col("period"))
    return aggregates.distribution(started, ["period", "o_orderstatus"])


@query(
    "j5_cross_scalars",
    "SELECT n_orders, n_lines, top_price FROM (SELECT count(*) AS n_orders, max(o_totalprice) AS top_price "
    "FROM orders) CROSS JOIN (SELECT count(*) AS n_lines FROM lineitem)",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )
    lines = aggregates.row_count(table(spark, sf_dir, "lineitem"), "n_lines")
    return joins.cross_scalars(orders, lines).select("n_orders", "n_lines", "top_price")


UNMATCHED_SQL = (
    "SELECT DISTINCT m.county_fips, m.state_abbrev, m.county_desc FROM clean_medicare m "
    "LEFT JOIN clean_codes r ON m.county_fips = r.county_fips WHERE r.county_fips IS NULL"
)
UNMATCHED_COLS = ["county_fips", "state_abbrev", "county_desc"]


@query("j6_unmatched", UNMATCHED_SQL, ("clean_medicare", "clean_codes"))
def _(spark, sf_dir):
    return joins.unmatched(
        staged(spark, sf_dir, C_MED), staged(spark, sf_dir, C_CODES), "county_fips", UNMATCHED_COLS
    ).select(*UNMATCHED_COLS)


COVERAGE_SQL = (
    "SELECT count(*) AS total, count(r.county_fips) AS matched, "
    "count(*) - count(r.county_fips) AS unmatched, "
    + percent_text("count(r.county_fips)", "count(*)")
    + " AS pct_matched FROM "
)


@query(
    "j7_join_coverage",
    COVERAGE_SQL + "(SELECT DISTINCT county_fips FROM clean_medicare) m "
    "LEFT JOIN clean_codes r ON m.county_fips = r.county_fips",
    ("clean_medicare", "clean_codes"),
)
def _(spark, sf_dir):
    return joins.join_coverage(
        staged(spark, sf_dir, C_MED), staged(spark, sf_dir, C_CODES), "county_fips"
    )


@query(
    "j8_fixed_year_report",
    f"SELECT p.county_fips, p.year_id, p.active_pharmacies, {doubles('m.tot_mdcr_stdzd_pymt_pc').replace('AS m.', 'AS ')} "
    f"FROM panel p LEFT JOIN clean_medicare m ON p.county_fips = m.county_fips AND m.year_id = {YEAR} "
    "AND m.bene_age_lvl = 'All'",
    ("panel", "clean_medicare"),
)
def _(spark, sf_dir):
    only = (F.col("year_id") == YEAR) & (F.col("bene_age_lvl") == "All")
    return joins.attach_denominator(
        staged(spark, sf_dir, PANEL).select("county_fips", "year_id", "active_pharmacies"),
        staged(spark, sf_dir, C_MED),
        ["county_fips"],
        [SPEND],
        only,
    )


# --- aggregates --------------------------------------------------------------


@query("a1_row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(spark, sf_dir):
    return aggregates.row_count(table(spark, sf_dir, "lineitem"))


@query(
    "a2_distribution",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(spark, sf_dir):
    return aggregates.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "a3_group_by_expression",
    "SELECT length(trim(postal_code)) AS postal_length, "
    "CASE WHEN trim(deactivation_date) = '' THEN 'open' ELSE 'ended' END AS state_of, count(*) AS n "
    "FROM raw_pharmacies GROUP BY 1, 2",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    ended = F.when(F.trim("deactivation_date") == "", "open").otherwise("ended")
    return aggregates.distribution(
        staged(spark, sf_dir, PHARMACIES),
        {"postal_length": F.length(F.trim("postal_code")), "state_of": ended},
    )


@query(
    "a4_key_multiplicity",
    "SELECT count(DISTINCT zip) AS distinct_keys, count(*) AS total_rows, "
    "count(*) - count(DISTINCT zip) AS extra_rows FROM raw_crosswalk",
    ("raw_crosswalk",),
)
def _(spark, sf_dir):
    return aggregates.key_multiplicity(staged(spark, sf_dir, CROSSWALK), "zip")


@query("a5_distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(spark, sf_dir):
    return aggregates.distinct_rows(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


_COMPLETE = (SPEND, "pharmacies_per_10k_benes", "rucc_code")


def completeness_sql(cols, source, by=""):
    parts = [
        f"count({c}) AS {c}_present, count(*) - count({c}) AS {c}_null, "
        f"{percent_text(f'count(*) - count({c})', 'count(*)')} AS {c}_pct_null"
        for c in cols
    ]
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"SELECT {lead}count(*) AS total_rows, {', '.join(parts)} FROM {source}{tail}"


@query("a6_completeness", completeness_sql(_COMPLETE, "fact", "year_id"), ("fact",))
def _(spark, sf_dir):
    return aggregates.completeness(staged(spark, sf_dir, FACT), _COMPLETE, ["year_id"])


@query(
    "a7_summary",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, "
    "sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_price, "
    + mean_text("l_extendedprice::DECIMAL(12,2)", 2, 2)
    + " AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def _(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return aggregates.summary(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "n": F.count("*"),
            "min_qty": F.min("l_quantity"),
            "max_qty": F.max("l_quantity"),
            "sum_price": F.sum(price),
            "avg_price": aggregates.average(price, "decimal(12,2)"),
        },
    )


@query(
    "a8_weighted_mean",
    "SELECT year_id, round(sum(tot_mdcr_stdzd_pymt_pc * benes_ffs_cnt)::DOUBLE "
    "/ nullif(sum(benes_ffs_cnt), 0)::DOUBLE, 4) AS weighted, "
    + mean_text(SPEND, 2, 4)
    + " AS unweighted FROM fact GROUP BY year_id",
    ("fact",),
)
def _(spark, sf_dir):
    return aggregates.summary(
        staged(spark, sf_dir, FACT),
        ["year_id"],
        {
            "weighted": F.round(aggregates.weighted_mean(SPEND, WEIGHT), 4),
            "unweighted": aggregates.average(SPEND, "decimal(12,4)"),
        },
    )


def gap_sql(where, by=""):
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    fragile, bench = "active_pharmacies IN (0, 1)", "active_pharmacies >= 2"

    def mean(cond):
        return (
            f"sum({SPEND} * {WEIGHT}) FILTER (WHERE {cond})::DOUBLE "
            f"/ nullif(sum({WEIGHT}) FILTER (WHERE {cond}), 0)::DOUBLE"
        )

    return (
        f"SELECT {lead}areas AS fragile_counties, seniors AS fragile_seniors, "
        "round(f, 2) AS fragile_spend_per_senior, round(b, 2) AS rural_with_pharmacy_per_senior, "
        "round(f - b, 2) AS gap_per_senior, round((f - b) * seniors, 0) AS annual_excess_dollars FROM ("
        f"SELECT {lead}count(*) FILTER (WHERE {fragile}) AS areas, "
        f"(sum({WEIGHT}) FILTER (WHERE {fragile}))::BIGINT AS seniors, {mean(fragile)} AS f, {mean(bench)} AS b "
        f"FROM fact WHERE {where} AND rucc_code BETWEEN 4 AND 9 AND {SPEND} IS NOT NULL "
        f"AND {WEIGHT} IS NOT NULL{tail})"
    )


@query(
    "a9_benchmark_gap",
    gap_sql(f"year_id = {FIRST}", "rucc_code"),
    ("fact",),
)
def _(spark, sf_dir):
    rows = staged(spark, sf_dir, FACT).filter(
        (F.col("year_id") == FIRST) & F.col("rucc_code").between(4, 9)
    )
    active = F.col("active_pharmacies")
    gap = aggregates.benchmark_gap(rows, SPEND, WEIGHT, active.isin(0, 1), active >= 2, ["rucc_code"])
    return gap.withColumnsRenamed(
        {
            "target_areas": "fragile_counties",
            "target_weight": "fragile_seniors",
            "target_mean": "fragile_spend_per_senior",
            "bench_mean": "rural_with_pharmacy_per_senior",
            "gap": "gap_per_senior",
            "excess_total": "annual_excess_dollars",
        }
    )


@query("a10_flag_totals", "SELECT * FROM counts", ("counts",))
def _(spark, sf_dir):
    return lifecycle.flag_totals(lifecycle.lifecycle_flags(staged(spark, sf_dir, C_PHARM), YEARS))


# --- windows -----------------------------------------------------------------


@query(
    "w1_dominant_row",
    "SELECT l_partkey, l_suppkey, q, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey "
    "ORDER BY q DESC, n DESC, l_suppkey) AS rn FROM (SELECT l_partkey, l_suppkey, sum(l_quantity)::BIGINT AS q, "
    "count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)) WHERE rn = 1",
)
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n")
    )
    return windows.dominant_row(pairs, "l_partkey", ["q", "n"], "l_suppkey")


GROUP_SIZE_SQL = (
    "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey) AS group_size FROM lineitem"
)


def _sized(spark, sf_dir, skewed=None):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return windows.group_size(lines, "l_suppkey", skewed=skewed).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "group_size"
    )


@query("w2_group_size", GROUP_SIZE_SQL)
def _(spark, sf_dir):
    return _sized(spark, sf_dir)


@query("w2_group_size_skewed", GROUP_SIZE_SQL)
def _(spark, sf_dir):
    return _sized(spark, sf_dir, skewed=True)


@query(
    "w3_percent_of_total",
    "SELECT num_counties_in_zip, count(*) AS num_zips, "
    + percent_text("count(*)", "(sum(count(*)) OVER ())")
    + " AS pct_of_total "
    "FROM clean_crosswalk GROUP BY num_counties_in_zip",
    ("clean_crosswalk",),
)
def _(spark, sf_dir):
    return aggregates.distribution(
        staged(spark, sf_dir, C_XWALK), ["num_counties_in_zip"], "num_zips", pct="pct_of_total"
    )


@query(
    "w4_ntile_bucket",
    "SELECT o_orderkey, ntile(5) OVER (ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey)::INTEGER AS bucket "
    "FROM orders",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return windows.ntile_bucket(orders, 5, "o_totalprice", "o_orderkey").select("o_orderkey", "bucket")


@query(
    "w4_ntile_repeated_values",
    "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey)::INTEGER AS bucket "
    "FROM orders",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return windows.ntile_bucket(orders, 7, "o_orderpriority", "o_orderkey").select("o_orderkey", "bucket")


@query(
    "w4_ntile_strata",
    "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice ASC NULLS FIRST, "
    "o_orderkey)::INTEGER AS bucket FROM orders",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    bucketed = windows.ntile_bucket(
        orders, 4, "o_totalprice", "o_orderkey", strata=["o_orderstatus"]
    )
    return bucketed.select("o_orderkey", "bucket")


@query(
    "w5_first_last_delta",
    "SELECT county_fips, year_id, (last_value(benes_total_cnt) OVER w - first_value(benes_total_cnt) OVER w) "
    "AS benes_total_cnt_change, (last_value(tot_mdcr_stdzd_pymt_pc) OVER w - "
    "first_value(tot_mdcr_stdzd_pymt_pc) OVER w)::DOUBLE AS tot_mdcr_stdzd_pymt_pc_change FROM clean_medicare "
    "WINDOW w AS (PARTITION BY county_fips ORDER BY year_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ("clean_medicare",),
)
def _(spark, sf_dir):
    rows = staged(spark, sf_dir, C_MED).select("county_fips", "year_id", "benes_total_cnt", SPEND)
    deltas = windows.first_last_delta(rows, "county_fips", "year_id", ["benes_total_cnt", SPEND])
    return deltas.drop("benes_total_cnt", SPEND)


# --- sorts and limits --------------------------------------------------------


@query(
    "k1_top_groups",
    "SELECT state, count(*) AS num_pharmacies, count(*) FILTER (WHERE most_recent_status = 'Active') AS active, "
    "count(*) FILTER (WHERE most_recent_status = 'Closed') AS closed FROM clean_pharmacies GROUP BY state "
    "ORDER BY num_pharmacies DESC, state LIMIT 10",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    status = F.col("most_recent_status")
    return aggregates.top_groups(
        staged(spark, sf_dir, C_PHARM),
        "state",
        10,
        "num_pharmacies",
        {
            "active": aggregates.count_where(status == "Active"),
            "closed": aggregates.count_where(status == "Closed"),
        },
    )


@query(
    "k2_top_rows",
    'SELECT "YEAR" AS y, BENE_GEO_DESC AS area, TOT_MDCR_STDZD_PYMT_PC AS spend_text FROM raw_medicare '
    f"WHERE BENE_GEO_LVL = 'County' AND BENE_AGE_LVL = 'All' AND \"YEAR\" = '{YEAR}' "
    "ORDER BY TRY_CAST(TOT_MDCR_STDZD_PYMT_PC AS DOUBLE) DESC NULLS LAST, BENE_GEO_DESC LIMIT 5",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    kept = (
        (F.col("BENE_GEO_LVL") == "County")
        & (F.col("BENE_AGE_LVL") == "All")
        & (F.col("YEAR") == str(YEAR))
    )
    order = [
        safe_cast("TOT_MDCR_STDZD_PYMT_PC", "double").desc_nulls_last(),
        F.col("BENE_GEO_DESC").asc(),
    ]
    top = aggregates.top_k(staged(spark, sf_dir, MEDICARE).filter(kept), order, 5)
    return top.select(
        F.col("YEAR").alias("y"),
        F.col("BENE_GEO_DESC").alias("area"),
        F.col("TOT_MDCR_STDZD_PYMT_PC").alias("spend_text"),
    )


@query(
    "k3_total_order",
    "SELECT county_fips, year_id, active_pharmacies FROM fact ORDER BY county_fips, year_id",
    ("fact",),
)
def _(spark, sf_dir):
    fact = staged(spark, sf_dir, FACT).select("county_fips", "year_id", "active_pharmacies")
    return fact.orderBy("county_fips", "year_id")


@query(
    "k4_first_rows",
    "SELECT zip, county_fips, bus_ratio FROM raw_crosswalk ORDER BY zip, county_fips LIMIT 10",
    ("raw_crosswalk",),
)
def _(spark, sf_dir):
    raw = staged(spark, sf_dir, CROSSWALK).select("zip", "county_fips", "bus_ratio")
    return aggregates.top_k(raw, [F.col("zip").asc(), F.col("county_fips").asc()], 10)


# --- lifecycle ---------------------------------------------------------------


@query(
    "l0_period_bounds",
    "SELECT y::INTEGER AS period, make_date(y, 1, 1)::VARCHAR AS period_start, "
    "make_date(y, 12, 31)::VARCHAR AS period_end, count(o_orderkey) AS n FROM range(1996, 2001) t(y) "
    "LEFT JOIN orders ON o_orderdate::DATE BETWEEN make_date(y, 1, 1) AND make_date(y, 12, 31) GROUP BY y",
)
def _(spark, sf_dir):
    bounds = lifecycle.period_bounds(tables.periods(spark, FIRST, LAST))
    per_year = aggregates.distribution(table(spark, sf_dir, "orders"), {"period": F.year("o_orderdate")})
    return bounds.join(per_year, ["period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("l1_lifecycle_flags", "SELECT * FROM flags", ("flags",))
def _(spark, sf_dir):
    flags = lifecycle.lifecycle_flags(staged(spark, sf_dir, C_PHARM), YEARS)
    return flags.select("npi", "county_fips", "year_id", "is_active", "is_opening", "is_closing")


@query("l1_period_counts", "SELECT * FROM counts", ("counts",))
def _(spark, sf_dir):
    return lifecycle.period_counts(staged(spark, sf_dir, C_PHARM), YEARS)


@query("l1_event_counts", "SELECT * FROM counts", ("counts",))
def _(spark, sf_dir):
    return lifecycle.event_counts(staged(spark, sf_dir, C_PHARM), YEARS)


PANEL_SQL = (
    "SELECT county_fips, year_id, active_pharmacies AS active, openings_in_year AS openings, "
    "closures_in_year AS closures, benes_ffs_cnt, pharmacies_per_10k_benes::DOUBLE AS rate, "
    f"closures_per_10k_benes::DOUBLE AS closure_rate, pharmacy_count_change_{FIRST}_{LAST} AS active_change, "
    f"pharmacy_density_change_{FIRST}_{LAST}::DOUBLE AS rate_change FROM panel"
)


@query("l2_build_panel", PANEL_SQL, ("panel",))
def _(spark, sf_dir):
    return lifecycle.build_panel(
        staged(spark, sf_dir, C_PHARM),
        staged(spark, sf_dir, C_MED),
        YEARS,
        only=F.col("bene_age_lvl") == "All",
    )


@query("l2_incremental_panel", PANEL_SQL, ("panel",))
def _(spark, sf_dir):
    new = staged(spark, sf_dir, C_PHARM)
    pick = F.crc32(F.col("npi").cast("binary")) % 100
    # the snapshot before: some providers elsewhere, some open longer, some missing, some since gone
    moved = new.where(pick != 3).withColumns(
        {
            "county_fips": F.when(pick == 5, F.lit("0" * CODE_WIDTH)).otherwise(F.col("county_fips")),
            "deactivation_date": F.when(pick == 7, F.date_add("deactivation_date", 400)).otherwise(F.col("deactivation_date")),
        }
    )
    gone = new.where(pick == 9).withColumn("npi", F.concat(F.lit("x"), "npi"))
    old = moved.unionByName(gone)
    stored = tables.materialize(lifecycle.partial_counts(old, YEARS), "partials")
    before, after = lifecycle.snapshot_changes(old, new, "npi")
    merged = lifecycle.merge_partials(stored, before, after, YEARS)
    return lifecycle.unfold_panel(merged, staged(spark, sf_dir, C_MED).where(F.col("bene_age_lvl") == "All"), YEARS)


# --- quality -----------------------------------------------------------------


@query(
    "v1_row_count",
    "SELECT count(*) AS row_count, 4 * (SELECT count(*) FROM orders) AS expected, "
    "CASE WHEN abs(count(*) - 4 * (SELECT count(*) FROM orders)) <= 0.1 * 4 * (SELECT count(*) FROM orders) "
    "THEN 1 ELSE 0 END AS within FROM lineitem",
)
def _(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").agg(4 * F.count("*"))
    return quality.check_row_count(table(spark, sf_dir, "lineitem"), expected, 0.1)


@query(
    "v1_load_report",
    "SELECT 'raw.pharmacies' AS table_name, count(*) AS row_count, "
    "'Rows loaded into raw.pharmacies: ' || count(*) AS message FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return quality.load_report(staged(spark, sf_dir, PHARMACIES), PHARMACIES).drop("expected")


_WRITTEN = "clean.rucc_codes"


@query(
    "v1_checks_while_writing",
    f"WITH c(check_name, column_name, value) AS (SELECT 'rows', '', count(*) FROM clean_codes "
    "UNION ALL SELECT 'nulls', 'rucc_code', sum((rucc_code IS NULL)::INT) FROM clean_codes "
    "UNION ALL SELECT 'nulls', 'state_abbrev', sum((state_abbrev IS NULL)::INT) FROM clean_codes "
    "UNION ALL SELECT 'below', 'rucc_code', sum((rucc_code < 2)::INT) FROM clean_codes "
    "UNION ALL SELECT 'above', 'rucc_code', sum((rucc_code > 8)::INT) FROM clean_codes "
    "UNION ALL SELECT 'below', 'population_2020', sum((population_2020 < 2000)::INT) FROM clean_codes) "
    f"SELECT '{_WRITTEN}' AS table_name, check_name, column_name, value::BIGINT AS value, "
    "(check_name = 'rows' OR value = 0)::INTEGER AS passed, "
    f"'{_WRITTEN}: ' || rtrim(check_name || ' ' || column_name) || ': ' || value::BIGINT AS message FROM c",
    ("clean_codes",),
)
def _(spark, sf_dir):
    checks = observed.WriteChecks(
        not_null=["rucc_code", "state_abbrev"], ranges={"rucc_code": (2, 8), "population_2020": (2000, None)}
    )
    root = f"{tables.staging_root(spark)}/accesspanel/{spark.sparkContext.applicationId}/files/observed-{uuid.uuid4().hex}"
    _, found = observed.write_observed(derive(spark, sf_dir, _WRITTEN), root, "clean", "rucc_codes", checks, gate=False)
    return found


@query(
    "v2_unique_key",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf_dir):
    return quality.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "v3_not_null",
    "SELECT 'npi' AS column_name, count(*) - count(npi) AS null_count FROM clean_pharmacies UNION ALL "
    "SELECT 'county_fips', count(*) - count(county_fips) FROM clean_pharmacies UNION ALL "
    "SELECT 'enumeration_date', count(*) - count(enumeration_date) FROM clean_pharmacies",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    return quality.check_not_null(
        staged(spark, sf_dir, C_PHARM), ["npi", "county_fips", "enumeration_date"]
    )


_KPI = (SPEND, "ip_mdcr_stdzd_pymt_pc", "benes_ffs_cnt")


@query("v4_completeness", completeness_sql(_KPI, "clean_medicare"), ("clean_medicare",))
def _(spark, sf_dir):
    return quality.completeness(staged(spark, sf_dir, C_MED), _KPI)


def audit_sql(col, dtype):
    return (
        f"SELECT '{col}' AS column_name, CASE WHEN {col} IS NULL OR trim({col}) = '' THEN 'blank' "
        f"WHEN trim({col}) = '*' THEN 'suppressed' WHEN TRY_CAST(trim({col}) AS {dtype}) IS NULL "
        f"THEN 'unparseable' ELSE 'ok' END AS reason FROM raw_medicare"
    )


_AUDITED = {
    "TOT_MDCR_STDZD_PYMT_PC": "decimal(12,2)",
    "BENES_FFS_CNT": "bigint",
    "BENE_GEO_CD": "int",
    "BENE_GEO_DESC": "double",
}


@query(
    "v4b_cast_audit",
    "SELECT column_name, reason, count(*) AS n FROM ("
    + " UNION ALL ".join(audit_sql(c, t) for c, t in _AUDITED.items())
    + ") GROUP BY column_name, reason",
    ("raw_medicare",),
)
def _(spark, sf_dir):
    return quality.cast_audit(staged(spark, sf_dir, MEDICARE), _AUDITED)


@query(
    "v5_length_profile",
    "SELECT length(rtrim(postal_code)) AS length, count(*) AS n FROM raw_pharmacies GROUP BY 1",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    return quality.length_profile(staged(spark, sf_dir, PHARMACIES), "postal_code")


@query(
    "v6_value_distribution",
    "SELECT most_recent_status, count(*) AS num_pharmacies, "
    + percent_text("count(*)", "(sum(count(*)) OVER ())")
    + " AS pct FROM clean_pharmacies "
    "GROUP BY most_recent_status",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    return quality.distribution(
        staged(spark, sf_dir, C_PHARM), ["most_recent_status"], "num_pharmacies", pct="pct"
    )


@query(
    "v7_join_coverage",
    COVERAGE_SQL + "clean_crosswalk z LEFT JOIN clean_codes r ON z.county_fips = r.county_fips",
    ("clean_crosswalk", "clean_codes"),
)
def _(spark, sf_dir):
    return quality.join_coverage(
        staged(spark, sf_dir, C_XWALK), staged(spark, sf_dir, C_CODES), "county_fips", distinct=False
    )


@query(
    "v7_match_rate",
    "SELECT CASE WHEN county_fips IS NULL THEN 'Unmatched' ELSE 'Matched' END AS fips_match, "
    "count(*) AS num_pharmacies, "
    + percent_text("count(*)", "(sum(count(*)) OVER ())")
    + " AS pct "
    "FROM clean_pharmacies GROUP BY 1",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    return quality.distribution(
        staged(spark, sf_dir, C_PHARM),
        {"fips_match": match_label("county_fips")},
        "num_pharmacies",
        pct="pct",
    )


@query(
    "v8_unmatched_sample",
    UNMATCHED_SQL + " ORDER BY ALL LIMIT 10",
    ("clean_medicare", "clean_codes"),
)
def _(spark, sf_dir):
    return quality.unmatched_sample(
        staged(spark, sf_dir, C_MED), staged(spark, sf_dir, C_CODES), "county_fips", UNMATCHED_COLS
    )


def profile_sql(cols, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'string' AS data_type, count(*) AS row_count, "
        f"count(*) - count({c}) AS null_count, count(*) FILTER (WHERE trim({c}) IN ('*', '')) AS marker_count, "
        f"min(length(rtrim({c}))) AS min_length, max(length(rtrim({c}))) AS max_length FROM {source}"
        for c in cols
    )


@query(
    "v9_profile_columns",
    profile_sql(["ER_VISITS_PER_1000_BENES", "ACUTE_HOSP_READMSN_PCT", "BENE_GEO_CD"], "raw_medicare"),
    ("raw_medicare",),
)
def _(spark, sf_dir):
    profile = quality.profile_columns(
        staged(spark, sf_dir, MEDICARE),
        required=["YEAR", "BENE_GEO_LVL"],
        patterns=["^ER_", "READM", "GEO"],
        exclude=["_LVL$", "_DESC$"],
    )
    return profile.drop("position", "approx_distinct")


@query(
    "v10_contract_violations",
    "SELECT CASE WHEN county_fips IS NULL THEN 'county_fips: required value missing' "
    "ELSE 'county_fips: longer than 9' END AS violation, count(*) AS n FROM clean_pharmacies "
    "WHERE county_fips IS NULL OR length(county_fips) > 9 GROUP BY 1",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    rule = Contract("audit.placed", (Field("npi"), Field("county_fips", "string", 9, True)))
    broken = quarantine(staged(spark, sf_dir, C_PHARM), rule)
    return aggregates.distribution(broken, ["violation"])


@query(
    "v11_spot_check",
    "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name LIKE 'Customer#%7' AND c_acctbal > 9000",
)
def _(spark, sf_dir):
    known = F.col("c_name").rlike("^Customer#.*7$") & (F.col("c_acctbal") > 9000)
    return quality.spot_check(
        table(spark, sf_dir, "customer"), known, ["c_custkey", "c_name", "c_nationkey"]
    )


@query(
    "v11_tie_back",
    "SELECT f.county_fips, f.year_id, f.benes_ffs_cnt AS later_value, p.benes_ffs_cnt AS earlier_value FROM fact f "
    "LEFT JOIN panel p ON f.county_fips = p.county_fips AND f.year_id = p.year_id "
    "WHERE f.benes_ffs_cnt IS DISTINCT FROM p.benes_ffs_cnt",
    ("fact", "panel"),
)
def _(spark, sf_dir):
    return quality.tie_back(
        staged(spark, sf_dir, PANEL), staged(spark, sf_dir, FACT), ["county_fips", "year_id"], WEIGHT
    )


@query(
    "v11_reconcile",
    "SELECT c_custkey, CASE WHEN c_custkey % 101 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer "
    "WHERE c_custkey % 101 = 0 OR c_custkey % 103 = 0 "
    "UNION ALL SELECT c_custkey + 1000000000, 'added' FROM customer WHERE c_custkey % 107 = 0",
)
def _(spark, sf_dir):
    earlier = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    kept = earlier.where(key % 101 != 0)
    later = kept.withColumn("c_acctbal", F.when(key % 103 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    later = later.unionByName(earlier.where(key % 107 == 0).withColumn("c_custkey", key + 1_000_000_000))
    root = f"{tables.staging_root(spark)}/accesspanel/{spark.sparkContext.applicationId}/files/hashed-{uuid.uuid4().hex}"
    reconcile.write_hashed(earlier, root, "raw", "earlier", ["c_custkey"], 64)
    reconcile.write_hashed(later, root, "raw", "later", ["c_custkey"], 64)
    return reconcile.reconcile(spark, (root, "raw", "earlier"), (root, "raw", "later"), ["c_custkey"])


@query(
    "v12_range_check",
    "SELECT year_id, min(pharmacies_per_10k_benes)::DOUBLE AS min_value, "
    "max(pharmacies_per_10k_benes)::DOUBLE AS max_value, "
    + mean_text(DENSITY, 4, 4)
    + " AS avg_value, count(*) - count(pharmacies_per_10k_benes) AS null_count FROM panel GROUP BY year_id",
    ("panel",),
)
def _(spark, sf_dir):
    return quality.range_check(staged(spark, sf_dir, PANEL), DENSITY, ["year_id"])


@query(
    "v13_status_mismatch",
    "SELECT npi, county_fips FROM clean_pharmacies WHERE most_recent_status = 'Closed' AND deactivation_date IS NULL",
    ("clean_pharmacies",),
)
def _(spark, sf_dir):
    found = quality.status_mismatch(
        staged(spark, sf_dir, C_PHARM), "most_recent_status", "deactivation_date"
    )
    return found.select("npi", "county_fips")


@query(
    "v14_flow_summary",
    "SELECT year_id, sum(openings_in_year)::BIGINT AS total_openings, sum(closures_in_year)::BIGINT AS total_closures "
    "FROM panel GROUP BY year_id",
    ("panel",),
)
def _(spark, sf_dir):
    return quality.flow_summary(
        staged(spark, sf_dir, PANEL), opened="openings_in_year", closed="closures_in_year"
    )


@query(
    "v15_period_compare",
    "SELECT year_id, count(*) AS areas, sum(active_pharmacies)::BIGINT AS total_active, "
    + mean_text(DENSITY, 4, 4)
    + f" AS avg_rate FROM panel WHERE year_id IN ({FIRST}, {LAST}) GROUP BY year_id",
    ("panel",),
)
def _(spark, sf_dir):
    return quality.period_compare(
        staged(spark, sf_dir, PANEL), FIRST, LAST, active="active_pharmacies", rate=DENSITY
    )


@query(
    "v16_verify_dominant",
    "SELECT zip, best AS expected, least_code AS found FROM (SELECT zip, "
    "first(county_fips ORDER BY bus_ratio DESC NULLS LAST, tot_ratio DESC NULLS LAST, county_fips) AS best, "
    "min(county_fips) AS least_code FROM typed_crosswalk GROUP BY zip) WHERE best <> least_code",
    ("typed_crosswalk",),
)
def _(spark, sf_dir):
    # Checked against the least county of each code, so that there are misses to find.
    raw = typed_crosswalk(staged(spark, sf_dir, CROSSWALK), CODE_WIDTH)
    claimed = raw.groupBy("zip").agg(F.min("county_fips").alias("county_fips"))
    return quality.verify_dominant(raw, claimed, "zip", ["bus_ratio", "tot_ratio"], "county_fips")


@query(
    "v16_verify_clean_crosswalk",
    "SELECT z.zip, b.best AS expected, z.county_fips AS found FROM clean_crosswalk z FULL JOIN (SELECT zip, "
    "first(county_fips ORDER BY bus_ratio DESC NULLS LAST, tot_ratio DESC NULLS LAST, county_fips) AS best "
    "FROM typed_crosswalk GROUP BY zip) b ON z.zip = b.zip WHERE b.best IS DISTINCT FROM z.county_fips",
    ("typed_crosswalk", "clean_crosswalk"),
)
def _(spark, sf_dir):
    raw = typed_crosswalk(staged(spark, sf_dir, CROSSWALK), CODE_WIDTH)
    clean = staged(spark, sf_dir, C_XWALK)
    return quality.verify_dominant(raw, clean, "zip", ["bus_ratio", "tot_ratio"], "county_fips")


KEYED = {
    C_CODES: ("clean_codes", ["county_fips"]),
    C_XWALK: ("clean_crosswalk", ["zip"]),
    C_PHARM: ("clean_pharmacies", ["npi"]),
    PANEL: ("panel", ["county_fips", "year_id"]),
    FACT: ("fact", ["county_fips", "year_id"]),
}


@query(
    "v2_table_keys",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS repeated_keys FROM "
        f"(SELECT 1 FROM {cte} GROUP BY {', '.join(keys)} HAVING count(*) > 1)"
        for name, (cte, keys) in KEYED.items()
    ),
    tuple(cte for cte, _ in KEYED.values()),
)
def _(spark, sf_dir):
    out = None
    for name, (_, keys) in KEYED.items():
        repeated = quality.check_unique(staged(spark, sf_dir, name), keys)
        row = repeated.agg(F.lit(name).alias("table_name"), F.count("*").alias("repeated_keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "v8_unmatched_crosswalk",
    "SELECT DISTINCT z.county_fips, z.state_abbrev FROM clean_crosswalk z LEFT JOIN clean_codes r "
    "ON z.county_fips = r.county_fips WHERE r.county_fips IS NULL ORDER BY ALL LIMIT 10",
    ("clean_crosswalk", "clean_codes"),
)
def _(spark, sf_dir):
    return quality.unmatched_sample(
        staged(spark, sf_dir, C_XWALK), staged(spark, sf_dir, C_CODES), "county_fips", ["county_fips", "state_abbrev"]
    )


@query(
    "v11_spot_check_panel",
    "SELECT county_fips, year_id, active_pharmacies, benes_ffs_cnt FROM panel "
    f"WHERE county_fips = '{1:0{CODE_WIDTH}d}' AND year_id = {YEAR}",
    ("panel",),
)
def _(spark, sf_dir):
    known = (F.col("county_fips") == f"{1:0{CODE_WIDTH}d}") & (F.col("year_id") == YEAR)
    return quality.spot_check(
        staged(spark, sf_dir, PANEL), known, ["county_fips", "year_id", "active_pharmacies", "benes_ffs_cnt"]
    )


@query(
    "r5_first_match_slot",
    "SELECT trim(npi) AS npi, CASE WHEN trim(taxonomy_code_1) LIKE '3336%' THEN trim(taxonomy_code_1) "
    "WHEN trim(taxonomy_code_2) LIKE '3336%' THEN trim(taxonomy_code_2) "
    "WHEN trim(taxonomy_code_3) LIKE '3336%' THEN trim(taxonomy_code_3) END AS code, "
    "CASE WHEN trim(taxonomy_code_1) LIKE '3336%' THEN 1 WHEN trim(taxonomy_code_2) LIKE '3336%' THEN 2 "
    "WHEN trim(taxonomy_code_3) LIKE '3336%' THEN 3 END AS slot FROM raw_pharmacies",
    ("raw_pharmacies",),
)
def _(spark, sf_dir):
    code, slot = first_match_slot(["taxonomy_code_1", "taxonomy_code_2", "taxonomy_code_3"], "3336")
    return staged(spark, sf_dir, PHARMACIES).select(
        F.trim("npi").alias("npi"), code.alias("code"), slot.alias("slot")
    )
