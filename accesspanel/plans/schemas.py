"""Contracts of the layered tables. Names, types and widths are fixed values:
they must equal the published table layouts. Labels made by this package itself
carry no width."""

from __future__ import annotations

from accesspanel.sources.contracts import Contract, Field, text_contract

RAW_PHARMACIES = text_contract(
    "raw.pharmacies",
    {
        "npi": 20,
        "entity_type_code": 5,
        "org_name": 500,
        "address_line_1": 500,
        "city": 100,
        "state": 50,
        "postal_code": 30,
        "enumeration_date": 30,
        "last_update_date": 30,
        "deactivation_reason_code": 20,
        "deactivation_date": 30,
        "reactivation_date": 30,
        "taxonomy_code_1": 20,
        "taxonomy_code_2": 20,
        "taxonomy_code_3": 20,
        "pharmacy_taxonomy_code": 20,
        "pharmacy_taxonomy_position": 10,
    },
)

RAW_CODES = text_contract(
    "raw.rucc_codes",
    ["fips", "state", "county_name", "population_2020", "rucc_2023", "description"],
)

RAW_CROSSWALK = text_contract(
    "raw.zip_to_fips",
    {
        "zip": 10,
        "county_fips": 10,
        "usps_zip_pref_city": 100,
        "usps_zip_pref_state": 10,
        "res_ratio": 50,
        "bus_ratio": 50,
        "oth_ratio": 50,
        "tot_ratio": 50,
    },
)

# Preventable-admission rates: condition, then its age bands.
PREVENTABLE = {
    "PQI03_DBTS": ("LT_65", "65_74", "GE_75"),
    "PQI05_COPD_ASTHMA": ("40_64", "65_74", "GE_75"),
    "PQI07_HYPRTNSN": ("LT_65", "65_74", "GE_75"),
    "PQI08_CHF": ("LT_65", "65_74", "GE_75"),
    "PQI11_BCTRL_PNA": ("LT_65", "65_74", "GE_75"),
}
PREVENTABLE_COLUMNS = tuple(f"{c}_AGE_{b}" for c, bands in PREVENTABLE.items() for b in bands)

# Source column -> (clean column, type) for the yearly measures.
MEASURES = {
    "BENES_FFS_CNT": ("benes_ffs_cnt", "bigint"),
    "BENES_TOTAL_CNT": ("benes_total_cnt", "bigint"),
    "TOT_MDCR_STDZD_PYMT_PC": ("tot_mdcr_stdzd_pymt_pc", "decimal(12,2)"),
    "IP_MDCR_STDZD_PYMT_PC": ("ip_mdcr_stdzd_pymt_pc", "decimal(12,2)"),
    "OP_MDCR_STDZD_PYMT_PC": ("op_mdcr_stdzd_pymt_pc", "decimal(12,2)"),
    "ER_VISITS_PER_1000_BENES": ("er_visits_per_1000", "decimal(10,2)"),
    "ACUTE_HOSP_READMSN_PCT": ("acute_hosp_readmsn_pct", "decimal(8,4)"),
    **{c: (c.lower(), "decimal(10,4)") for c in PREVENTABLE_COLUMNS},
}
MEASURE_KEYS = ("YEAR", "BENE_GEO_LVL", "BENE_GEO_DESC", "BENE_GEO_CD", "BENE_AGE_LVL")
RAW_MEDICARE_REQUIRED = (*MEASURE_KEYS, *MEASURES)

# The raw Medicare file has 247 columns; its header supplies them. All are text
# of width 20 but for these.
RAW_MEDICARE_WIDTH = 20
RAW_MEDICARE_WIDTHS = {"BENE_GEO_DESC": 100, "BENE_AGE_LVL": 10}


def raw_medicare_contract(columns: list[str]) -> Contract:
    return text_contract(
        "raw.medicare_spending",
        {c: RAW_MEDICARE_WIDTHS.get(c, RAW_MEDICARE_WIDTH) for c in columns},
    )


def clean_medicare(code_width: int = 5) -> Contract:
    return Contract(
        "clean.medicare_spending",
        (
            Field("geo_lvl", width=20, required=True),
            Field("state_abbrev", width=2),
            Field("county_desc", width=100),
            Field("county_fips", width=code_width, required=True),
            Field("year_id", "int", required=True),
            Field("bene_age_lvl", width=10, required=True),
            *[Field(name, dtype) for name, dtype in MEASURES.values()],
            Field("inpatient_spend_share", "decimal(8,6)"),
            Field("outpatient_spend_share", "decimal(8,6)"),
        ),
        ("county_fips", "year_id", "bene_age_lvl"),
    )


def clean_codes(code_width: int = 5) -> Contract:
    return Contract(
        "clean.rucc_codes",
        (
            Field("county_fips", width=code_width, required=True),
            Field("state_abbrev", width=2),
            Field("county_name", width=100),
            Field("population_2020", "int"),
            Field("rucc_code", "smallint"),
            Field("rucc_description", width=500),
            Field("rural_urban_group"),
        ),
        ("county_fips",),
    )


def clean_crosswalk(code_width: int = 5) -> Contract:
    return Contract(
        "clean.zip_to_fips",
        (
            Field("zip", width=code_width, required=True),
            Field("county_fips", width=code_width, required=True),
            Field("state_abbrev", width=2),
            Field("city_name", width=100),
            Field("bus_ratio", "double"),
            Field("res_ratio", "double"),
            Field("oth_ratio", "double"),
            Field("tot_ratio", "double"),
            Field("num_counties_in_zip", "smallint"),
        ),
        ("zip",),
    )


def clean_pharmacies(code_width: int = 5, npi_width: int = 10) -> Contract:
    return Contract(
        "clean.pharmacies",
        (
            Field("npi", width=npi_width, required=True),
            Field("entity_type_code", "smallint"),
            Field("org_name", width=500),
            Field("city", width=100),
            Field("state", width=50),
            Field("zip5", width=code_width),
            Field("county_fips", width=code_width),
            Field("enumeration_date", "date"),
            Field("last_update_date", "date"),
            Field("deactivation_date", "date"),
            Field("reactivation_date", "date"),
            Field("deactivation_reason_code", width=10),
            Field("most_recent_status"),
            Field("pharmacy_taxonomy_code", width=20),
            Field("pharmacy_taxonomy_pos", "smallint"),
        ),
        ("npi",),
    )


def _panel_fields(first: int, last: int) -> tuple[Field, ...]:
    return (
        Field("active_pharmacies", "int"),
        Field("openings_in_year", "int"),
        Field("closures_in_year", "int"),
        Field("pharmacies_per_10k_benes", "decimal(10,4)"),
        Field(f"pharmacy_count_change_{first}_{last}", "int"),
        Field(f"pharmacy_density_change_{first}_{last}", "decimal(10,4)"),
    )


def curated_panel(first: int = 2019, last: int = 2023, code_width: int = 5) -> Contract:
    active, opened, closed, density, count_change, density_change = _panel_fields(first, last)
    return Contract(
        "curated.county_year_panel",
        (
            Field("county_fips", width=code_width, required=True),
            Field("year_id", "int", required=True),
            active,
            opened,
            closed,
            Field("benes_ffs_cnt", "bigint"),
            density,
            Field("closures_per_10k_benes", "decimal(10,4)"),
            count_change,
            density_change,
        ),
        ("county_fips", "year_id"),
    )


def curated_fact(first: int = 2019, last: int = 2023, code_width: int = 5) -> Contract:
    measures = {name: Field(name, dtype) for name, dtype in MEASURES.values()}
    spend = [n for n in measures if n.endswith("mdcr_stdzd_pymt_pc")]
    preventable = [c.lower() for c in PREVENTABLE_COLUMNS]
    return Contract(
        "curated.fact_county_year",
        (
            Field("county_fips", width=code_width, required=True),
            Field("year_id", "int", required=True),
            Field("state_abbrev", width=2),
            Field("county_desc", width=100),
            Field("rucc_code", "smallint"),
            Field("rural_urban_group"),
            Field("rucc_description", width=500),
            *_panel_fields(first, last),
            measures["benes_ffs_cnt"],
            measures["benes_total_cnt"],
            *[measures[n] for n in spend],
            Field("inpatient_spend_share", "decimal(8,6)"),
            Field("outpatient_spend_share", "decimal(8,6)"),
            measures["er_visits_per_1000"],
            measures["acute_hosp_readmsn_pct"],
            *[measures[n] for n in preventable],
        ),
        ("county_fips", "year_id"),
    )
