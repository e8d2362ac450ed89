"""Source tables with the published raw layouts, derived from the given tables.

An order is a provider: its lead part is its postal code, its date starts its
lifecycle. A customer is a county: its order lines by year are the measures.
Which customers bought a part, and how much, is the postal-code crosswalk.
Every row of every given table takes part."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesspanel.operators.joins import frequent_keys, lookup_join
from accesspanel.plans import builders, schemas
from accesspanel.sources.tables import layer_path, materialize, staging_root, write_layer
from accesspanel.sources.versions import current_path

# Wide enough for any positive BIGINT key, so that padding never cuts one.
CODE_WIDTH = 19
YEARS = (1996, 1997, 1998, 1999, 2000)
YEAR = 2000
MIN_WEIGHT = 50
DESERT_WEIGHT = 20
# Lines of one part from which on its pairs are not all put in one task.
HOT_LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixed_text(scaled: Column, digits: int) -> Column:
    """Decimal text of an integer that counts units of 10**-digits."""
    unit = F.lit(10**digits)
    whole = F.call_function("div", scaled, unit).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((scaled % unit).cast("string"), digits, "0"))


def scaled_quotient(a: Column, factor: int, b: Column) -> Column:
    """a * factor / b without the fraction; the product may exceed a BIGINT."""
    product = a.cast("decimal(28,0)") * F.lit(factor).cast("decimal(10,0)")
    return F.call_function("div", product, b.cast("decimal(20,0)"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a two-letter state made of nation and region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    states = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.left("r_name", F.lit(1))).alias("state"),
    )
    return table(spark, sf_dir, "customer").join(states, ["c_nationkey"], "left")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer and order year; money in whole cents."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year")
    )
    return line.join(orders, line.l_orderkey == orders.o_orderkey, "inner").select(
        "o_orderkey",
        "o_custkey",
        "order_year",
        "l_partkey",
        "l_linenumber",
        "l_returnflag",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )


def raw_pharmacies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what the texts are made of, before the orders are moved: a day and a price band
    price = F.col("o_totalprice")
    band = F.when(price < 2000, 0).when(price < 3000, 1).when(price > 495_000, 3).otherwise(2)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.to_date("o_orderdate").alias("day"),
        band.alias("band"),
    )
    lead = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_partkey").alias("part"))
    )
    owner = customers(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"), "state")
    # a customer may hold much of the orders; its keys are sought in the given table, not in a join
    rows = lookup_join(orders, owner, "o_custkey").join(lead, ["o_orderkey"], "left")
    day, band = F.col("day"), F.col("band")

    def text(d: Column) -> Column:
        return F.date_format(d, "MM/dd/yyyy")

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    part = F.col("part").cast("string")
    ended = status.isin("F", "P")
    early, late = priority == "3-MEDIUM", priority.isin("1-URGENT", "2-HIGH")
    position = (
        F.when(priority == "1-URGENT", "1\r").when(priority == "2-HIGH", "2\r").otherwise("")
    )
    return rows.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("npi"),
        F.when(status == "O", "1").when(status == "F", "2").otherwise("").alias("entity_type_code"),
        F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"), F.lit(", INC.")).alias("org_name"),
        F.col("o_orderpriority").alias("address_line_1"),
        F.concat(F.lit("CITY OF "), part).alias("city"),
        F.concat(F.col("state"), F.lit(" ")).alias("state"),
        F.when(part.isNull(), "")
        .when(status == "F", F.concat(F.lpad(part, CODE_WIDTH, "0"), F.lit("1234")))
        .otherwise(F.concat(F.lit(" "), part))
        .alias("postal_code"),
        F.when(band == 0, "13/45/2001").when(band == 1, " ").otherwise(text(day)).alias("enumeration_date"),
        text(day).alias("last_update_date"),
        F.when(ended, "DQ").otherwise(" ").alias("deactivation_reason_code"),
        F.when(ended & (band == 3), "unknown")
        .when(ended, text(F.date_add(day, 200)))
        .otherwise("")
        .alias("deactivation_date"),
        F.when((status == "P") & late, text(F.date_add(day, 500)))
        .when((status == "P") & early, text(F.date_add(day, 100)))
        .otherwise("")
        .alias("reactivation_date"),
        F.when(priority == "1-URGENT", "3336C0003X").otherwise("183500000X").alias("taxonomy_code_1"),
        F.when(priority == "2-HIGH", "3336L0003X").otherwise("").alias("taxonomy_code_2"),
        F.when(status == "F", " 3336M0002X").otherwise(F.lit(None).cast("string")).alias("taxonomy_code_3"),
        F.when(late, "3336C0003X").otherwise("").alias("pharmacy_taxonomy_code"),
        position.alias("pharmacy_taxonomy_position"),
    )


BAND_LETTERS = ("A", "N", "R")


def county_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sums of every customer and order year."""
    bands = [
        F.expr(
            f"sum(CASE WHEN l_linenumber = {i} AND l_returnflag = '{letter}' THEN qty ELSE 0 END)"
        ).alias(f"{condition}_AGE_{band}")
        for i, (condition, names) in enumerate(schemas.PREVENTABLE.items(), start=1)
        for band, letter in zip(names, BAND_LETTERS, strict=True)
    ]
    return (
        lines(spark, sf_dir)
        .groupBy("o_custkey", "order_year")
        .agg(
            F.count("*").alias("n"),
            F.sum("qty").alias("q"),
            F.sum("cents").alias("total"),
            F.expr("sum(CASE WHEN l_returnflag = 'A' THEN cents ELSE 0 END)").alias("ip"),
            F.expr("sum(CASE WHEN l_returnflag = 'R' THEN cents ELSE 0 END)").alias("op"),
            F.expr("sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)").alias("back"),
            *bands,
        )
    )


def raw_medicare(
    spark: SparkSession, sf_dir: str, sums: DataFrame | None = None
) -> DataFrame:
    """County, State and National rows of every year."""
    sums = county_sums(spark, sf_dir) if sums is None else sums
    owner = customers(spark, sf_dir).select(
        F.col("c_custkey").alias("o_custkey"), "state", "c_mktsegment", "c_acctbal"
    )
    parts = list(schemas.PREVENTABLE_COLUMNS)
    added = ["n", "q", "total", "ip", "op", "back", *parts]
    owned = sums.join(owner, ["o_custkey"], "left")

    def level(df: DataFrame, label: str, name: str, code: str, balance: str) -> DataFrame:
        return df.selectExpr(
            "order_year",
            f"'{label}' AS level",
            f"{name} AS name",
            f"{code} AS code",
            f"{balance} AS c_acctbal",
            *added,
        )

    totals = [F.sum(c).alias(c) for c in added]
    of_state = owned.groupBy("order_year", "state").agg(*totals)
    of_nation = sums.groupBy("order_year").agg(*totals)
    name = "concat_ws('-', state, c_mktsegment, cast(o_custkey AS string))"
    levels = (
        level(owned, "County", name, "concat(' ', cast(o_custkey AS string))", "c_acctbal")
        .unionByName(level(of_state, "State", "state", "''", "0.0D"))
        .unionByName(level(of_nation, "National", "'National'", "''", "0.0D"))
    )
    # Integer quotients first, then their texts.
    quotients = {
        "total": "total div q",
        "ip": "ip div q",
        "op": "op div q",
        "visits": "n * 100000 div q",
        "back": "back * 1000000 div n",
        **{p: f"{p} * 10000 div q" for p in parts},
    }
    whole = levels.withColumns({c: F.expr(e) for c, e in quotients.items()})

    def text(c: str, digits: int) -> str:
        unit = 10**digits
        return (
            f"concat(cast({c} div {unit} AS string), '.', "
            f"lpad(cast({c} % {unit} AS string), {digits}, '0'))"
        )

    def shown(c: str, digits: int, name: str) -> str:
        return (
            f"CASE WHEN q < 30 THEN ' * ' WHEN c_acctbal < -900 THEN '' "
            f"ELSE {text(c, digits)} END AS {name}"
        )

    return whole.selectExpr(
        "cast(order_year AS string) AS YEAR",
        "level AS BENE_GEO_LVL",
        "name AS BENE_GEO_DESC",
        "code AS BENE_GEO_CD",
        "'All' AS BENE_AGE_LVL",
        "CASE WHEN q < 10 THEN '*' ELSE cast(q AS string) END AS BENES_FFS_CNT",
        "cast(q + n AS string) AS BENES_TOTAL_CNT",
        shown("total", 2, "TOT_MDCR_STDZD_PYMT_PC"),
        shown("ip", 2, "IP_MDCR_STDZD_PYMT_PC"),
        shown("op", 2, "OP_MDCR_STDZD_PYMT_PC"),
        shown("visits", 2, "ER_VISITS_PER_1000_BENES"),
        f"{text('back', 4)} AS ACUTE_HOSP_READMSN_PCT",
        *[shown(p, 4, p) for p in parts],
    )


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rural-urban codes. The last nation stands for territories, whose codes match no area."""
    nation = F.col("c_nationkey")
    key = F.col("c_custkey").cast("string")
    no_code = (nation == 23) & (F.col("c_mktsegment") == "BUILDING")
    code = F.concat((nation % 9 + 1).cast("string"), F.lit(".0"))
    return (
        customers(spark, sf_dir).select(
            F.when(nation == 24, F.concat(F.lit("T"), key)).otherwise(key).alias("fips"),
            F.concat(F.lit(" "), F.col("state"), F.lit(" ")).alias("state"),
            F.concat(F.lit(" "), F.col("c_name")).alias("county_name"),
            F.when(F.col("c_acctbal") < 0, "").otherwise((F.col("c_custkey") * 7 + 1000).cast("string")).alias("population_2020"),
            F.when(no_code, " ").otherwise(code).alias("rucc_2023"),
            F.when(no_code, "").otherwise(F.concat(F.lit("Area class "), code)).alias("description"),
        )
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every customer; ``copy`` numbers the rows of a repeated customer from 0."""
    same_key = Window.partitionBy("o_custkey").orderBy("state")
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"), "state").withColumn(
        "copy", F.row_number().over(same_key) - 1
    )


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with customer and state, once per row of a repeated customer. The state
    is looked up for the orders, of which there are fewer than lines or pairs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    placed = lookup_join(orders, owners(spark, sf_dir), "o_custkey").withColumn("copy", F.coalesce("copy", F.lit(0)))
    line = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return line.join(placed, line.l_orderkey == placed.o_orderkey, "inner").select(
        "l_partkey",
        "o_custkey",
        "copy",
        "state",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        "returned",
    )


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sums of every part and customer, with those of the whole part.

    The lines are dealt by part once, and pair, total and share are taken where they then
    lie. Where a part has more lines than a task should hold, pairs are added up map-side
    and written, and their totals are looked up."""
    sold = part_lines(spark, sf_dir)
    pair = ["l_partkey", "o_custkey", "copy", "state"]
    returned = F.when(F.col("returned"), F.col("qty")).otherwise(0)
    sums = [
        F.sum("qty").alias("q"),
        F.sum("cents").alias("c"),
        F.sum(returned).alias("r"),
        F.count("*").alias("n"),
    ]
    # the lines of a customer count once, however often it is repeated
    first = F.col("copy") == 0
    totals = {f"{x}_all": F.sum(F.when(first, F.col(x))) for x in ("q", "c", "r", "n")}
    if frequent_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], least=HOT_LINES):
        pairs = materialize(sold.groupBy(*pair).agg(*sums), "pairs")
        per_part = pairs.groupBy("l_partkey").agg(*[t.alias(n) for n, t in totals.items()])
        return lookup_join(pairs, per_part, "l_partkey")
    pairs = sold.repartition("l_partkey").groupBy(*pair).agg(*sums)
    whole = Window.partitionBy("l_partkey")
    known = F.col("l_partkey").isNotNull()  # no part, no total
    return pairs.withColumns({n: F.when(known, t.over(whole)) for n, t in totals.items()})


def raw_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to customer, with the customer's shares of the part's lines."""

    def share(x: str) -> Column:
        return scaled_quotient(F.col(x), 100_000_000, F.col(f"{x}_all"))

    returned_share = F.when(F.col("r_all") > 0, fixed_text(share("r"), 8)).otherwise("")
    return part_pairs(spark, sf_dir).select(
        F.col("l_partkey").cast("string").alias("zip"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("county_fips"),
        F.concat(F.lit(" CITY OF "), F.col("l_partkey").cast("string")).alias("usps_zip_pref_city"),
        F.col("state").alias("usps_zip_pref_state"),
        F.concat(share("c").cast("string"), F.lit("e-08")).alias("res_ratio"),
        F.concat(F.lit(" "), fixed_text(share("q"), 8)).alias("bus_ratio"),
        returned_share.alias("oth_ratio"),
        fixed_text(share("n"), 8).alias("tot_ratio"),
    )


# --- staged layers -----------------------------------------------------------

SOURCES = ("region", "nation", "customer", "orders", "lineitem")

#: Tables whose key is checked once written; a repeated one stops the run.
CONTRACTS = {
    c.name: c
    for c in (
        schemas.clean_medicare(CODE_WIDTH),
        schemas.clean_codes(CODE_WIDTH),
        schemas.clean_crosswalk(CODE_WIDTH),
        schemas.clean_pharmacies(CODE_WIDTH, CODE_WIDTH),
        schemas.curated_panel(YEARS[0], YEARS[-1], CODE_WIDTH),
        schemas.curated_fact(YEARS[0], YEARS[-1], CODE_WIDTH),
    )
}

_written: dict[tuple, str] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of each given file, so that changed ones are read anew."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            status = files.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def _build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def need(other: str) -> DataFrame:
        return staged(spark, sf_dir, other)

    steps: dict[str, Callable[[], DataFrame]] = {
        "raw.pharmacies": lambda: raw_pharmacies(spark, sf_dir),
        "raw.county_sums": lambda: county_sums(spark, sf_dir),
        "raw.medicare_spending": lambda: raw_medicare(spark, sf_dir, need("raw.county_sums")),
        "raw.rucc_codes": lambda: raw_codes(spark, sf_dir),
        "raw.zip_to_fips": lambda: raw_crosswalk(spark, sf_dir),
        "clean.medicare_spending": lambda: builders.clean_medicare(
            need("raw.medicare_spending"), CODE_WIDTH
        ),
        "clean.rucc_codes": lambda: builders.clean_codes(need("raw.rucc_codes"), CODE_WIDTH),
        "clean.zip_to_fips": lambda: builders.clean_crosswalk(need("raw.zip_to_fips"), CODE_WIDTH),
        "clean.pharmacies": lambda: builders.clean_pharmacies(
            need("raw.pharmacies"), need("clean.zip_to_fips"), CODE_WIDTH, npi_width=CODE_WIDTH
        ),
        "curated.county_year_panel": lambda: builders.county_year_panel(
            need("clean.pharmacies"), need("clean.medicare_spending"), YEARS, CODE_WIDTH
        ),
        "curated.fact_county_year": lambda: builders.fact_county_year(
            need("clean.medicare_spending"),
            need("curated.county_year_panel"),
            need("clean.rucc_codes"),
            YEARS,
            CODE_WIDTH,
        ),
    }
    return steps[name]()


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The plan of a table, from the written tables before it."""
    return _build(spark, sf_dir, name)


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the layered run, written once per application and read back."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, _stamp(spark, sf_dir), name)
    if key in _written:
        try:
            return spark.read.parquet(_written[key])
        except AnalysisException:  # the shared folder was cleared
            del _written[key]
    root = f"{staging_root(spark)}/accesspanel/{app}/tables/{uuid.uuid4().hex}"
    layer, short = name.split(".")
    contract = CONTRACTS.get(name)
    if contract:
        written = builders.write_checked(_build(spark, sf_dir, name), root, contract)
    else:
        written = write_layer(_build(spark, sf_dir, name), root, layer, short)
    _written[key] = current_path(spark, layer_path(root, layer, short))
    return written
