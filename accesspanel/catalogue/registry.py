"""Collects the registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesspanel.catalogue.oracle import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types both engines print alike: DECIMAL as DOUBLE, DATE as text."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL over ``needs`` tables."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn

    return register


def mean_text(c: str, scale: int, out: int) -> str:
    """SQL for the mean of a non-negative DECIMAL(_, scale), rounded half up at
    four more places and then at ``out``, as Spark does it; result DOUBLE."""
    total, n = f"(sum({c}) * {10**scale})::HUGEINT", f"count({c})"
    fine = f"(({total} * 20000 + {n}) // (2 * {n}))"
    cut = 10 ** (scale + 4 - out)
    return (
        f"CASE WHEN {n} > 0 THEN "
        f"((2 * {fine} + {cut}) // {2 * cut})::DOUBLE / {10**out} END"
    )


def doubles(*cols: str) -> str:
    return ", ".join(f"{c}::DOUBLE AS {c}" for c in cols)


def percent_text(part: str, whole: str, places: int = 2) -> str:
    """SQL for 100 * part / whole of two counts, rounded half up; DOUBLE."""
    unit = 10**places
    return (
        f"CASE WHEN {whole} > 0 THEN ((200 * {unit} * ({part})::HUGEINT + {whole}) "
        f"// (2 * {whole}))::DOUBLE / {unit} END"
    )
