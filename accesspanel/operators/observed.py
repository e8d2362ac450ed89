"""Checks taken while a table is written: row count, missing values and values out of range
come from the pass that writes, not from a scan of the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from accesspanel.operators.aggregates import count_where
from accesspanel.operators.quality import CheckFailed
from accesspanel.sources import versions
from accesspanel.sources.tables import layer_path


@dataclass(frozen=True)
class WriteChecks:
    """What to count while writing. ``ranges`` maps a column to its least and greatest good
    value (None: open); ``expected`` rows may be missed by the share ``tolerance``."""

    not_null: Sequence[str] = ()
    ranges: Mapping[str, tuple[object, object]] = field(default_factory=dict)
    expected: int | None = None
    tolerance: float = 0.0

    def metrics(self) -> list[tuple[str, str, Column]]:
        """(check, column, count) of everything that is counted."""
        out = [("rows", "", F.count("*"))]
        out += [("nulls", c, count_where(F.col(c).isNull())) for c in self.not_null]
        for c, (low, high) in self.ranges.items():
            if low is not None:
                out.append(("below", c, count_where(F.col(c) < low)))
            if high is not None:
                out.append(("above", c, count_where(F.col(c) > high)))
        return out

    def passes(self, check: str, value: int) -> bool:
        if check != "rows":
            return value == 0
        return self.expected is None or abs(value - self.expected) <= int(abs(self.expected) * self.tolerance)


def observed(df: DataFrame, checks: WriteChecks) -> tuple[DataFrame, Observation]:
    """The frame with its counts attached; they are known once an action on it has ended."""
    observation = Observation()
    named = [count.alias(f"m{i}") for i, (_, _, count) in enumerate(checks.metrics())]
    return df.observe(observation, *named), observation


def results(observation: Observation, checks: WriteChecks) -> list[tuple[str, str, int, bool]]:
    """(check, column, count, passed) after the action."""
    found = observation.get
    return [
        (check, column, found[f"m{i}"], checks.passes(check, found[f"m{i}"]))
        for i, (check, column, _) in enumerate(checks.metrics())
    ]


def report(spark: SparkSession, table: str, found: Sequence[tuple[str, str, int, bool]]) -> DataFrame:
    """One row per check: table, check, column, count, 1 when passed, message."""
    rows = [
        (table, check, column, value, int(good), f"{table}: {check} {column}".rstrip() + f": {value}")
        for check, column, value, good in found
    ]
    schema = "table_name string, check_name string, column_name string, value bigint, passed int, message string"
    return spark.createDataFrame(rows, schema)


def write_observed(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    checks: WriteChecks,
    cluster_by: Sequence[str] = (),
    gate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Replaces a table and reports its checks, in one pass over the frame. With ``gate`` a
    failed check raises and the table stays as it was."""
    spark, path = df.sparkSession, layer_path(root, layer, name)
    counted, observation = observed(df, checks)
    written, version = versions.stage_version(counted, path, cluster_by=cluster_by)
    found = results(observation, checks)
    bad = [f"{check} {column}: {value}" for check, column, value, good in found if not good]
    if bad and gate:
        raise CheckFailed(f"{layer}.{name}: {'; '.join(bad)}")
    versions.publish(spark, path, version)
    return written, report(spark, f"{layer}.{name}", found)
