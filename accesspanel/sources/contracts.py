"""Declared table contracts: names, types, text widths, keys, NOT NULL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesspanel.functions.cleaning import text_length


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str = "string"
    width: int | None = None
    required: bool = False


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    keys: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(f.name, T.DataType.fromDDL(f.dtype), not f.required) for f in self.fields]
        )


def text_contract(name: str, columns: dict[str, int | None] | list[str]) -> Contract:
    """A raw-layer contract: every column text, nothing required."""
    widths = columns if isinstance(columns, dict) else dict.fromkeys(columns)
    return Contract(name, tuple(Field(n, "string", w) for n, w in widths.items()))


def _rules(df: DataFrame, contract: Contract) -> list[tuple[str, Column]]:
    """(message, condition that breaks the rule), judged on the row before the
    cast, so a value the cast would lose counts too."""
    types = dict(df.dtypes)
    rules: list[tuple[str, Column]] = []
    for f in contract.fields:
        c = F.col(f.name)
        if f.required:
            rules.append((f"{f.name}: required value missing", c.isNull()))
        if f.width is not None:
            text = c if types[f.name] == "string" else c.cast("string")
            rules.append((f"{f.name}: longer than {f.width}", text_length(text) > f.width))
        if f.dtype not in ("string", types[f.name]):
            lost = c.isNotNull() & c.try_cast(f.dtype).isNull()
            rules.append((f"{f.name}: does not fit {f.dtype}", lost))
    return rules


def violation(df: DataFrame, contract: Contract) -> Column:
    """First broken rule of a row as text, NULL for a good row."""
    named = [F.when(broken, F.lit(message)) for message, broken in _rules(df, contract)]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def _is_good(df: DataFrame, contract: Contract) -> Column:
    """True for a row that breaks no rule; less code than naming the rule."""
    good = F.lit(True)
    for _, broken in _rules(df, contract):
        good = good & ~F.coalesce(broken, F.lit(False))
    return good


def _shaped(df: DataFrame, contract: Contract) -> DataFrame:
    return df.select(*[F.col(f.name).try_cast(f.dtype).alias(f.name) for f in contract.fields])


def conform(df: DataFrame, contract: Contract, on_error: str = "fail") -> DataFrame:
    """Project to the contract's columns and types.

    ``fail``: the first bad row raises, with its key, when the frame is executed.
    ``drop``: only the good rows; pair with :func:`quarantine` to keep the rest.
    """
    missing = [n for n in contract.columns if n not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: columns missing from input: {', '.join(missing)}")
    good = _is_good(df, contract)
    if on_error == "drop":
        return _shaped(df.filter(good), contract)
    if on_error != "fail":
        raise ValueError(f"unknown on_error {on_error!r}")
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in contract.keys]
    message = F.concat_ws(" ", F.lit(f"{contract.name}: row breaks the contract"), *keys)
    # A filter, not a column: column pruning can never drop the check.
    guard = F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return _shaped(df.filter(guard), contract)


def quarantine(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows that break the contract, untouched, with the reason."""
    return df.withColumn("violation", violation(df, contract)).filter(F.col("violation").isNotNull())
