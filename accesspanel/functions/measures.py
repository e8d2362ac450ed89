"""Derived measures: guarded ratios, rates, bins, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import col

# Rural-urban code bands and provider-count tiers.
RURAL_URBAN_BANDS = ((1, 3, "Metro"), (4, 9, "Nonmetro"))
PROVIDER_TIERS = (
    (0, 0, "0 - desert (acute)"),
    (1, 1, "1 - fragile (1 closure from desert)"),
    (2, 5, "2-5 pharmacies"),
    (6, None, "6+ pharmacies"),
)
UNKNOWN_TIER = "NULL / unknown"


def safe_ratio(num: Column | str, den: Column | str, dtype: str = "decimal(8,6)") -> Column:
    """num/den only where den > 0, else NULL (also when it does not fit dtype)."""
    n, d = col(num), col(den)
    return F.when(d > 0, (n / d).try_cast(dtype))


def rate_per(
    num: Column | str, den: Column | str, per: int = 10_000, dtype: str = "decimal(10,4)"
) -> Column:
    """num per ``per`` units of den, NULL unless den > 0. The numerator is a
    DECIMAL so that the result is exact before it is rounded to ``dtype``."""
    n, d = col(num).cast("decimal(20,1)"), col(den)
    return F.when(d > 0, (n * F.lit(per) / d).try_cast(dtype))


def share_sum(*parts: Column | str) -> Column:
    """Sum of shares; NULL when any part is."""
    total = col(parts[0])
    for part in parts[1:]:
        total = total + col(part)
    return total


def bin_label(
    c: Column | str,
    bins: Sequence[tuple[int | None, int | None, str]] = RURAL_URBAN_BANDS,
    otherwise: str | None = None,
) -> Column:
    """Label of the first closed range (low, high, label) that holds the value.
    An open end is None; a value in no range, or NULL, gets ``otherwise``."""
    value = col(c)
    chain = None
    for low, high, label in bins:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        chain = F.when(inside, F.lit(label)) if chain is None else chain.when(inside, F.lit(label))
    return chain.otherwise(F.lit(otherwise).cast("string"))


def tier_label(
    c: Column | str,
    tiers: Sequence[tuple[int | None, int | None, str]] = PROVIDER_TIERS,
    null_label: str = UNKNOWN_TIER,
) -> Column:
    """Count tier in which unknown (NULL) is a tier of its own, not zero."""
    return bin_label(c, tiers, otherwise=null_label)
