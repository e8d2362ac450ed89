"""Row predicates and column-name selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.functions.cleaning import col, fold_case


def same_text(c: Column | str, value: str, ignore_case: bool = False) -> Column:
    """Equality, optionally blind to case and trailing blanks."""
    if ignore_case:
        return fold_case(c) == value.rstrip(" ").lower()
    return col(c) == value


def at_least(c: Column | str, floor: int) -> Column:
    """Small-cell guard: keep rows whose weight reaches the floor."""
    return col(c) >= floor


def all_present(*cols: Column | str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def starts_with(c: Column | str, literal: str) -> Column:
    """Literal prefix: ``_`` and ``%`` in it are not wildcards."""
    return col(c).startswith(literal)


def contains_any(c: Column | str, words: Sequence[str], ignore_case: bool = True) -> Column:
    """True when any of the literal words occurs in the text."""
    flag = "(?i)" if ignore_case else ""
    return col(c).rlike(flag + "|".join(re.escape(w) for w in words))


def ends_with_cr(c: Column | str) -> Column:
    return col(c).endswith("\r")


def select_columns(
    df: DataFrame, patterns: Sequence[str] = (".*",), exclude: Sequence[str] = ()
) -> list[str]:
    """Column names in schema order matching any pattern and no exclusion
    (regular expressions, case-insensitive, anywhere in the name)."""

    def hits(name: str, regexes: Sequence[str]) -> bool:
        return any(re.search(r, name, re.IGNORECASE) for r in regexes)

    return [n for n in df.columns if hits(n, patterns) and not hits(n, exclude)]
