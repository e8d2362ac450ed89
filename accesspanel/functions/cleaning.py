"""Cleaning expressions. Every function takes and returns a Column and stays
inside whole-stage codegen; a bad value becomes NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "suppressed" and "missing" in the sources.
SUPPRESSED = "*"
BLANK = ""
DEFAULT_MARKERS = (SUPPRESSED, BLANK)

# Fixed patterns: what a tolerant cast accepts between blanks. Spark alone would
# also take '1e3' as a decimal and 'NaN' or '1d' as a double.
INTEGER_TEXT = r"^ *[+-]?[0-9]+ *$"
DECIMAL_TEXT = r"^ *[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+) *$"
UNSIGNED_BYTE_TEXT = r"^ *[+]?0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5]) *$"
FLOAT_TEXT = r"^ *[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)? *$"

# Fixed range: an unsigned one-byte integer, held in a SMALLINT.
UNSIGNED_BYTE = (0, 255)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_markers(c: Column | str, markers: Sequence[str] = DEFAULT_MARKERS) -> Column:
    """Trimmed text, NULL when it equals one of the markers."""
    text = F.trim(col(c))
    return F.when(~text.isin(list(markers)), text)


def clean_text(c: Column | str) -> Column:
    """Trimmed text, blank becomes NULL."""
    return F.nullif(F.trim(col(c)), F.lit(BLANK))


def _accepts(dtype: str) -> str:
    if dtype.startswith("decimal"):
        return DECIMAL_TEXT
    if dtype == "ubyte":
        return UNSIGNED_BYTE_TEXT
    if dtype in ("double", "float"):
        return FLOAT_TEXT
    return INTEGER_TEXT


def safe_cast(c: Column | str, dtype: str, markers: Sequence[str] = DEFAULT_MARKERS) -> Column:
    """Tolerant numeric cast. ``dtype`` is a Spark type name, or ``ubyte`` for
    an integer in 0..255 (returned as SMALLINT)."""
    target = "smallint" if dtype == "ubyte" else dtype
    pattern = _accepts(dtype)
    readable = col(c).rlike(pattern)
    # A marker that is no number is already refused by the pattern.
    numeric = [m for m in markers if re.match(pattern, m)]
    if numeric:
        readable = readable & ~F.trim(col(c)).isin(numeric)
    return F.when(readable, col(c).try_cast(target))


def safe_int_via_decimal(
    c: Column | str, precision: int = 3, scale: int = 1, dtype: str = "ubyte"
) -> Column:
    """Integer from text such as ``'1.0'``: read as a decimal, drop the fraction."""
    step = safe_cast(c, f"decimal({precision},{scale})")
    if dtype != "ubyte":
        return step.try_cast(dtype)
    low, high = UNSIGNED_BYTE
    return F.when((step > low - 1) & (step < high + 1), step.try_cast("smallint"))


def safe_date(c: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Date from month/day/year text; blank or unparseable is NULL."""
    return F.try_to_date(clean_text(c), fmt)


def zero_pad(c: Column | str, n: int = 5) -> Column:
    """Left-pad with zeros and keep the LAST n characters (``lpad`` would keep
    the first n of an over-long code)."""
    return F.right(F.concat(F.lit("0" * n), F.trim(col(c))), F.lit(n))


def zip5(c: Column | str, n: int = 5) -> Column:
    """First n characters of a postal code, zero-padded back to n."""
    return F.right(F.concat(F.lit("0" * n), F.left(F.trim(col(c)), F.lit(n))), F.lit(n))


def split_first(c: Column | str, delimiter: str = "-") -> tuple[Column, Column]:
    """(code, description) around the FIRST delimiter. Without one the code is
    NULL and the whole text is the description."""
    text = col(c)
    at = F.locate(delimiter, text)
    code = F.when(at > 0, F.substring_index(text, delimiter, 1))
    rest = F.trim(F.when(at > 0, F.substr(text, at + F.lit(len(delimiter)))).otherwise(text))
    return code, rest


def code_prefix(c: Column | str, n: int = 2) -> Column:
    return F.left(F.trim(col(c)), F.lit(n))


def label_null(c: Column | str, label: str = "NULL") -> Column:
    """Display text in which NULL is a visible label."""
    return F.coalesce(col(c).cast("string"), F.lit(label))


def match_label(c: Column | str, matched: str = "Matched", unmatched: str = "Unmatched") -> Column:
    return F.when(col(c).isNull(), F.lit(unmatched)).otherwise(F.lit(matched))


def text_length(c: Column | str) -> Column:
    """Length that ignores trailing blanks."""
    return F.length(F.rtrim(col(c)))


def fold_case(c: Column | str) -> Column:
    """Comparison key that ignores case and trailing blanks."""
    return F.lower(F.rtrim(col(c)))


def lifecycle_status(
    start: Column | str,
    end: Column | str,
    restart: Column | str,
    end_date: Column | str | None = None,
    restart_date: Column | str | None = None,
    active: str = "Active",
    closed: str = "Closed",
) -> Column:
    """Snapshot status from the RAW date texts. Presence is judged on the text,
    order on the parsed dates, so an unreadable end date counts as closed. Pass
    the parsed dates where they exist already, to parse them once."""
    ended = safe_date(end) if end_date is None else col(end_date)
    restarted = safe_date(restart) if restart_date is None else col(restart_date)
    return (
        F.when(clean_text(start).isNull(), F.lit(None).cast("string"))
        .when(clean_text(end).isNull(), F.lit(active))
        .when(restarted > ended, F.lit(active))
        .otherwise(F.lit(closed))
    )


def cast_reason(
    c: Column | str,
    dtype: str,
    suppressed: Sequence[str] = (SUPPRESSED,),
) -> Column:
    """Why a tolerant cast gave what it gave: ok, suppressed, blank, unparseable."""
    text = F.trim(col(c))
    return (
        F.when(text.isNull() | (text == BLANK), F.lit("blank"))
        .when(text.isin(list(suppressed)), F.lit("suppressed"))
        .when(safe_cast(c, dtype).isNull(), F.lit("unparseable"))
        .otherwise(F.lit("ok"))
    )


def first_match_slot(cols: Sequence[str], prefix: str) -> tuple[Column, Column]:
    """(code, 1-based slot) of the first of several code columns that starts
    with ``prefix``; both NULL when none does."""
    slots = F.array(
        *[
            F.struct(F.trim(F.col(name)).alias("code"), F.lit(i).alias("slot"))
            for i, name in enumerate(cols, start=1)
        ]
    )
    hit = F.get(F.filter(slots, lambda s: s["code"].startswith(prefix)), F.lit(0))
    return hit["code"], hit["slot"]
