"""Cleaning and typing of single values, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that mean "missing" in text input.
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "#N/A", "-", "nan", "NaN")
#: Labels for missing and for rare categories.
MISSING, OTHERS = "(sin dato)", "(otros)"
DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


def kind_of(kind: T.DataType) -> str:
    """boolean, datetime, numeric or categorical."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "numeric" if isinstance(kind, T.NumericType) else "categorical"


def clean_columns(names: Iterable[str]) -> list[str]:
    """Trimmed names with single spaces; blanks become col_i, repeats get a number."""
    taken: dict[str, int] = {}  # names given so far, and the last number tried behind each
    for i, name in enumerate(names):
        base = re.sub(r"\s+", " ", str(name or "")).strip() or f"col_{i}"
        fresh, n = base, taken.get(base, 0)
        while fresh in taken:
            n += 1
            fresh = f"{base}_{n}"
        taken[fresh] = 0
        taken[base] = n
    return [name for name in taken]


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*NULL_TOKENS), c)


def cast_numeric(c: Column, comma: bool = False) -> Column:
    """Text with currency signs, percent and thousands separators as a number; null if it is none."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"[$€£¥%\s]", "")
    plain = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if comma else F.replace(bare, F.lit(","), F.lit(""))
    return plain.try_cast("double")


def parse_datetime(c: Column, strict: bool = False) -> Column:
    """ISO text as a timestamp without zone; unless ``strict``, day-first forms too."""
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))
    if strict:
        return iso
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in DAY_FIRST])


def trim_text(c: Column, lower: bool = False) -> Column:
    trimmed = F.nullif(F.trim(c), F.lit(""))
    return F.lower(trimmed) if lower else trimmed


def date_parts(c: Column, name: str, hour: bool = False, quarter: bool = False) -> dict[str, Column]:
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dow": F.dayofweek(c) - 1, "week": F.weekofyear(c)}
    parts |= {"hour": F.hour(c)} if hour else {}
    parts |= {"quarter": F.quarter(c)} if quarter else {}
    return {f"{name}__{k}": v.cast("long") for k, v in parts.items()}


def clip(c: Column, low: float, high: float) -> Column:
    """A null becomes the lower bound, as least and greatest skip nulls."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def log_companion(c: Column) -> Column:
    return F.ln(F.greatest(c, F.lit(0.0)) + 1)


def group_rare(c: Column, keep: list[str]) -> Column:
    """Levels outside ``keep``, and nulls, become one level."""
    return F.when(c.cast("string").isin(*keep), c.cast("string")).otherwise(OTHERS) if keep else F.lit(OTHERS)


def is_finite(c: Column) -> Column:
    value = c.cast("double")
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def period_month(c: Column) -> Column:
    """Text periods (2023-01, 202301, 01/2023, 2023/01) as the first of their month."""
    text = F.trim(c.cast("string"))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    year_first = text.rlike(r"^\d{4}[-/]?\d{1,2}$")
    month_first = text.rlike(r"^\d{1,2}[-/]\d{4}$")
    year = F.when(year_first, F.substring(digits, 1, 4)).when(month_first, F.right(digits, F.lit(4)))
    month = F.when(year_first, F.substring(digits, 5, 2)).when(month_first, F.substring_index(F.replace(text, F.lit("-"), F.lit("/")), "/", 1))
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.when(year.isNotNull(), F.lit("01"))).try_cast("timestamp_ntz")


def truncated(grain: str, c: Column) -> Column:
    """Start of the period; unknown grains are months."""
    return F.date_trunc(grain if grain in ("day", "week", "month", "quarter", "year") else "month", c).cast("timestamp_ntz")


def normalise_types(df: DataFrame) -> DataFrame:
    """All-text input with missing tokens as null; other types are preserved."""
    return df.select(*[null_tokens_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
