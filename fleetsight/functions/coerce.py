"""Tolerant conversions. ANSI mode throws on bad casts, so every cast here is a ``try_cast``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: the text forms that count as a number.
INTEGER_TEXT = r"^[+-]?[0-9]+\z"
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
# Unicode white space and the four ASCII separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Text without white space at its ends; ``trim`` alone takes off blanks only."""
    return F.trim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cs: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def text_or(c: Column, fallback: str = "") -> Column:
    """Trimmed text; NULL takes the fallback, an empty string stays empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(fallback))


def number_from_text(c: Column) -> Column:
    """Double for numeric text, else NULL. The pattern keeps out forms such as ``5d`` that a cast accepts."""
    return F.when(strip(c).rlike(DECIMAL_TEXT), strip(c).try_cast("double"))


def whole_from_text(c: Column, kind="bigint") -> Column:
    """Whole number for integer text, else NULL."""
    return F.when(strip(c).rlike(INTEGER_TEXT), strip(c).try_cast(kind))


def float_or(c: Column, fallback: float = 0.0, is_text: bool = False) -> Column:
    value = number_from_text(c) if is_text else c.try_cast("double")
    return F.coalesce(value, F.lit(float(fallback)))


def int_or(c: Column, fallback: int = 0, is_text: bool = False) -> Column:
    """Numbers truncate toward zero; text must be a whole number (``7.9`` takes the fallback)."""
    value = whole_from_text(c) if is_text else c.try_cast("bigint")
    return F.coalesce(value, F.lit(fallback).cast("bigint"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def bounded_limit(n, default: int = 100, low: int = 1, high: int | None = None) -> int:
    """A row limit as given, at least ``low``; anything that is not a number means the default."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        n = default
    return max(low, n if high is None else min(n, high))


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select exactly ``schema``: missing columns are added, NULLs take their default, types are stated."""
    defaults = defaults or {}
    present = set(df.columns)
    out = []
    for field in schema.fields:
        c = F.col(field.name).try_cast(field.dataType) if field.name in present else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            c = F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def js_round(c: Column) -> Column:
    """Round half up to a whole number, as ``Math.round`` does."""
    return F.floor(c + F.lit(0.5))
