"""Cleaning column functions for raw exports (every raw cell is a string)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_null(x) -> Column:
    """Trimmed text, null when blank."""
    t = F.trim(_c(x))
    return F.when(t != "", t)


def money(x) -> Column:
    """B2: '$1,200,000' / '1,500,000' / '' -> decimal(18,2) or null (text that
    is not a number is null, never an error)."""
    t = F.regexp_replace(F.trim(_c(x)), r"[$,]", "")
    return F.when(t != "", t).try_cast("decimal(18,2)")


def int_value(x) -> Column:
    """Integer via a number, truncating ('12.0' -> 12); blank -> null."""
    t = blank_null(x)
    return t.try_cast("double").try_cast("int")


def quarter_label(x) -> Column:
    """B4: 'YYYY-Qn' passes; 'MM/YYYY' -> its quarter; anything else unchanged."""
    s = F.trim(_c(x))
    parts = F.split(s, "/")
    month = parts.getItem(0).try_cast("int")
    year = parts.getItem(1)
    return (F.when(s.contains("-Q"), s)
            .when(s.contains("/") & month.isNotNull(),
                  F.concat(year, F.lit("-Q"), (F.floor((month - 1) / 3) + 1).cast("int").cast("string")))
            .otherwise(s))


def code_key(x) -> Column:
    """B1 first step: the lookup key of a raw code (trimmed, lower case)."""
    return F.lower(F.trim(_c(x)))


def code_slug(key) -> Column:
    """B1 fallback: spacing / punctuation drift ('Costa Mesa' -> 'costa-mesa')."""
    k = _c(key)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(k, " ", "-"), r"\.", ""), "_", "-")


def raw_json(cols: list[str]) -> Column:
    """The raw row as JSON text (nulls kept) for the quarantine table."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
