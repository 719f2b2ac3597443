"""Text columns: cleaning, tokens, masks, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import col


def clean(text: str | Column) -> Column:
    """Drop timestamps, level words and punctuation; collapse spaces; lower case."""
    out = col(text)
    for pattern, replacement in fixed.CLEANING_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.lower(F.regexp_replace(F.trim(out), fixed.CLEANING_LAST, ""))


def tokens(text: str | Column) -> Column:
    """Words of the cleaned text, without empty ones."""
    return F.filter(F.split(clean(text), r"\s+"), lambda t: t != "")


def extract(text: str | Column, pattern: str, group: int = 1) -> Column:
    """A regular-expression group, or null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def mask(text: str | Column, custom: dict[str, str] | None = None) -> Column:
    """Replace variable parts by [TIME], [IP], [PATH] and custom marks."""
    out = col(text)
    for pattern, label in {
        r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?": "[TIME]",
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}": "[IP]",
        r"(/[A-Za-z0-9_.-]+)+/?": "[PATH]",
        **(custom or {}),
    }.items():
        out = F.regexp_replace(out, pattern, label)
    return out


def ips(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"), F.lit(1))


def user_mentions(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"user=(\w+)"), F.lit(1))
