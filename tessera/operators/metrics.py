"""Token statistics as plain Columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pretokenizers import matches


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def single_char_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: utf16_length(t) == 1))


def has_suffix(tokens: Column, suffix: str) -> Column:
    return F.exists(tokens, lambda t: t.endswith(suffix))


def chars_per_token(text: Column, ids: Column) -> Column:
    """Null for a text without tokens."""
    return F.try_divide(utf16_length(text).cast("double"), F.size(ids))


def attribute_names(html: Column) -> Column:
    """What stands between a space (or the beginning) and the next ``=`` after it, for every ``=`` that a space follows later."""
    return F.regexp_extract_all(html, F.lit(r"([^ =]*)="), F.lit(1))


def known_attributes(html: Column, names: list[str]) -> Column:
    return F.size(F.filter(attribute_names(html), lambda a: a.isin(names)))
