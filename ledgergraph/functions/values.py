"""Property maps and numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as numeric text, in one form that Java and RE2 read alike.
NUMERIC = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
NOT_FINITE = r"^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def number(text: Column) -> Column:
    """The double in a text, null if the text is not one. Words for infinity and NaN are numbers."""
    word = F.lower(F.trim(text))
    special = (F.when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
               .when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
               .when(word.isin("nan", "+nan", "-nan"), F.lit(float("nan"))))
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double")).otherwise(special)


def outside(value: Column, low: Column, high: Column) -> Column:
    """Value out of [low, high]. A NaN is never out of range, as every comparison with it is false."""
    return ~F.isnan(value) & ((value < low) | (value > high))


def has(props: Column, name: Column) -> Column:
    """Key is there; a null value counts as there."""
    return F.map_contains_key(props, name)


def get(props: Column, name: str) -> Column:
    return F.try_element_at(props, F.lit(name))


def put(props: Column, name: str, value: Column) -> Column:
    """Set a key, replacing an old value."""
    return F.map_concat(drop(props, name), F.create_map(F.lit(name), value.cast("string")))


def drop(props: Column, name: str) -> Column:
    return F.map_filter(props, lambda k, _: k != name)


def members(text: Column) -> Column:
    """Keys of a JSON object or elements of a JSON array held as text; empty if it is neither."""
    keys = F.when(text.rlike(r"^\s*\{"), F.json_object_keys(text))
    items = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    return F.coalesce(keys, items, F.array().cast("array<string>"))
