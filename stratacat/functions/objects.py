"""JSON objects in text columns: safe reads, merges that keep explicit nulls, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_object(text: Column) -> Column:
    """The JSON text if it is an object, else ``{}``."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), text).otherwise("{}")


def integer_at(text: Column, key: str) -> Column:
    """A member as a whole number; null if it is missing or no number."""
    return F.get_json_object(text, f"$.{key}").try_cast("double").try_cast("int")


def element_at(text: Column, index: Column) -> Column:
    """An element of a JSON array of strings by its place from 0; null if the text is no array or shorter."""
    return F.get(F.from_json(text, "array<string>"), index)


def members(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per member of an object, with ``key`` and ``value`` (typed, explicit nulls too)."""
    return rows.select(*keep, F.explode(F.from_json(safe_object(F.col(column)), "map<string,variant>")).alias("key", "value"))


def from_members(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The reverse, members in the order of their keys. A group is one object, so it is as small as that."""
    entries = F.array_sort(F.collect_list(F.struct("key", F.to_json(F.struct(F.col("value").alias("v")), {"ignoreNullFields": "false"}).alias("v"))))
    # {"v":...} without its frame is the value as JSON
    text = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.char_length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["v"].substr(F.lit(6), F.char_length(e["v"]) - 6)))
    return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias(name))


def merge(rows: DataFrame, keys: list[str], column: str, order: list) -> DataFrame:
    """One object per key: each member from the first row by ``order`` that has it, an explicit null included."""
    all_ = members(rows.withColumn("place_", F.struct(*order)), column, *keys, "place_")
    first = all_.groupBy(*keys, "key").agg(F.min_by(F.struct("value"), "place_").alias("x")).select(*keys, "key", "x.value")
    none = rows.select(*keys).distinct()
    return none.join(from_members(first, keys, column), keys, "left").withColumn(column, F.coalesce(column, F.lit("{}")))


def overlay(suggested: Column, override: Column, keys: list[str]) -> Column:
    """Two ``map<string,string>`` columns: per declared key the override if present, null included, else the suggestion."""
    s, o = F.coalesce(suggested, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), F.coalesce(override, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    known = F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(s, k) | F.map_contains_key(o, k))
    return F.map_from_entries(F.transform(known, lambda k: F.struct(k.alias("key"), F.when(F.map_contains_key(o, k), F.try_element_at(o, k)).otherwise(F.try_element_at(s, k)).alias("value"))))
