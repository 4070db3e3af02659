"""Small helpers over VARIANT columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"
LIST = "array<variant>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` while it stands in the plan once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def get(v: Column, key: str) -> Column:
    """Child ``key`` of an object; missing and JSON null are both SQL null."""
    child = F.array(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.get(F.filter(child, lambda x: ~F.is_variant_null(x)), F.lit(0))


def first(v: Column, keys: Iterable[str]) -> Column:
    return F.coalesce(*(get(v, key) for key in keys))


def sql_get(v: str, key: str) -> str:
    """:func:`get` as SQL text, for expressions that would be long as Columns."""
    return (
        f"get(filter(array(try_variant_get({v}, '$.{key}', 'variant')), "
        "j -> not is_variant_null(j)), 0)"
    )


def sql_first(v: str, keys: Iterable[str]) -> str:
    return "coalesce(" + ", ".join(sql_get(v, key) for key in keys) + ")"


def sql_text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def sql_map(v: str) -> str:
    return f"try_variant_get({v}, '$', '{MAP}')"


def sql_list(v: str) -> str:
    return f"try_variant_get({v}, '$', '{LIST}')"


def sql_fields(v: str) -> str:
    """Children of an object by key, without JSON nulls; null for other values.

    One pass over the object; aliases are then looked up in the map.
    """
    return f"map_filter({sql_map(v)}, (k, j) -> not is_variant_null(j))"


def sql_pick(fields: str, keys: Iterable[str]) -> str:
    """The first of ``keys`` that a map from :func:`sql_fields` holds."""
    return "coalesce(" + ", ".join(f"{fields}['{key}']" for key in keys) + ")"


def sql_any(fields: str, keys: Iterable[str]) -> str:
    """Whether a map from :func:`sql_fields` holds one of ``keys``."""
    return f"arrays_overlap(map_keys({fields}), array({', '.join(repr(key) for key in keys)}))"


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", MAP)


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST)


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def kind(v: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``object``, ``array`` or null."""
    return let(
        F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0),
        lambda name: F.when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "OBJECT", "object")
        .when(name == "ARRAY", "array")
        .when((name == "VOID") | name.isNull(), F.lit(None))
        .otherwise("number"),
    )


def entries(v: Column) -> Column:
    """Object or array as ``array<struct<key string, value variant>>``; null for scalars."""
    indexed = F.transform(
        as_list(v), lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("value"))
    )
    return F.coalesce(F.map_entries(as_map(v)), indexed)


def open_brackets(v: Column) -> Column:
    """Number of objects and arrays inside ``v``: an upper bound on its depth."""
    return F.length(F.regexp_replace(F.to_json(v), r"[^\[{]", ""))


def expand(v: Column) -> Column:
    """Every scalar below ``v`` as ``array<struct<path, value>>``, to any depth.

    Grows one level per step and stops as soon as no container is left.
    """
    empty_path = F.array().cast("array<string>")

    def node(path: Column, value: Column, is_open: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"), is_open.alias("open"))

    def children(x: Column) -> Column:
        inner = F.transform(
            entries(x["value"]),
            lambda e: node(F.concat(x["path"], F.array(e["key"])), e["value"], F.lit(True)),
        )
        done = F.array(node(x["path"], x["value"], F.lit(False)))
        return F.when(x["open"], F.coalesce(inner, done)).otherwise(F.array(x))

    def step(acc: Column, _: Column) -> Column:
        grown = F.struct(
            (~F.exists(acc["items"], lambda x: x["open"])).alias("done"),
            F.flatten(F.transform(acc["items"], children)).alias("items"),
        )
        return F.when(acc["done"], acc).otherwise(grown)

    start = F.struct(
        F.lit(False).alias("done"), F.array(node(empty_path, v, F.lit(True))).alias("items")
    )
    return F.aggregate(
        F.sequence(F.lit(0), open_brackets(v) + 1),
        start,
        step,
        lambda acc: F.transform(
            acc["items"], lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value"))
        ),
    )
