"""One row per scalar leaf of a span (PRJ-09): the input of every text rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import variants as V
from spanledger.functions.text import fold_key


def _leaf(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"))


def _under(prefix: list[Column], attributes: Column) -> Column:
    return F.transform(
        F.map_entries(V.as_map(attributes)),
        lambda e: _leaf(F.array(*prefix, e["key"]), e["value"]),
    )


def _nested(name: str, scalars: tuple[str, ...]) -> Column:
    def one(e: Column, i: Column) -> Column:
        prefix = [F.lit(name), i.cast("string")]
        fixed = [
            _leaf(F.array(*prefix, F.lit(s)), e[s].cast("string").cast("variant")) for s in scalars
        ]
        inner = _under([*prefix, F.lit("attributes")], e["attributes"])
        return F.concat(F.array(*fixed), inner) if fixed else inner

    return F.flatten(F.transform(F.col(name), one))


def _explode(spans: DataFrame, keep: list[str], first_level: Column) -> DataFrame:
    """Explode the first level, then only the containers among its values."""
    level = spans.select(*keep, F.posexplode_outer(first_level).alias("pos", "leaf"))
    value = F.col("leaf.value")
    deeper = F.when(
        V.kind(value).isin("object", "array"),
        F.transform(
            V.expand(value),
            lambda x: _leaf(F.concat(F.col("leaf.path"), x["path"]), x["value"]),
        ),
    ).otherwise(F.array(F.col("leaf")))
    rows = level.select(*keep, "pos", F.posexplode_outer(deeper).alias("sub", "x"))
    path = F.col("x.path")
    return rows.select(
        *keep,
        "pos",
        "sub",
        path.alias("path"),
        fold_key(F.get(path, F.size(path) - 1)).alias("last_key"),
        fold_key(F.array_join(path, ".")).alias("full_key"),
        V.kind(F.col("x.value")).alias("kind"),
        V.text(F.col("x.value")).alias("text"),
    )


def attribute_leaves(spans: DataFrame, keep: list[str]) -> DataFrame:
    """Leaves of the attributes of spans, events and links.

    Spans without attributes keep one row with a null path, so that counts per
    trace can be taken in the same pass.
    """
    parts = [
        F.coalesce(part, F.array().cast("array<struct<path:array<string>,value:variant>>"))
        for part in (
            _under([F.lit("attributes")], F.col("attributes")),
            _nested("events", ()),
            _nested("links", ()),
        )
    ]
    return _explode(spans, keep, F.concat(*parts))


def leaf_table(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, path, last_key, full_key, kind, text)`` of the whole span."""
    scalars = (
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "kind",
        "start_time",
        "end_time",
        "status",
        "status_message",
    )
    fixed = F.array(
        *(_leaf(F.array(F.lit(s)), F.col(s).cast("string").cast("variant")) for s in scalars)
    )
    first = F.concat(
        fixed,
        _under([F.lit("attributes")], F.col("attributes")),
        _nested("events", ("name", "timestamp")),
        _nested("links", ("trace_id", "span_id")),
    )
    rows = _explode(spans, ["trace_id", "span_id"], first)
    return rows.filter(F.col("path").isNotNull()).withColumn(
        "path", F.array_join("path", ".")
    )
