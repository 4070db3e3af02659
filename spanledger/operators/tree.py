"""Span trees: depth, cycles, missing parents (JN-01, JN-02, AGG-02, AGG-03, VAL-05, VAL-06).

The tree is an adjacency list. Only inner spans (those that are somebody's
parent) take part in pointer doubling, so the work per round follows the number
of inner spans and the number of rounds follows log2 of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.operators.skew import lookup_join
from spanledger.session import materialize


class _Nodes:
    """The (trace, span, parent) triples of a span table, written once and counted."""

    def __init__(self, triples: DataFrame) -> None:
        self.rows = materialize(triples)
        self.count = self.rows.count()

    @classmethod
    def of(cls, spans: DataFrame) -> _Nodes:
        """One row per (trace, span); an empty parent is no parent."""
        return cls(
            spans.groupBy("trace_id", "span_id")
            .agg(F.min(F.nullif("parent_span_id", F.lit(""))).alias("parent_span_id"))
            .filter(F.col("span_id").isNotNull())
        )

    def parents(self) -> DataFrame:
        """Distinct spans of the trace that are a parent, with their own parent."""
        named = (
            self.rows.filter(F.col("parent_span_id").isNotNull())
            .select("trace_id", F.col("parent_span_id").alias("span_id"))
            .distinct()
        )
        return self.rows.join(named, ["trace_id", "span_id"], "left_semi")

    def lookup(self, left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        return lookup_join(left, right, on, how)


def _inner(nodes: _Nodes) -> DataFrame:
    """``(trace_id, span_id, anc, dist)`` of spans that are a parent.

    ``anc`` is the parent when it exists in the trace, else null.
    """
    inner = nodes.parents()
    known = inner.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    linked = nodes.lookup(inner, known, ["trace_id", "parent_span_id"])
    return linked.select(
        "trace_id",
        "span_id",
        F.when(F.col("known"), F.col("parent_span_id")).alias("anc"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("dist"),
    )


def _double(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(resolved, looping)``: distances to the top, and rows that never end.

    A round that closes no row shows that no open row reaches a top. Once
    2**k jumps exceed the largest number of such rows in a trace, every pointer
    has left the tail of its path and stands on a cycle.
    """
    state = materialize(inner)
    # Rows whose distance is known are written once and stay where they are.
    closed = state.filter(F.col("anc").isNull())
    state = state.filter(F.col("anc").isNotNull())
    jumps, previous = 1, None
    while True:
        per_trace = state.groupBy("trace_id").agg(F.count("*").alias("n"))
        open_rows, longest = per_trace.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if open_rows == 0 or (open_rows == previous and jumps > longest):
            break
        previous = open_rows
        step = closed.unionByName(state).select(
            "trace_id",
            F.col("span_id").alias("anc"),
            F.col("anc").alias("next_anc"),
            F.col("dist").alias("next_dist"),
        )
        moved = materialize(
            lookup_join(state, step, ["trace_id", "anc"]).select(
                "trace_id",
                "span_id",
                F.col("next_anc").alias("anc"),
                (F.col("dist") + F.coalesce("next_dist", F.lit(0))).alias("dist"),
            )
        )
        closed = closed.unionByName(moved.filter(F.col("anc").isNull()))
        state = moved.filter(F.col("anc").isNotNull())
        jumps *= 2
    return closed, state


def span_depths(spans: DataFrame) -> DataFrame:
    """0-based depth per span; null on or below a cycle. A missing parent counts as none."""
    return _depths(_Nodes.of(spans))


def _depths(nodes: _Nodes) -> DataFrame:
    resolved, looping = _double(_inner(nodes))
    # Every inner span is in one of the two; a looping one has no depth.
    parents = resolved.select("trace_id", "span_id", "dist").unionByName(
        looping.select("trace_id", "span_id", F.lit(None).cast("long").alias("dist"))
    )
    tops = parents.select(
        "trace_id",
        F.col("span_id").alias("parent_span_id"),
        F.lit(True).alias("exists"),
        F.col("dist").alias("parent_depth"),
    )
    joined = nodes.lookup(nodes.rows, tops, ["trace_id", "parent_span_id"])
    return joined.select(
        "trace_id",
        "span_id",
        F.when(F.col("exists"), F.col("parent_depth") + 1).otherwise(F.lit(0)).cast("long").alias("depth"),
    )


def cycle_spans(spans: DataFrame) -> DataFrame:
    """Spans that lie on a parent cycle.

    Along a cycle the start time cannot rise at every step, so a cycle has a
    span that starts no later than its parent does. Only traces with such a
    span enter the pointer doubling; in ordinary data that is a small part.
    """
    timed = _Nodes(
        spans.groupBy("trace_id", "span_id")
        .agg(
            F.min(F.nullif("parent_span_id", F.lit(""))).alias("parent_span_id"),
            F.min("start_time").alias("earliest"),
            F.max("start_time").alias("latest"),
        )
        .filter(F.col("span_id").isNotNull())
    )
    parents = timed.rows.select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("latest").alias("parent_latest")
    )
    children = timed.rows.filter(F.col("parent_span_id").isNotNull())
    edges = timed.lookup(children, parents, ["trace_id", "parent_span_id"], "inner")
    suspects = (
        edges.filter(F.coalesce(F.col("parent_latest") >= F.col("earliest"), F.lit(True)))
        .select("trace_id")
        .distinct()
    )
    nodes = _Nodes(
        timed.lookup(timed.rows.drop("earliest", "latest"), suspects, ["trace_id"], "left_semi")
    )
    if nodes.count == 0:
        return nodes.rows.select("trace_id", "span_id")
    return _cycles(nodes)


def _cycles(nodes: _Nodes) -> DataFrame:
    _, looping = _double(_inner(nodes))
    return looping.select("trace_id", F.col("anc").alias("span_id")).distinct()


def max_depths(spans: DataFrame) -> DataFrame:
    """0-based depth of the deepest span per trace; null when the tree has a cycle."""
    return span_depths(spans).groupBy("trace_id").agg(
        F.when(F.max(F.col("depth").isNull().cast("int")) == 0, F.max("depth")).alias("max_depth")
    )


def call_tree_depth(spans: DataFrame) -> DataFrame:
    """Tolerant 1-based depth: missing parents are roots, cycle members count once."""
    nodes = _Nodes.of(spans)
    loops = _cycles(nodes).withColumn("looped", F.lit(True))
    opened = nodes.rows.join(loops, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", F.when(F.col("looped").isNull(), F.col("parent_span_id")).alias("parent_span_id")
    )
    return _depths(_Nodes(opened)).groupBy("trace_id").agg((F.max("depth") + 1).alias("depth"))


def reference_counts(spans: DataFrame) -> DataFrame:
    """Per (trace, span id): how often it is defined and how often it is a parent.

    One aggregation with map-side combine answers both "duplicate id" and
    "missing parent" without a join, whatever one parent's share of the spans.
    """
    defined = spans.select("trace_id", "span_id", F.lit(1).alias("d"), F.lit(0).alias("r"))
    named = spans.filter(F.coalesce("parent_span_id", F.lit("")) != "").select(
        "trace_id", F.col("parent_span_id").alias("span_id"), F.lit(0).alias("d"), F.lit(1).alias("r")
    )
    return (
        defined.unionAll(named)
        .groupBy("trace_id", "span_id")
        .agg(F.sum("d").alias("definitions"), F.sum("r").alias("children"))
    )


def missing_parents(spans: DataFrame) -> DataFrame:
    """Parent ids that are no span of their trace, with the number of children."""
    return reference_counts(spans).filter("definitions = 0").select(
        "trace_id", F.col("span_id").alias("parent_span_id"), "children"
    )


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is missing."""
    missing = missing_parents(spans).withColumn("missing", F.lit(True)).drop("children")
    joined = lookup_join(spans, missing, ["trace_id", "parent_span_id"], "inner")
    return joined.select("trace_id", "span_id", "parent_span_id")
