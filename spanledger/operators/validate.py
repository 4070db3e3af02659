"""Duplicate, shape and ingest checks (VAL-03, VAL-04, VAL-07 to VAL-09, VAL-12, SET-01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.digests import with_span_digest
from spanledger.operators.normalize import SPAN_COLUMNS
from spanledger.operators.skew import lookup_join
from spanledger.operators.tree import cycle_spans, reference_counts
from spanledger.session import materialize

_KEY = ["trace_id", "span_id"]


def union_sources(*spans: DataFrame) -> DataFrame:
    """Spans of several sources as one table; de-duplicate afterwards."""
    return reduce(lambda a, b: a.unionByName(b), spans)


def duplicate_groups(digested: DataFrame) -> DataFrame:
    """``(trace_id, span_id, variants, copies)`` of keys that occur more than once.

    Copies are counted per digest first, so a group of copies of any size
    shrinks to one row per task before the shuffle.
    """
    per_digest = digested.groupBy(*_KEY, "sha256").agg(F.count("*").alias("n"))
    return (
        per_digest.groupBy(*_KEY)
        .agg(F.count("*").alias("variants"), F.sum("n").alias("copies"))
        .filter("copies > 1")
    )


def conflicting_duplicates(digested: DataFrame) -> DataFrame:
    """Keys whose records differ: an error in every ingest mode."""
    return duplicate_groups(digested).filter("variants > 1")


def drop_identical_duplicates(digested: DataFrame) -> DataFrame:
    """First record of each (trace, span, digest) in (source, block, row, item) order."""
    payload = [c for c in digested.columns if c not in (*_KEY, "sha256")]
    place = F.struct("source", "block", "row", "item")
    kept = digested.groupBy(*_KEY, "sha256").agg(
        F.min_by(F.struct(*payload), place).alias("kept"), F.count("*").alias("copies")
    )
    return kept.select(*_KEY, "sha256", "copies", "kept.*")


def ingest(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, issues)`` of a permissive ingest after the duplicate rules.

    Identical copies are dropped and counted; keys with differing records are
    reported and none of their records is kept. The parsed records are written
    once, because the duplicate rules read them more than once.
    """
    normalized = materialize(
        normalized.withColumn("raw", F.when(F.size("issues") > 0, F.col("raw")))
    )
    valid = with_span_digest(normalized.filter(F.size("issues") == 0).select(*SPAN_COLUMNS))
    unique = drop_identical_duplicates(valid)
    # After the first step a conflicting key has few rows: one per distinct digest.
    conflicts = conflicting_duplicates(valid).select(*_KEY, F.lit(True).alias("conflict"))
    flagged = lookup_join(unique, conflicts, _KEY)
    spans = flagged.filter(F.col("conflict").isNull()).drop("conflict")
    where = ("source", "block", "row")
    rejected = normalized.filter(F.size("issues") > 0).select(
        *where, F.lit("invalid_span").alias("code"), F.array_join("issues", "; ").alias("reason")
    )
    copies = flagged.filter((F.col("copies") > 1) & F.col("conflict").isNull()).select(
        *where,
        F.lit("duplicate_span_ignored").alias("code"),
        F.concat(F.col("span_id"), F.lit(": identical copies ignored: "), F.col("copies") - 1).alias("reason"),
    )
    conflicting = flagged.filter("conflict").select(
        *where,
        F.lit("conflicting_duplicate_span").alias("code"),
        F.concat(F.col("span_id"), F.lit(": differs from another record")).alias("reason"),
    )
    return spans, rejected.unionByName(copies).unionByName(conflicting)


def time_order_violations(spans: DataFrame) -> DataFrame:
    """Spans that end before they start."""
    return spans.filter(F.col("end_time") < F.col("start_time")).select(*_KEY, "start_time", "end_time")


def structure_counts(spans: DataFrame, check_cycles: bool = True) -> DataFrame:
    """Per trace: duplicate ids, spans without id, spans with a missing parent, cycle spans."""
    per_id = reference_counts(spans)
    counts = per_id.groupBy("trace_id").agg(
        F.sum(F.when(F.col("span_id").isNotNull() & (F.col("definitions") > 1), 1).otherwise(0)).alias("duplicate_ids"),
        F.sum(F.when(F.col("span_id").isNull(), F.col("definitions")).otherwise(0)).alias("unnamed_spans"),
        F.sum(F.when(F.col("span_id").isNotNull() & (F.col("definitions") == 0), F.col("children")).otherwise(0)).alias("missing_parents"),
    )
    if not check_cycles:
        return counts.withColumn("cycle_spans", F.lit(0).cast("long"))
    loops = cycle_spans(spans).groupBy("trace_id").agg(F.count("*").alias("cycle_spans"))
    return counts.join(loops, "trace_id", "left").na.fill(0, ["cycle_spans"])


def structure_issues(spans: DataFrame) -> DataFrame:
    """All distinct structure issues, as ``(trace_id, rank, issue, span_id)``."""
    per_id = reference_counts(spans)
    duplicates = per_id.filter("span_id is not null and definitions > 1").select(
        "trace_id", F.lit(0).alias("rank"), "span_id", F.lit("duplicate span identifier").alias("issue")
    )
    unnamed = per_id.filter("span_id is null and definitions > 0").select(
        "trace_id", F.lit(1).alias("rank"), F.lit("").alias("span_id"), F.lit("span has no identifier").alias("issue")
    )
    missing = per_id.filter("span_id is not null and definitions = 0").select(
        "trace_id", F.lit(2).alias("rank"), "span_id", F.lit("missing parent").alias("issue")
    )
    loops = cycle_spans(spans).select(
        "trace_id", F.lit(3).alias("rank"), "span_id", F.lit("parent cycle").alias("issue")
    )
    return duplicates.unionAll(unnamed).unionAll(missing).unionAll(loops).select("trace_id", "rank", "issue", "span_id")


def print_first(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group for print, each with the group's ``total`` and ``cut``.

    A view on a complete table: ``cut`` says that rows are left out here.
    """
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n") <= limit)
    return ranked.join(totals, by).withColumn("cut", F.col("total") > limit)


def declared_mismatches(declared: DataFrame, derived: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Declared values that differ from the derived ones, one row per field."""
    right = derived.select(*keys, *(F.col(f).alias(f"derived_{f}") for f in fields))
    joined = declared.join(right, keys, "left")
    pairs = F.array(
        *(
            F.struct(
                F.lit(f).alias("field"),
                F.col(f).cast("string").alias("declared"),
                F.col(f"derived_{f}").cast("string").alias("derived"),
            )
            for f in fields
        )
    )
    rows = joined.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")
    return rows.filter(~F.col("declared").eqNullSafe(F.col("derived")) & F.col("declared").isNotNull())


def evaluation_invariants(evaluations: DataFrame) -> DataFrame:
    """Evaluations that break detected = caught or review = (action <> allow)."""
    return evaluations.filter(
        (F.col("injection_detected") != F.col("injection_caught"))
        | (F.col("human_review_required") != (F.col("policy_action") != "allow"))
    ).select("trace_id")
