"""Span, evidence and trace digests (PRJ-10, AGG-04, AGG-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.hashing import digest_of, sha


def span_digest() -> Column:
    """SHA-256 over the canonical JSON of the span evidence, location excluded."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return digest_of(
        attributes=F.col("attributes"),
        end_time=F.date_format("end_time", stamp),
        events=F.transform(
            "events",
            lambda e: F.struct(
                e["attributes"].alias("attributes"),
                e["name"].alias("name"),
                F.date_format(e["timestamp"], stamp).alias("timestamp"),
            ),
        ),
        kind=F.col("kind"),
        links=F.col("links"),
        name=F.col("name"),
        parent_span_id=F.col("parent_span_id"),
        span_id=F.col("span_id"),
        start_time=F.date_format("start_time", stamp),
        status=F.col("status"),
        status_message=F.col("status_message"),
        trace_id=F.col("trace_id"),
    )


def with_span_digest(spans: DataFrame) -> DataFrame:
    return spans.withColumn("sha256", span_digest())


def tree_digest(rows: DataFrame, keys: list[str], digest: str, out: str = "digest") -> DataFrame:
    """One order-independent digest per key over all its row digests.

    The digests (hexadecimal) are hashed in buckets of their first four, then first two hex
    digits, then once per key. No task sees more than the rows of one key with the same two
    digits, so a key that holds a third of all rows is spread like any other, and equal
    digests are counted before they are dealt. Digests are dealt as bytes, one to a row:
    most buckets hold one, and lists of one cost more than it.
    """
    raw = F.unhex(digest)
    counted = rows.select(*keys, raw.alias("raw")).groupBy(*keys, "raw").agg(F.count("*").alias("copies"))

    def level(df: DataFrame, bucket: list[str], item: Column) -> DataFrame:
        joined = F.array_join(F.array_sort(F.collect_list(item)), "\n")
        return df.groupBy(*keys, *bucket).agg(sha(joined).alias("node"), F.sum("copies").alias("copies"))

    # One deal serves the two inner levels, another the last.
    dealt = counted.withColumn("outer", F.substring("raw", 1, 1)).repartition(*keys, "outer")
    text = F.lower(F.hex("raw"))
    fine = level(dealt.withColumn("bucket", F.substring(text, 1, 4)), ["outer", "bucket"], F.concat_ws(":", text, F.col("copies").cast("string")))
    coarse = level(fine.withColumnRenamed("node", "inner"), ["outer"], F.concat_ws(":", "bucket", "inner"))
    top = coarse.select(*keys, "outer", F.unhex("node").alias("raw"), "copies").repartition(*keys)
    return (
        level(top, [], F.concat_ws(":", F.lower(F.hex("outer")), text))
        .withColumnRenamed("node", out)
        .withColumnRenamed("copies", "items")
    )


def trace_digests(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``tree_sha256`` and ``trace_sha256`` per trace."""
    keys = keys or ["trace_id"]
    rows = spans if "sha256" in spans.columns else with_span_digest(spans)
    tree = tree_digest(rows, keys, "sha256", "tree_sha256").withColumnRenamed("items", "span_count")
    return tree.withColumn(
        "trace_sha256",
        digest_of(
            span_count=F.col("span_count"),
            trace_id=F.col("trace_id"),
            tree_sha256=F.col("tree_sha256"),
        ),
    )


def evidence_digests(spans: DataFrame) -> DataFrame:
    """One digest row per span: ``span:{id}:{digest prefix}`` names are unique per content."""
    rows = with_span_digest(spans)
    return rows.select(
        "trace_id",
        F.concat_ws(":", F.lit("span"), "span_id", F.substring("sha256", 1, 16)).alias("evidence_id"),
        F.lit("span").alias("kind"),
        F.lit("SHA-256").alias("algorithm"),
        "sha256",
        F.col("span_id").alias("source_span_id"),
        "parent_span_id",
        "status",
    )
