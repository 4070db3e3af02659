"""Structured Streaming ingest (STR-01 to STR-05).

The parsing is the batch code: the same functions on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from spanledger.operators.digests import tree_digest, with_span_digest
from spanledger.operators.normalize import SPAN_COLUMNS, normalize_spans, split_valid
from spanledger.operators.validate import conflicting_duplicates, drop_identical_duplicates
from spanledger.sources.spans import document_digest, stream_span_lines, unwrap_envelopes


def stream_spans(spark: SparkSession, path: str) -> DataFrame:
    """Valid spans of a growing directory, with their digest."""
    records = unwrap_envelopes(stream_span_lines(spark, path))
    valid = normalize_spans(records).filter(F.size("issues") == 0).select(*SPAN_COLUMNS)
    return with_span_digest(valid)


def dedup_stream(spans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Identical spans pass once as long as copies arrive within ``delay``.

    Its state is bounded, so rows behind the watermark do not pass; where none
    may be missed, :func:`ingest_stream` keeps all and removes copies on reading.
    """
    return spans.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(
        ["trace_id", "span_id", "sha256"]
    )


class _ConflictProcessor(StatefulProcessor):
    """Keeps the first digest of a (trace, span) and reports any other one."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("sha256", StringType())])
        self._first = handle.getValueState("first", schema, self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self._first.get()[0] if self._first.exists() else None
        for batch in rows:
            for digest in batch["sha256"].unique():
                if known is None:
                    known = digest
                    self._first.update((digest,))
                elif digest != known:
                    yield pd.DataFrame(
                        {"trace_id": [key[0]], "span_id": [key[1]], "first_sha256": [known], "other_sha256": [digest]}
                    )

    def close(self) -> None:
        pass


CONFLICT_SCHEMA = "trace_id string, span_id string, first_sha256 string, other_sha256 string"


def stream_conflicts(spans: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Spans whose key was seen before with another digest.

    Without ``ttl_ms`` a key is remembered for good. Copies of one digest are
    skipped per Arrow batch, so a burst of copies costs no state updates.
    """
    return (
        spans.select("trace_id", "span_id", "sha256")
        .groupBy("trace_id", "span_id")
        .transformWithStateInPandas(
            statefulProcessor=_ConflictProcessor(ttl_ms),
            outputStructType=CONFLICT_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )


def stream_trace_summary(spans: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Trace summary per activity session; final once the watermark has passed it.

    A live view with bounded state. :func:`trace_summaries` has one row for each
    trace over all that was ingested, late rows included.
    """
    sessions = spans.withWatermark("start_time", delay).groupBy(
        "trace_id", F.session_window("start_time", gap).alias("session")
    )
    return sessions.agg(
        F.count("*").alias("span_count"),
        F.sum(F.size("events")).alias("event_count"),
        F.count_if(F.col("parent_span_id").isNull()).alias("root_count"),
    ).select(
        "trace_id",
        F.col("session.start").alias("session_start"),
        F.col("session.end").alias("session_end"),
        "span_count",
        "event_count",
        "root_count",
    )


def source_log(spark: SparkSession, path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """One digest row per document; a replayed micro-batch replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        document_digest(batch).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return (
        stream_span_lines(spark, path)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_spans(spans: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed spans as a table; ``current_spans`` reads the result so far."""
    return (
        spans.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_spans(spark: SparkSession, table_path: str) -> tuple[DataFrame, DataFrame]:
    """``(spans, conflicts)`` of everything appended so far, first copy wins."""
    table = spark.read.parquet(table_path)
    return drop_identical_duplicates(table), conflicting_duplicates(table)


def ingest_stream(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Take in all files of a growing directory; nothing late or invalid is lost.

    Every micro-batch writes its parsed records, with the lines that are no
    JSON, and its digests to folders of its own, so a replay replaces them. Each
    line is parsed once. The readers below see finished folders only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"batch_id={batch_id}"
        normalize_spans(unwrap_envelopes(batch, keep_unparsed=True)).write.mode("overwrite").parquet(f"{store}/parsed/{own}")
        document_digest(batch).write.mode("overwrite").parquet(f"{store}/log/{own}")

    return (
        stream_span_lines(spark, path)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested_spans(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """``(spans, conflicts)`` of a store: identical copies once, keys with differing records apart."""
    parsed = spark.read.parquet(f"{store}/parsed").filter(F.size("issues") == 0).select(*SPAN_COLUMNS)
    digested = with_span_digest(parsed)
    return drop_identical_duplicates(digested), conflicting_duplicates(digested)


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    """Records of a store that are no spans, with code and reason."""
    return split_valid(spark.read.parquet(f"{store}/parsed").drop("batch_id"))[1]


def trace_summaries(spark: SparkSession, store: str) -> DataFrame:
    """One row per trace over everything ingested."""
    spans, _ = ingested_spans(spark, store)
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        F.sum(F.size("events")).alias("event_count"),
        F.count_if(F.col("parent_span_id").isNull()).alias("root_count"),
        F.min("start_time").alias("first_start"),
        F.max("start_time").alias("last_start"),
    )


def source_digests(spark: SparkSession, store: str) -> DataFrame:
    """``(source, documents, digest)``: one digest per file over its documents' digests."""
    log = spark.read.parquet(f"{store}/log").drop("batch_id")
    return tree_digest(log, ["source"], "sha256").withColumnRenamed("items", "documents")
