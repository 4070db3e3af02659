"""Queries that ingest the events as a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.plans.registry import query
from spanledger.plans.trace_queries import event_records
from spanledger.session import shared_folder
from spanledger.streaming import spans as streaming

_VALID = "select * from events where event_type <> 'error'"


def _store(spark: SparkSession, folder: str) -> str:
    """Write the event records as text files and ingest them with an availableNow stream."""
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    event_records(spark, folder).select("text").write.text(f"{base}/files")
    streaming.ingest_stream(spark, f"{base}/files", f"{base}/store", f"{base}/progress").awaitTermination()
    return f"{base}/store"


@query(
    "stream_spans_ingested",
    f"""select 'u' || cast(user_id as string) as trace_id, lpad(printf('%x', event_id), 16, '0') as span_id, event_type as name,
    epoch_us(ts) as start_us from ({_VALID})""",
)
def stream_spans_ingested(spark: SparkSession, folder: str) -> DataFrame:
    spans, _ = streaming.ingested_spans(spark, _store(spark, folder))
    return spans.select("trace_id", "span_id", "name", F.unix_micros("start_time").alias("start_us"))


@query(
    "stream_quarantine",
    """select case when value > 50 then 'invalid_json' else 'invalid_span' end as code,
    case when value > 50 then 'record is not valid JSON or repeats a key'
      else case event_id % 6 when 1 then 'spans must be an array' when 2 then 'scopeSpans must be an array' when 3 then 'record holds no span'
        when 4 then 'attributes are invalid' else 'start time is invalid' end end as reason, count(*) as records
    from events where event_type = 'error' group by all""",
)
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return streaming.quarantined(spark, _store(spark, folder)).groupBy("code", "reason").agg(F.count("*").alias("records"))


@query(
    "stream_trace_summaries",
    f"""select 'u' || cast(user_id as string) as trace_id, count(*) as span_count, count(*) as root_count,
    min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from ({_VALID}) group by all""",
)
def stream_trace_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = streaming.trace_summaries(spark, _store(spark, folder))
    return rows.select(
        "trace_id", "span_count", "root_count", F.unix_micros("first_start").alias("first_us"), F.unix_micros("last_start").alias("last_us")
    )


def _streamed(spark: SparkSession, folder: str, copies: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str, str]:
    """A stream of spans over the event records, and folders for its output and progress; ``copies`` gives further records."""
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    records = event_records(spark, folder).select("text")
    records.write.text(f"{base}/files")
    copies(records).write.mode("append").text(f"{base}/files")
    spans = streaming.stream_spans(spark, f"{base}/files")
    return spans, f"{base}/out", f"{base}/progress"


@query(
    "stream_deduplicated",
    f"select 'u' || cast(user_id as string) as trace_id, lpad(printf('%x', event_id), 16, '0') as span_id from ({_VALID})",
)
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """All records come twice; each span passes once."""
    spans, out, progress = _streamed(spark, folder, lambda records: records)
    streaming.append_spans(streaming.dedup_stream(spans), out, progress).awaitTermination()
    return spark.read.parquet(out).select("trace_id", "span_id")
