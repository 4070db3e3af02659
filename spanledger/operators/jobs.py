"""Jobs, listings and readiness (JOB-01 to JOB-04, FLT-01 to FLT-05, AGG-12, JN-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.hashing import digest_of, sha

MAX_PAGE = 100


def select_traces(spans: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, not_found)`` for a table of requested trace ids, padded like span ids."""
    trimmed = F.regexp_replace(F.trim("trace_id"), "^0x", "")
    wanted = ids.select(
        F.when(trimmed.rlike("^[0-9a-fA-F]{1,32}$"), F.lpad(F.lower(trimmed), 32, "0"))
        .otherwise(F.lower(trimmed))
        .alias("trace_id")
    ).distinct()
    present = spans.select("trace_id").distinct()
    return spans.join(wanted, "trace_id", "left_semi"), wanted.join(present, "trace_id", "left_anti")


def idempotency_key(base: str):
    """Per-trace key: the hash of the whole base, then 20 digits of the trace id's hash."""
    return F.concat(sha(F.col(base)), F.lit(":"), F.substring(sha(F.col("trace_id")), 1, 20))


def create_jobs(traces: DataFrame, evaluations: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(jobs, conflicts)``: one job per trace and request.

    ``traces`` carries request_key and request_sha256. A stored job with the
    same key and request is returned unchanged; another request under the same
    key is a conflict.
    """
    c = F.col
    rows = traces.join(
        evaluations.select("trace_id", "evaluation_id", "policy_action"), "trace_id"
    ).withColumn("idempotency_key", idempotency_key("request_key"))
    jobs = rows.select(
        F.concat(
            F.lit("job-"),
            F.substring(digest_of(key=c("idempotency_key"), request=c("request_sha256"), trace_id=c("trace_id")), 1, 32),
        ).alias("job_id"),
        "trace_id",
        "trace_sha256",
        "evaluation_id",
        "policy_action",
        "request_sha256",
        "idempotency_key",
        "created_at",
        F.lit("awaiting-human-review").alias("status"),
    )
    if existing is None:
        return jobs, jobs.limit(0).select("job_id", "idempotency_key")
    stored = existing.select("idempotency_key", c("request_sha256").alias("stored_request"))
    joined = jobs.join(stored, "idempotency_key", "left")
    fresh = joined.filter("stored_request is null").drop("stored_request")
    conflicts = joined.filter("stored_request <> request_sha256").select("job_id", "idempotency_key")
    return fresh, conflicts


def job_status(events: DataFrame) -> DataFrame:
    """Latest status per job from its events ``(job_id, sequence, status)``."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence")
    )


def list_jobs(
    jobs: DataFrame, *, job_id: str | None = None, trace_id: str | None = None, limit: int = 50, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``(page, total)`` ordered by creation time and id, newest first."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    chosen = jobs
    if job_id is not None:
        chosen = chosen.filter(F.col("job_id") == job_id)
    if trace_id is not None:
        chosen = chosen.filter(F.col("trace_id") == trace_id)
    page = chosen.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)
    return page, chosen.agg(F.count("*").alias("total"))


def latest_job_per_trace(jobs: DataFrame) -> DataFrame:
    """Newest job of each trace."""
    newest = F.struct("created_at", "job_id")
    payload = [n for n in jobs.columns if n != "trace_id"]
    return jobs.groupBy("trace_id").agg(
        F.max_by(F.struct(*payload), newest).alias("j"), F.count("*").alias("job_count")
    ).select("trace_id", "j.*", "job_count")


def related_jobs(jobs: DataFrame) -> DataFrame:
    """All job ids of each trace, ranked from the newest."""
    order = Window.partitionBy("trace_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.select("trace_id", F.row_number().over(order).alias("rank"), "job_id")


def filter_receipts(
    receipts: DataFrame,
    *,
    job_id: str | None = None,
    trace_id: str | None = None,
    event_type: str | None = None,
    receipt_id: str | None = None,
) -> DataFrame:
    """Receipts by any of the keys, ordered by job and sequence."""
    chosen = receipts
    for name, value in (("job_id", job_id), ("trace_id", trace_id), ("event_type", event_type), ("receipt_id", receipt_id)):
        if value is not None:
            chosen = chosen.filter(F.col(name) == value)
    return chosen.orderBy("job_id", "sequence")


def chain_heads(receipts: DataFrame) -> DataFrame:
    """Number of receipts and newest receipt per job."""
    return receipts.groupBy("job_id").agg(
        F.count("*").alias("receipts"),
        F.max("sequence").alias("head_sequence"),
        F.max_by("receipt_hash", "sequence").alias("head_hash"),
    )


def filter_records(
    table: DataFrame, order: list[str], *, job_id: str | None = None, trace_id: str | None = None
) -> DataFrame:
    """Registrations, evaluations or reviews by job and trace, in the given order."""
    chosen = table
    if job_id is not None:
        chosen = chosen.filter(F.col("job_id") == job_id)
    if trace_id is not None:
        chosen = chosen.filter(F.col("trace_id") == trace_id)
    return chosen.orderBy(*order)


def readiness_cards(jobs: DataFrame) -> DataFrame:
    """Three article cards per job.

    ``jobs``: job_id, span_count, trace_sha256, review_verified, decision,
    article_15_threat_flagged, policy_action.
    """
    c = F.col
    logging = (c("span_count") > 0) & F.coalesce(c("trace_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    token = F.regexp_replace(F.lower(F.trim("decision")), "[^a-z0-9]+", "-")
    approved = F.coalesce(c("review_verified") & token.isin(*rules.APPROVED_DECISIONS), F.lit(False))
    reviewed = c("decision").isNotNull()
    flagged = F.coalesce(c("article_15_threat_flagged"), F.lit(False))
    blocked = F.lower(F.coalesce("policy_action", F.lit(""))).isin("block", "action.block", "action-block")

    def card(article: str, status, score):
        return F.struct(F.lit(article).alias("article"), status.alias("status"), score.cast("int").alias("score"))

    cards = F.array(
        card("article_12", F.when(logging, "ready").otherwise("attention"), F.when(logging, 100).otherwise(0)),
        card(
            "article_14",
            F.when(approved, "ready").when(reviewed, "blocked").otherwise("pending"),
            F.when(approved, 100).otherwise(0),
        ),
        card(
            "article_15",
            F.when(flagged & blocked, "blocked").when(flagged, "attention").otherwise("ready"),
            F.when(flagged, 0).otherwise(100),
        ),
    )
    return jobs.select("job_id", F.explode(cards).alias("c")).select("job_id", "c.*")


def readiness_rollup(cards: DataFrame) -> DataFrame:
    """Overall status: blocked > attention > pending > ready."""
    order = ("ready", "pending", "attention", "blocked")
    rank = F.lit(0)
    for n, name in enumerate(order):
        rank = F.when(F.col("status") == name, F.lit(n)).otherwise(rank)
    worst = F.max(rank)
    name = F.lit(order[0])
    for n, status in enumerate(order):
        name = F.when(F.col("worst") == n, F.lit(status)).otherwise(name)
    return cards.groupBy("job_id").agg(worst.alias("worst")).select("job_id", name.alias("overall"))


def job_summary(
    jobs: DataFrame,
    traces: DataFrame,
    evaluations: DataFrame,
    reviews: DataFrame,
    packs: DataFrame | None = None,
) -> DataFrame:
    """One report row per job: counts, verdicts, review and artifact."""
    c = F.col
    t = traces.select("trace_id", "span_count", "root_count")
    e = evaluations.select(
        "evaluation_id",
        "injection_detected",
        "injection_caught",
        "schema_valid",
        "disclosure_present",
        "article_15_threat_flagged",
        "human_review_required",
        "overall_score",
        "threat_count",
        F.size("conflicts").alias("conflict_count"),
    )
    r = reviews.select("job_id", "signoff_id", "reviewer_id", "decision", c("signature_valid").alias("review_verified"))
    rows = jobs.join(t, "trace_id", "left").join(e, "evaluation_id", "left").join(r, "job_id", "left")
    approved = F.coalesce(c("review_verified"), F.lit(False)) & F.coalesce(
        c("decision").isin(*rules.APPROVED_DECISIONS), F.lit(False)
    )
    rows = rows.withColumn("download_ready", approved).withColumn("human_review_required_for_export", ~approved)
    if packs is not None:
        rows = rows.join(packs.select("job_id", "pack_id", c("sha256").alias("artifact_sha256"), c("size").alias("artifact_size")), "job_id", "left")
    return rows
