"""Queries over receipts, reviews, export gates, jobs and packs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.hashing import base64url, hmac_sha256, padded_keys, sha
from spanledger.operators import audit, digests, evaluate, governance, jobs, packs, tree
from spanledger.plans import views as v
from spanledger.plans.registry import plain, query, table, view
from spanledger.plans.trace_queries import _evaluation_sql, _verdicts, _VERDICTS, CONV
from spanledger.session import HASHES, broadcast_if_small, materialize, shared_folder
from spanledger.sources.tables import review_problem_counts

JOBS = plain(v.JOBS)
_KEY_TEXT = "an-audit-key-of-more-than-32-bytes"


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    """One signing key per market segment, derived from its name."""
    segments = table(spark, folder, "customer").select("c_mktsegment").distinct()
    return segments.select(
        F.lower("c_mktsegment").alias("signing_key_id"),
        F.concat(F.lit(_KEY_TEXT), "c_mktsegment").cast("binary").alias("key"),
    )


# --- audit chains: orders of a customer ------------------------------------------------


def _events(spark, folder) -> DataFrame:
    """Orders as audit events; a customer is a job."""
    c = F.col
    return view(spark, folder, v.JOBS).select(
        F.concat(F.lit("r-"), c("o_orderkey").cast("string")).alias("receipt_id"),
        F.concat(F.lit("k-"), c("o_orderkey").cast("string")).alias("idempotency_key"),
        c("trace_id").alias("job_id"),
        c("job_id").alias("trace_id"),
        F.when(c("o_orderstatus") == "F", "review.signed").when(c("o_orderstatus") == "O", "job.created").otherwise("Pack.Exported").alias("event_type"),
        F.when(c("o_orderstatus") == "F", "reviewer").when(c("o_orderpriority") == "5-LOW", "robot").otherwise("system").alias("actor_type"),
        F.lower("o_orderpriority").alias("actor_id"),
        c("created_at").cast("timestamp").alias("occurred_at"),
        F.concat(F.lit('{"total": '), F.round(c("o_totalprice") * 100).cast("bigint").cast("string"), F.lit(', "key":'), c("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
    )


_GOOD = "(o_orderstatus = 'F' or o_orderpriority <> '5-LOW')"
_EVENTS = f"""ev as (select 'r-' || cast(o_orderkey as string) as receipt_id, trace_id as job_id, o_orderkey, created_at,
  case o_orderstatus when 'F' then 'review.signed' when 'O' then 'job.created' else 'pack.exported' end as event_type,
  case when o_orderstatus = 'F' then 'human' else 'service' end as actor_type, lower(o_orderpriority) as actor_id,
  sha256('{{"key":' || cast(o_orderkey as string) || ',"total":' || cast(cast(round(o_totalprice * 100) as bigint) as string) || '}}') as payload_sha256
  from ({JOBS}) where {_GOOD}),
num as (select *, row_number() over (partition by job_id order by created_at, receipt_id) as sequence from ev)"""


def _material(row: str, previous: str) -> str:
    """Canonical receipt body of row alias ``row`` as SQL."""
    return f"""'{{"actor_id":"' || {row}.actor_id || '","actor_type":"' || {row}.actor_type || '","event_type":"' || {row}.event_type
      || '","job_id":"' || {row}.job_id || '","occurred_at":"' || strftime({row}.created_at, '%Y-%m-%dT%H:%M:%S')
      || '+00:00","payload_sha256":"' || {row}.payload_sha256 || '","previous_receipt_hash":' || {previous}
      || ',"schema_version":1,"sequence":' || cast({row}.sequence as string) || '}}'"""


_QUOTED = "'\"' || c.receipt_hash || '\"'"
_NULL = "'null'"
_CHAIN = f"""{_EVENTS}, chain as (
  select n.*, cast(null as string) as previous_receipt_hash, sha256({_material('n', _NULL)}) as receipt_hash from num n where sequence = 1
  union all select n.*, c.receipt_hash, sha256({_material('n', _QUOTED)})
  from num n join chain c on n.job_id = c.job_id and n.sequence = c.sequence + 1)"""


def _receipts(spark, folder) -> DataFrame:
    events, _ = audit.prepare_events(_events(spark, folder))
    empty = spark.createDataFrame([], "job_id string, sequence bigint, receipt_hash string")
    # Chains are folded once; verification reads them more than once.
    return materialize(audit.build_receipts(events, empty, "building", _keys(spark, folder)), HASHES)


@query(
    "receipt_chain",
    f"""with recursive {_CHAIN} select job_id, receipt_id, cast(sequence as bigint) as sequence, event_type, actor_type, payload_sha256, previous_receipt_hash, receipt_hash from chain""",
)
def receipt_chain(spark, folder):
    return _receipts(spark, folder).select(
        "job_id", "receipt_id", "sequence", "event_type", "actor_type", "payload_sha256", "previous_receipt_hash", "receipt_hash"
    )


@query(
    "receipt_event_rejects",
    f"select 'actor type is unknown' as reason, count(*) as events from ({JOBS}) where not {_GOOD}",
)
def receipt_event_rejects(spark, folder):
    _, bad = audit.prepare_events(_events(spark, folder))
    return bad.groupBy("reason").agg(F.count("*").alias("events"))


@query("receipt_replays", f"with {_EVENTS} select receipt_id, 'reused for different evidence' as reason from ev where event_type = 'job.created'")
def receipt_replays(spark, folder):
    events, _ = audit.prepare_events(_events(spark, folder))
    # Everything is sent again; job.created events come with another actor.
    again = events.withColumn("actor_id", F.when(F.col("event_type") == "job.created", "someone").otherwise(F.col("actor_id")))
    _, conflicts = audit.new_events(again, events)
    return conflicts.select("receipt_id", "reason")


@query(
    "verify_chains",
    f"with {_EVENTS} select job_id, count(*) as receipts, cast(0 as bigint) as failed, true as valid from num group by job_id",
)
def verify_chains(spark, folder):
    return audit.verify_chains(_receipts(spark, folder), _keys(spark, folder)).drop("first_failure")


@query(
    "verify_tampered_chains",
    f"""with {_EVENTS}, t as (select *, actor_id = '1-urgent' and actor_type = 'service' as forged from num)
    select job_id, count(*) as receipts, count(*) filter (where forged) as failed, min(case when forged then sequence end) as first_failure, not bool_or(forged) as valid from t group by job_id""",
)
def verify_tampered_chains(spark, folder):
    forged = (F.col("actor_id") == "1-urgent") & (F.col("actor_type") == "service")
    tampered = _receipts(spark, folder).withColumn("payload", F.when(forged, '{"key":0}').otherwise(F.col("payload")))
    return audit.verify_chains(tampered, _keys(spark, folder))


@query(
    "verify_late_receipts",
    f"""with {_EVENTS} select job_id, cast(count(*) as bigint) as sequence, 'time' as failures from num
    group by job_id having count(*) > 1 and min(created_at) < max(created_at)""",
)
def verify_late_receipts(spark, folder):
    """The first event of each job is chained behind the later ones."""
    # Checked and written once; the first events and the others are taken from it.
    events = materialize(audit.prepare_events(_events(spark, folder))[0], HASHES)
    keys = _keys(spark, folder)
    firsts = events.groupBy("job_id").agg(F.min_by("receipt_id", F.struct("occurred_at", "receipt_id")).alias("receipt_id"))
    late = events.join(firsts, ["job_id", "receipt_id"], "left_semi")
    empty = spark.createDataFrame([], "job_id string, sequence bigint, receipt_hash string")
    stored = materialize(audit.build_receipts(events.join(firsts, ["job_id", "receipt_id"], "left_anti"), empty, "building", keys), HASHES)
    chained = stored.unionByName(audit.build_receipts(late, stored, "building", keys))
    rows = audit.verify_receipts(chained, keys).filter(F.size("failures") > 0)
    return rows.select("job_id", "sequence", F.array_join("failures", ",").alias("failures"))


@query(
    "verify_truncated_chains",
    f"""with {_EVENTS} select n.job_id, n.sequence, 'gap' as failures from num n
    join num p on n.job_id = p.job_id and n.sequence = p.sequence + 1 where p.actor_type = 'human' and n.actor_type <> 'human'""",
)
def verify_truncated_chains(spark, folder):
    kept = _receipts(spark, folder).filter("actor_type <> 'human'")
    rows = audit.verify_receipts(kept, _keys(spark, folder)).filter(F.size("failures") > 0)
    return rows.select("job_id", "sequence", F.array_join("failures", ",").alias("failures"))


@query(
    "chain_heads",
    f"""with recursive {_CHAIN} select job_id, count(*) as receipts, max(sequence) as head_sequence, max_by(receipt_hash, sequence) as head_hash from chain group by job_id""",
)
def chain_heads(spark, folder):
    return jobs.chain_heads(_receipts(spark, folder))


@query(
    "filtered_receipts",
    f"with {_EVENTS} select job_id, receipt_id, sequence from num where event_type = 'review.signed'",
)
def filtered_receipts(spark, folder):
    return jobs.filter_receipts(_receipts(spark, folder), event_type="review.signed").select("job_id", "receipt_id", "sequence")


_IN_FOUR = "'\"' || c.receipt_hash || '\"'"
_CHAIN_OF_FOURS = f"""{_EVENTS}, chain as (
  select n.*, sha256({_material('n', _NULL)}) as receipt_hash from num n where sequence = 1
  union all select n.*, sha256({_material('n', "case when (n.sequence - 1) % 4 = 0 then 'null' else " + _IN_FOUR + " end")})
  from num n join chain c on n.job_id = c.job_id and n.sequence = c.sequence + 1),
heads as (select job_id, (sequence - 1) // 4 as segment, count(*) as receipts, max_by(receipt_hash, sequence) as head_hash from chain group by all)"""


def _short_segments(spark, folder) -> DataFrame:
    events, _ = audit.prepare_events(_events(spark, folder))
    empty = spark.createDataFrame([], "job_id string, sequence bigint, receipt_hash string")
    return materialize(audit.build_receipts(events, empty, "building", _keys(spark, folder), 4))


@query("receipt_segments", f"with recursive {_CHAIN_OF_FOURS} select job_id, cast(segment as bigint) as segment, receipts, head_hash from heads")
def receipt_segments(spark, folder):
    return audit.segment_heads(_short_segments(spark, folder), 4)


# Neighbours are hashed level by level; a last one without a neighbour is a peak, higher ones stand before it.
@query(
    "chain_roots",
    f"""with recursive {_CHAIN_OF_FOURS}, levels as (
      select job_id, count(*) as segments, list(head_hash order by segment) as hs, '' as peaks from heads group by job_id
      union all select job_id, segments, list_transform(range(1, len(hs) // 2 + 1), lambda i: sha256(hs[2 * i - 1] || hs[2 * i])),
        case when len(hs) % 2 = 1 then hs[len(hs)] else '' end || peaks from levels where len(hs) > 0)
    select job_id, segments, sha256(peaks) as root from levels where len(hs) = 0""",
)
def chain_roots(spark, folder):
    return audit.chain_roots(_short_segments(spark, folder), 4)


@query("verify_segments", f"with {_EVENTS} select job_id, sequence, 'gap' as failure from num where sequence % 4 = 1 and sequence > 1")
def verify_segments(spark, folder):
    # The last receipt of every full segment is gone.
    kept = _short_segments(spark, folder).filter("sequence % 4 <> 0")
    rows = audit.verify_receipts(kept, _keys(spark, folder), 4)
    return rows.select("job_id", "sequence", F.explode("failures").alias("failure"))


@query("appended_receipts", f"""with recursive {_CHAIN} select job_id, receipt_id, cast(sequence as bigint) as sequence, receipt_hash from chain""")
def appended_receipts(spark, folder):
    """Human receipts are appended, then all, then all again: every receipt is stored once."""
    path = f"{shared_folder(spark).rstrip('/')}/receipts-{uuid.uuid4().hex}"
    receipts = _receipts(spark, folder)
    for batch in (receipts.filter("actor_type = 'human'"), receipts, receipts):
        audit.append_receipts(batch, path)
    return spark.read.parquet(path).select("job_id", "receipt_id", "sequence", "receipt_hash")


# --- registrations and integrity ---------------------------------------------------------


def _registered(spark, folder) -> DataFrame:
    c = F.col
    return audit.register_traces(
        view(spark, folder, v.JOBS).select(
            "job_id",
            "trace_id",
            sha(F.concat(c("trace_id"), F.lit("/"), c("o_orderstatus"))).alias("trace_sha256"),
            F.length("o_orderpriority").alias("span_count"),
            "o_orderkey",
            "o_orderpriority",
            "o_orderstatus",
        )
    )


def _replayed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Orders of three priorities are stored; all come again, the high ones changed."""
    every = _registered(spark, folder)
    stored = every.filter("o_orderpriority <> '5-LOW'")
    again = every.withColumn(
        "trace_sha256", F.when(F.col("o_orderpriority") == "2-HIGH", sha(F.col("trace_sha256"))).otherwise(F.col("trace_sha256"))
    )
    return audit.append_only(again, stored, ["job_id", "trace_id"], "trace_sha256")


@query("registrations_inserted", f"select job_id, trace_id, sha256(trace_id || '/' || o_orderstatus) as trace_sha256 from ({JOBS}) where o_orderpriority = '5-LOW'")
def registrations_inserted(spark, folder):
    return _replayed(spark, folder)[0].select("job_id", "trace_id", "trace_sha256")


@query(
    "registration_conflicts",
    f"""select job_id, trace_id, sha256(sha256(trace_id || '/' || o_orderstatus)) as new_digest, sha256(trace_id || '/' || o_orderstatus) as stored_digest
    from ({JOBS}) where o_orderpriority = '2-HIGH'""",
)
def registration_conflicts(spark, folder):
    return _replayed(spark, folder)[1]


@query(
    "integrity_violations",
    f"""with j as ({JOBS}) select 'registration' as record, job_id || '/' || trace_id as key, 'receipt_missing' as problem from j where o_orderstatus = 'F'
    union all select 'registration', job_id || '/' || trace_id, 'digest_mismatch' from j where o_orderpriority = '1-URGENT'
    union all select 'evaluation', 'ev-' || cast(o_orderkey as string), 'digest_mismatch' from j where o_orderpriority = '3-MEDIUM'
    union all select 'evaluation', 'ev-' || cast(o_orderkey as string), 'trace_hash_mismatch' from j where o_orderpriority = '4-NOT SPECIFIED'
    union all select 'evaluation', 'ev-' || cast(o_orderkey as string), 'receipt_missing' from j where o_orderstatus = 'F'""",
)
def integrity_violations(spark, folder):
    c = F.col
    base = _registered(spark, folder)
    receipts = base.filter("o_orderstatus <> 'F'").select("receipt_id")
    registrations = base.withColumn("span_count", c("span_count") + F.when(c("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    payload = F.concat(F.lit('{"order":'), c("o_orderkey").cast("string"), F.lit("}"))
    evaluations = base.select(
        "job_id",
        "trace_id",
        F.concat(F.lit("ev-"), c("o_orderkey").cast("string")).alias("evaluation_id"),
        "receipt_id",
        F.when(c("o_orderpriority") == "4-NOT SPECIFIED", sha(c("trace_sha256"))).otherwise(c("trace_sha256")).alias("trace_sha256"),
        F.when(c("o_orderpriority") == "3-MEDIUM", F.concat(payload, F.lit(" "))).otherwise(payload).alias("payload"),
        sha(payload).alias("payload_sha256"),
    )
    return audit.verify_integrity(registrations, evaluations, receipts)


# --- reviews and signatures ---------------------------------------------------------------


def _raw_reviews(spark, folder) -> DataFrame:
    """Orders as sign-offs; priorities and statuses break single rules."""
    c = F.col
    segment = table(spark, folder, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment")
    p = c("o_orderpriority")
    return view(spark, folder, v.JOBS).join(segment, "o_custkey").select(
        F.concat(F.lit("s-"), c("o_orderkey").cast("string")).alias("signoff_id"),
        "job_id",
        "trace_id",
        sha(c("trace_id")).alias("trace_sha256"),
        F.concat(F.lit("ev-"), "trace_id").alias("evaluation_id"),
        F.when(c("o_orderstatus") == "F", "Human_Reviewer").when(p == "5-LOW", "bot").otherwise("operator").alias("actor"),
        F.lower(F.concat(F.lit("rev-"), "c_mktsegment")).alias("reviewer_id"),
        F.initcap("c_mktsegment").alias("reviewer_name"),
        F.when(p == "1-URGENT", "Approve").when(p == "2-HIGH", "conditionally approved").when(p == "3-MEDIUM", "denied").when(p == "4-NOT SPECIFIED", "later").otherwise("accepted").alias("decision"),
        F.lit("I looked at the evidence.").alias("attestation"),
        F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.when(c("o_totalprice") < 20000, "T10:00:00").otherwise("T10:00:00Z")).alias("signed_at"),
        F.when(c("o_totalprice") > 480000, F.array(F.lit(" "))).otherwise(F.array(F.lit("export"))).alias("scope"),
        F.lower("c_mktsegment").alias("signing_key_id"),
        F.lit("c" * 42 + "c=").alias("signature"),
        p.alias("priority"),
        "o_orderstatus",
        "o_orderkey",
    )


@query(
    "review_checks",
    f"""with j as ({JOBS}) select 'actor must be human' as problem, count(*) as reviews from j where o_orderstatus <> 'F' and o_orderpriority = '5-LOW'
    union all select 'decision is invalid', count(*) from j where o_orderpriority = '4-NOT SPECIFIED'
    union all select 'signed_at needs a zone', count(*) from j where o_totalprice < 20000
    union all select 'scope must not be empty', count(*) from j where o_totalprice > 480000""",
)
def review_checks(spark, folder):
    return review_problem_counts(_raw_reviews(spark, folder))


def _signed_reviews(spark, folder) -> DataFrame:
    """Valid reviews signed with the segment's key; 5-LOW ones carry a foreign signature."""
    from spanledger.sources.tables import read_reviews

    good, _ = read_reviews(_raw_reviews(spark, folder))
    inner, outer = padded_keys(F.col("key"))
    keys = _keys(spark, folder).select("signing_key_id", inner.alias("ik"), outer.alias("ok"))
    message = governance.review_message()
    right = base64url(hmac_sha256(F.col("ik"), F.col("ok"), message))
    wrong = base64url(hmac_sha256(F.col("ok"), F.col("ik"), message))
    return good.join(broadcast_if_small(keys), "signing_key_id").withColumn(
        "signature", F.when(F.col("priority") == "5-LOW", wrong).otherwise(right)
    ).drop("ik", "ok")


_REVIEWED = """(o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW') or (o_orderpriority = '5-LOW' and o_orderstatus = 'F')) and o_totalprice >= 20000 and o_totalprice <= 480000"""


@query(
    "review_signatures",
    f"select 's-' || cast(o_orderkey as string) as signoff_id, o_orderpriority <> '5-LOW' as signature_valid from ({JOBS}) where {_REVIEWED}",
)
def review_signatures(spark, folder):
    checked = governance.verify_review_signatures(_signed_reviews(spark, folder), _keys(spark, folder))
    return checked.select("signoff_id", "signature_valid")


@query("recorded_reviews", f"select job_id from ({JOBS}) where {_REVIEWED} and o_orderstatus = 'F'")
def recorded_reviews(spark, folder):
    reviews = _signed_reviews(spark, folder)
    stored, _ = audit.record_reviews(reviews.filter("o_orderstatus <> 'F'"), spark.createDataFrame([], "job_id string, signoff_sha256 string"))
    return audit.record_reviews(reviews, stored)[0].select("job_id")


# --- gates -----------------------------------------------------------------------------------


@query(
    "stamp_claims",
    """select p_partkey, (p_brand in ('Brand#1', 'Brand#2', 'Brand#3') or p_size > 45) and (p_type in ('ECONOMY', 'SMALL', 'PROMO')) as prohibited from part""",
)
def stamp_claims(spark, folder):
    c = F.col
    brand = F.when(c("p_brand") == "Brand#1", "Service Account").when(c("p_brand") == "Brand#2", "AI").when(c("p_brand") == "Brand#3", "").otherwise(c("p_name"))
    claims = table(spark, folder, "part").select(
        "p_partkey",
        F.when(c("p_size") > 45, "compiler").otherwise(brand).alias("actor"),
        F.when(c("p_type") == "ECONOMY", "Fully compliant!").when(c("p_type") == "SMALL", "legal approval").when(c("p_type") == "PROMO", "non-conformity report").otherwise("draft").alias("claim"),
    )
    return governance.stamp_gate(claims).select("p_partkey", "prohibited")


def _gated(spark, folder) -> DataFrame:
    """Every order requests an export of its customer's trace."""
    c = F.col
    requests = view(spark, folder, v.JOBS).select(
        c("o_orderkey").alias("request_id"),
        "job_id",
        "trace_id",
        F.when(c("o_totalprice") > 450000, "preview").otherwise("export").alias("requested_action"),
    )
    customers = table(spark, folder, "customer").withColumn("trace_id", F.concat(F.lit("tr-"), c("c_custkey").cast("string")))
    digest = sha(c("trace_id"))
    traces = customers.select(
        "trace_id",
        F.lit(None).cast("string").alias("job_id"),
        digest.alias("trace_sha256"),
        F.when(c("c_acctbal") < 0, sha(digest)).otherwise(digest).alias("declared_sha256"),
        F.when(c("c_mktsegment") == "FURNITURE", F.when(c("c_acctbal") > 9000, "certified")).alias("stamp"),
        F.lit("evaluator").alias("stamp_actor"),
    )
    evaluations = customers.select(
        "trace_id",
        c("trace_id").alias("evaluated_trace_id"),
        F.lit(None).cast("string").alias("job_id"),
        F.concat(F.lit("ev-"), "trace_id").alias("evaluation_id"),
        F.when(c("c_acctbal") < 0, sha(digest)).otherwise(digest).alias("trace_sha256"),
        (c("c_nationkey") != 3).alias("schema_valid"),
        (c("c_nationkey") == 4).alias("injection_detected"),
        (c("c_nationkey") == 4).alias("injection_caught"),
        F.when(c("c_nationkey") == 4, "queue").when(c("c_nationkey") == 5, "Action.block").when(c("c_nationkey") == 6, "shrug").otherwise("allow").alias("policy_action"),
        F.lit(None).cast("string").alias("stamp"),
        F.lit(None).cast("string").alias("stamp_actor"),
    )
    reviews = governance.verify_review_signatures(_signed_reviews(spark, folder), _keys(spark, folder)).select(
        "job_id", "trace_id", "trace_sha256", "evaluation_id", "actor", "reviewer_id", "reviewer_name", "decision", "signature_valid", "signoff_id"
    )
    return governance.with_gates(governance.gather(requests, traces, evaluations, reviews))


_GATES = f"""g as (select o_orderkey as request_id, j.job_id, j.trace_id, o_totalprice > 450000 as preview, {_REVIEWED} as reviewed, o_orderpriority as p, c_acctbal as bal, c_nationkey as nk,
  c_mktsegment as seg from ({JOBS}) j join customer on c_custkey = o_custkey),
k as (select *, list_filter([case when bal < 0 then 'trace_hash_mismatch' end], lambda q: q is not null) as t,
  list_filter([case when nk = 3 then 'evaluation_schema_not_valid' end, case when nk = 6 then 'evaluation_policy_action_missing_or_invalid' end, case when nk = 5 then 'evaluation_requires_block' end], lambda q: q is not null) as e,
  list_filter([case when not preview and not reviewed then 'signed_human_review_required' end, case when not preview and reviewed and p = '3-MEDIUM' then 'human_review_rejected' end,
    case when not preview and reviewed and p = '5-LOW' then 'human_review_signature_invalid' end], lambda q: q is not null) as r,
  case when preview then [] when reviewed then list_filter([case when bal < 0 then 'review_trace_hash_mismatch' end], lambda q: q is not null) else
    ['review_trace_identifier_missing', 'review_trace_hash_missing_or_invalid', 'review_evaluation_identifier_missing', 'review_job_identifier_missing'] end as b,
  list_filter([case when seg = 'FURNITURE' and bal > 9000 then 'automated_compliance_stamp_prohibited:trace' end], lambda q: q is not null) as s from g),
d as (select *, list_concat(list_concat(list_concat(list_concat(t, e), r), b), s) as codes,
  case when len(t) + len(e) + len(b) + len(s) > 0 or list_contains(r, 'human_review_rejected') then 'Action.block' when len(r) > 0 then 'Action.queue'
    when nk = 4 then 'Action.queue' else 'Action.allow' end as policy_status from k)"""


@query(
    "governance_decisions",
    f"""with {_GATES} select request_id, array_to_string(codes, ',') as violations, policy_status, len(codes) = 0 as authorized,
    len(codes) = 0 and not preview as export_allowed, not preview as human_review_required,
    case when preview then reviewed and p in ('1-URGENT', '2-HIGH') else reviewed and len(r) = 0 end as human_review_verified from d""",
)
def governance_decisions(spark, folder):
    rows = governance.authorize_exports(_gated(spark, folder))
    return rows.select(
        "request_id", F.array_join("violation_codes", ",").alias("violations"), "policy_status", "authorized", "export_allowed", "human_review_required", "human_review_verified"
    )


@query(
    "governance_nodes",
    f"""with {_GATES} select request_id, 'constitutional_rule' as node_id, 'pass' as status, '' as detail from d
    union all select request_id, 'trace_evidence', case when len(t) > 0 then 'fail' else 'pass' end, array_to_string(t, '; ') from d
    union all select request_id, 'evaluation_evidence', case when len(e) > 0 then 'fail' else 'pass' end, array_to_string(e, '; ') from d
    union all select request_id, 'signed_human_review', case when len(r) > 0 then 'fail' else 'pass' end, array_to_string(r, '; ') from d
    union all select request_id, 'evidence_binding', case when len(b) > 0 then 'fail' else 'pass' end, array_to_string(b, '; ') from d
    union all select request_id, 'automated_stamp_prohibition', case when len(s) > 0 then 'fail' else 'pass' end, array_to_string(s, '; ') from d""",
)
def governance_nodes(spark, folder):
    nodes = governance.governance_nodes(governance.authorize_exports(_gated(spark, folder)))
    return nodes.select("request_id", "node_id", "status", "detail")


@query("decision_graph_digests")
def decision_graph_digests(spark, folder):
    return governance.decision_graphs(governance.authorize_exports(_gated(spark, folder)))


# --- jobs ---------------------------------------------------------------------------------------


@query("jobs_page", f"select job_id, trace_id from ({JOBS}) order by created_at desc, job_id desc limit 100 offset 50")
def jobs_page(spark, folder):
    page, _ = jobs.list_jobs(view(spark, folder, v.JOBS), limit=100, offset=50)
    return page.select("job_id", "trace_id")


@query("jobs_total", f"select count(*) as total from ({JOBS})")
def jobs_total(spark, folder):
    return jobs.list_jobs(view(spark, folder, v.JOBS))[1]


@query(
    "latest_job_per_trace",
    f"select trace_id, job_id, job_count from (select *, row_number() over (partition by trace_id order by created_at desc, job_id desc) as n, count(*) over (partition by trace_id) as job_count from ({JOBS})) where n = 1",
)
def latest_job_per_trace(spark, folder):
    return jobs.latest_job_per_trace(view(spark, folder, v.JOBS)).select("trace_id", "job_id", "job_count")


@query(
    "related_jobs",
    f"select trace_id, cast(n as integer) as rank, job_id from (select *, row_number() over (partition by trace_id order by created_at desc, job_id desc) as n from ({JOBS}))",
)
def related_jobs(spark, folder):
    return jobs.related_jobs(view(spark, folder, v.JOBS))


_STATUS = "case o_orderstatus when 'F' then 'exported' when 'O' then 'awaiting-human-review' else 'ready-for-export' end"


@query(
    "job_status",
    f"select trace_id as job_id, max_by({_STATUS}, o_orderkey) as status, max(o_orderkey) as sequence from ({JOBS}) group by trace_id",
)
def job_status(spark, folder):
    events = view(spark, folder, v.JOBS).select(F.col("trace_id").alias("job_id"), F.col("o_orderkey").alias("sequence"), F.expr(_STATUS).alias("status"))
    return jobs.job_status(events)


def _conv_traces(spark, folder) -> DataFrame:
    """Conversation traces with a request each: request text is the trace's root."""
    summary = packs.trace_summary(v.conv_spans(spark, folder))
    return summary.select(
        "trace_id",
        sha(F.concat("trace_id", F.col("span_count").cast("string"))).alias("trace_sha256"),
        F.concat(F.lit("request-"), "trace_id").alias("request_key"),
        sha(F.col("first_root")).alias("request_sha256"),
        F.col("first_start").alias("created_at"),
        "span_count",
        "root_count",
    )


@query(
    "created_jobs",
    f"""with s as ({CONV}), {_evaluation_sql()} select trace_id, sha256('request-' || trace_id) || ':' || left(sha256(trace_id), 20) as idempotency_key,
    policy_action, 'awaiting-human-review' as status from ev""",
)
def created_jobs(spark, folder):
    evaluations = evaluate.evaluate_traces(v.conv_spans(spark, folder))
    made, _ = jobs.create_jobs(_conv_traces(spark, folder), evaluations)
    return made.select("trace_id", "idempotency_key", "policy_action", "status")


@query(
    "job_conflicts",
    f"""with s as ({CONV}), {_evaluation_sql()} select sha256('request-' || trace_id) || ':' || left(sha256(trace_id), 20) as idempotency_key from ev where span_count > 6""",
)
def job_conflicts(spark, folder):
    evaluations = evaluate.evaluate_traces(v.conv_spans(spark, folder))
    traces = _conv_traces(spark, folder)
    stored, _ = jobs.create_jobs(traces, evaluations)
    changed = traces.withColumn("request_sha256", F.when(F.col("span_count") > 6, "other").otherwise(F.col("request_sha256")))
    return jobs.create_jobs(changed, evaluations, stored)[1].select("idempotency_key")


def _card_jobs(spark, folder) -> DataFrame:
    c = F.col
    return view(spark, folder, v.JOBS).select(
        "job_id",
        F.length("o_orderpriority").alias("span_count"),
        F.when(c("o_totalprice") > 30000, sha(c("trace_id"))).alias("trace_sha256"),
        (c("o_orderstatus") == "F").alias("review_verified"),
        F.when(c("o_orderpriority") == "1-URGENT", "approved").when(c("o_orderpriority") == "2-HIGH", "rejected").alias("decision"),
        (c("o_orderstatus") == "P").alias("article_15_threat_flagged"),
        F.when(c("o_orderpriority") == "5-LOW", "block").otherwise("review").alias("policy_action"),
    )


_CARDS = f"""cards as (select job_id, 'article_12' as article, case when o_totalprice > 30000 then 'ready' else 'attention' end as status, case when o_totalprice > 30000 then 100 else 0 end as score from ({JOBS})
  union all select job_id, 'article_14', case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'ready' when o_orderpriority in ('1-URGENT', '2-HIGH') then 'blocked' else 'pending' end,
    case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 100 else 0 end from ({JOBS})
  union all select job_id, 'article_15', case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'blocked' when o_orderstatus = 'P' then 'attention' else 'ready' end,
    case when o_orderstatus = 'P' then 0 else 100 end from ({JOBS}))"""


@query("readiness_cards", f"with {_CARDS} select job_id, article, status, score from cards")
def readiness_cards(spark, folder):
    return jobs.readiness_cards(_card_jobs(spark, folder))


@query(
    "readiness_rollup",
    f"""with {_CARDS} select job_id, case max(case status when 'blocked' then 3 when 'attention' then 2 when 'pending' then 1 else 0 end)
    when 3 then 'blocked' when 2 then 'attention' when 1 then 'pending' else 'ready' end as overall from cards group by job_id""",
)
def readiness_rollup(spark, folder):
    return jobs.readiness_rollup(jobs.readiness_cards(_card_jobs(spark, folder)))


@query(
    "article_readiness",
    """select p_partkey, case when p_size > 10 and p_size > 20 and p_retailprice > 950 then 'evidenced' else 'partial' end as article_12_status,
    case when p_type = 'PROMO' and p_size > 0 then 'evidenced' else 'partial' end as article_14_status,
    case when p_brand <> 'Brand#7' and p_size >= 40 then 'evidenced' else 'partial' end as article_15_status from part""",
)
def article_readiness(spark, folder):
    c = F.col
    yes = F.lit(True)
    sections = table(spark, folder, "part").select(
        "p_partkey",
        (c("p_size") > 10).alias("recorded"),
        (c("p_size") > 20).alias("timestamps_present"),
        (c("p_retailprice") > 950).alias("receipts_present"),
        c("p_size").alias("span_count"),
        (c("p_type") == "PROMO").alias("documented"),
        yes.alias("reviewer_identified"),
        yes.alias("criteria_documented"),
        c("p_size").alias("review_count"),
        (c("p_brand") != "Brand#7").alias("robustness_documented"),
        yes.alias("cybersecurity_documented"),
        F.greatest(F.lit(0), F.lit(40) - c("p_size")).alias("gap_count"),
    )
    return packs.article_readiness(sections).select("p_partkey", "article_12_status", "article_14_status", "article_15_status")


# --- packs ----------------------------------------------------------------------------------------


def _pack_inputs(spark, folder):
    """Conversations with their evaluations, signed reviews and decisions."""
    c = F.col
    spans = v.conv_spans(spark, folder)
    # Both are read by several sections of the pack.
    evaluations = materialize(evaluate.evaluate_traces(spans, _verdicts(spark, folder)))
    traces = materialize(digests.trace_digests(spans))
    jobs_of = traces.select(F.concat(F.lit("job-"), "trace_id").alias("job_id"), "trace_id")
    requests = jobs_of.select(c("trace_id").alias("request_id"), "job_id", "trace_id", F.lit("export").alias("requested_action"))
    plain_traces = traces.select(
        "trace_id", F.lit(None).cast("string").alias("job_id"), "trace_sha256", c("trace_sha256").alias("declared_sha256")
    )
    bound = evaluations.join(traces.select("trace_id", "trace_sha256"), "trace_id").select(
        "trace_id", c("trace_id").alias("evaluated_trace_id"), F.lit(None).cast("string").alias("job_id"), "evaluation_id", "trace_sha256",
        "schema_valid", "injection_detected", "injection_caught", "policy_action",
    )
    reviews = bound.join(jobs_of, "trace_id").select(
        jobs_of["job_id"], "trace_id", "trace_sha256", "evaluation_id",
        F.lit("human").alias("actor"), F.lit("rev-1").alias("reviewer_id"), F.lit("A Reviewer").alias("reviewer_name"),
        F.when(c("policy_action") == "review", "rejected").otherwise("approved").alias("decision"),
        F.lit(True).alias("signature_valid"),
        sha(F.concat("evaluation_id", "trace_id")).alias("review_sha256"),
    )
    decisions = governance.authorize_exports(
        governance.with_gates(governance.gather(requests, plain_traces, bound, reviews))
    ).withColumn("review_sha256", c("r_review_sha256"))
    return spans, evaluations, decisions


def _sections(spark, folder):
    spans, evaluations, decisions = _pack_inputs(spark, folder)
    twelve = packs.article_12_section(
        packs.trace_summary(spans), digests.evidence_digests(spans), packs.event_taxonomy(spans), tree.call_tree_depth(spans), evaluations
    )
    fourteen = packs.article_14_section(decisions, evaluations)
    fifteen = packs.article_15_section(evaluations, evaluate.threats(evaluations))
    return decisions, twelve, fourteen, fifteen


@query(
    "article_12_sections",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select e.trace_id, span_count, span_count as event_count, schema_valid,
    span_count as call_tree_depth, least(span_count, 256) as digests, (select count(distinct name) from s where s.trace_id = e.trace_id) as event_type_count,
    case when schema_valid then 1.0::double else 0.5::double end as readiness_score from ev e""",
)
def article_12_sections(spark, folder):
    _, twelve, _, _ = _sections(spark, folder)
    return twelve.select(
        "trace_id", "span_count", "event_count", "schema_valid", "call_tree_depth",
        F.size("span_digests").cast("bigint").alias("digests"), "event_type_count", "readiness_score",
    )


_AUTHORIZED = "schema_valid and policy_action not in ('review', 'block')"


@query(
    "article_14_sections",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select trace_id, policy_action, human_review_required as intervention_required,
    case when policy_action <> 'review' then 0.8::double else 0.4::double end as readiness_score from ev""",
)
def article_14_sections(spark, folder):
    _, _, fourteen, _ = _sections(spark, folder)
    return fourteen.select("trace_id", "policy_action", "intervention_required", "readiness_score")


@query(
    "article_15_sections",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select trace_id, injection_detected as threat_flagged,
    cast(injection_detected as bigint) as threat_count, overall_score as score from ev""",
)
def article_15_sections(spark, folder):
    _, _, _, fifteen = _sections(spark, folder)
    return fifteen.select("trace_id", "threat_flagged", "threat_count", "score")


@query(
    "security_threats",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select trace_id, 'prompt-injection' as category,
    case when found then injection_severity else 'medium' end as severity, 'observed' as status from ev where injection_detected""",
)
def security_threats(spark, folder):
    evaluations = evaluate.evaluate_traces(v.conv_spans(spark, folder), _verdicts(spark, folder))
    return packs.security_threats(evaluations, evaluate.threats(evaluations))


@query(
    "pack_manifest",
    f"with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select trace_id, 'job-' || trace_id as job_id, true as intact from ev where {_AUTHORIZED}",
)
def pack_manifest(spark, folder):
    decisions, twelve, fourteen, fifteen = _sections(spark, folder)
    made = packs.compile_packs(decisions, twelve, fourteen, fifteen)
    intact = (sha(F.col("document")) == F.col("sha256")) & F.try_parse_json("document").isNotNull() & (F.length("pack_id") == 29)
    return made.select("trace_id", "job_id", intact.alias("intact"))


@query(
    "pack_documents",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')}, g as (select 'conv-' || cast(conv_id as string) as trace_id, count(*) as n,
      string_agg(distinct lower(p_brand), ',' order by lower(p_brand)) as ids, max(p_size / 50) as best
      from (select distinct conv_id from conversations) join part on p_partkey in (conv_id + 1, 2 * conv_id + 5) group by all)
    select e.trace_id, 'job-' || e.trace_id as job_id, 'job-' || e.trace_id as named_job, e.span_count, (select count(distinct name) from s where s.trace_id = e.trace_id) as event_types,
      policy_action, overall_score as score, injection_detected as threat_flagged, coalesce(n, 0) as standards, coalesce(ids, '') as standard_ids, best as best_score, true as exact
    from ev e left join g on g.trace_id = e.trace_id where {_AUTHORIZED}""",
)
def pack_documents(spark, folder):
    """The compiled documents read back, with their grounding in standards."""
    decisions, twelve, fourteen, fifteen = _sections(spark, folder)
    made = packs.compile_packs(decisions, twelve, fourteen, fifteen, _grounding(spark, folder))
    doc = lambda path, kind: F.try_variant_get(F.try_parse_json("document"), path, kind)
    grounded = F.coalesce(doc("$.standards", "array<struct<article:string,standard_id:string,score:double>>"), F.array())
    # The digest, size and id are those of the document that was read.
    exact = (sha(F.col("document")) == F.col("sha256")) & (F.octet_length("document") == F.col("size")) & (doc("$.pack_id", "string") == F.col("pack_id"))
    return made.withColumn("grounded", grounded).select(
        "trace_id",
        "job_id",
        doc("$.job_id", "string").alias("named_job"),
        doc("$.article_12.span_count", "bigint").alias("span_count"),
        doc("$.article_12.event_type_count", "bigint").alias("event_types"),
        doc("$.article_14.policy_action", "string").alias("policy_action"),
        doc("$.article_15.score", "double").alias("score"),
        doc("$.article_15.threat_flagged", "boolean").alias("threat_flagged"),
        F.size("grounded").cast("bigint").alias("standards"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("grounded", lambda g: g["standard_id"]))), ",").alias("standard_ids"),
        F.array_max(F.transform("grounded", lambda g: g["score"])).alias("best_score"),
        exact.alias("exact"),
    )


def _grounding(spark, folder) -> DataFrame:
    """Up to two parts for each conversation, read as scores of standards."""
    c = F.col
    traces = table(spark, folder, "conversations").select("conv_id").distinct()
    wanted = traces.select("conv_id", F.explode(F.array_distinct(F.array(c("conv_id") + 1, 2 * c("conv_id") + 5))).alias("p_partkey"))
    return wanted.join(table(spark, folder, "part"), "p_partkey").select(
        F.concat(F.lit("conv-"), c("conv_id").cast("string")).alias("subject"),
        F.lit("Article 12").alias("article"),
        F.lower("p_brand").alias("standard_id"),
        (c("p_size") / 50).alias("score"),
    )


@query(
    "verified_packs",
    f"with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select 'job-' || trace_id as job_id, policy_action <> 'queue' as valid from ev where {_AUTHORIZED}",
)
def verified_packs(spark, folder):
    """Queued packs are stored first, then all; the manifest says too much of the queued ones."""
    decisions, twelve, fourteen, fifteen = _sections(spark, folder)
    made = materialize(packs.compile_packs(decisions, twelve, fourteen, fifteen))
    queued = F.get_json_object("document", "$.article_14.policy_action") == "queue"
    path = f"{shared_folder(spark).rstrip('/')}/packs-{uuid.uuid4().hex}"
    packs.write_packs(made.filter(queued), path)
    manifest = packs.write_packs(made, path)
    forged = made.filter(queued).select("pack_id", F.lit(1).alias("more"))
    manifest = manifest.join(forged, "pack_id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
    return packs.verify_packs(spark, path, manifest).select("job_id", "valid")


@query(
    "job_summary",
    f"""with s as ({CONV}), {_VERDICTS}, {_evaluation_sql('jv')} select 'job-' || trace_id as job_id, trace_id, span_count, schema_valid,
    policy_action <> 'review' as download_ready from ev""",
)
def job_summary(spark, folder):
    spans, evaluations, decisions = _pack_inputs(spark, folder)
    job_rows = decisions.select("job_id", "trace_id", F.col("g_evaluation_id").alias("evaluation_id"))
    reviews = decisions.select(
        "job_id", F.lit("s").alias("signoff_id"), F.col("r_reviewer_id").alias("reviewer_id"), F.col("r_decision").alias("decision"), F.col("r_signature_valid").alias("signature_valid")
    )
    summary = jobs.job_summary(job_rows, packs.trace_summary(spans), evaluations, reviews)
    return summary.select("job_id", "trace_id", "span_count", "schema_valid", "download_ready")


@query(
    "evaluations_by_trace",
    f"with s as ({CONV}), {_evaluation_sql()} select trace_id, policy_action from ev where policy_action in ('queue', 'review')",
)
def evaluations_by_trace(spark, folder):
    evaluations = evaluate.evaluate_traces(v.conv_spans(spark, folder))
    ordered = jobs.filter_records(evaluations.filter(F.col("policy_action").isin("queue", "review")), ["trace_id", "evaluation_id"])
    return ordered.select("trace_id", "policy_action")
