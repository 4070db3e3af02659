"""Export gates (GOV-01 to GOV-09, JN-03, JN-04).

Inputs are one row per export request, already joined to its trace, evaluation
and review. Each gate is a column with an array of violation codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.hashing import digest_of, hmac_sha256, padded_keys, plain_json, sha
from spanledger.functions.text import dash_token
from spanledger.operators.cost import lookup_or_broadcast

_SHA = "^[0-9a-f]{64}$"
_TRACE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
CODES = "array<string>"

#: Domain prefix of review signatures; the key holder must use the same one.
REVIEW_CONTEXT = "spanledger/review-signoff/v1"


def _id(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def _sha(name: str) -> Column:
    text = F.regexp_replace(F.lower(F.trim(F.col(name))), "^0x", "")
    return F.when(text.rlike(_SHA), text)


def _code(when: Column, code: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(code))


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes)).cast(CODES)


def normalize_action(c: Column) -> Column:
    token = dash_token(c)
    result = F.lit(None).cast("string")
    for action, words in rules.GATE_ACTIONS.items():
        result = F.when(token.isin(*words), F.lit(action)).otherwise(result)
    return result


def is_approved(decision: Column) -> Column:
    return dash_token(decision).isin(*rules.APPROVED_DECISIONS)


def is_rejected(decision: Column) -> Column:
    return dash_token(decision).isin(*rules.REJECTED_DECISIONS)


def stamp_prohibited(actor: Column, claim: Column) -> Column:
    """A software actor, or none, that claims approval or conformity (GOV-05)."""
    who, said = dash_token(actor), dash_token(claim)
    marked = F.lit(False)
    for marker in rules.STAMP_MARKERS:
        marked = marked | said.contains(marker)
    return ((who == "") | who.isin(*rules.AUTOMATED_ACTORS)) & marked


def stamp_gate(claims: DataFrame) -> DataFrame:
    """Add ``prohibited`` to claims ``(actor, claim)``."""
    return claims.withColumn("prohibited", stamp_prohibited(F.col("actor"), F.col("claim")))


def verify_review_signatures(reviews: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``signature_valid``: HMAC-SHA256 over the canonical sign-off fields (GOV-08).

    ``keys`` is ``(signing_key_id, key binary)``; keys under 32 bytes never verify.
    """
    inner, outer = padded_keys(F.col("key"))
    padded = keys.filter(F.octet_length("key") >= 32).select(
        "signing_key_id", inner.alias("inner_key"), outer.alias("outer_key")
    )
    signed = lookup_or_broadcast(reviews, padded, ["signing_key_id"])
    expected = hmac_sha256(F.col("inner_key"), F.col("outer_key"), review_message())
    supplied = F.lower(F.hex(F.try_to_binary(F.translate("signature", "-_", "+/"), F.lit("base64"))))
    return signed.withColumn(
        "signature_valid", F.coalesce(expected == supplied, F.lit(False))
    ).drop("inner_key", "outer_key")


def review_message() -> Column:
    """Bytes a reviewer signs: domain prefix, a zero byte, canonical JSON of the fields."""
    names = (
        "signoff_id",
        "job_id",
        "trace_id",
        "trace_sha256",
        "evaluation_id",
        "actor",
        "reviewer_id",
        "reviewer_name",
        "decision",
        "attestation",
        "signing_key_id",
    )
    fields = {name: F.col(name) for name in (*names, "scope")}
    fields["signed_at"] = F.date_format("signed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = plain_json(**dict(sorted(fields.items())))
    prefix = F.concat(F.lit(REVIEW_CONTEXT).cast("binary"), F.unhex(F.lit("00")))
    return F.concat(prefix, body.cast("binary"))


def gather(requests: DataFrame, traces: DataFrame, evaluations: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per request with its trace, evaluation and review, side by side.

    ``requests``: request_id, job_id, trace_id, requested_action.
    ``traces``: trace_id, job_id, trace_sha256, declared_sha256, stamp, stamp_actor.
    ``evaluations``: trace_id, evaluation_id, trace_sha256, verdict columns.
    ``reviews``: one per job.
    """
    def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
        return df.select(*keep, *(F.col(n).alias(f"{prefix}_{n}") for n in df.columns if n not in keep))

    t = prefixed(traces.withColumn("found", F.lit(True)), "t", ["trace_id"])
    e = prefixed(evaluations.withColumn("found", F.lit(True)), "e", ["trace_id"])
    r = prefixed(reviews.withColumn("found", F.lit(True)).withColumn("own_job_id", F.col("job_id")), "r", ["job_id"])
    return requests.join(t, "trace_id", "left").join(e, "trace_id", "left").join(r, "job_id", "left")


def with_gates(rows: DataFrame) -> DataFrame:
    """Add the five code arrays of :func:`gather` rows."""
    c = F.col
    trace_hash = F.coalesce(_sha("t_declared_sha256"), _sha("t_trace_sha256"))
    action = normalize_action(c("e_policy_action"))
    preview = c("requested_action") == "preview"
    staged = rows.select(
        "*",
        trace_hash.alias("g_trace_sha256"),
        _sha("e_trace_sha256").alias("g_evaluation_sha256"),
        _id("e_evaluation_id").alias("g_evaluation_id"),
        F.coalesce(action, F.lit("Action.queue")).alias("g_action"),
        action.isNull().alias("g_action_missing"),
        F.coalesce(_id("job_id"), _id("t_job_id"), _id("e_job_id"), _id("r_own_job_id")).alias("g_job_id"),
        (~preview).alias("human_review_required"),
        dash_token(c("r_decision")).alias("g_decision"),
        F.coalesce(c("r_found"), F.lit(False)).alias("g_reviewed"),
    )
    trace_id = _id("trace_id")
    trace_issues = _codes(
        _code(trace_id.isNull(), "trace_identifier_missing"),
        _code(~trace_id.rlike(_TRACE_ID), "trace_identifier_invalid"),
        _code(_sha("t_declared_sha256") != _sha("t_trace_sha256"), "trace_hash_mismatch"),
        _code(c("g_trace_sha256").isNull(), "trace_hash_missing_or_invalid"),
    )
    detected, caught = c("e_injection_detected"), c("e_injection_caught")
    evaluation_issues = _codes(
        _code(c("g_evaluation_id").isNull(), "evaluation_identifier_missing"),
        _code(_id("e_evaluated_trace_id").isNull(), "evaluation_trace_identifier_missing"),
        _code(c("g_evaluation_sha256").isNull(), "evaluation_trace_hash_missing_or_invalid"),
        _code(~F.coalesce(c("e_schema_valid"), F.lit(False)), "evaluation_schema_not_valid"),
        _code(detected & ~caught, "detected_injection_not_caught"),
        _code(caught & ~detected, "caught_injection_not_detected"),
        _code(c("g_action_missing"), "evaluation_policy_action_missing_or_invalid"),
        _code(~c("g_action_missing") & (c("g_action") == "Action.block"), "evaluation_requires_block"),
    )
    reviewed, required = c("g_reviewed"), c("human_review_required")
    approved = c("g_decision").isin(*rules.APPROVED_DECISIONS)
    rejected = c("g_decision").isin(*rules.REJECTED_DECISIONS)
    valid_signature = F.coalesce(c("r_signature_valid"), F.lit(False))
    human = dash_token(c("r_actor")) == "human"
    review_issues = F.when(
        required,
        _codes(
            _code(~reviewed, "signed_human_review_required"),
            _code(reviewed & ~human, "human_reviewer_required"),
            _code(reviewed & F.coalesce(_id("r_reviewer_id"), _id("r_reviewer_name")).isNull(), "human_reviewer_identifier_missing"),
            _code(reviewed & (c("g_decision") == ""), "human_review_decision_missing"),
            _code(reviewed & rejected, "human_review_rejected"),
            _code(reviewed & (c("g_decision") != "") & ~approved & ~rejected, "human_review_decision_invalid"),
            _code(reviewed & ~valid_signature, "human_review_signature_invalid"),
        ),
    ).otherwise(F.array().cast(CODES))
    review_trace, review_hash = _id("r_trace_id"), _sha("r_trace_sha256")
    review_evaluation, review_job = _id("r_evaluation_id"), _id("r_own_job_id")
    evaluated = _codes(
        _code(_id("e_evaluated_trace_id") != trace_id, "evaluation_trace_binding_mismatch"),
        _code(c("g_evaluation_sha256") != c("g_trace_sha256"), "evaluation_trace_hash_mismatch"),
    )
    bound = _codes(
        _code(review_trace.isNull(), "review_trace_identifier_missing"),
        _code(review_trace != trace_id, "review_trace_binding_mismatch"),
        _code(review_hash.isNull(), "review_trace_hash_missing_or_invalid"),
        _code(review_hash != c("g_trace_sha256"), "review_trace_hash_mismatch"),
        _code(review_evaluation.isNull(), "review_evaluation_identifier_missing"),
        _code(review_evaluation != c("g_evaluation_id"), "review_evaluation_binding_mismatch"),
        _code(c("g_job_id").isNull(), "job_identifier_missing"),
        _code(review_job.isNull(), "review_job_identifier_missing"),
        _code(review_job != c("g_job_id"), "review_job_binding_mismatch"),
        _code(_id("t_job_id") != c("g_job_id"), "trace_job_binding_mismatch"),
        _code(_id("e_job_id") != c("g_job_id"), "evaluation_job_binding_mismatch"),
    )
    binding_issues = F.when(required, F.concat(evaluated, bound)).otherwise(
        F.concat(evaluated, _codes(_code(F.size(evaluated) > 0, "preview_does_not_override_evidence_binding")))
    )
    stamp_issues = _codes(
        *(
            _code(
                c(f"{side}_stamp").isNotNull() & stamp_prohibited(F.coalesce(c(f"{side}_stamp_actor"), F.lit("system")), c(f"{side}_stamp")),
                f"automated_compliance_stamp_prohibited:{label}",
            )
            for side, label in (("t", "trace"), ("e", "evaluation"))
            if f"{side}_stamp" in rows.columns
        )
    )
    gated = staged.select(
        "*",
        trace_issues.alias("trace_issues"),
        evaluation_issues.alias("evaluation_issues"),
        review_issues.alias("review_issues"),
        binding_issues.alias("binding_issues"),
        stamp_issues.alias("stamp_issues"),
    )
    verified = F.when(required, reviewed & (F.size("review_issues") == 0)).otherwise(
        reviewed & human & valid_signature & approved
    )
    return gated.withColumn("human_review_verified", verified)


def authorize_exports(rows: DataFrame) -> DataFrame:
    """Decisions of gated rows (GOV-06, GOV-09)."""
    c = F.col
    violations = F.array_distinct(
        F.flatten(F.array("trace_issues", "evaluation_issues", "review_issues", "binding_issues", "stamp_issues"))
    )
    structural = (
        F.size("trace_issues") + F.size("evaluation_issues") + F.size("binding_issues") + F.size("stamp_issues")
    ) > 0
    rejected = F.array_contains("review_issues", "human_review_rejected")
    status = (
        F.when(structural | rejected, "Action.block")
        .when(F.size("review_issues") > 0, "Action.queue")
        .otherwise(c("g_action"))
    )
    decided = rows.withColumn("violation_codes", violations)
    authorized = F.size("violation_codes") == 0
    return decided.select(
        "*",
        authorized.alias("authorized"),
        status.alias("policy_status"),
        (authorized & (c("requested_action") == "export")).alias("export_allowed"),
        (authorized & c("requested_action").isin("export", "compile")).alias("compile_allowed"),
        authorized.alias("preview_allowed"),
    )


_NODES = (
    ("constitutional_rule", None),
    ("trace_evidence", "trace_issues"),
    ("evaluation_evidence", "evaluation_issues"),
    ("signed_human_review", "review_issues"),
    ("evidence_binding", "binding_issues"),
    ("automated_stamp_prohibition", "stamp_issues"),
)


def _node_issues(name: str, issues: str | None) -> tuple[Column, Column]:
    """Whether a node is required, and its issues."""
    required = F.col("human_review_required") if name == "signed_human_review" else F.lit(True)
    return required, F.array_distinct(issues) if issues else F.array().cast(CODES)


def _node_result(node_id: Column, required: Column, issues: Column) -> tuple[Column, Column, Column]:
    """Status, detail and evidence digest of a node."""
    c = F.col
    text = plain_json(
        evaluation_id=c("g_evaluation_id"),
        issues=issues,
        job_id=c("g_job_id"),
        node_id=node_id,
        required=required,
        rule=F.lit(rules.CONSTITUTIONAL_RULE),
        trace_id=c("trace_id"),
        trace_sha256=c("g_trace_sha256"),
    )
    return F.when(F.size(issues) > 0, "fail").otherwise("pass"), F.array_join(issues, "; "), sha(text)


def governance_nodes(decisions: DataFrame) -> DataFrame:
    """Six nodes per request with status, detail and evidence digest."""
    c = F.col
    listed = []
    for n, (name, codes) in enumerate(_NODES):
        required, issues = _node_issues(name, codes)
        listed.append(F.struct(F.lit(n).alias("node_order"), F.lit(name).alias("node_id"), required.alias("required"), issues.alias("issues")))
    rows = decisions.select(
        "request_id", "trace_id", "g_trace_sha256", "g_evaluation_id", "g_job_id", F.explode(F.array(*listed)).alias("n")
    )
    status, detail, digest = _node_result(c("n.node_id"), c("n.required"), c("n.issues"))
    return rows.select(
        "request_id",
        c("n.node_order").alias("node_order"),
        c("n.node_id").alias("node_id"),
        c("n.required").alias("required"),
        status.alias("status"),
        detail.alias("detail"),
        digest.alias("evidence_digest"),
    )


def decision_graph_digest(nodes: DataFrame) -> DataFrame:
    """One digest per request over its six nodes, in node order (GOV-07)."""
    item = F.struct(
        "node_order", "node_id", "status", "detail", "evidence_digest"
    )
    ordered = F.array_sort(F.collect_list(item))  # always six rows per request
    return nodes.groupBy("request_id").agg(ordered.alias("nodes")).select(
        "request_id", digest_of(nodes=F.col("nodes")).alias("graph_sha256")
    )


def decision_graphs(decisions: DataFrame) -> DataFrame:
    """:func:`decision_graph_digest` from the decisions, one row per request: its nodes are made and digested in its row."""
    c = F.col
    rows = decisions.select(
        "request_id",
        "trace_id",
        "g_trace_sha256",
        "g_evaluation_id",
        "g_job_id",
        "human_review_required",
        *(_node_issues(name, codes)[1].alias(f"issues_{n}") for n, (name, codes) in enumerate(_NODES)),
    )
    nodes = []
    for n, (name, codes) in enumerate(_NODES):
        required, _ = _node_issues(name, codes)
        status, detail, digest = _node_result(F.lit(name), required, c(f"issues_{n}"))
        # Named in the order of canonical JSON.
        nodes.append(F.struct(detail.alias("detail"), digest.alias("evidence_digest"), F.lit(name).alias("node_id"), F.lit(n).alias("node_order"), status.alias("status")))
    return rows.select("request_id", sha(plain_json(nodes=F.array(*nodes))).alias("graph_sha256"))
