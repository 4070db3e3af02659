"""Trace evaluation (EVL-01 to EVL-17, AGG-07, AGG-08, AGG-11, AGG-14).

Every rule is a column on the leaf rows, and one aggregation by trace with
numeric states turns them into verdicts. It combines map-side, so a trace that
holds a third of all spans costs no more than any other. Lists in reports are
top-k rows; the complete evidence stays available as rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.hashing import digest_of
from spanledger.functions.text import (
    blank_to_underscore,
    clean_text,
    compact,
    fold_text,
    is_ascii,
    parse_flag,
    word_match,
)
from spanledger.operators.digests import tree_digest, with_span_digest
from spanledger.operators.leaves import attribute_leaves
from spanledger.operators.validate import structure_counts

_RANK = {name: rank for rank, name in enumerate(rules.SEVERITIES)}


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def _contains_any(c: Column, markers) -> Column:
    return _any(c.contains(m) for m in markers)


# --- rules on one text -------------------------------------------------------


def _spaced(letters: str) -> str:
    """Pattern of the letters with any separators between them."""
    return "[^a-z0-9]*".join(letters)


#: Necessary for any compact marker: its first letters, however separated.
_COMPACT_START = "|".join(_spaced(start) for start in ("ignoreall", "bypassall", "revealyour"))


def _pattern_hits(folded: Column) -> Column:
    """``array<struct<code, rank>>`` of the injection rules a folded text meets.

    Plain substring tests come first; a regex runs only on texts that hold one
    of its anchor words.
    """
    squeezed = compact(folded)

    def hit(code: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(_RANK[severity]).alias("rank")))

    spoken = [
        hit(code, severity, _contains_any(folded, rules.PATTERN_ANCHORS[code]) & word_match(folded, pattern))
        for code, pattern, severity in rules.INJECTION_PATTERNS
    ]
    packed = F.array_compact(
        F.array(*(hit(c, s, squeezed.contains(m)) for c, m, s in rules.COMPACT_PATTERNS))
    )
    none = F.array().cast("array<struct<code:string,rank:int>>")
    return F.concat(
        F.array_compact(F.array(*spoken)), F.when(folded.rlike(_COMPACT_START), packed).otherwise(none)
    )


def _is_injection_label(folded: Column) -> Column:
    return ~word_match(folded, rules.LABEL_NEGATION) & _contains_any(compact(folded), rules.INJECTION_LABELS)


def _is_disclosure(raw: Column, folded: Column) -> Column:
    pattern = rules.DISCLOSURE_PATTERN
    found = F.when(is_ascii(raw), raw.rlike(pattern)).otherwise(raw.rlike("(?U)" + pattern))
    negated = word_match(folded, rules.NOTICE_NEGATION) | compact(folded).isin(*rules.NEGATED_NOTICES)
    return F.when(_contains_any(folded, rules.DISCLOSURE_ANCHORS), found & ~negated).otherwise(F.lit(False))


def scan_text(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``injection_codes``, ``injection_severity`` and ``ai_disclosure`` for any text column."""
    staged = df.withColumn("__folded", fold_text(F.col(text_col)))
    staged = staged.withColumn("__hits", _pattern_hits(F.col("__folded")))
    rank = F.array_max(F.transform("__hits", lambda h: h["rank"]))
    return (
        staged.withColumn("injection_codes", F.transform("__hits", lambda h: h["code"]))
        .withColumn("injection_severity", _severity_name(rank))
        .withColumn(
            "ai_disclosure", _is_disclosure(F.col("__folded"), F.col("__folded"))
        )
        .drop("__folded", "__hits")
    )


def _severity_name(rank: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, number in _RANK.items():
        result = F.when(rank == number, F.lit(name)).otherwise(result)
    return result


# --- leaf signals ------------------------------------------------------------


def _flag_value(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "boolean", text == "true")
        .when(
            kind == "number",
            F.when(text.try_cast("double") == 1, F.lit(True)).when(text.try_cast("double") == 0, F.lit(False)),
        )
        .when(kind == "string", parse_flag(text))
    )


def leaf_signals(spans: DataFrame, keep: list[str]) -> DataFrame:
    """Leaves with one column per rule; irrelevant leaves keep nulls and zeros."""
    leaves = attribute_leaves(spans, keep)
    full, last, kind = F.col("full_key"), F.col("last_key"), F.col("kind")
    is_string = kind == "string"
    marked = leaves.select(
        "*",
        *(
            _any(full.endswith(k) for k in names).alias(f"is_{family}")
            for family, names in rules.FLAG_KEYS.items()
        ),
        (is_string & _contains_any(full, rules.INPUT_MARKERS)).alias("is_input"),
        (is_string & (last.isin(*rules.DISCLOSURE_TEXT_KEYS) | _contains_any(full, rules.OUTPUT_MARKERS))).alias("is_output"),
        (is_string & last.isin(*rules.ACTION_KEYS)).alias("is_action"),
        (is_string & last.isin(*rules.CLASSIFICATION_KEYS)).alias("is_class"),
        (is_string & (last == "severity")).alias("is_severity"),
    )
    wanted = F.col("is_input") | F.col("is_output") | F.col("is_class")
    folded = marked.withColumn("folded", F.when(wanted, fold_text(F.col("text"))))
    action = F.regexp_replace(F.lower(F.trim(F.col("text"))), r"[\s_]+", "")
    action = F.regexp_replace(action, r"^action\.", "action")
    named = F.lit("unknown")
    for value, words in rules.ACTION_WORDS.items():
        named = F.when(action.isin(*words), F.lit(value)).otherwise(named)
    severity = F.lit(None).cast("int")
    for name, rank in _RANK.items():
        severity = F.when(blank_to_underscore(F.col("text")) == name, F.lit(rank)).otherwise(severity)
    any_flag = _any(F.col(f"is_{family}") for family in rules.FLAG_KEYS)
    signals = folded.select(
        "*",
        F.when(F.col("is_input"), _pattern_hits(F.col("folded"))).alias("hits"),
        F.when(F.col("is_output"), _is_disclosure(F.col("text"), F.col("folded"))).alias("discloses"),
        F.when(F.col("is_class"), _is_injection_label(F.col("folded"))).alias("labels_injection"),
        F.when(F.col("is_action"), named).alias("action"),
        F.when(F.col("is_severity"), severity).alias("severity_rank"),
        F.when(any_flag, _flag_value(F.col("kind"), F.col("text"))).alias("flag"),
    )
    return signals.drop("folded")


def flag_observations(spans: DataFrame) -> DataFrame:
    """Distinct ``(trace_id, family, span_id, key, value)``; value null = not a boolean."""
    signals = leaf_signals(spans, ["trace_id", "span_id"])
    families = F.array_compact(
        F.array(*(F.when(F.col(f"is_{f}"), F.lit(f)) for f in rules.FLAG_KEYS))
    )
    return (
        signals.select("trace_id", F.explode(families).alias("family"), "span_id", F.col("last_key").alias("key"), F.col("flag").alias("value"))
        .distinct()
    )


def resolve_flags(observations: DataFrame) -> DataFrame:
    """Per trace and family: counts, resolved value and conflict."""
    value = F.col("value")
    counted = observations.groupBy("trace_id", "family").agg(
        F.count_if(value).alias("positive"),
        F.count_if(~value).alias("negative"),
        F.count_if(value.isNull()).alias("invalid"),
    )
    return counted.select(
        "*",
        ((F.col("positive") > 0) & (F.col("negative") == 0) & (F.col("invalid") == 0)).alias("value"),
        ((F.col("positive") > 0) & (F.col("negative") > 0)).alias("conflict"),
    )


def injection_matches(spans: DataFrame) -> DataFrame:
    """Distinct ``(trace_id, span_id, code, severity, text_sha256, excerpt)`` of pattern hits.

    Texts are told apart by the digest of the whole text; ``excerpt`` is its start, for print.
    """
    signals = leaf_signals(spans, ["trace_id", "span_id"])
    hit = signals.select(
        "trace_id",
        "span_id",
        F.explode("hits").alias("hit"),
        F.sha2("text", 256).alias("text_sha256"),
        clean_text(F.col("text"), 180).alias("excerpt"),
    )
    return hit.select(
        "trace_id", "span_id", F.col("hit.code").alias("code"), _severity_name(F.col("hit.rank")).alias("severity"), "text_sha256", "excerpt"
    ).distinct()


def threat_classifications(spans: DataFrame) -> DataFrame:
    """Leaves whose classification names an injection."""
    return leaf_signals(spans, ["trace_id", "span_id"]).filter("labels_injection").select(
        "trace_id", "span_id", clean_text(F.col("text")).alias("classification")
    )


def severity_signals(spans: DataFrame) -> DataFrame:
    """Highest severity per trace from severity leaves and matched patterns."""
    return _signals_by_trace(spans, ["trace_id"]).select(
        "trace_id", _severity_name(F.col("severity_rank")).alias("severity")
    ).filter("severity is not null")


def observed_actions(spans: DataFrame) -> DataFrame:
    """Policy actions found in the spans, with ``unknown`` for other words."""
    return leaf_signals(spans, ["trace_id", "span_id"]).filter("action is not null").select(
        "trace_id", "span_id", "action", clean_text(F.col("text")).alias("text")
    )


# --- verdicts per trace ------------------------------------------------------


def _signals_by_trace(spans: DataFrame, keys: list[str]) -> DataFrame:
    signals = leaf_signals(spans.withColumn("__events", F.size("events")), [*keys, "__events"])
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    once = once & (F.coalesce(F.col("sub"), F.lit(0)) == 0)

    def seen(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0)) == 1

    flags = []
    for family in rules.FLAG_KEYS:
        member, flag = F.col(f"is_{family}"), F.col("flag")
        flags += [
            seen(member & flag).alias(f"{family}_pos"),
            seen(member & ~flag).alias(f"{family}_neg"),
            seen(member & flag.isNull()).alias(f"{family}_inv"),
        ]
    hit_rank = F.array_max(F.transform("hits", lambda h: h["rank"]))
    return signals.groupBy(*keys).agg(
        F.sum(once.cast("int")).alias("span_count"),
        F.sum(F.when(once, F.col("__events")).otherwise(0)).alias("event_count"),
        *flags,
        F.sum(F.coalesce(F.size("hits"), F.lit(0))).alias("pattern_hits"),
        F.max(F.greatest("severity_rank", hit_rank)).alias("severity_rank"),
        seen(F.col("labels_injection")).alias("labelled"),
        seen(F.col("discloses")).alias("disclosure_text"),
        *(seen(F.col("action") == a).alias(f"action_{a}") for a in (*rules.ACTION_WORDS, "unknown")),
    )


def _conflict(when: Column, code: str) -> Column:
    return F.when(when, F.lit(code))


def evaluate_traces(
    spans: DataFrame,
    judge_verdicts: DataFrame | None = None,
    *,
    check_cycles: bool = True,
    extra_issues: DataFrame | None = None,
) -> DataFrame:
    """One evaluation per trace.

    ``judge_verdicts`` may hold one advisory verdict per trace; it can make a
    result worse, never better. ``extra_issues`` ``(trace_id, issues)`` adds
    schema issues found while parsing.
    """
    c = F.col
    signals = _signals_by_trace(spans, ["trace_id"])
    shape = structure_counts(spans, check_cycles)
    base = signals.join(shape, "trace_id", "left")
    if extra_issues is not None:
        base = base.join(extra_issues.select("trace_id", c("issues").alias("parse_issues")), "trace_id", "left")
    else:
        base = base.withColumn("parse_issues", F.lit(0).cast("long"))
    base = base.withColumn(
        "schema_issues",
        c("duplicate_ids") + c("unnamed_spans") + c("missing_parents") + c("cycle_spans") + F.coalesce("parse_issues", F.lit(0)),
    )
    invalid_injection = c("detected_inv") | c("caught_inv")
    base = base.select(
        "*",
        (c("detected_pos") | c("caught_pos") | c("labelled") | (c("pattern_hits") > 0) | invalid_injection).alias("found"),
        ((c("schema_issues") == 0) & ~c("schema_neg") & ~c("schema_inv")).alias("conforms"),
        (c("disclosure_pos") | c("disclosure_text")).alias("disclosed"),
    )
    if judge_verdicts is None:
        judged = base.select(
            "*",
            F.lit(None).cast("boolean").alias("j_detected"),
            F.lit(None).cast("boolean").alias("j_caught"),
            F.lit(None).cast("boolean").alias("j_schema"),
            F.lit(None).cast("boolean").alias("j_disclosure"),
            F.lit(None).cast("double").alias("j_confidence"),
            F.lit(None).cast("string").alias("judge_rationale"),
            F.lit("not-requested").alias("judge_status"),
        )
    else:
        verdicts = judge_verdicts.select(
            "trace_id",
            c("injection_detected").alias("j_detected"),
            c("injection_caught").alias("j_caught"),
            c("schema_valid").alias("j_schema"),
            c("disclosure_present").alias("j_disclosure"),
            c("confidence").cast("double").alias("j_confidence"),
            (clean_text(c("rationale").cast("string")) if "rationale" in judge_verdicts.columns else F.lit(None).cast("string")).alias("judge_rationale"),
            F.lit("completed").alias("judge_status"),
        )
        judged = base.join(verdicts, "trace_id", "left").withColumn(
            "judge_status", F.coalesce("judge_status", F.lit("fallback"))
        )
    yes, no = F.lit(True), F.lit(False)
    merged = judged.select(
        "*",
        (c("found") | F.coalesce("j_detected", no) | F.coalesce("j_caught", no)).alias("injection_detected"),
        (c("conforms") & F.coalesce("j_schema", yes)).alias("schema_valid"),
        (c("disclosed") | F.coalesce("j_disclosure", no)).alias("disclosure_present"),
        F.coalesce("severity_rank", F.lit(_RANK["high"])).alias("injection_rank"),
    ).withColumn("article_15_threat_flagged", c("injection_detected") | c("article15_pos"))

    actions = [c(f"action_{a}") for a in rules.ACTION_WORDS]
    distinct_actions = sum((a.cast("int") for a in actions[1:]), actions[0].cast("int"))
    merged = merged.withColumn("distinct_actions", distinct_actions)
    disclosure_conflict = (c("disclosed") & (c("disclosure_neg") | c("disclosure_inv"))) | (
        c("disclosure_pos") & c("disclosure_neg")
    )
    only_action = F.lit("allow")
    for name in rules.ACTION_WORDS:
        only_action = F.when(c(f"action_{name}"), F.lit(name)).otherwise(only_action)
    action = (
        F.when(c("article_15_threat_flagged") | ~c("schema_valid"), "queue")
        .when(~c("disclosure_present") | disclosure_conflict | (c("distinct_actions") > 1), "review")
        .when(c("human_pos"), "review")
        .when(c("j_confidence") < rules.MIN_JUDGE_CONFIDENCE, "review")
        .otherwise(only_action)
    )
    merged = merged.withColumn("policy_action", action)
    conflicts = F.array_compact(
        F.array(
            _conflict((c("detected_pos") & c("detected_neg")) | (c("caught_pos") & c("caught_neg")), "injection-signals-conflict"),
            _conflict(c("found") & c("detected_neg"), "false-injection-flag-overridden"),
            _conflict(c("found") & c("caught_neg"), "false-interception-flag-overridden"),
            _conflict(invalid_injection, "invalid-injection-metadata"),
            _conflict(c("schema_pos") & c("schema_neg"), "schema-signals-conflict"),
            _conflict(c("schema_inv"), "invalid-schema-metadata"),
            _conflict(c("disclosed") & c("disclosure_neg"), "disclosure-against-false-flag"),
            _conflict(c("disclosed") & c("disclosure_inv"), "disclosure-against-invalid-flag"),
            _conflict(c("disclosure_pos") & c("disclosure_neg"), "disclosure-signals-conflict"),
            _conflict(c("article15_pos") & c("article15_neg"), "threat-flags-conflict"),
            _conflict(c("injection_detected") & c("article15_neg"), "false-threat-flag-overridden"),
            _conflict(c("article15_inv"), "invalid-threat-metadata"),
            _conflict(c("distinct_actions") > 1, "policy-actions-conflict"),
            _conflict(c("action_unknown"), "unknown-policy-action"),
            _conflict(c("human_pos") & c("human_neg"), "oversight-signals-conflict"),
            _conflict(c("human_inv"), "invalid-oversight-metadata"),
            _conflict(c("human_neg") & (c("policy_action") != "allow"), "intervention-against-false-flag"),
            _conflict(~F.coalesce("j_schema", yes), "judge-schema-concern"),
        )
    )
    worsened = (
        (F.coalesce("j_detected", no) & ~c("found"))
        | (F.coalesce("j_caught", no) & ~c("found"))
        | (~F.coalesce("j_schema", yes) & c("conforms"))
    )
    judge_threat = F.coalesce("j_detected", no) & ~c("found")
    score = (
        F.lit(1) + c("schema_valid").cast("int") + c("disclosure_present").cast("int")
    )
    result = merged.select(
        "trace_id",
        "span_count",
        "event_count",
        "injection_detected",
        c("injection_detected").alias("injection_caught"),
        c("found").alias("detected_by_rules"),
        F.coalesce("j_detected", no).alias("detected_by_judge"),
        F.when(c("injection_detected"), _severity_name(c("injection_rank"))).alias("injection_severity"),
        "schema_valid",
        "disclosure_present",
        "article_15_threat_flagged",
        "policy_action",
        (c("policy_action") != "allow").alias("human_review_required"),
        # Injection immunity passes whenever detected implies caught, which the rules guarantee.
        F.round(score / 3.0, 4).alias("overall_score"),
        F.when(worsened, c("j_confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        "judge_status",
        "judge_rationale",
        "pattern_hits",
        "schema_issues",
        (c("found").cast("int") + judge_threat.cast("int") + (c("article15_pos") & ~c("injection_detected")).cast("int")).alias("threat_count"),
        conflicts.alias("conflicts"),
    )
    return with_evaluation_id(result)


_ID_FIELDS = (
    "trace_id",
    "injection_detected",
    "injection_caught",
    "schema_valid",
    "disclosure_present",
    "article_15_threat_flagged",
    "policy_action",
    "human_review_required",
    "overall_score",
    "confidence",
    "judge_status",
    "span_count",
    "pattern_hits",
    "schema_issues",
)


def with_evaluation_id(evaluations: DataFrame) -> DataFrame:
    """``evaluation_id``: digest of the verdict fields and conflicts."""
    fields = {name: F.col(name).cast("string") for name in _ID_FIELDS}
    return evaluations.withColumn(
        "evaluation_id", digest_of(**fields, conflicts=F.array_join("conflicts", ","))
    )


def evaluation_evidence_digest(spans: DataFrame) -> DataFrame:
    """``evidence_sha256`` per trace over its span digests (EVL-15)."""
    return tree_digest(with_span_digest(spans), ["trace_id"], "sha256", "evidence_sha256").drop("items")


def injection_evidence(spans: DataFrame) -> DataFrame:
    """All distinct evidence of a trace: ``(trace_id, n, evidence, text_sha256, span_id)``.

    ``n`` numbers a trace's evidence by kind and walk order. ``evidence`` prints
    the start of a text; the digest tells whole texts apart, and ``span_id`` is
    where it occurs first. For a print of the first few see
    :func:`spanledger.operators.validate.print_first`.
    """
    place = ["source", "block", "row", "item"]
    signals = leaf_signals(spans, ["trace_id", "span_id", *place])
    step = F.struct(*place, "pos", "sub")
    none = F.array().cast("array<struct<rank:int,text:string,digest:string>>")

    def note(rank: int, text: Column, digest: Column | None = None) -> Column:
        own = F.lit(None).cast("string") if digest is None else digest
        return F.struct(F.lit(rank).alias("rank"), text.alias("text"), own.alias("digest"))

    excerpt = clean_text(F.col("text"), 180)
    label = F.concat(F.lit("threat classification: "), excerpt)
    whole = F.sha2("text", 256)
    notes = signals.withColumn("excerpt", excerpt).withColumn("label", label).withColumn("digest", whole).select(
        "trace_id",
        "span_id",
        step.alias("step"),
        F.explode(
            F.concat(
                F.coalesce(
                    F.transform("hits", lambda h: note(0, F.concat_ws(": ", h["code"], F.col("excerpt")), F.col("digest"))), none
                ),
                F.array_compact(
                    F.array(
                        F.when(F.col("is_detected") & F.col("flag"), note(1, F.lit("explicit detection flag is true"))),
                        F.when(F.col("is_caught") & F.col("flag"), note(2, F.lit("explicit interception flag is true"))),
                        F.when(F.col("labels_injection"), note(3, F.col("label"), F.col("digest"))),
                    )
                ),
            )
        ).alias("note"),
    )
    first = notes.groupBy("trace_id", "note.rank", "note.text", "note.digest").agg(
        F.min("step").alias("step"), F.min_by("span_id", "step").alias("span_id")
    )
    order = Window.partitionBy("trace_id").orderBy("rank", "step", "text")
    return first.select(
        "trace_id", F.row_number().over(order).alias("n"), F.col("text").alias("evidence"), F.col("digest").alias("text_sha256"), "span_id"
    )


def disclosure_evidence(spans: DataFrame) -> DataFrame:
    """Where a disclosure stands: ``(trace_id, span_id, source, text_sha256, excerpt)``.

    ``source`` is ``text`` for an output that discloses and ``flag`` for a
    disclosure flag that is true.
    """
    signals = leaf_signals(spans, ["trace_id", "span_id"])
    source = F.when(F.col("discloses"), "text").when(F.col("is_disclosure") & F.col("flag"), "flag")
    return (
        signals.withColumn("source", source)
        .filter("source is not null")
        .select("trace_id", "span_id", "source", F.sha2("text", 256).alias("text_sha256"), clean_text(F.col("text"), 180).alias("excerpt"))
        .distinct()
    )


def finding_evidence(spans: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Evidence behind findings: ``(trace_id, code, span_id, text_sha256, evidence)``.

    Injection findings list all injection evidence, disclosure findings all
    places that disclose. Other findings follow from the verdict columns alone.
    """
    found = evaluations.select("trace_id", "injection_detected", "disclosure_present")
    injection = injection_evidence(spans).select(
        "trace_id", F.lit("INJECTION_INTERCEPTED").alias("code"), "span_id", "text_sha256", "evidence"
    )
    disclosure = disclosure_evidence(spans).select(
        "trace_id", F.lit("DISCLOSURE_PRESENT").alias("code"), "span_id", "text_sha256", F.col("excerpt").alias("evidence")
    )
    rows = injection.unionByName(disclosure).join(found, "trace_id")
    holds = F.when(F.col("code") == "INJECTION_INTERCEPTED", F.col("injection_detected")).otherwise(F.col("disclosure_present"))
    return rows.filter(holds).drop("injection_detected", "disclosure_present")


# --- reports -----------------------------------------------------------------


def findings(evaluations: DataFrame) -> DataFrame:
    """``(trace_id, code, severity, message)`` rows of the ten finding codes."""
    c = F.col

    def finding(when: Column, code: str, severity: Column, message: str) -> Column:
        return F.when(
            when,
            F.struct(F.lit(code).alias("code"), severity.alias("severity"), F.lit(message).alias("message")),
        )

    info, medium, high = F.lit("info"), F.lit("medium"), F.lit("high")
    conflict = F.size("conflicts") > 0
    detected = c("injection_detected")
    listed = F.array_compact(
        F.array(
            finding(detected, "INJECTION_INTERCEPTED", c("injection_severity"), "Injection evidence was found and held for human review."),
            finding(~detected, "NO_INJECTION_SIGNAL", info, "No injection rule met any inspected input."),
            finding(c("schema_valid"), "SCHEMA_VALID", info, "Span structure and schema signals are consistent."),
            finding(~c("schema_valid"), "SCHEMA_INVALID", high, "Span structure or schema signals failed."),
            finding(c("disclosure_present"), "DISCLOSURE_PRESENT", info, "AI disclosure was found in text or flags."),
            finding(~c("disclosure_present"), "DISCLOSURE_MISSING", medium, "No AI disclosure was found."),
            finding(c("policy_action") == "queue", "HUMAN_INTERVENTION_REQUIRED", high, "The policy queued the trace for a human."),
            finding(c("article_15_threat_flagged"), "ARTICLE_15_THREAT_FLAGGED", F.when(detected, c("injection_severity")).otherwise(medium), "The trace carries a security threat."),
            finding(conflict, "EVIDENCE_CONFLICT", F.when(detected, high).otherwise(medium), "Signals conflict; the stricter reading was used."),
            finding(c("judge_status") == "completed", "LLM_ASSESSMENT_RECORDED", info, "An advisory verdict was recorded."),
            finding(c("judge_status") == "fallback", "LLM_FALLBACK_USED", medium, "No usable advisory verdict; rules only."),
        )
    )
    return evaluations.select("trace_id", F.explode(listed).alias("f")).select("trace_id", "f.*")


def advisory_evidence(evaluations: DataFrame) -> DataFrame:
    """What an advisory verdict leaves behind: ``(trace_id, record, code, evidence)``.

    ``record`` is finding or threat. A recorded assessment has the judge's
    rationale as evidence, a missing one the reason; a threat that only the
    judge saw names the judge before the rationale. A verdict without rationale
    has an empty one.
    """
    c = F.col
    said = F.coalesce("judge_rationale", F.lit(""))

    def entry(when: Column, record: str, code: str, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(record).alias("record"), F.lit(code).alias("code"), evidence.alias("evidence")))

    rows = F.array_compact(
        F.array(
            entry(c("judge_status") == "completed", "finding", "LLM_ASSESSMENT_RECORDED", said),
            entry(c("judge_status") == "fallback", "finding", "LLM_FALLBACK_USED", F.lit("judge-error")),
            entry(c("detected_by_judge") & ~c("detected_by_rules"), "threat", "prompt-injection", F.concat(F.lit("advisory judge: "), said)),
        )
    )
    return evaluations.select("trace_id", F.explode(rows).alias("e")).select("trace_id", "e.*")


def criteria(evaluations: DataFrame) -> DataFrame:
    """Three 0/1 criteria per trace."""
    c = F.col
    passed = F.array(
        F.struct(F.lit("injection_immunity").alias("name"), (~c("injection_detected") | c("injection_caught")).alias("passed")),
        F.struct(F.lit("schema_validity").alias("name"), c("schema_valid").alias("passed")),
        F.struct(F.lit("article_50_transparency").alias("name"), c("disclosure_present").alias("passed")),
    )
    return evaluations.select("trace_id", F.explode(passed).alias("x")).select(
        "trace_id", "x.name", "x.passed", F.col("x.passed").cast("double").alias("score")
    )


def overall_scores(criteria_rows: DataFrame) -> DataFrame:
    return criteria_rows.groupBy("trace_id").agg(F.round(F.avg("score"), 4).alias("overall_score"))


def threats(evaluations: DataFrame) -> DataFrame:
    """``(trace_id, category, severity)``: injection, advisory or declared threats."""
    c = F.col
    rows = F.array_compact(
        F.array(
            F.when(c("detected_by_rules") | c("detected_by_judge"), F.struct(F.lit("prompt-injection").alias("category"), F.when(c("detected_by_rules"), c("injection_severity")).otherwise("medium").alias("severity"))),
            F.when(~c("injection_detected") & c("article_15_threat_flagged"), F.struct(F.lit("declared-security-threat").alias("category"), F.lit("medium").alias("severity"))),
        )
    )
    return evaluations.select("trace_id", F.explode(rows).alias("t")).select("trace_id", "t.*")


def evidence_rates(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """Conformance, detection, interception and disclosure rates and counts per action."""
    c = F.col

    def share(condition: Column) -> Column:
        return F.round(F.avg(condition.cast("double")), 6)

    return evaluations.groupBy(*by).agg(
        F.count("*").alias("traces"),
        share(c("schema_valid")).alias("schema_valid_rate"),
        share(c("injection_detected")).alias("injection_rate"),
        F.round(F.avg(F.when(c("injection_detected"), c("injection_caught").cast("double"))), 6).alias("caught_rate"),
        share(c("disclosure_present")).alias("disclosure_rate"),
        *(F.count_if(c("policy_action") == a).alias(f"{a}_count") for a in rules.ACTION_WORDS),
    )


def judge_inputs(spans: DataFrame) -> DataFrame:
    """Per span: scalar attributes and distinct input and output texts for an outside judge.

    Everything is given whole; what fits a judge's window is the caller's choice.
    """
    from spanledger.functions import variants as V

    def one(e: Column) -> Column:
        scalar = V.kind(e["value"]).isin("string", "number", "boolean")
        return F.when(scalar, F.struct(e["key"].alias("key"), V.text(e["value"]).alias("value")))

    heads = spans.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "status",
        F.map_from_entries(
            F.array_compact(F.transform(F.map_entries(V.as_map(F.col("attributes"))), one))
        ).alias("scalar_attributes"),
    )
    texts = leaf_signals(spans, ["trace_id", "span_id"]).filter("is_input or is_output")
    cleaned = texts.withColumn("cleaned", clean_text(F.col("text"))).filter("cleaned <> ''")
    both = cleaned.select(
        "trace_id",
        "span_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("is_input"), F.lit("input")),
                    # Disclosure keys are outputs for the disclosure rule only.
                    F.when(F.col("is_output") & _contains_any(F.col("full_key"), rules.OUTPUT_MARKERS), F.lit("output")),
                )
            )
        ).alias("side"),
        "pos",
        "sub",
        "cleaned",
    )
    first = both.groupBy("trace_id", "span_id", "side", "cleaned").agg(F.min(F.struct("pos", "sub")).alias("at"))
    lists = first.groupBy("trace_id", "span_id").agg(
        *(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "cleaned")))),
                lambda x: x["cleaned"],
            ).alias(f"{side}_text")
            for side in ("input", "output")
        )
    )
    return heads.join(lists, ["trace_id", "span_id"], "left")
