"""Trace summaries and evidence packs (AGG-01, AGG-06, AGG-13, PCK-01 to PCK-07, SNK-03, WIN-04)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.hashing import canonical_json, digest_of, sha
from spanledger.session import materialize

SCHEMA_VERSION = "1.0.0"

LIMITATIONS = (
    rules.CONSTITUTIONAL_RULE,
    "The pack is engineering evidence and no legal certification or conformity finding.",
    "A signed review releases the pack; it classifies nothing.",
    "Only records handed to the compiler are covered; nothing is inferred about others.",
    "Digests show integrity of the supplied evidence, not retention or access control.",
    "Rule and judge results are diagnostic and prove no resistance to attack.",
    "Standards matches are technical references; their legal status needs checking.",
)


def trace_summary(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spans, events, roots and times per trace, from one aggregation.

    Root ids are rows of :func:`trace_roots`; the summary carries their number
    and the smallest one.
    """
    keys = keys or ["trace_id"]
    root = F.col("parent_span_id").isNull()
    return spans.groupBy(*keys).agg(
        F.count("*").alias("span_count"),
        F.sum(F.size("events")).alias("event_count"),
        F.count_if(root).alias("root_count"),
        F.min(F.when(root, F.col("span_id"))).alias("first_root"),
        F.min("start_time").alias("first_start"),
        F.max(F.coalesce("end_time", "start_time")).alias("last_end"),
    )


def trace_roots(spans: DataFrame) -> DataFrame:
    """Distinct root span ids."""
    return spans.filter("parent_span_id is null").select("trace_id", "span_id").distinct()


def event_taxonomy(spans: DataFrame) -> DataFrame:
    """Distinct event names per trace with their count."""
    return (
        spans.select("trace_id", F.explode("events.name").alias("name"))
        .groupBy("trace_id", "name")
        .agg(F.count("*").alias("events"))
    )


def span_durations(spans: DataFrame) -> DataFrame:
    """Microseconds per finished span."""
    micros = F.unix_micros("end_time") - F.unix_micros("start_time")
    return spans.filter("end_time is not null").select("trace_id", "span_id", micros.alias("duration_us"))


def trace_durations(durations: DataFrame) -> DataFrame:
    return durations.groupBy("trace_id").agg(
        F.count("*").alias("finished_spans"),
        F.min("duration_us").alias("min_us"),
        F.max("duration_us").alias("max_us"),
        F.sum("duration_us").alias("sum_us"),
    )


def listed_digests(digests: DataFrame, limit: int = rules.SPAN_DIGEST_LIMIT) -> DataFrame:
    """The first ``limit`` span digests per trace for the printed pack (WIN-04).

    The complete list is :func:`spanledger.operators.digests.evidence_digests`,
    and ``tree_sha256`` covers all of it.
    """
    order = Window.partitionBy("trace_id").orderBy("source_span_id", "sha256")
    return digests.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def _top_names(rows: DataFrame, key: str, name: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(name)
    return (
        rows.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= limit)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(name)).alias("names"))
    )


def article_12_section(
    summaries: DataFrame, digests: DataFrame, taxonomy: DataFrame, depths: DataFrame, evaluations: DataFrame
) -> DataFrame:
    """Logging section per trace. Lists print 256 entries at most and carry their total."""
    c = F.col
    limit = rules.SPAN_DIGEST_LIMIT
    printed = (
        listed_digests(digests, limit)
        .groupBy("trace_id")
        .agg(F.array_sort(F.collect_list(F.struct("source_span_id", "sha256", "status"))).alias("span_digests"))
    )
    listed = digests.groupBy("trace_id").agg(F.count("*").alias("span_digest_count"))
    names = _top_names(taxonomy, "trace_id", "name", limit).withColumnRenamed("names", "event_types")
    kinds = taxonomy.groupBy("trace_id").agg(F.count("*").alias("event_type_count"))
    rows = (
        summaries.select("trace_id", "span_count", "event_count")
        .join(evaluations.select("trace_id", "schema_valid"), "trace_id")
        .join(depths.select("trace_id", c("depth").alias("call_tree_depth")), "trace_id", "left")
        .join(printed, "trace_id", "left")
        .join(names, "trace_id", "left")
        .join(kinds, "trace_id", "left")
        .join(listed, "trace_id", "left")
        .withColumn("span_digests_cut", F.coalesce(c("span_digest_count") > limit, F.lit(False)))
        .withColumn("event_types_cut", F.coalesce(c("event_type_count") > limit, F.lit(False)))
    )
    complete = c("schema_valid") & (c("span_count") > 0)
    return rows.select(
        "*",
        F.when(complete, 1.0).otherwise(0.5).alias("readiness_score"),
        F.when(c("schema_valid"), "evidenced").otherwise("not-evidenced").alias("readiness_status"),
    )


def article_14_section(decisions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Oversight section per request from its decision row and evaluation."""
    c = F.col
    rows = decisions.select(
        "request_id",
        "job_id",
        "trace_id",
        c("r_reviewer_id").alias("reviewer_id"),
        c("g_decision").alias("decision"),
        "human_review_verified",
        "policy_status",
    ).join(evaluations.select("trace_id", "evaluation_id", "policy_action", "human_review_required"), "trace_id")
    return rows.select(
        "*",
        c("human_review_required").alias("intervention_required"),
        F.when(c("human_review_verified"), 0.8).otherwise(0.4).alias("readiness_score"),
    ).drop("human_review_required")


def article_15_section(evaluations: DataFrame, threats: DataFrame) -> DataFrame:
    """Security section per trace; a detected injection always has a threat."""
    c = F.col
    has_injection = F.max(F.regexp_replace(F.lower("category"), "[^a-z0-9]", "").contains("injection").cast("int"))
    counted = threats.groupBy("trace_id").agg(F.count("*").alias("listed"), has_injection.alias("has_injection"))
    rows = evaluations.select(
        "trace_id",
        "evaluation_id",
        "injection_detected",
        "injection_caught",
        "article_15_threat_flagged",
        "overall_score",
    ).join(counted, "trace_id", "left")
    added = c("injection_detected") & (F.coalesce("has_injection", F.lit(0)) == 0)
    return rows.select(
        "trace_id",
        "evaluation_id",
        "injection_detected",
        "injection_caught",
        c("article_15_threat_flagged").alias("threat_flagged"),
        (F.coalesce("listed", F.lit(0)) + added.cast("int")).alias("threat_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("overall_score"))).alias("score"),
    )


def security_threats(evaluations: DataFrame, threats: DataFrame) -> DataFrame:
    """Threat rows with status; adds one for a detected injection without a threat."""
    c = F.col
    listed = threats.select("trace_id", "category", F.when(c("severity").isin(*rules.SEVERITIES), c("severity")).otherwise("medium").alias("severity"), F.lit("observed").alias("status"))
    injected = listed.filter(F.regexp_replace(F.lower("category"), "[^a-z0-9]", "").contains("injection")).select("trace_id").distinct()
    missing = evaluations.filter("injection_detected").join(injected, "trace_id", "left_anti").select(
        "trace_id",
        F.lit("prompt-injection").alias("category"),
        F.lit("high").alias("severity"),
        F.when(c("injection_caught"), "caught").otherwise("detected-not-caught").alias("status"),
    )
    return listed.unionByName(missing)


def article_readiness(sections: DataFrame) -> DataFrame:
    """Default readiness (PCK-07): 1.0 evidenced when complete, else 0.5 partial.

    ``sections``: recorded, timestamps_present, receipts_present, span_count,
    documented, reviewer_identified, criteria_documented, review_count,
    robustness_documented, cybersecurity_documented, gap_count.
    """
    c = F.col
    complete = {
        "article_12": c("recorded") & c("timestamps_present") & c("receipts_present") & (c("span_count") > 0),
        "article_14": c("documented") & c("reviewer_identified") & c("criteria_documented") & (c("review_count") > 0),
        "article_15": c("robustness_documented") & c("cybersecurity_documented") & (c("gap_count") == 0),
    }
    columns = []
    for name, done in complete.items():
        columns.append(F.when(done, "evidenced").otherwise("partial").alias(f"{name}_status"))
        columns.append(F.when(done, 1.0).otherwise(0.5).alias(f"{name}_score"))
    return sections.select("*", *columns)


def pack_id() -> Column:
    digest = digest_of(
        evaluation_id=F.col("evaluation_id"),
        job_id=F.col("job_id"),
        review_sha256=F.col("review_sha256"),
        trace_sha256=F.col("trace_sha256"),
    )
    return F.concat(F.lit("pack-"), F.substring(digest, 1, 24))


def compile_packs(decisions: DataFrame, article_12: DataFrame, article_14: DataFrame, article_15: DataFrame, standards: DataFrame | None = None) -> DataFrame:
    """One canonical document per authorised request, with its digest and size.

    ``decisions`` are rows of ``authorize_exports`` with review_sha256.
    ``standards`` is optional ``(subject = trace_id, article, standard_id, score)``.
    """
    c = F.col
    allowed = decisions.filter("authorized").select(
        "request_id",
        "job_id",
        "trace_id",
        c("g_trace_sha256").alias("trace_sha256"),
        c("g_evaluation_id").alias("evaluation_id"),
        "review_sha256",
        "policy_status",
        "human_review_verified",
    )

    def body(df: DataFrame, key: str, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
        fields = [n for n in df.columns if n not in (key, *drop)]
        return df.select(key, F.struct(*fields).alias(name))

    rows = (
        allowed.join(body(article_12, "trace_id", "article_12"), "trace_id")
        .join(body(article_14, "request_id", "article_14", ("job_id", "trace_id")), "request_id")
        .join(body(article_15, "trace_id", "article_15"), "trace_id")
    )
    if standards is not None:
        # As many entries as the catalog has standards for the three articles.
        grounding = standards.groupBy(c("subject").alias("trace_id")).agg(
            F.array_sort(F.collect_list(F.struct("article", "standard_id", "score"))).alias("standards")
        )
        rows = rows.join(grounding, "trace_id", "left")
    else:
        rows = rows.withColumn(
            "standards", F.array().cast("array<struct<article:string,standard_id:string,score:double>>")
        )
    identified = rows.withColumn("pack_id", pack_id())
    document = canonical_json(
        article_12=c("article_12"),
        article_14=c("article_14"),
        article_15=c("article_15"),
        automated_compliance_stamp=F.lit(False),
        constitutional_rule=F.lit(rules.CONSTITUTIONAL_RULE),
        evaluation_id=c("evaluation_id"),
        human_review_verified=c("human_review_verified"),
        job_id=c("job_id"),
        limitations=F.array(*(F.lit(text) for text in LIMITATIONS)),
        pack_id=c("pack_id"),
        policy_status=c("policy_status"),
        review_sha256=c("review_sha256"),
        schema_version=F.lit(SCHEMA_VERSION),
        standards=c("standards"),
        trace_id=c("trace_id"),
        trace_sha256=c("trace_sha256"),
    )
    return identified.select("pack_id", "request_id", "job_id", "trace_id", document.alias("document")).select(
        "*", sha(c("document")).alias("sha256"), F.octet_length("document").alias("size")
    )


_MANIFEST = "pack_id string, job_id string, sha256 string, size int"
_STORED = _MANIFEST + ", document string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_packs(packs: DataFrame, path: str) -> DataFrame:
    """Append packs that the store at ``path`` does not have; returns the manifest (SNK-03).

    A pack id stands for one content, so a replay changes nothing. The store
    has two tables, ``packs`` and ``manifest`` without the documents; only the
    manifest is read to find what is new. Documents are written first: after a
    failure between both writes the next call writes them once more, and
    readers take equal copies as one.
    """
    spark = packs.sparkSession
    columns = ["pack_id", "job_id", "sha256", "size", "document"]
    known = _read(spark, f"{path}/manifest", _MANIFEST)
    new = packs.select(*columns).join(known.select("pack_id"), "pack_id", "left_anti")
    # Copies inside a batch are equal but for their documents' origin; the smallest digest stays.
    chosen = materialize(
        new.select(*columns[:-1]).groupBy("pack_id").agg(F.min(F.struct("sha256", "job_id", "size")).alias("first")).select("pack_id", "first.job_id", "first.sha256", "first.size")
    )
    documents = new.join(chosen, ["pack_id", "job_id", "sha256", "size"], "left_semi").dropDuplicates(["pack_id"])
    documents.write.mode("append").parquet(f"{path}/packs")
    chosen.write.mode("append").parquet(f"{path}/manifest")
    return _read(spark, f"{path}/manifest", _MANIFEST)


def verify_packs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Stored documents against digest and size of the manifest; bad JSON is reported."""
    actual = _read(spark, f"{path}/packs", _STORED).select(
        "pack_id",
        sha(F.col("document")).alias("stored_sha256"),
        F.octet_length("document").alias("stored_size"),
        F.try_parse_json("document").isNotNull().alias("valid_json"),
    )
    joined = manifest.join(actual, "pack_id", "left")
    ok = (F.col("sha256") == F.col("stored_sha256")) & (F.col("size") == F.col("stored_size")) & F.col("valid_json")
    # A pack that was stored twice is valid if all its copies are.
    return joined.groupBy("pack_id", "job_id").agg(F.min(F.coalesce(ok, F.lit(False))).alias("valid"))
