"""Reading the side tables: standards catalog, rate cards, reviews (SRC-07 to SRC-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions import variants as V
from spanledger.session import hold
from spanledger.functions.text import annex_number, article_number, feature_token

_CATALOG_SCHEMA = """
    catalog_id string, schema_version string, title string, constitutional_rule string,
    last_reviewed string,
    standards array<struct<
        standard_id: string, designation: string, title: string, issuing_body: string,
        technical_committee: string, edition: string, harmonization_status: string,
        official_journal_listing: boolean,
        articles: array<string>, annex_iv_sections: array<string>,
        characteristics: array<string>, limitations: array<string>,
        evidence_requirements: array<struct<
            evidence_id: string, article: string, description: string,
            characteristics: array<string>>>,
        source: struct<publisher: string, title: string, url: string,
            retrieved_on: string, verification_required: boolean>>>
"""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per standard with its catalog fields; ``ord`` is the catalog order."""
    documents = spark.read.schema(_CATALOG_SCHEMA).json(path, multiLine=True)
    return documents.select(
        "catalog_id", "last_reviewed", "constitutional_rule", F.posexplode("standards").alias("ord", "s")
    ).select("catalog_id", "last_reviewed", "constitutional_rule", "ord", "s.*")


def standards_tables(catalog: DataFrame) -> dict[str, DataFrame]:
    """Catalog rows as dimension tables with normalised keys."""
    article = F.concat(F.lit("Article "), article_number(F.col("article"), bare=True))
    section = annex_number(F.col("section"))
    standards = catalog.select(
        "standard_id",
        "ord",
        "designation",
        "title",
        "issuing_body",
        "edition",
        "harmonization_status",
        "official_journal_listing",
        F.size("articles").alias("article_count"),
        F.size("annex_iv_sections").alias("annex_count"),
        F.size("characteristics").alias("characteristic_count"),
    )
    requirements = catalog.select(
        "standard_id", "ord", F.posexplode("evidence_requirements").alias("req_ord", "r")
    )
    return {
        "standards": standards,
        "articles": catalog.select("standard_id", F.explode("articles").alias("article"))
        .select("standard_id", article.alias("article"))
        .distinct(),
        "annex": catalog.select("standard_id", F.explode("annex_iv_sections").alias("section"))
        .select("standard_id", F.concat(F.lit("annex-iv-"), section).alias("annex"))
        .distinct(),
        "characteristics": catalog.select("standard_id", F.explode("characteristics").alias("c"))
        .select("standard_id", feature_token(F.col("c")).alias("characteristic"))
        .distinct(),
        "requirements": requirements.select(
            "standard_id",
            "ord",
            "req_ord",
            F.col("r.evidence_id").alias("evidence_id"),
            F.col("r.article").alias("article"),
            F.col("r.description").alias("description"),
        ).withColumn("article", article),
        "evidence_characteristics": requirements.select(
            "standard_id", F.explode("r.characteristics").alias("c")
        )
        .select("standard_id", feature_token(F.col("c")).alias("characteristic"))
        .distinct(),
    }


def catalog_issues(catalog: DataFrame) -> DataFrame:
    """Catalog rule violations ``(standard_id, issue)``."""
    c = F.col

    def repeated(column: str, issue: str) -> DataFrame:
        keyed = catalog.select(c(column).alias("key"), c("standard_id").alias("named"))
        return (
            keyed.groupBy("key")
            .agg(F.count("*").alias("n"), F.min("named").alias("standard_id"))
            .filter("n > 1")
            .select("standard_id", F.lit(issue).alias("issue"))
        )

    date = r"^\d{4}-\d{2}-\d{2}$"
    empties = [
        F.when(F.coalesce(F.size(name), F.lit(0)) < 1, F.lit(f"{name} must not be empty"))
        for name in ("articles", "annex_iv_sections", "characteristics", "limitations", "evidence_requirements")
    ]
    outside = F.exists(
        "evidence_requirements", lambda r: ~F.array_contains(c("articles"), r["article"])
    )
    checks = F.array_compact(
        F.array(
            *empties,
            F.when(F.coalesce(outside, F.lit(False)), F.lit("requirement article is not listed by the standard")),
            F.when(
                c("official_journal_listing") & (c("harmonization_status") != "harmonised"),
                F.lit("listing requires harmonised status"),
            ),
            F.when(~F.coalesce(c("source.url").rlike("^https?://[^/]+"), F.lit(False)), F.lit("source url must be absolute")),
            F.when(
                ~F.coalesce(c("source.retrieved_on").rlike(date) & c("source.retrieved_on").try_cast("date").isNotNull(), F.lit(False)),
                F.lit("retrieval date must be an ISO date"),
            ),
            F.when(
                F.coalesce(c("constitutional_rule"), F.lit("")) != rules.CONSTITUTIONAL_RULE,
                F.lit("constitutional rule text differs"),
            ),
        )
    )
    own = catalog.select("standard_id", F.explode(checks).alias("issue"))
    requirement_ids = (
        catalog.select("standard_id", F.explode("evidence_requirements.evidence_id").alias("evidence_id"))
        .groupBy("evidence_id")
        .agg(F.count("*").alias("n"), F.min("standard_id").alias("standard_id"))
        .filter("n > 1")
        .select("standard_id", F.lit("duplicate requirement id").alias("issue"))
    )
    return (
        own.unionByName(repeated("standard_id", "duplicate standard id"))
        .unionByName(repeated("designation", "duplicate designation"))
        .unionByName(requirement_ids)
    )


def _values_of(entries: str, names: tuple[str, ...]) -> Column:
    """Texts of the entries whose folded key is one of the aliases, nulls left out."""
    keys = ", ".join(f"'{key}'" for key in dict.fromkeys(rules.squash(names)))
    return F.expr(
        f"transform(filter({entries}, e -> e.key in ({keys}) and not is_variant_null(e.value)), "
        f"e -> trim({V.sql_text('e.value')}))"
    )


def folded_entries(column: str) -> Column:
    """Object entries with keys reduced to ``[a-z0-9]``."""
    return F.expr(
        f"transform(map_entries({V.sql_map(column)}), e -> named_struct("
        "'key', regexp_replace(lower(e.key), '[^a-z0-9]', ''), 'value', e.value))"
    )


def _amount(text: Column) -> Column:
    """``€ 1.50`` or ``EUR 1.50`` to a decimal."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, "^€", "")), r"(?i)^EUR\s*", "")
    plain = F.when(F.trim(bare).rlike(r"^\+?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"), F.trim(bare))
    return plain.try_cast("decimal(38,18)")


def _rates_of(kind: str, per_million) -> Column:
    """Distinct rates per million tokens that the tagged entries give for one kind."""
    return F.array_distinct(F.transform(F.filter("tagged", lambda t: t["tag"][0] == kind), per_million))


def read_rate_cards(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rate_cards, rejects)`` from one ``card`` VARIANT per row.

    Rates per thousand or per token are turned into rates per million tokens;
    units that disagree, foreign currencies and bad numbers are rejected.
    """
    nested = V.sql_first("card", tuple(rules.PRICING_CONTAINERS) + ("priceCard", "rateCard"))
    # One lookup per entry says which rate and unit its key stands for.
    alias_of = {}
    for (kind, factor), names in rules.RATE_ALIASES.items():
        alias_of |= {key: f"{kind}|{factor}" for key in rules.squash(names)}
    alias_of |= {key: "model|0" for key in rules.squash(rules.MODEL_ALIASES)}
    alias_of |= {key: "currency|0" for key in rules.squash(rules.CURRENCY_ALIASES)}
    literal = ", ".join(f"'{key}', '{tag}'" for key, tag in alias_of.items())
    tagged = F.expr(
        "transform(filter(entries, e -> not is_variant_null(e.value)), e -> named_struct("
        f"'tag', split(try_element_at(map({literal}), e.key), '[|]'), 'txt', trim({V.sql_text('e.value')})))"
    )
    opened = cards.withColumn(
        "entries",
        F.concat(
            F.coalesce(folded_entries(nested), F.array().cast("array<struct<key:string,value:variant>>")),
            folded_entries("card"),
        ),
    ).withColumn("tagged", tagged)
    kinds = ("input", "output", "cached_input", "reasoning")

    def texts(name: str) -> Column:
        return F.transform(F.filter("tagged", lambda t: t["tag"][0] == name), lambda t: t["txt"])

    def per_million(t: Column) -> Column:
        return (_amount(t["txt"]) * t["tag"][1].cast("decimal(10,0)")).try_cast("decimal(30,12)")

    rated = opened.select(
        "card",
        texts("model").alias("models"),
        texts("currency").alias("currencies"),
        *(_rates_of(k, per_million).alias(f"{k}_rates") for k in kinds),
    )
    currency = F.upper(F.coalesce(F.get("currencies", F.lit(0)), F.lit("EUR")))
    limit = F.lit(rules.MAX_RATE).cast("decimal(30,12)")
    problems = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct("models")) > 1, F.lit("conflicting model names")),
            F.when(F.exists("models", lambda m: m == ""), F.lit("model name is empty")),
            F.when(~currency.isin("EUR", "€", "EURO"), F.lit("only EUR pricing is supported")),
            F.when(F.size("input_rates") == 0, F.lit("input rate is required")),
            F.when(F.size("output_rates") == 0, F.lit("output rate is required")),
            *(F.when(F.size(f"{k}_rates") > 1, F.lit(f"conflicting {k} rates")) for k in kinds),
            *(F.when(F.exists(f"{k}_rates", lambda r: r.isNull() | (r > limit)), F.lit(f"{k} rate is invalid")) for k in kinds),
        )
    )
    checked = hold(rated.withColumn("problems", problems))
    good = checked.filter(F.size("problems") == 0).select(
        F.coalesce(F.get("models", F.lit(0)), F.lit("unspecified")).alias("model"),
        *(F.get(f"{k}_rates", F.lit(0)).cast("decimal(25,12)").alias(f"{k}_rate") for k in kinds),
        F.lit("EUR").alias("currency"),
    )
    bad = checked.filter(F.size("problems") > 0).select(
        F.to_json("card").alias("card"), F.array_join("problems", "; ").alias("reason")
    )
    return good, bad


_IDENTIFIER = r"^[^\x00-\x1f\x7f]+$"
_KEY_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def read_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reviews, rejects)`` after the sign-off checks (VAL-10).

    Input columns: signoff_id, job_id, trace_id, trace_sha256, evaluation_id,
    actor, reviewer_id, reviewer_name, decision, attestation, signed_at (text
    with a zone), scope array<string>, metadata VARIANT, receipt_id,
    signing_key_id, signature.
    """
    c = F.col
    actor = F.replace(F.lower(F.trim("actor")), F.lit("_"), F.lit("-"))
    token = F.regexp_replace(F.regexp_replace(F.lower(F.trim("decision")), "[^a-z0-9]+", "-"), "^-|-$", "")
    decision = F.lit(None).cast("string")
    for value, words in rules.REVIEW_DECISIONS.items():
        decision = F.when(token.isin(*words), F.lit(value)).otherwise(decision)
    sha_text = F.regexp_replace(F.lower(F.trim("trace_sha256")), "^0x", "")
    signature = F.try_to_binary(F.translate("signature", "-_", "+/"), F.lit("base64"))
    scope = F.filter(F.transform("scope", lambda s: F.trim(s)), lambda s: s != "")
    staged = reviews.select(
        "*",
        F.when(actor.isin(*rules.HUMAN_ACTORS), "human").otherwise(actor).alias("n_actor"),
        decision.alias("n_decision"),
        sha_text.alias("n_sha"),
        scope.alias("n_scope"),
        F.octet_length(signature).alias("n_length"),
        c("signed_at").try_cast("timestamp").alias("n_signed_at"),
    )

    def blank(name: str) -> Column:
        value = F.trim(name)
        return c(name).isNull() | (value == "") | ~value.rlike(_IDENTIFIER)

    problems = F.array_compact(
        F.array(
            *(F.when(blank(n), F.lit(f"{n} is required")) for n in ("signoff_id", "job_id", "trace_id", "reviewer_id", "reviewer_name", "attestation")),
            F.when(F.length("attestation") > 8000, F.lit("attestation is too long")),
            F.when(~F.coalesce(c("n_sha").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("trace_sha256 is invalid")),
            F.when(F.coalesce(c("n_actor"), F.lit("")) != "human", F.lit("actor must be human")),
            F.when(c("n_decision").isNull(), F.lit("decision is invalid")),
            F.when(
                c("n_signed_at").isNull() | ~c("signed_at").rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"),
                F.lit("signed_at needs a zone"),
            ),
            F.when(F.coalesce(F.size("n_scope"), F.lit(0)) < 1, F.lit("scope must not be empty")),
            F.when(~F.coalesce(c("signing_key_id").rlike(_KEY_ID), F.lit(False)), F.lit("signing key id is invalid")),
            F.when(
                ~F.coalesce(c("signature").rlike("^[A-Za-z0-9_-]+={0,2}$"), F.lit(False)) | ~c("n_length").eqNullSafe(32),
                F.lit("signature must be a base64url SHA-256 HMAC"),
            ),
        )
    )
    checked = hold(staged.withColumn("problems", problems))
    plain = [name for name in reviews.columns if name not in ("actor", "decision", "trace_sha256", "scope", "signed_at")]
    good = checked.filter(F.size("problems") == 0).select(
        *plain,
        c("n_actor").alias("actor"),
        c("n_decision").alias("decision"),
        c("n_sha").alias("trace_sha256"),
        c("n_scope").alias("scope"),
        c("n_signed_at").alias("signed_at"),
    )
    bad = checked.filter(F.size("problems") > 0).select(
        "signoff_id", "job_id", F.array_join("problems", "; ").alias("reason")
    )
    return good, bad


def review_problem_counts(reviews: DataFrame) -> DataFrame:
    """How often each sign-off check fails."""
    _, bad = read_reviews(reviews)
    return (
        bad.select(F.explode(F.split("reason", "; ")).alias("problem")).groupBy("problem").agg(F.count("*").alias("reviews"))
    )
