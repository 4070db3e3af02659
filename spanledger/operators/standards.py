"""Standards lookup and matching (FLT-06 to FLT-10, STD-03 to STD-07, JN-06, SET-02 to SET-04)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions.text import (
    annex_number,
    article_number,
    designation,
    feature_token,
    looks_like_article,
)
from spanledger.operators.skew import lookup_join
from spanledger.operators.standard_masks import (
    CATALOG_STANDARDS,
    CATALOG_VALUES,
    Bits,
    bounded_rows,
    catalog_masks,
    common,
    is_feature,
    local_rows,
    subject_masks,
)
from spanledger.session import fits_broadcast, hold, materialize

Tables = dict[str, DataFrame]


def _join_dimension(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Facts to a catalog table: broadcast when measured as small, a lookup join beyond."""
    if fits_broadcast(dimension):
        return facts.join(F.broadcast(dimension), on, how)
    return lookup_join(facts, dimension, on, how)


# --- lookups -----------------------------------------------------------------


def link_standards_by_id(refs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``(linked, unknown)`` for ``refs.reference``: an id or a designation in any spelling."""
    keys = tables["standards"].select(
        "standard_id",
        F.explode(
            F.array_distinct(
                F.array(F.col("standard_id"), feature_token(designation(F.col("designation"))))
            )
        ).alias("key"),
    ).distinct()
    keyed = refs.withColumn("key", feature_token(designation(F.col("reference"))))
    linked = _join_dimension(keyed, keys, ["key"], "left")
    return linked.filter("standard_id is not null").drop("key"), linked.filter("standard_id is null").drop("key", "standard_id")


def link_standards_by_article(refs: DataFrame, tables: Tables) -> DataFrame:
    """Every standard that covers the article named in ``refs.article``."""
    named = refs.withColumn(
        "article", F.concat(F.lit("Article "), article_number(F.col("article"), bare=True))
    ).filter("article is not null")
    # Distinct rows on both sides make distinct links; these are many more than the references.
    return _join_dimension(named.distinct(), tables["articles"].distinct(), ["article"])


def link_standards_by_annex(refs: DataFrame, tables: Tables) -> DataFrame:
    """Every standard that covers the Annex IV section named in ``refs.section``."""
    named = refs.withColumn("annex", F.concat(F.lit("annex-iv-"), annex_number(F.col("section")))).filter("annex is not null")
    return _join_dimension(named.distinct(), tables["annex"].distinct(), ["annex"])


def link_standards_by_characteristic(refs: DataFrame, tables: Tables) -> DataFrame:
    """Every standard with a characteristic that contains ``refs.characteristic``.

    The substrings of each characteristic are listed once, which turns the
    containment test into an equi join. The list grows with the catalog, not
    with the references.
    """
    text = F.col("characteristic")
    starts = F.sequence(F.lit(1), F.length(text))
    parts = F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.length(text) - s + 1), lambda n: F.substring(text, s, n)
            ),
        )
    )
    substrings = (
        tables["characteristics"]
        .filter(F.length(text) > 0)
        .select("standard_id", F.explode(F.array_distinct(parts)).alias("needle"))
        .distinct()
    )
    needles = refs.distinct().withColumn("needle", feature_token(F.col("characteristic"))).filter("needle <> ''")
    return _join_dimension(needles, substrings, ["needle"]).drop("needle")


def requirements_per_trace(refs: DataFrame, tables: Tables) -> DataFrame:
    """Number of evidence requirements owed per subject through its articles."""
    named = (
        refs.select("subject", F.concat(F.lit("Article "), article_number(F.col("article"), bare=True)).alias("article"))
        .filter("article is not null")
        .distinct()
    )
    owed = tables["requirements"].groupBy("article").agg(F.count("*").alias("requirements"))
    return _join_dimension(named, owed, ["article"]).groupBy("subject").agg(F.sum("requirements").alias("requirements"))


# --- features ----------------------------------------------------------------


def feature_tokens(leaves: DataFrame) -> DataFrame:
    """Distinct ``(subject, token)`` of leaf rows, see :func:`feature_token_rows`."""
    return feature_token_rows(leaves).distinct()


def feature_token_rows(leaves: DataFrame) -> DataFrame:
    """``(subject, token)`` of leaf rows ``(subject, last_key, kind, text)``, as often as they occur.

    All matching below takes tokens that repeat, so they need not be made distinct for it.

    ``last_key`` is the raw key of the leaf. String leaves give their text;
    a key whose value is true gives the key, unless it is structural; article
    references give three spellings.
    """
    c = F.col
    # Each stage is held, or its regular expressions would run again wherever a column is used.
    staged = hold(leaves.select("subject", "last_key", "kind", "text", feature_token(F.coalesce(c("last_key"), F.lit(""))).alias("key_token")))
    is_article_key = c("key_token").isin("article", "articles")
    truthy = (c("kind") == "boolean") & (c("text") == "true") & ~c("key_token").isin(*rules.STRUCTURAL_FEATURE_KEYS)
    source = (
        F.when(c("kind") == "string", c("text"))
        .when(truthy, c("last_key"))
        .when((c("kind") == "number") & is_article_key, c("text"))
    )
    staged = hold(staged.select("subject", "key_token", source.alias("source_text"))).filter("source_text is not null and trim(source_text) <> ''")
    # Every spelling of an article holds these letters, which are found faster.
    spelled = F.lower("source_text").contains("art") & looks_like_article(F.trim("source_text"))
    found = F.when(is_article_key | spelled, article_number(c("source_text"), bare=True)).cast("string")
    staged = hold(staged.select("subject", "key_token", "source_text", found.alias("number")))
    number = c("number")
    tokens = F.when(
        number.isNotNull(),
        F.array(F.concat(F.lit("Article "), number), number, F.concat(F.lit("article-"), number)),
    ).otherwise(F.array(feature_token(c("source_text"))))
    annex = F.when(
        F.lower("source_text").contains("annex"),
        F.concat(F.lit("annex-iv-"), annex_number(c("source_text"))),
    )
    keyed_annex = F.when(
        c("key_token").startswith("annex") & F.trim("source_text").rlike(r"^\d{1,9}$"),
        F.concat(F.lit("annex-iv-"), F.trim("source_text").try_cast("int")),
    )
    all_tokens = F.array_compact(F.concat(tokens, F.array(annex, keyed_annex)))
    return staged.select("subject", F.explode(all_tokens).alias("token")).filter("token <> ''")


def subject_inputs(tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature tokens, article references and annex references per subject."""
    token = F.col("token")
    articles = tokens.filter(token.rlike("^[0-9]+$")).select("subject", F.concat(F.lit("Article "), token).alias("article")).distinct()
    annex = tokens.filter(token.startswith("annex-iv-")).select("subject", F.col("token").alias("annex")).distinct()
    features = tokens.filter(is_feature(token))
    return features, articles, annex


def _words(phrase: Column, stop: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(F.split(phrase, "-"), lambda w: (w != "") & ~w.isin(*stop)))


def _phrase_matches(features: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct ``(subject, phrase)``: exact token, or at least half of the phrase's words.

    Word-exploded equi join; a subject and a phrase meet only through a shared
    word, so no pair is formed that shares nothing.
    """
    distinct_phrases = phrases.select(F.col("characteristic").alias("phrase")).filter("phrase <> ''").distinct()
    exact = _join_dimension(
        features.select("subject", F.col("token").alias("phrase")), distinct_phrases, ["phrase"]
    ).select("subject", "phrase")
    subject_words = (
        features.select("subject", F.explode(_words(F.col("token"), rules.FEATURE_STOP_WORDS)).alias("word")).distinct()
    )
    phrase_words = distinct_phrases.withColumn("words", _words(F.col("phrase"), rules.PHRASE_STOP_WORDS)).select(
        "phrase", F.size("words").alias("size"), F.explode("words").alias("word")
    )
    overlap = (
        _join_dimension(subject_words, phrase_words, ["word"])
        .groupBy("subject", "phrase", "size")
        .agg(F.count("*").alias("shared"))
        .filter(F.col("shared") * 2 >= F.col("size"))
    )
    return exact.union(overlap.select("subject", "phrase")).distinct()


def _parts(inputs: tuple[DataFrame, DataFrame, DataFrame], tables: Tables) -> DataFrame:
    features, articles, annex = inputs
    phrases = tables["characteristics"].union(tables["evidence_characteristics"])
    matched = _phrase_matches(features, phrases)

    def hits(table: str, on: str, facts: DataFrame, name: str) -> DataFrame:
        # Matched characteristics become one row each; counts follow later.
        dimension = tables[table].withColumnRenamed("characteristic", "phrase") if on == "phrase" else tables[table]
        return _join_dimension(facts, dimension, [on]).select("subject", "standard_id", F.lit(name).alias("part"), F.col(on).alias("value"))

    return (
        hits("characteristics", "phrase", matched, "characteristic")
        .unionAll(hits("evidence_characteristics", "phrase", matched, "evidence"))
        .unionAll(hits("articles", "article", articles, "article"))
        .unionAll(hits("annex", "annex", annex, "annex"))
    )


#: Tables of a standard's parts, and how the numbers of matches are called.
_PARTS = ("characteristics", "evidence_characteristics", "articles", "annex")
_MATCHED = ("matched_characteristics", "matched_evidences", "matched_articles", "matched_annexs")


def matched_parts(tokens: DataFrame, tables: Tables) -> DataFrame:
    """What of a standard a subject matches: distinct ``(subject, standard_id, part, value)`` (SET-04).

    ``part`` is characteristic, evidence, article or annex. The matched features
    of a standard are the distinct values of all four.
    """
    return _parts(subject_inputs(materialize(tokens)), tables).distinct()


def matched_value_lists(tokens: DataFrame, tables: Tables) -> DataFrame:
    """:func:`matched_parts` as one sorted array of distinct values: ``(subject, standard_id, values)``."""
    catalog = catalog_masks(tables, None)
    if catalog is None:
        return matched_parts(tokens, tables).groupBy("subject", "standard_id").agg(F.array_sort(F.collect_set("value")).alias("values"))
    pairs = catalog.pairs(catalog.subjects(tokens), catalog.lists(tokens.sparkSession, _PARTS).drop("all", "values", "whole"), _PARTS)
    # A phrase may be spelled as an article or a section is.
    several = set(catalog.phrases.places) & {*catalog.articles.places, *catalog.annex.places}
    values = F.array_distinct("values") if several else F.col("values")
    return catalog.with_shared_values(pairs, _PARTS).select("subject", "standard_id", values.alias("values"))


def _supplied(features: DataFrame, articles: DataFrame, annex: DataFrame) -> DataFrame:
    """Which weights apply depends on what a subject supplied at all."""
    return (
        features.select("subject", F.lit(1).alias("f"), F.lit(0).alias("a"), F.lit(0).alias("x"))
        .unionAll(articles.select("subject", F.lit(0), F.lit(1), F.lit(0)))
        .unionAll(annex.select("subject", F.lit(0), F.lit(0), F.lit(1)))
        .groupBy("subject")
        .agg(F.max("f").alias("has_features"), F.max("a").alias("has_articles"), F.max("x").alias("has_annex"))
    )


def _sizes(tables: Tables) -> DataFrame:
    evidence = tables["evidence_characteristics"].groupBy("standard_id").agg(F.count("*").alias("evidence_count"))
    return tables["standards"].join(evidence, "standard_id", "left").select(
        "standard_id",
        "ord",
        "characteristic_count",
        "article_count",
        "annex_count",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
    )


def _weighted(characteristic: Column, evidence: Column, article: Column, annex: Column, of: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """Weighted sum of the ratios that apply, and the sum of their weights; ``of`` gives a field of the standard."""
    c = F.col
    zero = F.lit(0.0)
    by_feature = (c("has_features") == 1) & (of("characteristic_count") > 0)
    by_article = (c("has_articles") == 1) & (of("article_count") > 0)
    by_annex = (c("has_annex") == 1) & (of("annex_count") > 0)
    total = (
        F.when(by_feature, F.lit(0.70) * characteristic + F.lit(0.15) * evidence).otherwise(zero)
        + F.when(by_article, F.lit(0.25) * article).otherwise(zero)
        + F.when(by_annex, F.lit(0.15) * annex).otherwise(zero)
    )
    weight = (
        F.when(by_feature, F.lit(0.85)).otherwise(zero)
        + F.when(by_article, F.lit(0.25)).otherwise(zero)
        + F.when(by_annex, F.lit(0.15)).otherwise(zero)
    )
    return total, weight


def _score(characteristics: Column, evidences: Column, articles: Column, annexs: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Score from the numbers of matched parts."""
    characteristic = characteristics / of("characteristic_count")
    evidence = F.when(of("evidence_count") > 0, evidences / of("evidence_count")).otherwise(characteristic)
    total, weight = _weighted(characteristic, evidence, articles / of("article_count"), annexs / of("annex_count"), of)
    return F.round(F.when(weight > 0, total / weight).otherwise(F.lit(0.0)), 6)


def _scored(counts: DataFrame, minimum: float) -> DataFrame:
    """Scores from the numbers of matched parts, above ``minimum``."""
    c = F.col
    scored = counts.withColumn("score", _score(c("matched_characteristics"), c("matched_evidences"), c("matched_articles"), c("matched_annexs")))
    return scored.filter(c("score") > minimum).select(
        "subject",
        "standard_id",
        "ord",
        "score",
        "matched_characteristics",
        (c("characteristic_count") - c("matched_characteristics")).alias("missing_characteristics"),
        c("matched_evidences").alias("matched_evidence_characteristics"),
        "matched_articles",
        c("matched_annexs").alias("matched_annex_sections"),
    )


def match_standards(tokens: DataFrame, tables: Tables, minimum_score: float = 0.0) -> DataFrame:
    """Score of every standard that shares something with a subject (STD-04).

    Every pair that shares something is counted; where pairs are many and few
    reach the minimum, :func:`bounded_matches` builds fewer. With a catalog of
    bounded size a pair is counted in its row; beyond, the tokens are read by
    several branches, so they are written once.
    """
    catalog = catalog_masks(tables, _sizes(tables))
    if catalog is not None:
        subjects = catalog.subjects(tokens).filter("subject is not null")
        pairs = catalog.pairs(subjects, catalog.standards(tokens.sparkSession), _PARTS)
        return _scored(pairs.withColumns({name: catalog.matched(part) for name, part in zip(_MATCHED, _PARTS, strict=True)}), minimum_score)
    tokens = materialize(tokens)
    features, articles, annex = subject_inputs(tokens)
    parts = _parts((features, articles, annex), tables)
    counts = parts.groupBy("subject", "standard_id").agg(
        *(
            F.count_if(F.col("part") == part).alias(f"matched_{part}s")
            for part in ("characteristic", "evidence", "article", "annex")
        )
    )
    full = _join_dimension(counts.join(_supplied(features, articles, annex), "subject"), _sizes(tables), ["standard_id"])
    return _scored(full, minimum_score)


def _least_matches(minimum: float) -> Column:
    """Characteristics that a subject must match at least to score above ``minimum``.

    The other parts are taken to match in full. A little less than the exact
    bound, because the score is rounded; 0 where the minimum can be reached
    without any.
    """
    c = F.col
    total, weight = _weighted(F.lit(0.0), F.when(c("evidence_count") > 0, 1.0).otherwise(0.0), F.lit(1.0), F.lit(1.0))
    slope = F.when(c("evidence_count") > 0, 0.70).otherwise(0.85)
    by_feature = (c("has_features") == 1) & (c("characteristic_count") > 0)
    least = F.ceil(c("characteristic_count") * ((F.lit(minimum) - 2e-6) * weight - total) / slope - 1e-6)
    return F.when(by_feature, F.greatest(least, F.lit(0))).otherwise(F.lit(0)).cast("int")


def built_pairs(tokens: DataFrame, tables: Tables, minimum: float, share: float = 0.5) -> DataFrame:
    """``(subject, standard_id)`` that :func:`bounded_matches` builds for ``minimum``."""
    features, articles, annex = subject_inputs(tokens)
    matched = materialize(_phrase_matches(features, _phrases(tables)))
    return _built(matched, materialize(_supplied(features, articles, annex)), (features, articles, annex), tables, minimum, share)


def _phrases(tables: Tables) -> DataFrame:
    return tables["characteristics"].union(tables["evidence_characteristics"])


def _built(matched: DataFrame, supplied: DataFrame, inputs: tuple[DataFrame, DataFrame, DataFrame], tables: Tables, minimum: float, share: float) -> DataFrame:
    c = F.col
    sizes = _sizes(tables)

    # Bounds for each standard and each kind of subjects, of which there are eight at most.
    kind = ["has_features", "has_articles", "has_annex"]
    present = supplied.select(*kind).distinct().collect()
    if not present:
        return matched.select("subject", F.lit(None).cast("string").alias("standard_id")).limit(0)
    kinds = F.array(*(F.struct(*(F.lit(row[name]).alias(name) for name in kind)) for row in present))
    bounds = sizes.withColumn("kind", F.explode(kinds)).select("*", "kind.*").withColumn("least", _least_matches(minimum))
    bounds = materialize(bounds.withColumn("met", F.greatest(F.lit(1), F.ceil(c("least") * share)).cast("int")).drop("kind"))
    often = matched.groupBy("phrase").agg(F.count("*").alias("subjects"))
    rarest = Window.partitionBy("standard_id").orderBy(F.coalesce("subjects", F.lit(0)), "phrase")
    listed = tables["characteristics"].withColumnRenamed("characteristic", "phrase").join(often, "phrase", "left")
    prefixes = materialize(
        listed.withColumn("place", F.row_number().over(rarest))
        .join(bounds.filter("least > 0"), "standard_id")
        .filter(c("place") <= c("characteristic_count") - c("least") + c("met"))
        .select("phrase", "standard_id", *kind, "met")
    )
    subjects = matched.join(supplied, "subject")
    built = (
        _join_dimension(subjects, prefixes, ["phrase", *kind])
        .groupBy("subject", "standard_id", "met")
        .agg(F.count("*").alias("n"))
        .filter("n >= met")
        .select("subject", "standard_id")
    )
    # Where no characteristic is needed, whatever part matches makes the pair.
    free = bounds.filter("least = 0").select("standard_id", *kind)
    if free.isEmpty():
        return built
    _, articles, annex = inputs
    found = []
    for table, column, on, facts in (
        ("characteristics", "characteristic", "phrase", subjects),
        ("evidence_characteristics", "characteristic", "phrase", subjects),
        ("articles", "article", "article", articles.join(supplied, "subject")),
        ("annex", "annex", "annex", annex.join(supplied, "subject")),
    ):
        lists = tables[table].withColumnRenamed(column, on).join(free, "standard_id")
        found.append(_join_dimension(facts, lists, [on, *kind]).select("subject", "standard_id"))
    return built.unionAll(found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3]).distinct())


def bounded_matches(tokens: DataFrame, tables: Tables, minimum: float, share: float = 0.5) -> DataFrame:
    """:func:`match_standards` above ``minimum`` without the pairs that cannot reach it.

    A standard's characteristics stand in order of how many subjects match
    them, the rarest first. A subject that needs t of n characteristics misses
    at most n - t, so of the first n - t + l it matches l at least. Only these
    prefixes are joined, and only pairs with l matches there are built (l is
    ``share`` of t). Their scores come from the subject's matched phrases, one
    set a subject, and the standard's parts. Pairs that can reach the minimum
    without any characteristic are found by their other parts.
    """
    features, articles, annex = subject_inputs(tokens)
    supplied = materialize(_supplied(features, articles, annex))
    matched = materialize(_phrase_matches(features, _phrases(tables)))
    built = _built(matched, supplied, (features, articles, annex), tables, minimum, share)

    def gathered(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.collect_set(value).alias(name))

    # A subject's sets hold no more than the catalog has phrases, articles and sections.
    own = (
        supplied.join(gathered(matched, "subject", "phrase", "own_phrases"), "subject", "left")
        .join(gathered(_join_dimension(articles, tables["articles"].select("article").distinct(), ["article"]), "subject", "article", "own_articles"), "subject", "left")
        .join(gathered(_join_dimension(annex, tables["annex"].select("annex").distinct(), ["annex"]), "subject", "annex", "own_annex"), "subject", "left")
    )
    parts = _sizes(tables)
    for name, value in (("characteristics", "characteristic"), ("evidence_characteristics", "characteristic"), ("articles", "article"), ("annex", "annex")):
        parts = parts.join(gathered(tables[name], "standard_id", value, f"all_{name}"), "standard_id", "left")
    pairs = _join_dimension(built.join(own, "subject"), materialize(parts), ["standard_id"])

    def common(one: str, other: str) -> Column:
        return F.coalesce(F.size(F.array_intersect(one, other)), F.lit(0)).cast("bigint")

    counts = pairs.withColumns(
        {
            "matched_characteristics": common("own_phrases", "all_characteristics"),
            "matched_evidences": common("own_phrases", "all_evidence_characteristics"),
            "matched_articles": common("own_articles", "all_articles"),
            "matched_annexs": common("own_annex", "all_annex"),
        }
    )
    return _scored(counts, minimum)


def matched_characteristics(tokens: DataFrame, tables: Tables) -> DataFrame:
    """``(subject, standard_id, characteristic, matched)`` for standards with at least one match."""
    features, _, _ = subject_inputs(tokens)
    matched = _phrase_matches(features, tables["characteristics"]).withColumnRenamed("phrase", "characteristic")
    hit = _join_dimension(matched, tables["characteristics"], ["characteristic"]).withColumn("matched", F.lit(True))
    wanted = _join_dimension(hit.select("subject", "standard_id").distinct(), tables["characteristics"], ["standard_id"])
    return wanted.join(hit, ["subject", "standard_id", "characteristic"], "left").na.fill(False, ["matched"])


def characteristic_lists(tokens: DataFrame, tables: Tables) -> DataFrame:
    """:func:`matched_characteristics` as sorted arrays: ``(subject, standard_id, characteristics, matched, missing)``.

    Rows without a subject are paired but match nothing, as equality with null has it.
    """
    c = F.col
    part = ("characteristics",)
    catalog = catalog_masks({name: tables[name] for name in part}, None)
    if catalog is None:

        def listed(condition: Column) -> Column:
            return F.array_sort(F.collect_list(F.when(condition, c("characteristic"))))

        return matched_characteristics(tokens, tables).groupBy("subject", "standard_id").agg(
            F.count("*").alias("characteristics"), listed(c("matched")).alias("matched"), listed(~c("matched")).alias("missing")
        )
    lists = catalog.lists(tokens.sparkSession, part).filter("standard_id is not null")
    pairs = catalog.pairs(catalog.subject_lists(tokens, part), lists, part)

    def those(condition: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("values", condition), lambda v: v["value"])

    every, none = catalog.all_held(part), F.array().cast("array<string>")
    there = c("subject").isNotNull()
    matched = F.when(there & every, c("all")).when(there, those(catalog.holds)).otherwise(none)
    missing = F.when(there & every, none).when(there, those(lambda v: ~catalog.holds(v))).otherwise(c("all"))
    return pairs.select("subject", "standard_id", F.size("all").cast("long").alias("characteristics"), matched.alias("matched"), missing.alias("missing"))


def top_standards(matches: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` standards per subject: score descending, then catalog order."""
    order = Window.partitionBy("subject").orderBy(F.desc("score"), "ord")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Thresholds that :func:`best_standards` tries in turn.
THRESHOLDS = (0.8, 0.5)


def best_standards(tokens: DataFrame, tables: Tables, k: int = 3, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Best ``k`` standards per subject (STD-05) without scoring the low ones.

    A threshold algorithm: a subject with ``k`` standards above a threshold is
    done, for all others score less. Each threshold is tried on the subjects
    that are left, by :func:`bounded_matches`; the last ones are matched in full.
    With a catalog of bounded size all standards are ranked in the subject's row.
    """
    catalog = catalog_masks(tables, _sizes(tables))
    if catalog is not None:
        standards = catalog.standards(tokens.sparkSession)
        listed = standards.agg(F.collect_list(F.struct(*standards.columns)).alias("all"))

        def ranked_by(s: Column) -> Column:
            n = [catalog.matched(part, s.getField) for part in _PARTS]
            return F.struct(
                (-_score(*n, s.getField)).alias("score"),
                s["ord"].alias("ord"),
                s["standard_id"].alias("standard_id"),
                n[0].alias("matched_characteristics"),
                (s["characteristic_count"] - n[0]).alias("missing_characteristics"),
                n[1].alias("matched_evidence_characteristics"),
                n[2].alias("matched_articles"),
                n[3].alias("matched_annex_sections"),
            )

        rows = catalog.subjects(tokens).filter("subject is not null").crossJoin(F.broadcast(listed))
        order = F.array_sort(F.filter(F.transform("all", ranked_by), lambda r: r["score"] < 0))
        best = rows.select("subject", F.posexplode(F.slice(order, 1, k)).alias("place", "s"))
        return best.select(
            "subject",
            "s.standard_id",
            "s.ord",
            (-F.col("s.score")).alias("score"),
            "s.matched_characteristics",
            "s.missing_characteristics",
            "s.matched_evidence_characteristics",
            "s.matched_articles",
            "s.matched_annex_sections",
            (F.col("place") + 1).alias("rank"),
        )
    left, found = materialize(tokens), None
    for minimum in (*thresholds, 0.0):
        matches = bounded_matches(left, tables, minimum) if minimum else match_standards(left, tables)
        ranked = materialize(top_standards(matches, k))
        done = ranked.groupBy("subject").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("subject")
        kept = ranked.join(done, "subject", "left_semi") if minimum else ranked
        found = kept if found is None else found.unionByName(kept)
        left = materialize(left.join(done, "subject", "left_anti")) if minimum else left
    return found


# --- pack-time scores --------------------------------------------------------


def _article_pairs(tables: Tables) -> DataFrame:
    """``(article, standard_id, characteristic, given)`` of the standards of Articles 12, 14 and 15."""
    spark = tables["articles"].sparkSession
    c = F.col
    own = spark.createDataFrame(
        [(a, f) for a, names in rules.ARTICLE_FEATURES.items() for f in names], "article string, feature string"
    ).select("article", feature_token(c("feature")).alias("characteristic"))
    covered = tables["articles"].join(F.broadcast(own.select("article").distinct()), "article", "left_semi")
    # As many rows as there are fixed features of the three articles.
    return covered.join(tables["characteristics"], "standard_id").join(
        F.broadcast(own.withColumn("given", F.lit(1))), ["article", "characteristic"], "left"
    )


def _article_score(matched: Column, size: Column) -> Column:
    score = F.least(
        F.lit(1.0),
        F.lit(0.35) + F.lit(0.55) * matched / F.greatest(F.lit(1), size) + F.when(matched > 0, 0.10).otherwise(0.0),
    )
    return F.round(score, 6)


def article_base(tables: Tables) -> DataFrame:
    """Catalog side of the pack-time rule: what every subject gets, ``(article, standard_id, ord, given, size, score)``.

    A subject has these standards with the score of ``given`` matches out of
    ``size``, where :func:`article_standard_scores` does not give it a higher
    one; they are not repeated per subject.
    """
    base = _article_pairs(tables).groupBy("article", "standard_id").agg(
        F.sum(F.coalesce("given", F.lit(0))).alias("given"), F.count("*").alias("size")
    )
    return base.join(tables["standards"].select("standard_id", "ord"), "standard_id").withColumn(
        "score", _article_score(F.col("given"), F.col("size"))
    )


def _article_rows(tokens: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, Callable[[Callable[[str], Column]], Column]] | None:
    """Subjects and article standards with masks, and what counts the own matches of a pair; None beyond the bounds."""
    c = F.col
    extra = bounded_rows(_article_pairs(tables).filter("given is null").select("article", "standard_id", "characteristic"))
    base = bounded_rows(article_base(tables).drop("score"), CATALOG_STANDARDS)
    if extra is None or base is None:
        return None
    own: dict[tuple[str, str], set[str]] = {}
    for article, standard, characteristic in extra:
        if characteristic:
            own.setdefault((article, standard), set()).add(characteristic)
    bits = Bits("p", (v for values in own.values() for v in values))
    if len(bits.places) > CATALOG_VALUES:
        return None
    rows = [(r["article"], r["standard_id"], r["ord"], r["given"], r["size"], *bits.masks(own.get((r["article"], r["standard_id"]), ()))) for r in base]
    names = [f"c_{n}" for n in range(len(bits.columns))]
    schema = ", ".join(["article string, standard_id string, ord int, given long, size long", *(f"{name} long" for name in names)])
    subjects = subject_masks(tokens, [], [(bits, str)])

    def own_of(of: Callable[[str], Column]) -> Column:
        # Equality with null never holds, so rows without a subject match nothing.
        return F.when(c("subject").isNotNull(), common([c(name) for name in bits.columns], [of(name) for name in names])).otherwise(0)

    return subjects, local_rows(tokens.sparkSession, rows, schema), own_of


def article_standard_scores(tokens: DataFrame, tables: Tables) -> DataFrame:
    """Pack-time rule (STD-06): every standard of an article that a subject's own tokens match.

    ``(subject, article, standard_id, ord, own_features, matched_features, score)``,
    without a limit. Together with :func:`article_base`, which has the score of
    all other standards, the scores of a subject are complete.
    """
    c = F.col
    rows = _article_rows(tokens, tables)
    if rows is not None:
        subjects, listed, own_of = rows
        pairs = subjects.crossJoin(F.broadcast(listed)).withColumn("own", own_of(c)).filter("own > 0")
        return pairs.select(
            "subject",
            "article",
            "standard_id",
            "ord",
            c("own").alias("own_features"),
            (c("given") + c("own")).alias("matched_features"),
            _article_score(c("given") + c("own"), c("size")).alias("score"),
        )
    pairs, base = _article_pairs(tables), article_base(tables).drop("score")
    extra = pairs.filter("given is null").select("article", "standard_id", "characteristic")
    hits = (
        _join_dimension(tokens.select("subject", c("token").alias("characteristic")).distinct(), extra, ["characteristic"])
        .groupBy("subject", "article", "standard_id")
        .agg(F.count("*").alias("own"))
    )
    joined = _join_dimension(hits, base, ["article", "standard_id"])
    matched = c("given") + c("own")
    return joined.select(
        "subject",
        "article",
        "standard_id",
        "ord",
        c("own").alias("own_features"),
        matched.alias("matched_features"),
        _article_score(matched, c("size")).alias("score"),
    )


def top_article_standards(tokens: DataFrame, tables: Tables, k: int = 3) -> DataFrame:
    """Best ``k`` standards of each article for every subject: score descending, then catalog order.

    An own match never lowers a score, so no standard beyond the ``k`` best of
    :func:`article_base` gets among the best of a subject without own matches.
    Only those ``k`` are merged with a subject's own scores. With a catalog of
    bounded size the standards of an article are ranked in the subject's row.
    """
    rows = _article_rows(tokens, tables)
    if rows is not None:
        subjects, listed, own_of = rows
        by_article = listed.groupBy("article").agg(F.collect_list(F.struct(*listed.columns[1:])).alias("all"))

        def ranked_by(s: Column) -> Column:
            own = own_of(s.getField)
            matched = s["given"] + own
            score = _article_score(matched, s["size"])
            return F.struct((-score).alias("score"), s["ord"].alias("ord"), s["standard_id"].alias("standard_id"), own.alias("own"), matched.alias("matched"))

        best = F.slice(F.array_sort(F.transform("all", ranked_by)), 1, k)
        return subjects.crossJoin(F.broadcast(by_article)).select("subject", "article", F.posexplode(best).alias("place", "s")).select(
            "subject",
            "article",
            "s.standard_id",
            "s.ord",
            F.col("s.own").alias("own_features"),
            F.col("s.matched").alias("matched_features"),
            (-F.col("s.score")).alias("score"),
            (F.col("place") + 1).alias("rank"),
        )
    tokens = materialize(tokens)
    order = [F.desc("score"), F.col("ord")]
    best = (
        article_base(tables)
        .withColumn("n", F.row_number().over(Window.partitionBy("article").orderBy(*order)))
        .filter(F.col("n") <= k)
        .select("article", "standard_id", "ord", F.lit(0).cast("long").alias("own_features"), F.col("given").cast("long").alias("matched_features"), "score")
    )
    # At most k rows for each of the articles.
    base = tokens.select("subject").distinct().crossJoin(F.broadcast(best))
    merged = (
        article_standard_scores(tokens, tables)
        .unionByName(base)
        .groupBy("subject", "article", "standard_id", "ord")
        .agg(*(F.max(name).alias(name) for name in ("own_features", "matched_features", "score")))
    )
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("subject", "article").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def annex_checklist(tables: Tables) -> DataFrame:
    """Requirements per article; the first standard wins (STD-07).

    All standards of an article apply to every subject, so the checklist is one
    table for all of them.
    """
    requirements = tables["requirements"].filter("evidence_id is not null")
    order = Window.partitionBy("article", "evidence_id").orderBy("ord", "req_ord")
    return (
        requirements.join(tables["articles"], ["standard_id", "article"], "left_semi")
        .withColumn("n", F.row_number().over(order))
        .filter("n = 1")
        .select("standard_id", "article", "evidence_id", "description", F.lit("mapped-engineering-reference").alias("status"))
    )
