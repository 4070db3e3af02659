"""Matching by masks gives the rows of the joins and shuffles no pairs."""

import random

import pytest
from pyspark.sql import functions as F

from spanledger.operators import standards
from tests.test_standards import random_catalog


@pytest.fixture(params=[3])
def case(spark, request):
    tokens, known = random_catalog(spark, random.Random(request.param))
    # Repeated tokens, a null, phrases that are no features, a phrase spelled as a section.
    tokens = tokens.unionAll(tokens.limit(20)).unionAll(spark.createDataFrame([(1, None), (2, "annex-iv-9"), (None, "w1-w2")], "subject int, token string"))
    odd = spark.createDataFrame([("s1", "annex-iv-2"), ("s2", "12"), ("s3", ""), ("s4", None)], "standard_id string, characteristic string")
    count = F.col("characteristic_count") + F.when(F.col("standard_id").isin("s1", "s2", "s3", "s4"), 1).otherwise(0)
    return tokens, known | {"characteristics": known["characteristics"].unionAll(odd), "standards": known["standards"].withColumn("characteristic_count", count)}


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["match_standards", "best_standards", "matched_value_lists", "characteristic_lists"])
def test_masks_equal_the_joins(case, monkeypatch, name):
    tokens, known = case
    by_masks = getattr(standards, name)(tokens, known)
    monkeypatch.setattr(standards, "catalog_masks", lambda *_: None)
    by_joins = getattr(standards, name)(tokens, known)
    assert dict(by_masks.dtypes) == dict(by_joins.dtypes)
    if name == "characteristic_lists":
        by_masks, by_joins = (df.withColumns({k: F.array_compact(k) for k in ("matched", "missing")}) for df in (by_masks, by_joins))
    assert rows(by_masks) == rows(by_joins) and by_joins.count() > 20


@pytest.mark.parametrize("name", ["match_standards", "best_standards", "matched_value_lists", "characteristic_lists"])
def test_only_subjects_are_shuffled(case, name):
    """One shuffle, by subject: none of phrases or pairs."""
    plan = getattr(standards, name)(*case)._jdf.queryExecution().sparkPlan().toString()
    final = getattr(standards, name)(*case)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert final.count("Exchange hashpartitioning(subject#") == final.count("Exchange hashpartitioning(") == 1


def test_article_scores_by_masks_equal_the_joins(spark, monkeypatch):
    tokens = spark.createDataFrame([(1, "a-b"), (1, "a-b"), (1, "c"), (2, "x"), (3, "c"), (3, "12")], "subject int, token string")
    listed = [("s1", "a-b"), ("s1", "c"), ("s2", "c"), ("s2", "z"), ("s3", "12")]
    tables = {
        "standards": spark.createDataFrame([("s1", 2), ("s2", 1), ("s3", 0)], "standard_id string, ord int"),
        "articles": spark.createDataFrame([(s, a) for s in ("s1", "s2", "s3") for a in ("Article 12", "Article 14")], "standard_id string, article string"),
        "characteristics": spark.createDataFrame(listed, "standard_id string, characteristic string"),
    }
    own, best = standards.article_standard_scores(tokens, tables), standards.top_article_standards(tokens, tables, 2)
    assert "SortMergeJoin" not in own._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(standards, "_article_rows", lambda *_: None)
    assert rows(own) == rows(standards.article_standard_scores(tokens, tables))
    assert rows(best) == rows(standards.top_article_standards(tokens, tables, 2)) and best.count() == 12


def test_links_are_distinct_before_they_are_made(spark):
    """The rows that are made distinct are references, not links."""
    refs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "subject int, characteristic string")
    tables = {"characteristics": spark.createDataFrame([("s1", "ab"), ("s2", "a-a"), ("s2", "ba")], "standard_id string, characteristic string")}
    linked = standards.link_standards_by_characteristic(refs, tables)
    assert rows(linked) == [("a", "s1", "1"), ("a", "s2", "1"), ("b", "s1", "2"), ("b", "s2", "2")]
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
