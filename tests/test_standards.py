"""Pack-time scores and matches of standards on a small catalog."""

import random

import pytest

from spanledger.operators import standards

#: Standards of Article 12: their characteristics. "retention-controls" is a fixed feature of the article.
CATALOG = {
    "s1": ["alpha", "beta", "gamma", "delta"],
    "s2": ["alpha", "beta"],
    "s3": ["alpha"],
    "s4": ["alpha", "beta", "gamma"],
    "s5": ["alpha", "x", "y", "z", "u"],
    "s6": ["retention-controls"],
    "s7": ["retention-controls", "alpha"],
}
TOKENS = [(1, "alpha"), (1, "beta"), (1, "retention-controls"), (2, "gamma"), (3, "nothing")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(s, c) for s, names in CATALOG.items() for c in names]
    return {
        "standards": spark.createDataFrame([(s, i) for i, s in enumerate(CATALOG)], "standard_id string, ord int"),
        "articles": spark.createDataFrame([(s, "Article 12") for s in CATALOG], "standard_id string, article string"),
        "characteristics": spark.createDataFrame(rows, "standard_id string, characteristic string"),
    }


def plain_scores(subject):
    """Score and catalog order of every standard, and whether own tokens matched."""
    tokens = {t for s, t in TOKENS if s == subject}
    out = {}
    for ord_, (name, own) in enumerate(CATALOG.items()):
        k = len((tokens | {"retention-controls"}) & set(own))
        score = min(1.0, 0.35 + 0.55 * k / len(own) + (0.10 if k else 0.0))
        out[name] = (round(score, 6), ord_, bool((tokens - {"retention-controls"}) & set(own)))
    return out


def test_article_scores_have_no_limit(spark, tables):
    tokens = spark.createDataFrame(TOKENS, "subject long, token string")
    found = standards.article_standard_scores(tokens, tables).collect()
    expected = {(s, n): v[0] for s in (1, 2, 3) for n, v in plain_scores(s).items() if v[2]}
    assert {(r.subject, r.standard_id): r.score for r in found} == expected
    assert len(found) == len(expected) and sum(s == 1 for s, _ in expected) == 6
    base = {r.standard_id: r.score for r in standards.article_base(tables).collect()}
    assert base == {n: v[0] for n, v in plain_scores(3).items()}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_top_standards_of_an_article_count_those_without_own_matches(spark, tables, k):
    tokens = spark.createDataFrame(TOKENS, "subject long, token string")
    found = {(r.subject, r["rank"]): (r.standard_id, r.score) for r in standards.top_article_standards(tokens, tables, k).collect()}
    expected = {}
    for subject in (1, 2, 3):
        order = sorted(plain_scores(subject).items(), key=lambda x: (-x[1][0], x[1][1]))
        expected |= {(subject, n + 1): (name, v[0]) for n, (name, v) in enumerate(order[:k])}
    assert found == expected


def test_matched_parts_keep_their_values(spark, tables):
    more = {
        "evidence_characteristics": spark.createDataFrame([("s1", "alpha"), ("s2", "audit-log")], "standard_id string, characteristic string"),
        "annex": spark.createDataFrame([("s1", "annex-iv-3")], "standard_id string, annex string"),
    }
    tokens = spark.createDataFrame([(1, "alpha"), (1, "audit-log"), (1, "12"), (1, "annex-iv-3")], "subject long, token string")
    rows = [tuple(r) for r in standards.matched_parts(tokens, tables | more).collect()]
    assert len(rows) == len(set(rows))
    by_part = {(s, p): {v for _, t, q, v in rows if (t, q) == (s, p)} for _, s, p, _ in rows}
    assert by_part["s1", "characteristic"] == by_part["s1", "evidence"] == {"alpha"}
    assert by_part["s2", "evidence"] == {"audit-log"} and by_part["s1", "annex"] == {"annex-iv-3"}
    assert {s for s, p in by_part if p == "article"} == set(CATALOG) and by_part["s6", "article"] == {"Article 12"}


def test_low_scores_are_compared():
    import __spark_entry__ as entry

    assert "score <= 0.8" in entry.oracle_sql()["standards_low_scores"]
    assert "standards_low_scores" in entry.queries()


def random_catalog(spark, rng):
    words = [f"w{i}" for i in range(14)]
    phrases = ["-".join(rng.sample(words, rng.randint(1, 3))) for _ in range(30)]
    parts = {name: [] for name in ("characteristics", "evidence_characteristics", "articles", "annex")}
    rows = []
    for n in range(12):
        name = f"s{n}"
        own = sorted(set(rng.sample(phrases, rng.randint(1, 12))))
        parts["characteristics"] += [(name, p) for p in own]
        parts["evidence_characteristics"] += [(name, p) for p in sorted(set(rng.sample(phrases, rng.randint(0, 3))))]
        articles, annex = rng.sample([12, 14, 15], rng.randint(0, 2)), rng.sample([1, 2, 3], rng.randint(0, 2))
        parts["articles"] += [(name, f"Article {a}") for a in articles]
        parts["annex"] += [(name, f"annex-iv-{a}") for a in annex]
        rows.append((name, n, len(own), len(articles), len(annex)))
    value = {"articles": "article", "annex": "annex"}
    known = {k: spark.createDataFrame(v, f"standard_id string, {value.get(k, 'characteristic')} string") for k, v in parts.items()}
    known["standards"] = spark.createDataFrame(rows, "standard_id string, ord int, characteristic_count long, article_count long, annex_count long")
    tokens = [(s, "-".join(rng.sample(words, rng.randint(1, 3)))) for s in range(40) for _ in range(rng.randint(0, 8))]
    tokens += [(s, t) for s in range(0, 40, 3) for t in ("Article 12", "12", "article-12")] + [(s, "annex-iv-2") for s in range(0, 40, 4)]
    return spark.createDataFrame(sorted(set(tokens)), "subject int, token string"), known


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_matches_equal_the_plain_ones(spark, seed):
    """Every minimum gives the plain scores above it; top k by thresholds is the plain one."""
    tokens, known = random_catalog(spark, random.Random(seed))
    plain = {tuple(r) for r in standards.match_standards(tokens, known).collect()}
    assert len({r[3] for r in plain}) > 20
    for minimum in (0.1, 0.45, 0.7):
        found = [tuple(r) for r in standards.bounded_matches(tokens, known, minimum).collect()]
        assert len(found) == len(set(found)) and set(found) == {r for r in plain if r[3] > minimum}
    best = {}
    for r in sorted(plain, key=lambda r: (r[0], -r[3], r[2])):
        best.setdefault(r[0], []).append(r[1])
    found = {(r.subject, r["rank"], r.standard_id) for r in standards.best_standards(tokens, known, 2, (0.7, 0.4)).collect()}
    assert found == {(s, i + 1, x) for s, own in best.items() for i, x in enumerate(own[:2])}


def test_pairs_below_the_bound_are_not_built(spark):
    """Subjects that share one common phrase of many with each standard meet none of the prefixes."""
    phrases = [f"p{i}" for i in range(10)]
    known = {
        "standards": spark.createDataFrame([(f"s{n}", n, 10, 0, 0) for n in range(20)], "standard_id string, ord int, characteristic_count long, article_count long, annex_count long"),
        "characteristics": spark.createDataFrame([(f"s{n}", f"{p}x{n}" if p != "p0" else "p0") for n in range(20) for p in phrases], "standard_id string, characteristic string"),
        "evidence_characteristics": spark.createDataFrame([], "standard_id string, characteristic string"),
        "articles": spark.createDataFrame([], "standard_id string, article string"),
        "annex": spark.createDataFrame([], "standard_id string, annex string"),
    }
    tokens = [(s, "p0") for s in range(50)] + [(s, f"{p}x{s}") for s in range(5) for p in phrases[1:]]
    rows = spark.createDataFrame(tokens, "subject int, token string")
    assert standards.match_standards(rows, known).count() == 50 * 20
    built = standards.built_pairs(rows, known, 0.5)
    assert built.count() == 5
    assert {(r.subject, r.standard_id, r.score) for r in standards.bounded_matches(rows, known, 0.5).collect()} == {(s, f"s{s}", 1.0) for s in range(5)}
