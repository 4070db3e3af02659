"""Language identification, the quality classifier and nearest neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import clashing, table, words

from spanledger.llm import language, neighbours, quality_model


def tongue(seed, letters):
    own = words(random.Random(seed), 120, letters)
    return lambda rng, n: " ".join(rng.choice(own) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    tongues = {"aa": tongue(2, "abcdeo"), "bb": tongue(3, "klmnou"), "cc": tongue(4, "rstéia")}
    return [(i, tongues[name](rng, rng.choice([12, 60])), name, "s") for i, name in enumerate(sorted(tongues) * 40)]


def test_language_of_held_out_texts(spark, spoken):
    docs = clashing(table(spark, spoken + [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !? 34", "bb", "s"), (903, spoken[0][1] * 400, None, "s")]))
    held = language.fold("doc_id", 3) == 1
    model = language.fit_languages(docs.filter(~held))
    assert sorted(model.languages) == ["aa", "bb", "cc"]
    found = {r.doc_id: r for r in language.identify_languages(docs, model).collect()}
    right = [found[i].lang_pred == name for i, _, name, _ in spoken]
    assert np.mean(right) > 0.97
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert found[903].lang_pred == spoken[0][2]
    assert all(0 <= r.score <= 1 for r in found.values())


def test_narrow_margins_are_rejected(spark, spoken):
    docs = table(spark, spoken)
    model = language.fit_languages(docs)
    some = language.identify_languages(docs, model, least_margin=2.0).select("language").distinct().collect()
    assert [r.language for r in some] == ["und"]


def test_language_without_anything_to_learn(spark, spoken):
    empty = language.fit_languages(table(spark, []))
    assert language.identify_languages(table(spark, spoken[:3]), empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.identify_languages(table(spark, []), empty).collect() == []


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(5)
    good = tongue(6, "abcdeo")
    out = []
    for i in range(300):
        text = good(rng, rng.choice([10, 50]))
        bad = rng.random() < 0.3
        out.append((i, text.replace(" ", "## ") if bad else text, int(not bad)))
    return out


def test_quality_on_held_out_rows(spark, graded):
    rows = spark.createDataFrame(graded, "doc_id long, text string, quality int")
    held = language.fold("doc_id", 4) == 2
    model = quality_model.fit_quality(rows.filter(~held))
    found = quality_model.score_quality(clashing(rows), model).join(rows, "doc_id").filter(held).collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in found)


def test_quality_of_odd_texts(spark, graded):
    model = quality_model.SubwordClassifier().fit([t for _, t, _ in graded], [q for *_, q in graded])
    odd = table(spark, [(1, None, None, None), (2, "", None, None), (3, "é", None, None), (4, "a " * 60_000, None, None)])
    found = {r.doc_id: r.score for r in quality_model.score_quality(odd, model).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[1] == found[2]
    assert quality_model.score_quality(table(spark, []), model).collect() == []
    # Batches do not matter.
    texts = [t for _, t, _ in graded[:20]]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_quality_with_one_class():
    model = quality_model.SubwordClassifier().fit(["a", "b"], [1, 1])
    assert model.score(["a", "anything"])[0] > 0.5


def plain_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for i, v in good.items():
        if i % 20 == 0:
            scored = sorted((-float((v * w).sum()), j) for j, w in good.items() if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def vectors(seed, n, scale=False):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, 16))
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    if scale:
        out *= rng.uniform(0.2, 3, (n, 1))
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_recall_and_scores(spark, scale):
    rows = vectors(7, 1500, scale)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("row", F.lit(2))
    found = neighbours.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    expected = plain_nearest(rows, 20)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    own = dict(rows)
    for q, near in by_query.items():
        near.sort()
        assert [n for n, *_ in near] == list(range(1, 21))
        assert all(abs(s - float(np.dot(own[q], own[i]))) < 1e-9 for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for i, _ in expected[q]})
    assert by_query.keys() == expected.keys() and hits / (20 * len(expected)) >= 0.9


def test_neighbours_of_copies_and_bad_vectors(spark):
    rows = vectors(8, 60)
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    rows += [(200, None), (220, []), (240, [0.0] * 16), (260, [float("nan")] + [1.0] * 15), (280, [None] + [1.0] * 15), (300, [1.0] * 5), (None, rows[1][1])]
    rows += [rows[3]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    expected = plain_nearest(rows, 20)
    assert {r.query_id for r in found} == expected.keys()
    for query in (0, 100, 120, 140):
        near = sorted((r["rank"], r.vec_id) for r in found if r.query_id == query)
        copies = [i for i in [0, *range(100, 150)] if i != query][:20]
        assert [i for _, i in near] == copies


def test_few_candidates(spark):
    docs = spark.createDataFrame(vectors(9, 5), "vec_id long, embedding array<double>")
    found = neighbours.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in found) == [1, 2, 3, 4]
    assert neighbours.nearest(docs.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_multi_index_finds_every_code():
    rng = np.random.default_rng(10)
    codes = rng.integers(0, 256, (400, 32), dtype=np.uint8)
    codes[200:] = codes[:200] ^ (rng.random((200, 32)) < 0.3).astype(np.uint8)
    tables = neighbours.MultiIndex(codes)
    for radius in (0, 5, 31, 32, 40, 100):
        for code in codes[::50]:
            plain = np.flatnonzero(np.unpackbits(codes ^ code, axis=1).sum(1) <= radius)
            assert tables.within(code, radius).tolist() == plain.tolist()
