"""Language-model scores, whitening and spelling variants against plain versions."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import WORD, clashing, corpus, lowered, table, words

from spanledger.llm import language, maxent, queries, spelling, whitening

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


# Language-model scores


def plain_tokens(text):
    return [*WORD.findall(lowered(text or "")), ""]


def plain_base(rows, held):
    counts = collections.Counter(t for i, text, *_ in rows if not held(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = collections.Counter()
    for i, text, *_ in rows:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out[i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    return out


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


@pytest.fixture
def frequent(monkeypatch, request):
    monkeypatch.setattr(maxent, "HOT_WORDS", request.param)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17], indirect=True)
def test_base_scores(spark, frequent):
    rows = corpus(3) + [(200, "y" * 70 + " " + "y" * 71 + " one", "xx", "a"), (201, ("y" * 70 + " ") * 3, "xx", "a"), (202, "z" * 100_000, "xx", "a")]
    docs = clashing(table(spark, rows))
    held = language.fold("doc_id", 5) == 1
    model = maxent.fit_maxent(docs.filter(~held))
    found = maxent.score_texts(docs, model).withColumn("held_out", held).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == plain_base(rows, held_out)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_scores_are_those_of_the_model(spark):
    """Score of a text token by token, with its history looked at anew."""
    rows = corpus(4, 40)
    docs = table(spark, rows)
    model = maxent.fit_maxent(docs)
    counts = {r.word: r.n for r in model.vocabulary.collect()}
    scores = {(r.doc_id, r.n_tokens): r.score for r in maxent.score_texts(docs, model).collect()}
    for i, text, *_ in rows[:15] + rows[-9:-6]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        tokens = maxent.tokenize(maxent.LOWER[data], np.array([0, len(data)]), model.bounds, model.settings)
        total = 0.0
        for t, word in enumerate(plain_tokens(text)):
            scores_of = model.weights[-1].astype(float) + sum(model.weights[f].astype(float) for f in tokens.features[:, t])
            p = np.exp(scores_of - scores_of.max())
            own = tokens.classes[t]
            rest = model.class_tokens[own] + 0.5 * (model.class_words[own] + (1 if word else 0))
            total += math.log10(p[own] / p.sum()) + math.log10((counts.get(word, 0) + 0.5) / rest)
        assert scores[i, len(plain_tokens(text))] == pytest.approx(total, abs=1e-3 + 1e-5 * t)


def test_probabilities_sum_to_one(spark):
    docs = table(spark, corpus(5, 30))
    model = maxent.fit_maxent(docs)
    rows = model.vocabulary.collect()
    own = {r.word: int(np.searchsorted(model.bounds, np.uint64(r.ending % (1 << 64)), side="right")) if r.word else model.settings.classes for r in rows}
    sums = np.zeros(model.settings.classes + 1)
    for r in rows:
        rest = model.class_tokens[own[r.word]] + 0.5 * (model.class_words[own[r.word]] + (1 if r.word else 0))
        sums[own[r.word]] += (r.n + 0.5) / rest
    unknown = 0.5 / (model.class_tokens + 0.5 * (model.class_words + 1))
    assert np.allclose((sums + unknown)[:-1][model.class_words[:-1] > 0], 1) and math.isclose(sums[-1], 1)


def test_history_helps_on_held_out_texts(spark):
    rng = random.Random(6)
    tongues = [words(random.Random(k), 60, "abcdeo" if k else "klmnou") for k in range(2)]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(60)), "xx", "s") for i in range(300)]
    docs = table(spark, rows)
    held = language.fold("doc_id", 5) == 1
    model = maxent.fit_maxent(docs.filter(~held))
    found = maxent.score_texts(docs.filter(held), model).collect()
    assert sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found) > 0.1


def test_gradient_step():
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(9, 4)).astype(np.float32)
    features, classes = rng.integers(0, 8, (2, 30)), rng.integers(0, 4, 30)

    def loss(w):
        scores = w[-1] + w[features[0]] + w[features[1]]
        return sum(np.log(np.exp(s).sum()) - s[c] for s, c in zip(scores, classes, strict=True))

    plain = np.zeros(weights.shape)
    for i, j in np.ndindex(weights.shape):
        step = np.zeros(weights.shape)
        step[i, j] = 1e-4
        plain[i, j] = (loss(weights.astype(float) + step) - loss(weights.astype(float) - step)) / 2e-4
    after, squares, seen = weights.copy(), np.zeros(9, np.float32), np.zeros(9, np.float32)
    maxent.learn(after, squares, seen, features, classes, 1e-3)
    moved = after - weights
    assert (moved * plain <= 1e-6).all() and loss(after.astype(float)) < loss(weights.astype(float))
    assert seen[-1] == 30 and seen[:-1].sum() == 60


def test_model_of_nothing(spark):
    docs = table(spark, corpus(8, 5))
    model = maxent.fit_maxent(docs.limit(0))
    found = maxent.score_texts(docs, model).collect()
    assert len(found) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-6 and math.isfinite(r.score) for r in found)
    assert maxent.score_texts(docs.limit(0), model).collect() == []


# Whitening


def plain_whitening(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums, strict=True)] for row in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return n, deviation, centred, values[::-1], vectors[:, ::-1], np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_whitening(spark, scale):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * scale
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (905, [1e300] * 6)]
    rows += [rows[3], (None, rows[4][1])]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    docs = docs.withColumns({c: F.lit(1) for c in ("n", "key", "vector", "component", "total", "i", "length", "whitened")})
    models = whitening.fit_whitening(docs)
    found = whitening.components_table(whitening.whiten_vectors(docs, models)).collect()
    n, deviation, centred, values, vectors, trace = plain_whitening(rows)
    assert len(found) == 6 * len(rows) and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 7))
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in found if r.component == 1) == collections.Counter(zip([i for i, _ in rows], deviation, strict=True))
    by_id = {(r.vec_id, r.component): r for r in found}
    for k in range(6):
        plain = centred @ vectors[:, k] / math.sqrt(values[k])
        got = np.array([by_id[i, k + 1].whitened for i, _ in rows])
        assert np.abs(got - plain).max() < 1e-6 or np.abs(got + plain).max() < 1e-6
        assert by_id[0, k + 1].explained == pytest.approx(values[k] / trace, rel=1e-9)
    assert max(r.identity_error for r in found) < 1e-9


def test_whitening_of_lengths_copies_and_nothing(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(c) for c in rng.normal(size=3 if i % 2 else 4)]) for i in range(60)] + [(100 + i, [1.0, 2.0]) for i in range(5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = whitening.fit_whitening(docs)
    found = whitening.components_table(whitening.whiten_vectors(docs, models)).collect()
    assert {k: m.n for k, m in models.items()} == {2: 5, 3: 30, 4: 30}
    assert collections.Counter(r.n for r in found) == {5: 10, 30: 90 + 120}
    # Vectors that do not vary have no direction to whiten.
    assert all((r.whitened is None) == (r.n == 5) and r.deviation >= 0 for r in found)
    empty = whitening.fit_whitening(docs.limit(0))
    assert empty == {} and whitening.whiten_vectors(docs.limit(0), empty).collect() == []


def test_polarised_covariance():
    y = np.random.default_rng(13).integers(-1000, 1000, (50, 5))
    for kind in (1, 1 << 40):
        squares = whitening.pair_squares(y * kind)
        exact = {(i, j): int(squares[i, j]) for i in range(5) for j in range(i, 5)}
        found = whitening.covariance(50, [int(s) * kind for s in y.sum(0)], exact)
        assert np.allclose(found / float(kind) ** 2, np.cov(y.T.astype(float), bias=True))


# Spelling variants


def plain_words(rows):
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in LETTERS.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    counts = plain_words(rows)
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def misspelt(seed):
    rng = random.Random(seed)
    letters = "abcdeénoÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(30):
            word = rng.choice(stems[: rng.randint(1, 40)])
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
            text.append(word.title() if rng.random() < 0.1 else word)
        rows.append((i, rng.choice([" ", "-", "9", "œ"]).join(text), "xx", "a"))
    rows.append((600, " ".join(["bacdefg"] * 200 + ["bacdefgh"] * 30 + ["bacdefghi"] * 5), "xx", "a"))
    return rows + [(None, "Ünicode's ×÷× " * 9, None, None), (500, None, None, None), (501, "", None, None), (502, "abcdef" * 20_000, None, None), rows[0]]


@pytest.mark.parametrize("tile", [4096, 7])
def test_spelling_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    rows = misspelt(21)
    found = {tuple(r) for r in spelling.spelling_variants(clashing(table(spark, rows))).collect()}
    expected = plain_variants(rows)
    assert found == expected and len({w[2] for w in expected}) < len(expected) and any(w[1] and w[1] != w[2] for w in expected)


def test_long_words_and_nothing(spark):
    long = "".join(random.Random(22).choice("abcdefgh") for _ in range(5000))
    rows = [(i, " ".join([long] * 30 + [long[:2500] + "z" + long[2500:]] * 2 + [long[:-1] + "z"] * 2), "xx", "a") for i in range(6)]
    found = {tuple(r) for r in spelling.spelling_variants(table(spark, rows)).collect()}
    assert found == plain_variants(rows) and len(found) == 3
    assert spelling.spelling_variants(table(spark, [])).collect() == []


def test_check_sums_and_counts_in_parts():
    rng = random.Random(23)
    spans = [rng.randbytes(rng.choice([1, 6, 20, 64, 65, 200])) for _ in range(300)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    at = np.cumsum([0, *map(len, spans)])
    first = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    assert spelling.check_sums(data, at[:-1], at[1:], first).tolist() == [zlib.crc32(str(i).encode() + s) for i, s in enumerate(spans)]
    import pyarrow as pa

    parts = [[rng.choice("abcdefghij") * 3 for _ in range(50)] for _ in range(20)]
    total = collections.Counter()
    for batch in spelling.merge_counts((pa.array(p, pa.large_string()) for p in parts), held=12):
        total.update(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)))
    assert sum(total.values()) == 1000
    assert {"op11_lm_scoring", "op12_whitening", "op13_spelling"} <= queries.QUERIES.keys()
