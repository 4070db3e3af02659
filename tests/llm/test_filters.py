"""Line dedup, quality rules and the Jaccard join against plain versions."""

import collections
import random
from array import array

import numpy as np
import pytest
from tests.llm.helpers import WORD, clashing, corpus, lowered, table, words

from spanledger.llm import jaccard_join, line_dedup, quality_rules

SPACES = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    found = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(SPACES))
            if len(key) >= 10:
                found[key].add((doc is None, doc))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(found.get(lowered(x.strip(SPACES)), ())) < 2 or min(found[lowered(x.strip(SPACES))]) == (doc is None, doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def test_lines_match_plain_version(spark):
    rows = corpus(1)
    found = line_dedup.line_report(clashing(table(spark, rows))).collect()
    assert collections.Counter(tuple(r) for r in found) == plain_lines(rows)


def test_lines_keep_columns_and_rows(spark):
    docs = clashing(table(spark, corpus(2)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def test_twice_filter_misses_nothing(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(63) for _ in range(2000)]
    rows = [([v],) for v in values + values[:300]]
    data = line_dedup.twice_filter(spark.createDataFrame(rows, "h array<long>").repartition(5), 1 << 20)
    own = np.frombuffer(data, np.uint8)
    first, second = line_dedup._positions(np.array(values, np.int64), 1 << 20)
    hit = (line_dedup._get(own, first) & line_dedup._get(own, second)) == 1
    assert hit[:300].all() and hit[300:].mean() < 0.05


def plain_longest(own):
    n = len(own)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and own[i + k] == own[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats():
    rng = random.Random(4)
    for _ in range(200):
        own = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        assert quality_rules.longest_repeats(quality_rules._tokens([own])).tolist() == plain_longest(own)


def plain_measures(text):
    own = WORD.findall(text or "")
    longest = plain_longest(own) if len(own) < 500 else None
    if longest is None:
        return None
    again, spans = set(), set()
    for i, n in enumerate(longest):
        if n >= 5:
            again |= set(range(i, i + 5))
        if n >= 8:
            spans |= set(range(i, i + n))
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    most = max([n for n in longest if n >= 8], default=0)
    failed = len(own) < 10 or 100 * len(again) > 20 * len(own)
    kept = not failed and len(spans) <= 0.15 * len(own) and most <= max(60, 0.1 * len(own))
    return (len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(again), len(spans), most, failed, kept)


def test_quality_measures(spark):
    rng = random.Random(5)
    run = " ".join(words(rng, 9))
    rows = corpus(5) + [
        (200, " ".join([run, *words(rng, 90), run]), "xx", "a"),
        (201, " ".join([*words(rng, 50), run, "# * |", run]), "xx", "a"),
        (202, "same line of text\n" * 4 + "\n\n", "xx", "a"),
    ]
    found = quality_rules.quality_report(clashing(table(spark, rows))).collect()
    by_id = collections.defaultdict(list)
    for r in found:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.repeated_words, r.longest_repeat, r.base_failed, r.kept)
        by_id[r.doc_id].append(own)
    for doc, text, *_ in rows:
        expected = plain_measures(text)
        assert expected is None or expected in by_id[doc], doc
    assert by_id[104][0][-1] is False
    assert len(found) == len(rows)


def test_method_rejects_what_the_base_lets_pass(spark):
    rng = random.Random(6)
    long = words(rng, 70)
    text = " ".join([*long, *words(rng, 800), *long])
    row = quality_rules.quality_report(table(spark, [(1, text, "xx", "a")])).first()
    assert not row.base_failed and row.longest_repeat == 70 and row.kept
    text = " ".join([*long, *words(rng, 560), *long])
    row = quality_rules.quality_report(table(spark, [(1, text, "xx", "a")])).first()
    assert not row.base_failed and row.repeated_words == 140 and not row.kept


def test_quality_filter_agrees_with_report(spark):
    docs = clashing(table(spark, corpus(7)))
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.quality_report(docs).filter("kept").count()
    assert quality_rules.quality_report(table(spark, [])).collect() == []


def plain_groups(rows):
    sets = []
    for _, text, *_ in rows:
        own = WORD.findall(lowered(text or ""))
        sets.append(frozenset([tuple(own)] if 0 < len(own) < 5 else [tuple(own[i : i + 5]) for i in range(len(own) - 4)]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return collections.Counter((rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows)))


def family(seed, n, edits):
    """A chain of near copies: each differs a little from the one before."""
    rng = random.Random(seed)
    own = words(rng, 80)
    out = []
    for _ in range(n):
        own = list(own)
        for _ in range(edits):
            own[rng.randrange(len(own))] = "".join(words(rng, 1))
        out.append(" ".join(own))
    return out


def test_groups_match_plain_version(spark):
    rows = corpus(8) + [(300 + i, t, "xx", "a") for i, t in enumerate(family(9, 25, 1) + family(10, 25, 2))]
    found = jaccard_join.jaccard_groups(clashing(table(spark, rows)).repartition(7))
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in found.collect()) == plain_groups(rows)


def test_groups_in_blocks_match(spark, monkeypatch):
    rows = [(i, t, "xx", "a") for i, t in enumerate(family(11, 40, 1) + family(12, 30, 2))]
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 500)
    found = jaccard_join.jaccard_groups(table(spark, rows))
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in found.collect()) == plain_groups(rows)


def test_frequent_shingles_change_nothing(spark):
    rng = random.Random(13)
    line = " ".join(words(rng, 12))
    rows = [(i, line + "\n" + " ".join(words(rng, 14)), "xx", "a") for i in range(120)]
    rows += [(200 + i, line + " " + w, "xx", "a") for i, w in enumerate(["end", "end", "fin"])]
    found = jaccard_join.jaccard_groups(table(spark, rows))
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in found.collect()) == plain_groups(rows)


@pytest.mark.parametrize("heaped", [0, 2000])
def test_divide_skip(monkeypatch, heaped):
    monkeypatch.setattr(jaccard_join, "_HEAPED", heaped)
    rng = random.Random(14)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        counts = collections.Counter(x for own in lists for x in own)
        numbers, found = jaccard_join.divide_skip([array("i", own) for own in lists], least)
        expected = sorted((x, n) for x, n in counts.items() if n >= least)
        assert list(zip(numbers.tolist(), found.tolist(), strict=True)) == expected


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = corpus(15)
    docs = clashing(table(spark, rows))
    out = jaccard_join.dedup_near(docs)
    assert out.columns == docs.columns
    groups = plain_groups([r for r in rows if WORD.search(r[1] or "")])
    ids = [r.doc_id for r in out.collect() if WORD.search(r.text or "")]
    assert set(ids) == {c for _, _, c in groups}
    assert jaccard_join.dedup_near(table(spark, [])).collect() == []
