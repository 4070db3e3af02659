"""Links of structured words, and tables of which much is one repeated row."""

import random

import numpy as np
from tests.llm.helpers import corpus, table, words

from spanledger.llm import bytearrays, jaccard_join, packing


def alternating(n: int, letters: str = "ab") -> str:
    """A word whose letter at place i is the parity of i's binary ones."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_structured_words_do_not_link(spark):
    one, other = alternating(1024), alternating(1024, "ba")
    rows = [(1, " ".join([one] * 5), "xx", "a"), (2, " ".join([other] * 5), "xx", "a"), (3, " ".join([one] * 5), "xx", "b")]
    found = {r.id: r.component_id for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a", b"abcdefgh", b"abcdefghi", b"x" * 511, b"x" * 512, b"x" * 513, b"a\x00", alternating(256).encode(), alternating(256, "ba").encode()]
    data = np.frombuffer(b" ".join(words + words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words + words]) - 1
    found = bytearrays.word_hashes(data, ends - [len(w) for w in words + words], ends).tolist()
    assert found[: len(words)] == found[len(words) :] and len(set(found)) == len(words)
    assert found == [int(bytearrays.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words + words]


def searched(spark, monkeypatch, run) -> list[int]:
    """Rows of every table of texts that goes on to the search."""
    written, plain = [], jaccard_join.materialize

    def noted(df):
        out = plain(df)
        if df.columns == ["node", "n", "id", "check", "text"]:
            written.append((out.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    run()
    return written


def test_one_row_of_each_node_is_searched(spark, monkeypatch):
    rows = corpus(31, 40)
    near = rows[6][1] + " and one more"
    docs = table(spark, rows + [(300, near, "xx", "a")] + [rows[6]] * 60)
    groups: list = []
    sizes = searched(spark, monkeypatch, lambda: groups.extend(jaccard_join.jaccard_groups(docs).collect()))
    assert sizes and all(n == nodes for n, nodes in sizes)
    assert len(groups) == docs.count()
    sizes = searched(spark, monkeypatch, lambda: groups.extend(packing.near_clusters(docs).collect()))
    assert sizes and all(n == nodes for n, nodes in sizes)


def edited(rng, n, gone, added):
    """Two sorted sets that share all but ``gone`` of the ``n`` of one and ``added`` of the other."""
    own = rng.integers(-(2**63), 2**63 - 1, n)
    return np.sort(own), np.sort(np.concatenate((own[gone:], rng.integers(-(2**63), 2**63 - 1, added))))


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(11)
    for trial in range(600):
        n = int(rng.choice([4, 5, 9, 16, 33, 64, 129, 450, 1025]))
        gone = int(rng.integers(0, n // 5 + 1))
        most = max((m for m in range(n // 4 + 1) if jaccard_join.linked(n - gone, n, n - gone + m)), default=None)
        if most is None or gone + most == 0:
            continue
        a, b = edited(rng, n, gone, most)
        # All, some or none of the shingles are frequent.
        frequent = np.sort(np.union1d(a, b)[:: int(rng.integers(1, 4))]) if trial % 2 else None
        with np.errstate(over="ignore"):
            text, found = jaccard_join.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), frequent)
        common = len(np.intersect1d(found[text == 0], found[text == 1]))
        assert common >= max(1, jaccard_join.least_overlap(max(len(a), len(b))) // jaccard_join._SPARE), (n, gone, most)


def test_a_common_passage_makes_no_candidate_group(spark, monkeypatch):
    rng = random.Random(12)
    passage = words(rng, 20)
    rows = [(i, " ".join(passage + words(rng, 70)), "xx", "a") for i in range(300)]
    rows.append((300, rows[0][1] + " more", "xx", "a"))
    written, plain = [], jaccard_join.materialize

    def noted(df):
        out = plain(df)
        if df.columns == ["node", "n", "root"]:
            written.extend(r["count"] for r in out.groupBy("root").count().collect())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    found = {r.id: (r.component_id, r.n_words) for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()}
    assert found == {i: (0 if i == 300 else i, 91 if i == 300 else 90) for i in range(301)}
    assert sum(written) <= 30


def test_shingles_of_one_set_alone_change_no_link():
    rng = np.random.default_rng(13)
    a, b = edited(rng, 100, 5, 6)
    for left in (slice(None), np.isin(a, b)):
        linker = jaccard_join.Linker()
        order = np.unique(np.concatenate((a[left], b)))
        one, other = (np.searchsorted(order, x).astype(np.int32) for x in (a[left], b))
        assert linker.add(one, "a", 100) == [] and linker.add(other, "b", 101) == ["a"]
    # Their sizes count: half of the shared ones is no link.
    linker = jaccard_join.Linker()
    assert linker.add(np.arange(50), "a", 100) == [] and linker.add(np.arange(50), "b", 100) == []
