"""Packing: near copies stay apart, and no id makes a group of its own."""

import collections
import random

import pytest
from tests.llm.helpers import table, words

from spanledger.llm import packing, queries


def test_near_copies_are_not_in_one_sequence(spark, tmp_path):
    own = words(random.Random(1), 60)
    near = [own[:i] + ["changed"] + own[i + 1 :] for i in (5, 55)]
    rows = [(i, " ".join(w), "xx", f"source {i}") for i, w in enumerate([own, *near, words(random.Random(2), 60)])]
    # Rows without id are told apart by their texts.
    rows += [(None, " ".join([*own[:59], "other"]), "xx", "source 8"), (None, " ".join(words(random.Random(3), 50)), "xx", "source 9")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op7_packing"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    at = {(r.doc_id, r.n_words): r.bin_id for r in found}
    alike = [at[0, 60], at[1, 60], at[2, 60], at[None, 60]]
    assert len(set(alike)) == 4
    # The other texts share a sequence with one of them.
    assert {at[3, 60], at[None, 50]} <= set(alike)


@pytest.mark.parametrize("same_text", [False, True])
def test_a_hot_id_is_dealt_to_all_groups(spark, same_text):
    rng = random.Random(4)
    rows = [(None, "a b c" if same_text else " ".join(words(rng, 5)), "xx", str(i)) for i in range(400)]
    if same_text:
        rows = [(*r[:3], "a") for r in rows]
    found = packing.pack_documents(table(spark, rows), group_rows=20).collect()
    assert len(found) == 400
    groups = collections.Counter(r.bin_id >> 32 for r in found)
    assert len(groups) >= 15 and max(groups.values()) <= 50


def test_words_come_with_the_clusters(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, n)), "xx", str(i)) for i, n in enumerate((0, 1, 4, 60, 250))] + [(5, None, "xx", "a"), (6, "a\tb\u00a0c \n d", "xx", "b")]
    docs = table(spark, rows)
    clusters = packing.near_clusters(docs)
    assert "words" in clusters.columns
    columns = ["doc_id", "piece", "first_word", "n_words"]
    found, plain = (sorted(tuple(r[c] for c in columns) for r in packing.pack_documents(docs, 100, clusters=c).collect()) for c in (clusters, None))
    assert found == plain
