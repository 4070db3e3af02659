"""Sharding, mixing and packing: laws, round trips and plain versions."""

import collections
import hashlib
import math
import zlib

import pytest
from tests.llm.helpers import WORD, clashing, corpus, table

from spanledger.llm import mixing, packing, sharding


def cost(key, shard, weight=1.0):
    name = "\x00null" if key is None else str(key)
    h = int(hashlib.md5(f"{name}:{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((h + 0.5) / 16**13) / weight


def test_shards_match_plain_version(spark):
    rows = corpus(1)
    found = sharding.assign_shards(clashing(table(spark, rows)), [1.0] * 8, grown_weight=1.0).collect()
    expected = collections.Counter()
    for doc, text, *_ in rows:
        data = (text or "").encode()
        shard = min(range(8), key=lambda s: (cost(doc, s), s))
        grown = min(range(9), key=lambda s: (cost(doc, s), s))
        expected[doc, len(data) + 1, zlib.crc32(data), shard, grown] += 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found) == expected
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weighted_shards_and_growth(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    found = sharding.assign_shards(docs, [1.0, 3.0], grown_weight=2.0).collect()
    share = sum(r.shard == 1 for r in found) / len(found)
    assert abs(share - 0.75) < 0.03
    moved = [r for r in found if r.shard != r.grown_shard]
    assert all(r.grown_shard == 2 for r in moved)
    assert abs(len(moved) / len(found) - 2 / 6) < 0.03


def test_sharding_limits(spark):
    assert sharding.assign_shards(table(spark, []), [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.rendezvous("key", [1.0, 0.0])


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            out.update({s: weights[s] * level for s in free})
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_targets(spark):
    rows = corpus(2)
    found = mixing.mix_records(clashing(table(spark, rows))).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    taken = collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        # Equal rows at the cut share what is left, so some words may be missing.
        assert target - 130 <= taken[source] <= target


def test_mixed_documents_hold_the_words_taken(spark):
    docs = clashing(table(spark, corpus(3)))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    records = mixing.mix_records(docs)
    assert records.agg({"taken": "sum"}).first()[0] == sum(len(WORD.findall(r.text)) for r in out.collect())
    again = mixing.mix_documents(docs.repartition(9))
    assert collections.Counter(map(str, out.collect())) == collections.Counter(map(str, again.collect()))


def test_mix_of_an_empty_table(spark):
    assert mixing.mix_records(table(spark, [])).collect() == []
    assert mixing.mix_records(table(spark, [(1, None, None, None)])).first().taken == 0


def check_packing(rows, found, capacity):
    spans = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in found:
        if r.n_words:
            spans[r.doc_id].append((r.first_word, r.n_words))
            bins[r.bin_id].append(r)
    total = collections.Counter()
    for doc, text, *_ in rows:
        total[doc] += len(WORD.findall(text or ""))
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == {d: n for d, n in total.items() if n}
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= capacity
        assert sorted(r.bin_position for r in own) == list(range(len(own)))
    return bins


def test_packing_is_whole_and_respects_conflicts(spark):
    rows = [r for r in corpus(4) if r[0] not in (None, 5, 4)]
    docs = clashing(table(spark, rows))
    found = packing.pack_documents(docs, capacity=200).collect()
    bins = check_packing(rows, found, 200)
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[3] for r in rows}
    for own in bins.values():
        ids = [r.doc_id for r in own]
        assert len({source[i] for i in ids}) == len(ids)
        assert len({" ".join(WORD.findall((text[i] or "").lower())) for i in ids}) == len(ids)
    assert {r.doc_id for r in found if r.bin_id is None} == {100, 101, 102}


def test_packing_of_odd_tables(spark):
    rows = corpus(5)
    check_packing(rows, packing.pack_documents(table(spark, rows), capacity=50, group_rows=10).collect(), 50)
    assert packing.pack_documents(table(spark, [])).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10)
    assert bins.place(6, 1, 0) == (0, 0)
    assert bins.place(7, 2, 0) == (1, 0)
    # Three are left in bin 1, four in bin 0: the tighter one is taken.
    assert bins.place(3, 4, 0) == (1, 1)
    # Bin 0 holds the source already.
    assert bins.place(4, 1, 0) == (2, 0)
    # Bin 0 is tighter than bin 2, and free of source 2.
    assert bins.place(4, 2, 8) == (0, 1)
    # Bin 2 is the only one left; its cluster is free.
    assert bins.place(2, 2, 8) == (2, 1)


def test_best_fit_matches_a_scan_of_all_bins():
    import random

    rng = random.Random(6)
    bins, plain = packing.Bins(50), []
    for _ in range(800):
        size, source, cluster = rng.randint(1, 50), 1 << rng.randint(0, 3), rng.choice([0, 0, 1, 2, 4])
        fits = [b for b in plain if b[0] >= size and not b[1] & source and not b[2] & cluster]
        tightest = min((b[0] for b in fits), default=None)
        number, _ = bins.place(size, source, cluster)
        if tightest is None:
            assert number == len(plain)
            plain.append([50 - size, source, cluster])
        else:
            own = plain[number]
            assert own in fits and own[0] == tightest
            own[0] -= size
            own[1] |= source
            own[2] |= cluster
