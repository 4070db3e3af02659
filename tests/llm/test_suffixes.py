"""Removal of repeated strings against a plain version."""

import collections
import random

import numpy as np
import pyarrow as pa
from tests.llm.helpers import clashing, corpus, table, words

from spanledger.llm import suffix_dedup

N = suffix_dedup.LENGTH


def plain_removal(rows):
    data = [(r[1] or "").encode() for r in rows]
    counts = collections.Counter(d[i : i + N] for d in data for i in range(len(d) - N + 1))
    out = collections.Counter()
    for row, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - N + 1):
            if counts[d[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[row[0], len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)] += 1
    return out


def found_removal(docs):
    return collections.Counter(
        (r[0], r.n_bytes, sum(s["last"] - s["first"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()
    )


def passages(seed, n):
    """Texts that share passages of about the length that matters, at any offset, with edits."""
    rng = random.Random(seed)
    shared = [" ".join(words(rng, 70, "abcdé")) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(0, 60)))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(shared)
            a = rng.randint(0, len(own) - 150)
            text += " " + own[a : a + rng.randint(150, 400)] + " " + " ".join(words(rng, rng.randint(0, 40)))
        rows.append((1000 + i, text, "xx", "a"))
    return rows


def test_removal_matches_plain_version(spark):
    rows = [r for r in corpus(1) if r[0] != 104] + passages(2, 60)
    rows += [(2000, "ab" * 300, "xx", "a"), (2001, "z" * 199, "xx", "a"), (2002, "z" * 200, "xx", "a"), (2003, "\x00" * 450, "xx", "a")]
    docs = clashing(table(spark, rows)).repartition(5)
    assert found_removal(docs) == plain_removal(rows)


def test_small_batches_and_slices(spark, monkeypatch):
    rows = passages(3, 30)
    monkeypatch.setattr(suffix_dedup, "BATCH_ENTRIES", 5)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ENTRIES", 20)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 700)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 500)
    assert found_removal(table(spark, rows)) == plain_removal(rows)


def test_hot_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_HOT", 2)
    rows = passages(4, 60)
    assert found_removal(table(spark, rows)) == plain_removal(rows)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).collect() == []


def test_levels_grow_with_the_logarithm_of_batches():
    rng = np.random.default_rng(5)
    family = suffix_dedup.Family({})
    batches = []
    for i in range(13):
        batch = np.zeros(50, suffix_dedup._ENTRY)
        batch["key"] = rng.integers(0, 200, 50)
        batch["region"] = rng.integers(0, 3, 50)
        batch["text"] = np.arange(50) + 50 * i
        batches.append(batch.copy())
        family.add(suffix_dedup._condensed(batch))
    # 13 is 1101 in binary.
    assert sorted(family.levels) == [0, 2, 3]
    everything = np.concatenate(batches)
    keys = collections.Counter(everything["key"].tolist())
    runs = collections.Counter(zip(everything["key"].tolist(), everything["region"].tolist(), strict=True))
    for e in family.entries():
        k, r = int(e["key"]), int(e["region"])
        expected = suffix_dedup.WHOLE if runs[k, r] > 1 else suffix_dedup.SHARED if keys[k] > 1 else suffix_dedup.ALONE
        assert e["state"] == expected


def test_an_index_goes_on_with_new_texts(spark):
    rows = passages(6, 40)
    texts = table(spark, rows).selectExpr("xxhash64(text) AS text", "text AS content").filter(f"length(content) >= {N}")
    old, new = texts.filter("pmod(text, 2) = 0"), texts.filter("pmod(text, 2) = 1")
    first = suffix_dedup.index_texts(old, 3, keep_levels=True)
    both = suffix_dedup.index_texts(new, 3, levels=first.filter("level IS NOT NULL"))
    once = suffix_dedup.index_texts(texts, 3)
    wanted = ["text", "state", "key", "first", "last", "anchor"]
    found = [collections.Counter(tuple(r) for r in x.filter("state = 2").select(*wanted).collect()) for x in (both, once)]
    assert found[0] == found[1]


def test_repeated_windows():
    rng = random.Random(7)
    data = bytes(rng.choice(b"ab") for _ in range(300)) * 2 + bytes(rng.choice(b"abc") for _ in range(500))
    ends = np.full(len(data), len(data))
    counts = collections.Counter(data[i : i + N] for i in range(len(data) - N + 1))
    plain = [i for i in range(len(data) - N + 1) if counts[data[i : i + N]] > 1]
    assert suffix_dedup.repeated_windows(np.frombuffer(data, np.uint8), ends).tolist() == plain


def test_equal_runs_of_a_batch_send_one_entry_on():
    passage = " ".join(words(random.Random(8), 200))

    def entries(copies):
        texts = pa.array(range(copies), pa.int64())
        rows = [pa.RecordBatch.from_arrays([texts, pa.array([passage] * copies)], ["text", "content"])]
        found = {True: [], False: []}
        for batch in suffix_dedup._batches(7)(iter(rows)):
            for level, blob in zip(batch.column("level").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                found[level is None].extend(np.frombuffer(blob, suffix_dedup._ENTRY).tolist())
        return found

    few, many = entries(2), entries(50)
    assert len(many[True]) == len(few[True])
    # All places are there once, as an entry that goes on or as a match.
    places = collections.Counter((e[2], e[3]) for own in many.values() for e in own)
    assert set(places.values()) == {1} and len(places) == 50 * len(many[True])
    assert all(e[-1] == suffix_dedup.WHOLE for own in many.values() for e in own)


def test_many_small_batches_of_a_bucket_are_scanned_together(monkeypatch):
    rng = np.random.default_rng(3)
    blobs = []
    for i in range(300):
        entries = np.zeros(20, suffix_dedup._ENTRY)
        entries["key"], entries["region"] = rng.integers(0, 4000, 20), rng.integers(0, 3, 20)
        entries["text"], entries["first"] = i, np.arange(20)
        blobs.append(suffix_dedup._condensed(entries))
    scanned = []
    plain = suffix_dedup.Family._scan
    monkeypatch.setattr(suffix_dedup.Family, "_scan", staticmethod(lambda new, old: scanned.append(len(old)) or plain(new, old)))
    rows = pa.RecordBatch.from_arrays(
        [pa.array([0] * 300, pa.int32()), pa.nulls(300, pa.int32()), pa.array([b.tobytes() for b in blobs])], ["bucket", "level", "blob"]
    )

    def found():
        out = collections.Counter()
        for batch in suffix_dedup._families(False, False)(iter([rows])):
            out.update(zip(*(batch.column(c).to_pylist() for c in ("text", "first", "state")), strict=True))
        return out

    together = found()
    # The entries of a bucket that are looked at grow with the bucket, not with its batches.
    assert sum(scanned) <= 2 * 300 * 20
    entries = np.concatenate(blobs)
    runs = collections.Counter(zip(entries["key"].tolist(), entries["region"].tolist(), strict=True))
    keys = collections.Counter(entries["key"].tolist())
    expected = collections.Counter()
    for e in entries:
        if runs[int(e["key"]), int(e["region"])] > 1:
            expected[int(e["text"]), int(e["first"]), suffix_dedup.WHOLE] += 1
        elif keys[int(e["key"])] > 1:
            expected[int(e["text"]), int(e["first"]), suffix_dedup.SHARED] += 1
    assert together == expected
    monkeypatch.setattr(suffix_dedup, "ARRAY_ENTRIES", 700)
    assert found() == expected


def test_passed_matches_are_given_in_few_batches():
    entries = np.zeros(10, suffix_dedup._ENTRY)
    entries["first"] = np.arange(10)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(50), pa.int32()), pa.array([suffix_dedup.PASSED] * 50, pa.int32()), pa.array([entries.tobytes()] * 50)],
        ["bucket", "level", "blob"],
    )
    batches = [b for b in suffix_dedup._families(False, False)(iter([rows])) if b.num_rows]
    assert len(batches) == 1 and batches[0].num_rows == 500
