"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Suffixes are taken at anchors: of the 64-byte strings inside a window of
``LENGTH`` bytes the one with the smallest hash, so equal windows have their
anchors at the same place wherever they stand. Consecutive windows with one
anchor are a run, and each window belongs to exactly one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.bytearrays import Hashed, mix, pieces, utf8
from spanledger.session import materialize

#: Bytes of a string that may not occur twice, and of an anchor.
LENGTH, ANCHOR = 200, 64
_STARTS = LENGTH - ANCHOR + 1
#: Windows of a text that are worked on at once; longer texts are cut, with an overlap.
_SLICE = 1 << 20
#: Anchors of one batch (a new suffix array), and of a bucket of the index.
BATCH_ENTRIES, BUCKET_ENTRIES = 200_000, 300_000
#: Least entries of a suffix array that joins a family, and matches of a row batch.
ARRAY_ENTRIES, _MATCHES = 1 << 16, 50_000
#: Bytes of text that share a byte suffix array, and the largest group of one anchor in it.
ARRAY_BYTES = 1 << 20
_HOT = 2000

_ENTRY = np.dtype(
    [("key", "<u8"), ("region", "<u8"), ("text", "<i8"), ("first", "<i8"), ("last", "<i4"), ("anchor", "<i4"), ("state", "<i1")]
)
#: What is known of an entry: alone, its anchor occurs again, its whole run occurs again.
ALONE, SHARED, WHOLE = 0, 1, 2


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashed]:
    """(first, last, anchor, key) of all runs of windows, and the hashes of the bytes.

    ``ends`` has for each place the end of its text; no window crosses it.
    """
    hashed = Hashed(data)
    keys = hashed.windows(ANCHOR)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), hashed
    place = np.arange(len(keys), dtype=np.uint64)
    low = np.uint64((1 << 28) - 1)
    ranked = (keys & ~low) | place
    # Minimum over windows of _STARTS keys, from minima of blocks from both sides.
    padded = np.full(-(-len(ranked) // _STARTS) * _STARTS, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, _STARTS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:windows], ahead[_STARTS - 1 : _STARTS - 1 + windows]) & low).astype(np.int64)
    inside = np.arange(windows) + LENGTH <= ends[:windows]
    edge = np.ones(windows, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (ends[1:windows] != ends[: windows - 1])
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [windows])) - 1
    use = inside[first]
    first, last = first[use], last[use]
    anchor = anchor[first]
    return first, last, anchor, keys[anchor], hashed


def _entries(texts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Entries of all runs of some texts; long texts come in slices of windows."""
    for start, end in pieces(offsets, _SLICE):
        a, b = int(offsets[start]), int(offsets[end])
        for cut in range(a, max(a + 1, b), _SLICE if end - start == 1 else max(1, b - a)):
            stop = min(b, cut + _SLICE + LENGTH - 1) if end - start == 1 else b
            part = data[cut:stop]
            inner = np.clip(offsets[start : end + 1] - cut, 0, len(part))
            owner = np.repeat(np.arange(start, end), np.diff(inner))
            first, last, anchor, key, hashed = _runs(part, np.repeat(inner[1:], np.diff(inner)))
            out = np.zeros(len(first), _ENTRY)
            out["key"] = key
            out["region"] = mix(hashed.spans(first, last + LENGTH) + (anchor - first).astype(np.uint64))
            own = owner[first] if len(first) else np.zeros(0, int)
            out["text"] = texts[own]
            out["first"] = first + cut - offsets[own]
            out["last"] = last - first
            out["anchor"] = anchor - first
            yield out


def suffix_order(entries: np.ndarray) -> np.ndarray:
    """Entries in the order of their suffixes: fingerprint of the anchor, then of the run."""
    return entries[np.lexsort((entries["region"], entries["key"]))]


def _condensed(entries: np.ndarray) -> np.ndarray:
    """A batch in suffix order, with what its own entries say of each other."""
    entries = suffix_order(entries)
    if not len(entries):
        return entries
    key, region = entries["key"], entries["region"]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new_run = new_key | np.concatenate(([True], region[1:] != region[:-1]))
    many_keys = np.add.reduceat(np.ones(len(key), int), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] > 1
    many_runs = np.add.reduceat(np.ones(len(key), int), np.flatnonzero(new_run))[np.cumsum(new_run) - 1] > 1
    entries["state"] = np.maximum(entries["state"], np.where(many_runs, WHOLE, np.where(many_keys, SHARED, ALONE)))
    return entries


@dataclass
class Family:
    """Levels of suffix arrays: each new one is scanned against all, equal sizes merge.

    A level has the size of its batches times a power of two; two levels of one
    power become one of the next. So there are about log2(batches) levels and
    each entry is merged as often.
    """

    levels: dict[int, np.ndarray]

    @staticmethod
    def _scan(new: np.ndarray, old: np.ndarray) -> None:
        """Merge scan of two suffix arrays; marks long matches on both sides."""
        for a, b in ((new, old), (old, new)):
            at = np.minimum(np.searchsorted(b["key"], a["key"]), len(b) - 1)
            shared = b["key"][at] == a["key"]
            a["state"][shared] = np.maximum(a["state"][shared], SHARED)
            some = np.flatnonzero(shared & (a["state"] < WHOLE))
            # Runs only match under one key, so the few shared ones are looked up.
            whole = np.isin(mix(a["key"][some]) ^ a["region"][some], mix(b["key"]) ^ b["region"])
            a["state"][some[whole]] = WHOLE

    def add(self, batch: np.ndarray) -> None:
        if not len(batch):
            return
        for level in self.levels.values():
            self._scan(batch, level)
        power = 0
        while power in self.levels:
            batch = suffix_order(np.concatenate((self.levels.pop(power), batch)))
            power += 1
        self.levels[power] = batch

    def gather(self, batches: list[np.ndarray]) -> None:
        """Add batches of one bucket, small ones together.

        A bucket keeps its size as the input grows, but gets a batch from every
        stretch of the input; added one by one, each would be scanned against
        the whole bucket.
        """
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ARRAY_ENTRIES:
                self.add(_condensed(np.concatenate(held)))
                held, size = [], 0
        if held:
            self.add(_condensed(np.concatenate(held)))

    def entries(self) -> np.ndarray:
        parts = [*self.levels.values()] or [np.zeros(0, _ENTRY)]
        return np.concatenate(parts)


# Spark stages of the index

_BLOB = "bucket int, level int, blob binary"
_MATCH = "bucket int, level int, blob binary, text long, state int, key long, first long, last int, anchor int"


#: Level of entries that are matches already and only pass through.
PASSED = -1


def _blob_rows(entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A condensed batch cut by bucket: one entry of each run, in suffix order.

    The other entries of equal runs are matches already. They pass through with
    the level ``PASSED``, dealt by text and place, not by their anchor.
    """
    entries = entries[np.lexsort((entries["first"], entries["text"], entries["region"], entries["key"]))]

    def fresh(*names: str) -> np.ndarray:
        new = np.ones(len(entries), bool)
        if len(entries):
            new[1:] = np.any([entries[n][1:] != entries[n][:-1] for n in names], axis=0)
        return new

    run = fresh("key", "region")
    # Rows of one text have the same runs; one entry speaks for them all.
    other = fresh("key", "region", "text", "first") & ~run
    passed = mix(entries["text"].astype(np.uint64) + entries["first"].astype(np.uint64))
    found, levels, blobs = [], [], []
    for level, use, dealt in ((None, run, entries["key"]), (PASSED, other, passed)):
        bucket = ((dealt[use] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, bucket = entries[use][order], bucket[order]
        numbers = np.unique(bucket)
        cuts = np.searchsorted(bucket, np.append(numbers, buckets))
        found.extend(numbers)
        levels.extend([level] * len(numbers))
        blobs.extend(own[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), pa.array(levels, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "level", "blob"]
    )


def _batches(buckets: int):
    """Texts to batches of entries. Of equal runs in a batch one entry goes on, marked as whole."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            data, offsets = utf8(batch.column("content"))
            for part in _entries(batch.column("text").to_numpy(zero_copy_only=False), data, offsets):
                held.append(part)
                size += len(part)
                if size >= BATCH_ENTRIES:
                    yield _blob_rows(_condensed(np.concatenate(held)), buckets)
                    held, size = [], 0
        if size:
            yield _blob_rows(_condensed(np.concatenate(held)), buckets)

    return run


def _match_rows(entries: np.ndarray, state: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), _MATCHES):
        own = entries[at : at + _MATCHES]
        n = len(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.binary()),
                pa.array(own["text"]),
                pa.array(np.full(n, state, np.int32)),
                pa.array(own["key"].copy().view(np.int64)),
                pa.array(own["first"]),
                pa.array(own["last"]),
                pa.array(own["anchor"]),
            ],
            [f.split()[0] for f in _MATCH.split(", ")],
        )


def _level_row(bucket: int, level: int, blob: bytes) -> pa.RecordBatch:
    blank = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([level], pa.int32()), pa.array([blob], pa.binary()), *blank],
        [f.split()[0] for f in _MATCH.split(", ")],
    )


def _families(keep_levels: bool, references: bool):
    """Rows sorted by bucket to the matches of each bucket, and its levels if they are kept.

    Null levels are new batches; entries that are matches already pass through
    and are not held. With ``references``, of a whole run whose anchor
    also stands in runs of other content one entry is given as SHARED, to be
    compared with those.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, family, batches = None, Family({}), []
        passed, size = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            family.gather(batches)
            found = suffix_order(family.entries())
            hit = found[found["state"] == WHOLE]
            out = [(hit, WHOLE)]
            part = found[found["state"] == SHARED]
            if len(part) and references:
                beside = hit[np.isin(hit["key"], part["key"])]
                fresh = np.ones(len(beside), bool)
                fresh[1:] = (beside["region"][1:] != beside["region"][:-1]) | (beside["key"][1:] != beside["key"][:-1])
                part = np.concatenate((part, beside[fresh]))
            out.append((part, SHARED))
            for entries, state in out:
                yield from _match_rows(entries, state)
            if keep_levels:
                for level, entries in family.levels.items():
                    yield _level_row(bucket, level, entries.tobytes())

        for part in rows:
            for now, level, blob in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if now != bucket:
                    if bucket is not None:
                        yield from closed()
                    bucket, family, batches = now, Family({}), []
                entries = np.frombuffer(blob, _ENTRY).copy()
                if level == PASSED:
                    passed.append(entries)
                    size += len(entries)
                    if size >= _MATCHES:
                        yield from _match_rows(np.concatenate(passed), WHOLE)
                        passed, size = [], 0
                    if keep_levels:
                        yield _level_row(bucket, PASSED, blob)
                elif level is None:
                    batches.append(entries)
                else:
                    family.levels[level] = entries
        if bucket is not None:
            yield from closed()
        if passed:
            yield from _match_rows(np.concatenate(passed), WHOLE)

    return run


def index_texts(texts: DataFrame, buckets: int, levels: DataFrame | None = None, keep_levels: bool = False, references: bool = True) -> DataFrame:
    """Add texts (text: a long that names the content; content) to an index family.

    ``levels`` is the family so far, as (bucket, level, blob); the result has the
    matches of all entries, old and new, and with ``keep_levels`` the levels to
    go on with. The number of buckets must stay the same.
    """
    blobs = texts.mapInArrow(_batches(buckets), _BLOB)
    if levels is not None:
        blobs = blobs.unionByName(levels.select("bucket", "level", "blob"))
    dealt = blobs.repartition("bucket").sortWithinPartitions("bucket", F.col("level").isNull())
    return materialize(dealt.mapInArrow(_families(keep_levels, references), _MATCH))


# Exact comparison of runs that share an anchor but not all bytes


def repeated_windows(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of windows of ``LENGTH`` bytes that occur at two places or more.

    Suffixes are ranked by prefix doubling, from 8 bytes to 128; a window is two
    overlapping strings of 128. ``ends`` bounds the text of each place.
    """
    n = len(data)
    starts = np.flatnonzero(np.arange(n) + LENGTH <= ends)
    if not len(starts):
        return starts
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    _, rank = np.unique(word, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 8
    while width < 128:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64)
        width *= 2
    order = starts[np.lexsort((rank[starts + LENGTH - 128], rank[starts]))]
    same = (rank[order[1:]] == rank[order[:-1]]) & (rank[order[1:] + LENGTH - 128] == rank[order[:-1] + LENGTH - 128])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return np.sort(order[hit])


_PIECE = "bucket int, level int, blob binary, key long, text long, first long, content binary"


def _cut_runs(buckets: int):
    """Joined rows to the bytes of their runs; runs of hot anchors to windows for the index."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held, plain = [], {"key": [], "text": [], "first": [], "content": []}
            for text, content, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "content", "runs")), strict=True):
                data = content.encode()
                for r in runs:
                    own = data[r["first"] : r["first"] + r["last"] + LENGTH]
                    if not r["hot"]:
                        for name, value in (("key", r["key"]), ("text", text), ("first", r["first"]), ("content", own)):
                            plain[name].append(value)
                        continue
                    hashed = Hashed(np.frombuffer(own, np.uint8))
                    keys = hashed.windows(LENGTH)
                    entry = np.zeros(len(keys), _ENTRY)
                    entry["key"] = keys
                    entry["region"] = mix(keys)
                    entry["text"] = text
                    entry["first"] = r["first"] + np.arange(len(keys))
                    held.append(entry)
            if plain["key"]:
                n = len(plain["key"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                        pa.array(plain["key"], pa.int64()),
                        pa.array(plain["text"], pa.int64()),
                        pa.array(plain["first"], pa.int64()),
                        pa.array(plain["content"], pa.binary()),
                    ],
                    [f.split()[0] for f in _PIECE.split(", ")],
                )
            if held:
                found = _blob_rows(_condensed(np.concatenate(held)), buckets)
                blank = [pa.nulls(found.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*found.columns, *blank], [f.split()[0] for f in _PIECE.split(", ")])

    return run


def _compare_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of runs, sorted by anchor, to the windows among them that repeat."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def closed() -> pa.RecordBatch:
        distinct: dict[tuple[int, bytes], tuple[int, int]] = {}
        for key, text, first, content in held:
            # Runs of equal content under one anchor match as a whole elsewhere.
            distinct.setdefault((key, content), (text, first))
        contents = [c for _, c in distinct]
        lengths = np.array([len(c) for c in contents])
        ends = np.cumsum(lengths)
        hits = repeated_windows(np.frombuffer(b"".join(contents), np.uint8), np.repeat(ends, lengths))
        owner = np.searchsorted(ends, hits, side="right")
        where = list(distinct.values())
        texts = np.array([t for t, _ in where], np.int64)[owner]
        firsts = np.array([f for _, f in where], np.int64)[owner] + hits - (ends - lengths)[owner]
        new = np.ones(len(hits), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hits[1:] != hits[:-1] + 1)
        at = np.flatnonzero(new)
        counts = np.diff(at, append=len(hits))
        return pa.RecordBatch.from_arrays(
            [pa.array(texts[at]), pa.array(firsts[at]), pa.array((counts - 1).astype(np.int32))], ["text", "first", "last"]
        )

    last_key = None
    for batch in rows:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "first", "content")), strict=True):
            if size > ARRAY_BYTES and row[0] != last_key:
                yield closed()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last_key = row[0]
    if held:
        yield closed()


def _removed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the starts of repeated windows to what is left of them."""
    for batch in rows:
        out = {"n_bytes": [], "spans": [], "kept": []}
        for content, windows in zip(batch.column("content").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            data = content.encode()
            spans: list[list[int]] = []
            for first, last in sorted((w["first"], w["first"] + w["last"] + LENGTH) for w in windows or ()):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last)
                else:
                    spans.append([first, last])
            kept, at = [], 0
            for first, last in spans:
                kept.append(data[at:first])
                at = last
            kept.append(data[at:])
            out["n_bytes"].append(len(data))
            out["spans"].append([{"first": a, "last": b} for a, b in spans])
            out["kept"].append(b"".join(kept))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())],
            ["id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: texts without repeated strings.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts
    elsewhere in the table, the same text included; overlaps count and strings
    are judged on the input. ``spans`` are the maximal removed byte ranges,
    ``kept`` the remaining bytes.

    1. Batches of texts become suffix arrays over anchors and join the index
       family of each hash bucket, which finds entries that share an anchor and
       runs that are equal as a whole (64-bit hashes of anchor and of run).
    2. For runs that share only the anchor the bytes are fetched, and byte suffix
       arrays find the repeated windows. An anchor with very many different runs
       is not gathered: its windows go through a second index family instead,
       which spreads them by their own hashes.

    A null or empty text has no bytes. Repeated rows repeat each other's bytes.
    A text shorter than ``LENGTH`` stays. An empty table gives no rows. Other
    columns are ignored. Texts are named by a 64-bit hash.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("content")
    )
    long = texts.filter(F.octet_length("content") >= LENGTH).select("text", "content")
    # Runs have about (LENGTH - ANCHOR) / 2 windows.
    size = long.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(1, math.ceil(size / ((LENGTH - ANCHOR) / 2) / BUCKET_ENTRIES))
    found = index_texts(long, buckets)
    whole = found.filter(F.col("state") == WHOLE).select("text", "first", "last")
    part = found.filter(F.col("state") == SHARED).select("text", "key", "first", "last")
    hot = part.groupBy("key").agg((F.count("*") > _HOT).alias("hot"))
    marked = materialize(part.join(hot, "key"))
    # Windows of hot anchors are many more than anchors, so their index has buckets of its own.
    many = marked.filter("hot").agg(F.sum(F.col("last").cast("long") + 1)).first()[0] or 0
    window_buckets = max(1, math.ceil(many / BUCKET_ENTRIES))
    runs = marked.groupBy("text").agg(F.collect_list(F.struct("key", "first", "last", "hot")).alias("runs"))
    cut = materialize(long.join(runs, "text").mapInArrow(_cut_runs(window_buckets), _PIECE))
    plain = cut.filter(F.col("content").isNotNull()).select("key", "text", "first", "content")
    compared = plain.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_runs, "text long, first long, last int")
    windows = cut.filter(F.col("blob").isNotNull()).select("bucket", "level", "blob")
    again = windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_families(False, False), _MATCH)
    again = again.filter(F.col("state") == WHOLE).select("text", "first", "last")
    ranges = whole.unionByName(compared).unionByName(again).groupBy("text").agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    joined = texts.join(ranges, "text", "left").select("id", "content", "windows")
    kind = texts.schema["id"].dataType.simpleString()
    spans = "array<struct<first: bigint, last: bigint>>"
    return joined.mapInArrow(_removed, f"id {kind}, n_bytes long, spans {spans}, kept binary").withColumnRenamed("id", id_col)
