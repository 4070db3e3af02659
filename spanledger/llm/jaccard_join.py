"""Near-duplicate join on word shingles: T-occurrence search with DivideSkip."""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.bytearrays import LOWER, mix, pieces, utf8, word_hashes, word_spans
from spanledger.llm.common import key_text, pack_row, unpack_row
from spanledger.llm.components import connected_components
from spanledger.session import materialize

#: Words of a shingle and the least similarity, in percent.
WORDS, PERCENT = 5, 80
#: Frequent shingles that are told apart, a bound on what is broadcast, and texts that hold them at least.
FREQUENT, OFTEN = 1 << 16, 50
#: Shingles of one search task; larger candidate groups are cut into blocks.
TASK_SHINGLES = 4_000_000
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Signatures that a task holds before it works on them.
_HELD = 1_000_000
#: Signatures of a mean text, and of a bucket in which they meet.
_POSTINGS, _BUCKET = 150, 500_000
#: A set shares at least a signature for so many shingles with a partner.
_SPARE = 64
#: Mean shingles of a part of the largest sets of a level, by attempt.
_MEANS = (2.8, 2.5, 3.1, 2.2)
#: Entries of short lists that are merged with a heap.
_HEAPED = 50
#: Members from which a cluster keeps places.
_LARGE = 16
#: Links of a row batch.
_LINKS = 50_000


# Shingle sets


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, cuts, words): the sorted distinct shingles of text i are hashes[cuts[i]:cuts[i + 1]], its words words[i].

    Texts are UTF-8 bytes. A text with fewer words than ``width`` has its whole
    word sequence as one shingle; one without words has none.
    """
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(LOWER[data], starts, ends)
    n = len(offsets) - 1
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(n), counts)
    hashes = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        hashes = hashes * _FACTOR + words[i : i + len(hashes)]
    owners = owner[: len(hashes)]
    inside = owners == owner[width - 1 : width - 1 + len(hashes)]
    hashes, owners = mix(hashes[inside]), owners[inside]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = counts[few].astype(np.uint64)
        for i in range(width - 1):
            more = i < counts[few]
            whole[more] = whole[more] * _FACTOR + words[firsts[few[more]] + i]
        owners = np.concatenate((owners, few))
        order = np.argsort(owners, kind="stable")
        hashes, owners = np.concatenate((hashes, mix(whole)))[order], owners[order]
    hashes = hashes.view(np.int64)
    bounds = np.searchsorted(owners, np.arange(n + 1)).tolist()
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - start > 1:
            hashes[start:end].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[fresh], owners[fresh]
    return hashes, np.searchsorted(owners, np.arange(n + 1)), counts


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``shingles`` of all texts, some at a time, in order."""
    data, offsets = utf8(column)
    for start, end in pieces(offsets):
        part = offsets[start : end + 1]
        with np.errstate(over="ignore"):
            yield shingles(data[part[0] : part[-1]], part - part[0])


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of every text."""
    for hashes, cuts, _ in _parts(column):
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield hashes[start:end]


def least_overlap(n: int) -> int:
    """Shingles that a set of ``n`` shares with any partner that is not larger: PERCENT of n, rounded up."""
    return -(-n * PERCENT // 100)


def _compatible(small: int, large: int) -> bool:
    """Sizes of linked sets: the smaller holds PERCENT of the larger at least."""
    return 100 * small >= PERCENT * large


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


# Candidate groups


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles found in three texts or more of a stretch of a task's rows."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts > 2
        return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often].astype(np.int64))], ["shingle", "texts"])

    for batch in batches:
        for hashes, _, _ in _parts(batch.column("text")):
            held.append(hashes)
            size += len(hashes)
            if size > _HELD:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted. They only choose signatures; any answer gives the same links."""
    counted = texts.mapInArrow(_count_frequent, "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    top = counted.filter(F.col("texts") >= OFTEN).orderBy(F.desc("texts"), "shingle").limit(FREQUENT).toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64))


def _level(n: np.ndarray) -> np.ndarray:
    """Power of two that bounds a size."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def most_apart(n: np.ndarray) -> np.ndarray:
    """Shingles that only one of two linked sets has, at most, if one of them has ``n``: the other has 100 n / PERCENT at most."""
    return (n + n * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def least_meetings(n):
    """Signatures that a set has beyond those that a partner of it may lack, so that it shares as many with each."""
    return np.maximum(1, n // _SPARE)


def _cut(hashes: np.ndarray, rare: np.ndarray, counts: np.ndarray, parts: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, size, whether one is rare, signature) of what each text has in each of ``parts`` ranges of hashes, where it has something."""
    owner = np.repeat(np.arange(len(counts)), counts)
    unsigned = hashes.view(np.uint64)
    # Hashes are sorted as signed numbers, and so are their ranges.
    high = (unsigned ^ np.uint64(1 << 63)) >> np.uint64(32)
    part = (high * parts.astype(np.uint64)[owner]) >> np.uint64(32)
    edge = np.ones(len(hashes), bool)
    edge[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    text = owner[first]
    name = mix((salt.astype(np.uint64)[text] << np.uint64(32)) + part[first])
    sums = np.add.reduceat(unsigned, first) if len(first) else unsigned
    some = np.logical_or.reduceat(rare, first) if len(first) else rare
    return text, np.diff(first, append=len(hashes)), some, mix(sums ^ name)


def signatures(hashes: np.ndarray, cuts: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature): of two linked sets that are not equal, one shares its ``least_meetings`` with the other at least.

    A level (a bound on sizes) cuts all hashes into ranges, and a signature names
    what a set has in one range. Linked sets differ in ``most_apart`` shingles,
    so in as many ranges at most. A set with so many more ranges of two shingles or more
    has some of these in common with each partner, and gives these alone:
    other texts rarely share all that they have in a range. A set with fewer
    gives them too and goes on to other ranges, in the end to those with one
    shingle. Of two partners the one that has enough first decides, and both
    have given that level's ranges. A set goes to its own level and to that of
    its largest partner.

    With ``frequent`` shingles, ranges that hold others too are tried first:
    texts that share common lines alone do not meet in these.
    """
    n = np.diff(cuts)
    rare = np.ones(len(hashes), bool)
    tries = [(mean, 2, False) for mean in _MEANS] + [(1.0, 1, False)]
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes
        tries = [(mean, 2, True) for mean in _MEANS] + tries
    apart = most_apart(n)
    least = apart + least_meetings(n)
    own, up = _level(n), _level(n * 100 // PERCENT)
    texts, found = [], []
    for step in range(int((up - own).max(initial=0)) + 1):
        level = own + step
        left = np.flatnonzero((apart > 0) & (level <= up))
        for attempt, (mean, fewest, mixed) in enumerate(tries):
            if not len(left):
                break
            counts = n[left]
            at = np.repeat(cuts[left] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            parts = np.maximum(2, (np.exp2(level[left]) / mean).astype(np.int64))
            text, size, some, signature = _cut(hashes[at], rare[at], counts, parts, level[left] * 16 + attempt)
            use = (size >= fewest) & (some | (not mixed))
            texts.append(left[text[use]])
            found.append(signature[use])
            left = left[np.bincount(text[use], minlength=len(left)) < least[left]]
        # All shingles in so few ranges: these sets meet by their level.
        many = np.maximum(1, np.exp2(level[left]).astype(np.int64) // _SPARE)
        texts.append(np.repeat(left, many))
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append(mix((np.repeat(level[left], many) << 32 | place).astype(np.uint64)))
    return np.concatenate(texts), np.concatenate(found)


_POSTING = np.dtype([("signature", "<u4"), ("node", "<i8")])


def _meetings(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the first entry of each signature, and of those with several nodes: smallest node, node).

    Signatures are sorted; a node counts once for each.
    """
    new = np.ones(len(signature), bool)
    new[1:] = signature[1:] != signature[:-1]
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(signature))
    several = np.flatnonzero(np.repeat(length > 1, length))
    own, number = node[several], np.repeat(np.arange(len(first)), length)[several]
    order = np.lexsort((own, number))
    own, number = own[order], number[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    own, number = own[fresh], number[fresh]
    heads = np.flatnonzero(np.diff(number, prepend=-1))
    length = np.diff(heads, append=len(number))
    mixed = np.repeat(length > 1, length)
    return first, np.repeat(own[heads], length)[mixed], own[mixed]


_FOUND = "id {id}, check long, n int, words long, digest binary, node long, other long, met long, bucket int, blob binary"


def _found_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("id", id_type),
            ("check", pa.int64()),
            ("n", pa.int32()),
            ("words", pa.int64()),
            ("digest", pa.binary()),
            ("node", pa.int64()),
            ("other", pa.int64()),
            ("met", pa.int64()),
            ("bucket", pa.int32()),
            ("blob", pa.binary()),
        ]
    )


def _rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _meeting_rows(schema: pa.Schema, least: np.ndarray, node: np.ndarray, edges: bool) -> Iterator[pa.RecordBatch]:
    """Edges, or how many signatures of each node meet another node."""
    if not edges:
        nodes, counts = np.unique(node, return_counts=True)
        if len(nodes):
            yield _rows(schema, {"node": nodes, "met": counts})
        return
    pairs = np.column_stack((least, node))[least != node]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = np.any(pairs[1:] != pairs[:-1], axis=1)
    if len(pairs):
        yield _rows(schema, {"node": pairs[fresh, 0], "other": pairs[fresh, 1]})


def _met(schema: pa.Schema, signature: np.ndarray, node: np.ndarray, buckets: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Signatures of a stretch of rows to its meetings, and to blobs of one node for each signature by ranges of them."""
    order = np.argsort(signature)
    signature, node = signature[order], node[order]
    first, *meetings = _meetings(signature, node)
    yield from _meeting_rows(schema, *meetings, edges)
    signature = signature[first]
    postings = np.zeros(len(first), _POSTING)
    # A bucket is a range; within it 32 other bits tell signatures apart. A false meeting is a candidate that no comparison accepts.
    postings["signature"], postings["node"] = signature & np.uint64(0xFFFFFFFF), node[first]
    bucket = ((signature >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        yield _rows(schema, {"bucket": some.astype(np.int32), "blob": [postings[cuts[i] : cuts[i + 1]].tobytes() for i in some]})


def _scan(schema: pa.Schema, buckets: int, edges: bool, shared=None):
    """Every text to its set's digest; its signatures to meetings in the task and to blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value if shared is not None else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {"n": [], "words": [], "digest": [], "node": []}
            for hashes, cuts, words in _parts(batch.column("text")):
                ends = cuts.tolist()
                fresh = []
                for i, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    digest = hashlib.md5(hashes[start:end]).digest() if end > start else None
                    node = int.from_bytes(digest[:8], "big", signed=True) if digest else None
                    out["n"].append(end - start)
                    out["digest"].append(digest)
                    out["node"].append(node)
                    if digest and node not in seen:
                        seen.add(node)
                        fresh.append((i, node))
                out["words"].extend(words.tolist())
                if not fresh:
                    continue
                texts, nodes = (np.array(x, np.int64) for x in zip(*fresh, strict=True))
                counts = np.diff(cuts)[texts]
                use = np.zeros(len(words), bool)
                use[texts] = True
                own = hashes[np.repeat(use, np.diff(cuts))]
                with np.errstate(over="ignore"):
                    text, signature = signatures(own, np.concatenate(([0], np.cumsum(counts))), frequent)
                held.append((signature, nodes[text]))
                size += len(text)
                if size > _HELD:
                    yield from _met(schema, *(np.concatenate(x) for x in zip(*held, strict=True)), buckets, edges)
                    held, size = [], 0
                    seen.clear()
            if not edges:
                yield _rows(schema, {"id": batch.column("id"), "check": batch.column("check"), **out})
        if held:
            yield from _met(schema, *(np.concatenate(x) for x in zip(*held, strict=True)), buckets, edges)

    return run


def _join_blobs(schema: pa.Schema, edges: bool):
    """Rows sorted by bucket: blobs to meetings between their stretches; other rows pass."""

    def joined(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(b"".join(blobs), _POSTING)
        order = np.argsort(found["signature"])
        _, *meetings = _meetings(found["signature"][order], found["node"][order])
        yield from _meeting_rows(schema, *meetings, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            is_blob = batch.column("bucket").is_valid()
            plain = batch.filter(pc.invert(is_blob))
            if plain.num_rows:
                yield plain
            blobs = batch.filter(is_blob)
            for now, blob in zip(blobs.column("bucket").to_pylist(), blobs.column("blob").to_pylist(), strict=True):
                if now != bucket:
                    if held:
                        yield from joined(held)
                    bucket, held = now, []
                held.append(blob)
        if held:
            yield from joined(held)

    return run


def _meet(texts: DataFrame, rows: int, edges: bool, shared=None) -> DataFrame:
    """Rows of ``_FOUND`` for (id, check, text), written to the shared folder."""
    kind = _FOUND.format(id=texts.schema["id"].dataType.simpleString())
    id_type = texts.sparkSession.createDataFrame([], texts.select("id").schema).toArrow().schema.field("id").type
    schema = _found_schema(id_type)
    buckets = max(1, math.ceil(rows * _POSTINGS / _BUCKET))
    scanned = texts.mapInArrow(_scan(schema, buckets, edges, shared), kind)
    dealt = scanned.repartition(F.coalesce("bucket", F.xxhash64("id", "node", "check"))).sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(_join_blobs(schema, edges), kind))


# Search


def divide_skip(lists: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of what occurs in at least ``least`` of the sorted integer arrays.

    The longest lists are set aside. The short ones are merged with a heap, or
    counted at once where they hold many entries; what occurs often enough there
    is looked up in the long lists by binary search, all candidates together.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(lists) < least or least < 1:
        return none
    lists = sorted(lists, key=len, reverse=True)
    aside = min(least - 1, int(least / (0.0085 * math.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:aside], lists[aside:]
    if sum(map(len, short)) <= _HEAPED:
        numbers, counts = [], []
        for number, group in groupby(heapq.merge(*short)):
            numbers.append(number)
            counts.append(sum(1 for _ in group))
        numbers, counts = np.array(numbers, np.int64), np.array(counts, np.int64)
    else:
        numbers, counts = np.unique(np.frombuffer(b"".join(short), np.int32), return_counts=True)
    for left, own in zip(range(len(long), 0, -1), long, strict=True):
        possible = counts + left >= least
        numbers, counts = numbers[possible], counts[possible]
        if not len(numbers):
            return none
        values = np.frombuffer(own, np.int32)
        at = np.minimum(np.searchsorted(values, numbers), len(values) - 1)
        counts = counts + (values[at] == numbers)
    enough = counts >= least
    return numbers[enough], counts[enough]


class Linker:
    """Sets in order of size, linked as they come.

    Inverted lists hold cluster numbers. A cluster's sets are linked already, so
    one list entry serves all of them: sharing T shingles with some set of a
    cluster needs T shared with their union. Only sets of clusters that reach T
    are compared, and only until one links.
    """

    def __init__(self) -> None:
        self.lists: dict[int, array] = {}
        self.members: list[list[tuple[np.ndarray, object, int]]] = []
        self.parent: list[int] = []
        # Of large clusters: by shingle the places of the members that hold it.
        self.places: dict[int, dict[int, array]] = {}

    def root(self, cluster: int) -> int:
        while self.parent[cluster] != cluster:
            self.parent[cluster] = self.parent[self.parent[cluster]]
            cluster = self.parent[cluster]
        return cluster

    def _note(self, cluster: int, values: list[int]) -> None:
        """Keep the places of a cluster's members once it is large."""
        members = self.members[cluster]
        if len(members) < _LARGE:
            return
        if cluster not in self.places:
            self.places[cluster] = {}
            for at, (own, _, _) in enumerate(members[:-1]):
                for v in own.tolist():
                    self.places[cluster].setdefault(v, array("i")).append(at)
        places = self.places[cluster]
        for v in values:
            places.setdefault(v, array("i")).append(len(members) - 1)

    def _partner(self, cluster: int, own: np.ndarray, values: list[int], n: int) -> int | None:
        """Place of a member that links, the last ones first; members stand in order of size."""
        members = self.members[cluster]
        first = len(members)
        while first and len(members) - first < _LARGE:
            other, _, size = members[first - 1]
            if not _compatible(size, n):
                return None
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            if linked(int((own[at] == other).sum()), n, size):
                return first - 1
            first -= 1
        if not first:
            return None
        # All others at once: how many of the shingles each of them holds.
        places = self.places[cluster]
        lists = [np.frombuffer(places[v], np.int32) for v in values if v in places]
        common = np.bincount(np.concatenate(lists), minlength=len(members)) if lists else np.zeros(len(members), np.int64)
        sizes = np.array([size for _, _, size in members])
        hits = np.flatnonzero(100 * common >= PERCENT * (n + sizes - common))
        return int(hits[-1]) if len(hits) else None

    def add(self, own: np.ndarray, name: object, size: int | None = None) -> list[object]:
        """Link a set, not smaller than those before; returns a linked name of each cluster it joins.

        Elements that no other set has may be left out of ``own``; ``size`` counts them.
        """
        n = len(own) if size is None else size
        values = own.tolist()
        lists = [found for v in values if (found := self.lists.get(v))]
        home, partners = None, []
        for cluster, common in zip(*(x.tolist() for x in divide_skip(lists, least_overlap(n))), strict=True):
            if home is not None and self.root(cluster) == self.root(home):
                continue
            if len(self.members[cluster]) == 1:
                # The count is the exact overlap with its only set.
                found = 0 if linked(common, n, self.members[cluster][0][2]) else None
            else:
                found = self._partner(cluster, own, values, n)
            if found is not None:
                partners.append(self.members[cluster][found][1])
                if home is None:
                    home = cluster
                else:
                    self.parent[self.root(cluster)] = self.root(home)
        if home is None:
            home = len(self.members)
            self.members.append([])
            self.parent.append(home)
        self.members[home].append((own, name, n))
        self._note(home, values)
        for v in values:
            found = self.lists.get(v)
            if found is None:
                self.lists[v] = array("i", [home])
            elif found[-1] != home:
                at = bisect_left(found, home)
                if at == len(found) or found[at] != home:
                    insort(found, home)
        return partners


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task to links between nodes of one task."""
    task, held = None, {}
    a, b = [], []

    def search() -> None:
        if len(held) < 2:
            return
        sets = sorted(held.items(), key=lambda x: (len(x[1]), x[0]))
        sizes = [len(own) for _, own in sets]
        _, number, counts = np.unique(np.concatenate([own for _, own in sets]), return_inverse=True, return_counts=True)
        # A shingle of one set alone meets nothing.
        common = counts[number] > 1
        cuts = np.concatenate(([0], np.cumsum(common)))[np.cumsum([0, *sizes])]
        number = number[common].astype(np.int32)
        linker = Linker()
        for (node, _), size, start, end in zip(sets, sizes, cuts[:-1], cuts[1:], strict=True):
            for other in linker.add(number[start:end], node, size):
                a.append(node)
                b.append(other)

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        sets = _sets(batch.column("text"))
        for now, node, own in zip(batch.column("task").to_pylist(), batch.column("node").to_pylist(), sets, strict=True):
            if now != task:
                search()
                task, held = now, {}
                if len(a) > _LINKS:
                    yield links()
                    a, b = [], []
            held.setdefault(node, own.copy())
    search()
    yield links()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, check, n_shingles, class_id, component_id, n_words) of every row.

    Two texts link when their sets of ``WORDS``-word shingles (A to Z in lower
    case) have a Jaccard similarity of ``PERCENT`` percent or more. ``class_id``
    is the smallest id with the same set, ``component_id`` the smallest id
    reachable by links.

    1. Every text is hashed to its set; equal sets are one node from here on.
       Nodes meet where they share a signature (:func:`signatures`), and a node
       with too few meetings has no partner. This needs no pairs: a frequent
       signature leaves a stretch of rows once.
    2. The texts of the remaining nodes meet again, now for edges and by what they
       share besides frequent shingles. Components of these edges are candidate groups; groups above ``TASK_SHINGLES`` are
       cut into blocks and searched by pairs of blocks.
    3. Within a task, T-occurrence search over inverted lists of clusters finds
       partners; an exact comparison decides.

    A text without words, null included, has no set: n_shingles is 0 and its
    component its own id. A null id is larger than all; repeated rows have
    equal sets. ``check`` is a hash of the text, to tell rows of one id apart.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("check"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _meet(texts, docs.count(), edges=False)
    rows = found.filter(F.col("check").isNotNull()).select("id", "check", "n", "words", "digest", "node")
    met = found.filter(F.col("met").isNotNull()).groupBy("node").agg(F.sum("met").alias("met"))
    # A partner that decides may be smaller, and need fewer meetings.
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / _SPARE))
    # One row of each node brings its text along: repeated rows share id and check.
    chosen = (
        rows.filter(F.col("digest").isNotNull())
        .groupBy("node")
        # A set that only rows without id have still has a text.
        .agg(F.min("id").alias("id"), F.coalesce(F.min_by("check", "id"), F.min("check")).alias("check"), F.min("n").alias("n"))
        .join(met, "node")
        .filter(F.col("met") >= need)
    )
    same = texts["id"].eqNullSafe(chosen["id"]) & (texts["check"] == chosen["check"])
    carried = texts.join(chosen, same).select("node", "n", texts["id"], texts["check"], "text")
    asked = materialize(carried.dropDuplicates(["node"]))
    shared = spark.sparkContext.broadcast(frequent_shingles(asked.select("text")))
    pairs = _meet(asked.select("id", "check", "text"), asked.count(), True, shared)
    groups = connected_components(pairs.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))

    groups = materialize(asked.select("node", "n").join(groups, "node"))
    sizes = groups.groupBy("root").agg(F.sum("n").alias("all"))
    blocks = F.when(F.col("all") > TASK_SHINGLES, F.ceil(2 * F.col("all") / TASK_SHINGLES)).otherwise(1).cast("int")
    placed = groups.join(sizes.select("root", blocks.alias("blocks")), "root").select(
        "node",
        "root",
        F.pmod("node", "blocks").cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    placed = placed.select("node", F.concat_ws(":", "root", F.least("own", "block"), F.greatest("own", "block")).alias("task"))
    dealt = asked.select("node", "text").join(placed, "node").repartition("task").sortWithinPartitions("task", "node")
    links = materialize(dealt.select("task", "node", "text").mapInArrow(_search, "a long, b long"))
    components = connected_components(links)

    classes = rows.filter(F.col("digest").isNotNull()).groupBy("digest", "node").agg(F.min("id").alias("class_id"))
    classes = classes.join(components.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labelled = classes.join(least, "root").select("digest", "class_id", "component_id")
    return rows.join(labelled, "digest", "left").select(
        "id",
        "check",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("words").alias("n_words"),
    )


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts: the smallest id.

    Of rows with equal id and text one stays; rows that share the smallest id
    but not the text are kept apart only if their texts do not link. Texts
    without words stay. Columns are those of ``docs``.
    """
    groups = jaccard_groups(docs, id_col, text_col)
    # Rows of one component with its id: the smallest text hash is the one to stay.
    kept = (
        groups.filter((F.col("n_shingles") > 0) & F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("id", "component_id")
        .agg(F.min("check").alias("check"))
        .select("id", "check")
        .unionByName(groups.filter("n_shingles = 0").select("id", "check").distinct())
    )
    # One text key for ids of any kind, null included, so that join and choice share a partitioning.
    kept = kept.select(key_text(F.col("id")).alias("name"), "check")
    rows = docs.select(pack_row(docs), key_text(F.col(id_col)).alias("name"), F.xxhash64(text_col).alias("check"))
    joined = rows.join(kept, ["name", "check"], "left_semi")
    return unpack_row(joined.dropDuplicates(["name", "check"]), docs.columns)
