"""Line de-duplication: two Bloom filters pick suspects, a shuffle confirms them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import SPACES, lower_ascii, pack_row, unpack_row
from spanledger.session import materialize

#: A filter has about this many bits for each document, a power of two between the limits.
BITS_PER_DOCUMENT = 1024
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Shortest key, in code points, that is looked at.
LEAST_KEY = 10
_CHUNK = 1 << 16  # bytes of a filter that are merged together
_NO_TEXT = ""


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit(_NO_TEXT)), "\n")


def line_key(line: Column) -> Column:
    """A line without spaces at both ends and with A to Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each 64-bit hash."""
    mask = np.uint64(bits - 1)
    h = hashes.view(np.uint64)
    return h & mask, ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask


def _get(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def _put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _filler(bits: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
            hashes, counts = np.unique(values, return_counts=True)
            first, second = _positions(hashes, bits)
            again = (counts > 1) | ((_get(once, first) & _get(once, second)) == 1)
            _put(twice, first[again])
            _put(twice, second[again])
            _put(once, first)
            _put(once, second)
        for start in range(0, bits // 8, _CHUNK):
            part = once[start : start + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([start // _CHUNK], pa.int32()),
                        "once": pa.array([zlib.compress(part, 1)], pa.binary()),
                        "twice": pa.array([zlib.compress(twice[start : start + _CHUNK], 1)], pa.binary()),
                    }
                )

    return fill


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: seen twice in a task, or seen in two tasks. Input is sorted by chunk."""
    chunk, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"chunk": pa.array([chunk], pa.int32()), "twice": pa.array([zlib.compress(twice, 1)], pa.binary())}
        )

    for batch in parts:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
            if row["chunk"] != chunk:
                if chunk is not None and twice.any():
                    yield closed()
                chunk, once, twice = row["chunk"], a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if chunk is not None and twice.any():
        yield closed()


def twice_filter(hashes: DataFrame, bits: int) -> bytes:
    """Bloom filter of the hashes (one column, arrays of longs) that occur at least twice.

    Each task fills a filter of what it saw and one of what it saw again. Merged,
    a bit counts as seen twice if a task saw it twice or two tasks saw it once;
    this covers every hash seen twice and a few more. The result has ``bits``
    bits, at most ``MOST_BITS`` (32 MB), so it may be broadcast.
    """
    parts = hashes.mapInArrow(_filler(bits), "chunk int, once binary, twice binary")
    merged = (
        parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge, "chunk int, twice binary").toLocalIterator()
    )
    out = bytearray(bits // 8)
    for row in merged:
        start = row["chunk"] * _CHUNK
        data = zlib.decompress(row["twice"])
        out[start : start + len(data)] = data
    return bytes(out)


def _suspects(shared, bits: int):
    """Rows (id, check, text, hashes) to the suspected lines with the digests of their keys."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            lists = batch.column("hashes")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten()
            known = ~values.is_null().to_numpy(zero_copy_only=False)
            first, second = _positions(values.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = np.flatnonzero(known & ((_get(filter_, first) & _get(filter_, second)) == 1))
            starts = np.concatenate(([0], np.cumsum(counts)))
            rows = np.searchsorted(starts, hit, side="right") - 1
            lines = hit - starts[rows]
            digests, last, split = [], -1, []
            for row, line in zip(rows.tolist(), lines.tolist(), strict=True):
                if row != last:
                    last, split = row, batch.column("text")[row].as_py().encode().split(b"\n")
                # Bytes lower-case A to Z only.
                digests.append(hashlib.sha256(split[line].strip(SPACES.encode()).lower()).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("check").take(at), pa.array(lines, pa.int32()), pa.array(digests, pa.binary())],
                ["id", "check", "line", "digest"],
            )

    return find


def filter_bits(rows: int, per_row: int = BITS_PER_DOCUMENT) -> int:
    wanted = max(LEAST_BITS, rows * per_row)
    return min(MOST_BITS, 1 << (wanted - 1).bit_length())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop, as (id, check, lines): their places in each affected text.

    A key of at least ``LEAST_KEY`` code points found under at least two ids
    stays only under the smallest one. Every line is hashed into the filters;
    only lines that the second filter holds travel, and SHA-256 of the key
    decides. ``check`` is a hash of the text: rows that share an id but not the
    text are told apart, equal rows get equal answers.
    """
    text = F.col(text_col)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= LEAST_KEY, F.xxhash64(key))

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("check"),
        F.coalesce(text, F.lit(_NO_TEXT)).alias("text"),
        F.transform(lines_of(text), hashed).alias("hashes"),
    )
    bits = filter_bits(docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(rows.select("hashes"), bits))
    kind = rows.schema["id"].dataType.simpleString()
    suspects = materialize(rows.mapInArrow(_suspects(shared, bits), f"id {kind}, check long, line int, digest binary"))
    found = suspects.groupBy("digest").agg(
        F.min("id").alias("keeper"), F.max("id").alias("other"), F.max(F.col("id").isNull()).alias("nameless")
    )
    # A null id counts as one document after all others.
    found = found.filter((F.col("keeper") != F.col("other")) | (F.col("keeper").isNotNull() & F.col("nameless"))).select("digest", "keeper")
    losing = suspects.join(found, "digest").filter(F.col("id").isNull() | (F.col("id") > F.col("keeper")))
    return losing.groupBy("id", "check").agg(F.collect_set("line").alias("lines"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the places of their dropped lines."""
    drops = repeated_lines(docs, id_col, text_col)
    rows = docs.select(pack_row(docs), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("check"))
    same = rows["id"].eqNullSafe(drops["id"]) & (rows["check"] == drops["check"])
    return rows.join(drops, same, "left").select("__row", "lines")


def _kept_text(text: Column, drops: Column) -> Column:
    lines = lines_of(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    return F.when(drops.isNull(), F.coalesce(text, F.lit(_NO_TEXT))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines; same rows and columns, shorter texts.

    See :func:`repeated_lines` for the rule. A text without a dropped line
    stays as it is, null included. A text whose lines all go becomes empty.
    Rows with the same id are one document. An empty table stays empty.
    """
    text = F.col(f"__row.{text_col}")
    rows = _with_drops(docs, id_col, text_col).select(
        F.when(F.col("lines").isNull(), F.col("__row"))
        .otherwise(F.col("__row").withField(text_col, _kept_text(text, F.col("lines"))))
        .alias("__row")
    )
    return unpack_row(rows, docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines before, n_dropped and the kept text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.col("__row.text")
    return _with_drops(slim, "doc_id", "text").select(
        F.col("__row.doc_id").alias(id_col),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept_text(text, F.col("lines")).alias("kept"),
    )
