"""Quality rules on repetition, found with word suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import WORD, pack_row, unpack_row

#: Words that share one suffix array; a longer text has an array of its own.
ARRAY_WORDS = 400_000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Least words of a text, and what repetition may cover.

    A repeat is a run of at least ``repeat_words`` words that occurs twice or
    more. Repeats may cover at most ``covered`` of the words, and the longest
    may have at most ``longest_words`` words or ``longest_share`` of the text,
    whichever is more.
    """

    least_words: int = 10
    window: int = 5
    window_percent: int = 20
    repeat_words: int = 8
    covered: float = 0.15
    longest_words: int = 60
    longest_share: float = 0.1


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by prefix doubling, and the ranks of every level.

    ``tokens`` are whole numbers; level k ranks the suffixes by their first
    2**k tokens. A level sorts only suffixes that still tie.
    """
    n = len(tokens)
    _, first, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    # The rank of a suffix is the number of suffixes in smaller groups.
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = starts[first].astype(np.int64)
    levels = [rank.astype(np.int32)]
    active = np.flatnonzero(counts[first] > 1)
    width = 1
    while len(active):
        ahead = active + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        head = rank[active]
        order = np.argsort(head * (n + 1) + second, kind="stable")
        head, second = head[order], second[order]
        new_group = np.concatenate(([True], head[1:] != head[:-1]))
        new_rank = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(order))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        rank_start = np.maximum.accumulate(np.where(new_rank, at, 0))
        rank = rank.copy()
        rank[active[order]] = head + rank_start - group_start
        sizes = np.diff(np.concatenate((np.flatnonzero(new_rank), [len(order)])))
        tied = np.repeat(sizes > 1, sizes)
        levels.append(rank.astype(np.int32))
        active = np.sort(active[order][tied])
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix length of each suffix in order with the one before it."""
    n = len(order)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    left, right = order[:-1].copy(), order[1:].copy()
    length = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        inside = (left < n) & (right < n)
        same = inside & (rank[np.minimum(left, n - 1)] == rank[np.minimum(right, n - 1)])
        step = same * (1 << level)
        length += step
        left += step
        right += step
    common[1:] = length
    return common


def longest_repeats(tokens: np.ndarray) -> np.ndarray:
    """At each place, the longest run from there that also starts elsewhere.

    The longest common prefix with either neighbour in the suffix array, which
    is the value of the innermost prefix interval that holds the suffix.
    """
    order, levels = suffix_array(tokens)
    common = neighbour_prefixes(order, levels)
    best = np.maximum(common, np.concatenate((common[1:], [0])))
    out = np.empty(len(tokens), np.int64)
    out[order] = best
    return out


def _covered(starts_at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Places inside the union of the spans [place, place + reach)."""
    if not len(reach):
        return np.zeros(0, bool)
    return np.maximum.accumulate(np.where(reach > 0, starts_at + reach, 0)) > starts_at


def _tokens(words: list[list[str]]) -> np.ndarray:
    """Numbers for words such that texts share none, so no repeat leaves a text."""
    out, base = [], 0
    for own in words:
        known: dict[str, int] = {}
        out += [base + known.setdefault(w, len(known)) for w in own]
        base += len(known)
    return np.array(out, np.int64)


def repeat_spans(text: str | None, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Word spans [start, end) of a text that the union of its repeats covers."""
    words = re.findall(WORD, text or "")
    if not words:
        return []
    longest = longest_repeats(_tokens([words]))
    at = np.arange(len(words))
    inside = _covered(at, np.where(longest >= limits.repeat_words, longest, 0))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line in seen:
            count += bool(re.search(WORD, line))
        else:
            seen.add(line)
    return count


_MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeated_words long, longest_repeat long, n_repeats long, base_failed boolean, kept boolean"
)


def measure(texts: list[str | None], limits: Limits) -> list[dict]:
    """All measures and the verdict for some texts, with one suffix array for all."""
    finder = re.compile(WORD)
    words = [finder.findall(t or "") for t in texts]
    tokens = _tokens(words)
    longest = longest_repeats(tokens) if len(tokens) else np.zeros(0, np.int64)
    at = np.arange(len(tokens))
    window = _covered(at, np.where(longest >= limits.window, limits.window, 0))
    reach = np.where(longest >= limits.repeat_words, longest, 0)
    spans = _covered(at, reach)
    # A repeat starts where the one a word earlier does not just contain it.
    starts = (reach > 0) & np.concatenate(([True], reach[1:] >= reach[:-1]))[: len(reach)]
    ends = np.cumsum([len(w) for w in words])
    out = []
    for text, own, end in zip(texts, words, ends, strict=True):
        part = slice(int(end) - len(own), int(end))
        n = len(own)
        again = int(window[part].sum())
        covered = int(spans[part].sum())
        most = int(reach[part].max()) if n else 0
        failed = n < limits.least_words or 100 * again > limits.window_percent * n
        out.append(
            {
                "n_words": n,
                "word_chars": sum(map(len, own)),
                "n_symbols": sum(map((text or "").count, SYMBOLS)),
                "n_dup_lines": _dup_lines(text or ""),
                "n_repeat_words": again,
                "repeated_words": covered,
                "longest_repeat": most,
                "n_repeats": int(starts[part].sum()),
                "base_failed": failed,
                "kept": not failed
                and covered <= limits.covered * n
                and most <= max(limits.longest_words, limits.longest_share * n),
            }
        )
    return out


def _measurer(limits: Limits, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            results, pending, size = [], [], 0
            for text in texts:
                # A text has at most half as many words as characters.
                own = len(text or "") // 2 + 1
                if pending and size + own > 3 * ARRAY_WORDS:
                    results += measure(pending, limits)
                    pending, size = [], 0
                pending.append(text)
                size += own
            if pending:
                results += measure(pending, limits)
            columns = [batch.column("key")] + [pa.array([r[f.name] for r in results], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("key", batch.schema.field("key").type), *list(schema)[1:]]))

    return run


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([pa.field("key", pa.null())] + [pa.field(n, kinds[k]) for n, k in (f.split() for f in _MEASURES.split(", "))])


def quality_report(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measures and ``kept``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line) and
    ``n_repeat_words`` (words in windows of ``window`` words found twice or
    more) are the base. ``repeated_words`` is the union of the spans of all
    repeats, ``longest_repeat`` the longest, ``n_repeats`` their number.
    ``base_failed``: too few words, or too many in repeated windows. ``kept``
    is false then, and else says that repeats stay within :class:`Limits`.

    A null or empty text has no words and fails. Rows are independent, so no
    shuffle is needed; equal rows get equal answers. An empty table gives no
    rows. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(_measurer(limits, _arrow_schema()), f"key {kind}, {_MEASURES}").withColumnRenamed("key", id_col)


def _keeper(limits: Limits):
    @F.pandas_udf("boolean")
    def keep(texts):
        import pandas as pd

        results, pending, size = [], [], 0
        for text in texts:
            own = len(text or "") // 2 + 1
            if pending and size + own > 3 * ARRAY_WORDS:
                results += measure(pending, limits)
                pending, size = [], 0
            pending.append(text)
            size += own
        if pending:
            results += measure(pending, limits)
        return pd.Series([r["kept"] for r in results], dtype=bool)

    return keep


def keep_quality(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_report` keeps, columns unchanged."""
    rows = docs.select(pack_row(docs), _keeper(limits)(F.col(text_col)).alias("keep")).filter("keep")
    return unpack_row(rows, docs.columns)
