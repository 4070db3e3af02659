"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.bytearrays import LOWER, pieces, utf8
from spanledger.session import broadcast_if_small, materialize

#: Code points and occurrences a word has at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 5
#: Of runs with a check sum divisible by this, one code point is deleted.
NOISE = 199
#: Words of a tile, and letters of its words together, on average at most.
TILE_WORDS, TILE_LETTERS = 4096, 1 << 22
#: Letters are put in so many classes; a block holds the words with equal class counts.
CLASSES = 3
#: Cells of a Gram matrix, or letters of candidate words, held at once.
_CELLS = 1 << 21
#: Distinct words counted together before they are sent on.
_HELD = 1 << 18
#: Longest run, in bytes, whose check sum is made beside others'.
_LONG = 64

_A, _Z = ord("a"), ord("z")
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[_A : _Z + 1] = True
#: First byte of U+00C0 to U+00FF in UTF-8; no other code point has it.
_LEAD = 0xC3
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text numbers) of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8 texts."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def check_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, going on from the check sums ``first``."""
    out = np.empty(len(starts), np.uint32)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -_LONG, side="left"))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(first[i]))
    rest = order[long:]
    at, left = starts[rest], lengths[rest]
    state = first[rest].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(int(left[0]) if len(left) else 0):
        # Lengths fall, so the spans that still have a byte come first.
        n = int(np.searchsorted(-left, -k, side="left"))
        part = state[:n]
        state[:n] = _CRC[(part ^ data[at[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[rest] = state ^ np.uint32(0xFFFFFFFF)
    return out


def spans_as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as one string array."""
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[index])))


def _noisy_words(data: np.ndarray, offsets: np.ndarray, prefixes: np.ndarray) -> pa.Array:
    """Words of the texts, as often as they occur; runs that the check sum picks lose a code point."""
    data = LOWER[data]
    starts, ends, owner = letter_runs(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    able = points[ends] - points[starts] >= LEAST_LENGTH
    starts, ends, owner = starts[able], ends[able], owner[able]
    sums = check_sums(data, starts, ends, prefixes[owner])
    picked = sums % NOISE == 0
    words = spans_as_strings(data, starts[~picked], ends[~picked])
    changed = []
    for start, end, h in zip(starts[picked].tolist(), ends[picked].tolist(), sums[picked].tolist(), strict=True):
        word = data[start:end].tobytes().decode()
        at = h % len(word)
        if len(word) > LEAST_LENGTH:
            changed.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([words, pa.array(changed, pa.large_string())])


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def merge_counts(parts: Iterator[pa.Array], held: int = _HELD) -> Iterator[pa.RecordBatch]:
    """(word, n) of a stream of words, counted together while at most about ``held`` words are distinct."""
    tables, size = [], 0
    for words in parts:
        found = words.value_counts()
        tables.append(pa.table({"word": found.field("values"), "n": found.field("counts").cast(pa.int64())}))
        size += len(found)
        if size > held:
            tables = [_merged(tables)]
            size = len(tables[0])
            if size > held // 2:
                yield from _sent(tables[0])
                tables, size = [], 0
    if tables:
        yield from _sent(_merged(tables))


def _sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.cast(pa.schema([("word", pa.large_string()), ("n", pa.int64())])).to_batches(max_chunksize=1 << 14):
        yield batch


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def words() -> Iterator[pa.Array]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("id").to_pylist()
            prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            for start, end in pieces(offsets):
                part = offsets[start : end + 1]
                yield _noisy_words(data[part[0] : part[-1]], part - part[0], prefixes[start:end])

    for batch in merge_counts(words()):
        yield pa.RecordBatch.from_arrays([batch.column("word").cast(pa.string()), batch.column("n")], ["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word of at least ``LEAST_LENGTH`` code points and ``least`` occurrences.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A to Z in lower
    case; noise of a known rule is planted: where ``NOISE`` divides h, the
    CRC-32 of ``<id>:<run>``, code point h modulo the run's length is deleted.
    Null texts have no words; a null id counts as no text. Repeated rows count
    each. Counts combine within a partition before they shuffle.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = slim.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _class_counts(word: Column) -> list[Column]:
    """How many letters of each class a word has; they add up to its length.

    An edit changes no count by more than one. A letter's class is its code
    point modulo ``CLASSES``.
    """
    letters = [chr(c) for c in (*range(_A, _Z + 1), *range(0xC0, 0x100))]
    out = []
    for c in range(CLASSES):
        others = "".join(x for x in letters if ord(x) % CLASSES != c)
        out.append(F.length(F.translate(word, others, "")).cast("int"))
    return out


def _shifts() -> list[list[int]]:
    """Differences of class counts from a block to one that is not before it: equal length, or one longer."""
    unit = [[int(i == c) for i in range(CLASSES)] for c in range(CLASSES)]
    moved = [[b - a for a, b in zip(unit[i], unit[j], strict=True)] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return [[0] * CLASSES, *moved, *unit]


def _count_matrix(codes: np.ndarray, kind: type) -> np.ndarray:
    """Letter counts of each row of codes; a column for each Latin-1 code from ``a`` on."""
    cells = np.repeat(np.arange(len(codes)) * 256, codes.shape[1]) + codes.ravel()
    return np.bincount(cells, minlength=256 * len(codes)).reshape(len(codes), 256)[:, _A:].astype(kind)


def code_matrix(words: pa.Array) -> np.ndarray:
    """Latin-1 codes of words of one length, a row for each."""
    data, offsets = utf8(words)
    text = data[offsets[0] : offsets[-1]].tobytes().decode().encode("latin-1")
    return np.frombuffer(text, np.uint8).reshape(len(words), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (code matrices, b as wide or one wider) are exactly one edit apart."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(1) == 1
    same_front = np.minimum.accumulate(a == b[:, :width], axis=1).sum(1)
    same_back = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return same_front + same_back >= width


def near_pairs(left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart, in pieces.

    ``left`` and ``right`` are code matrices, ``right`` as wide or one wider;
    without it, ``left`` is paired with itself, each pair once. Products of
    letter counts give the squared distances; pairs at most two apart are
    compared letter by letter.
    """
    alone = right is None
    right = left if alone else right
    wide = right.shape[1]
    # Products of counts must be exact.
    kind = np.float32 if wide < 2048 else np.float64
    a, b = _count_matrix(left, kind), _count_matrix(right, kind)
    # Columns that no word of either side uses are left out.
    used = a.any(0) | b.any(0)
    a, b = a[:, used], b[:, used]
    # A column for each side's squares makes the product the distance itself.
    one_a, one_b = np.ones((len(a), 1), kind), np.ones((len(b), 1), kind)
    a = np.hstack([a, (a * a).sum(1)[:, None], one_a])
    b = np.ascontiguousarray(np.hstack([-2 * b, one_b, (b * b).sum(1)[:, None]]).T)
    step, chunk = max(1, _CELLS // len(right)), max(1, _CELLS // wide)
    for first in range(0, len(left), step):
        distance = a[first : first + step] @ b
        i, j = np.divmod(np.flatnonzero(distance <= 2), len(right))
        i = i + first
        if alone:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), chunk):
            x, y = i[at : at + chunk], j[at : at + chunk]
            near = _one_edit(left[x], right[y])
            if near.any():
                yield x[near], y[near]


def _best(counts: np.ndarray, own: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, best of them): largest count, then smallest index."""
    order = np.lexsort((near, -counts[near], own))
    own, near = own[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.diff(np.append(first, len(own))), near[first]


def _task_result(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Near words within one task; its words are sorted by side, then by word."""
    rows = pa.Table.from_batches(held).combine_chunks()
    right = np.asarray(rows["right"])
    words, counts = rows["word"].combine_chunks(), np.asarray(rows["n"])
    alone, n_left = rows["alone"][0].as_py(), int((~right).sum())
    if not n_left or not (alone or n_left < len(right)):
        return None
    left = code_matrix(words.slice(0, n_left))
    pairs = list(near_pairs(left, None if alone else code_matrix(words.slice(n_left))))
    if not pairs:
        return None
    i, j = np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])
    j = j if alone else j + n_left
    own, n_near, best = _best(counts, np.concatenate([i, j]), np.concatenate([j, i]))
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(own)), pa.array(n_near, pa.int64()), words.take(pa.array(best)), pa.array(counts[best])],
        ["word", "n_near", "near", "near_n"],
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each pair of tiles: for each word their number and the best of them."""
    task: str | None = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("task")
        codes = np.asarray(names.dictionary_encode().indices)
        cuts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        for start, end in zip(cuts, np.append(cuts[1:], len(codes)), strict=True):
            name = names[int(start)].as_py()
            if name != task:
                if held and (out := _task_result(held)) is not None:
                    yield out
                task, held = name, []
            held.append(batch.slice(start, end - start))
    if held and (out := _task_result(held)) is not None:
        yield out


def tile_tasks(words: DataFrame) -> DataFrame:
    """(task, alone, right, word, n): every word for each pair of tiles it is compared in.

    Words with equal length and class counts are a block; a block is cut into
    tiles by a hash. A tile meets those of its own block and of the blocks one
    edit away, among which are those of the next length. Each two words that
    can be one edit apart meet in exactly one task.
    """
    names = [f"c{i}" for i in range(CLASSES)]
    keyed = words.withColumns(dict(zip(names, _class_counts(F.col("word")), strict=True)))
    letters = F.sum(F.length("word"))
    size = F.greatest(F.ceil(F.count("*") / TILE_WORDS), F.ceil(letters / TILE_LETTERS))
    blocks = materialize(keyed.groupBy(*names).agg(size.cast("int").alias("tiles")))
    # An edge joins a block to itself or to one a shift away.
    shifts = F.posexplode(F.array(*(F.array(*map(F.lit, s)) for s in _shifts()))).alias("edge", "shift")
    moved = blocks.select(*names, F.col("tiles").alias("own_tiles"), shifts)
    other = blocks.select(*(F.col(c).alias(f"o{c}") for c in names), F.col("tiles").alias("other_tiles"))
    edges = moved.join(other, [F.col(c) + F.col("shift")[i] == F.col(f"o{c}") for i, c in enumerate(names)])
    label = F.concat_ws(",", "edge", *names).alias("edge")
    within = (F.col("edge") == 0).alias("within")
    left = edges.select(*names, label, within, F.lit(False).alias("right"), "own_tiles", "other_tiles")
    right = edges.filter("edge > 0").select(
        *(F.col(f"o{c}").alias(c) for c in names),
        label,
        within,
        F.lit(True).alias("right"),
        F.col("other_tiles").alias("own_tiles"),
        F.col("own_tiles").alias("other_tiles"),
    )
    ways = broadcast_if_small(materialize(left.unionByName(right)))
    met = keyed.select("word", "n", *names).join(ways, names)
    met = met.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("own_tiles")).cast("int"))
    met = met.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    # Within a block the smaller tile is the left side.
    first = F.when(F.col("within"), F.least("tile", "met")).when(F.col("right"), F.col("met")).otherwise(F.col("tile"))
    second = F.when(F.col("within"), F.greatest("tile", "met")).when(F.col("right"), F.col("tile")).otherwise(F.col("met"))
    return met.select(
        F.concat_ws(":", "edge", first.cast("string"), second.cast("string")).alias("task"),
        (F.col("within") & (F.col("tile") == F.col("met"))).alias("alone"),
        F.when(F.col("within"), F.col("tile") > F.col("met")).otherwise(F.col("right")).alias("right"),
        "word",
        "n",
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words are one edit from each, and the most frequent of them.

    ``words`` has distinct words of ``[a-z\\u00C0-\\u00FF]`` and their counts n.
    Words without a near word are left out. A word has at most 91 times twice
    its length near words, so no later group is large.
    """
    tasks = tile_tasks(words)
    found = tasks.repartition("task").sortWithinPartitions("task", "right", "word").mapInArrow(_search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along ``forms`` (word, form) to the last.

    Pointer doubling over the words that have a form. Counts grow along a
    chain by ``FORM_RATIO``, so there are no cycles and few rounds.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return current


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of :func:`count_words`.

    ``form`` is the near word (one inserted, deleted or replaced code point)
    with the largest n, ties to the smallest word, if that n is at least
    ``ratio`` times the word's; ``root`` is where the forms lead, the word
    itself without one. An empty table gives no rows. Other columns are ignored.
    """
    words = materialize(count_words(docs, id_col, text_col))
    joined = words.join(near_words(words), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    found = materialize(
        joined.select(
            "word",
            F.when(fits, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("near_n")).alias("form_n"),
        )
    )
    roots = follow_forms(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
