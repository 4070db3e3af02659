"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class softmax
sums hashed n-gram and skip features of the history; the word softmax within a
class has the word's own count as its feature, which has a closed form. Classes
are ranges of endings (words sorted from their last byte) with about equal
shares of the tokens, so an unknown word has a class too. Every class keeps a
share for unknown words: known words and the unknown ones of each class sum to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.bytearrays import LOWER, mix, pieces, utf8, word_spans
from spanledger.llm.spelling import spans_as_strings
from spanledger.session import materialize

#: Frequent words whose counts are broadcast; they hold at most this many names of ``NAME_BYTES`` or less.
HOT_WORDS = 1 << 17
#: Longer words go by the SHA-256 of their bytes, behind a space, which no word has.
NAME_BYTES = 64
#: The token that ends a text; no word is empty.
END = ""
#: Distinct words counted together before they are sent on.
_HELD = 1 << 18
#: Rows of weights in one message of a gradient update.
_BLOCK = 256
#: Keeps the last k bytes of eight.
_KEPT = np.array([((1 << 64) - 1) >> (64 - 8 * k) << (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)
#: Tokens of a step when learning, and of a batch when scoring.
_STEP, _SCORED = 1 << 12, 1 << 13


@dataclass(frozen=True)
class Settings:
    classes: int = 31
    buckets: int = 1 << 15
    rounds: int = 3
    rate: float = 0.12


@dataclass
class MaxEnt:
    """A fitted model. ``weights`` has a row of class scores for each bucket, the last row for no feature."""

    settings: Settings
    #: First ending of each class of words but the first.
    bounds: np.ndarray
    #: Training tokens and distinct training tokens of each class; the last class is the end of a text.
    class_tokens: np.ndarray
    class_words: np.ndarray
    weights: np.ndarray
    hot: pa.Array
    hot_counts: np.ndarray
    end_count: int
    #: (word, n) of all training tokens.
    vocabulary: DataFrame

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def distinct(self) -> int:
        return int(self.class_words.sum())


def _lowered(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text behind, bytes in lower case, offsets) in pieces of a batch."""
    data, offsets = utf8(column)
    for start, end in pieces(offsets, 1 << 20):
        part = offsets[start : end + 1]
        yield start, end, LOWER[data[part[0] : part[-1]]], part - part[0]


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last eight bytes of each word, last byte first, as a number; short words end in zeros."""
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    # Eight bytes from every place on, in little-endian order.
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return np.take(eights, ends) & np.take(_KEPT, np.minimum(ends - starts, 8))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Names of the words: the words themselves, or a hash of long ones."""
    long = np.flatnonzero(ends - starts > NAME_BYTES)
    if not len(long):
        return spans_as_strings(data, starts, ends)
    cut = ends.copy()
    cut[long] = starts[long]
    names = spans_as_strings(data, starts, cut)
    hashed = [" " + hashlib.sha256(data[starts[i] : ends[i]].tobytes()).hexdigest() for i in long]
    mask = np.zeros(len(starts), bool)
    mask[long] = True
    return pc.replace_with_mask(names, pa.array(mask), pa.array(hashed, pa.large_string()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) of a partition's tokens, counted together within bounds."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["word", "ending"]).aggregate([("n", "sum")]).rename_columns(["word", "ending", "n"])

    tables, size, texts = [], 0, 0
    for batch in batches:
        texts += batch.num_rows
        for _, _, data, offsets in _lowered(batch.column("text")):
            starts, ends, _ = word_spans(data, offsets)
            found = word_names(data, starts, ends).dictionary_encode()
            counts = np.bincount(found.indices, minlength=len(found.dictionary))
            # Any word of a name gives its ending.
            first = np.empty(len(counts), np.int64)
            first[np.asarray(found.indices)] = np.arange(len(starts))
            keys = endings(data, starts[first], ends[first]).view(np.int64)
            tables.append(pa.table({"word": found.dictionary, "ending": keys, "n": counts.astype(np.int64)}))
            size += len(counts)
            if size > _HELD:
                tables = [merged(tables)]
                size = len(tables[0])
                if size > _HELD // 2:
                    yield from _sent(tables.pop())
                    size = 0
    if texts:
        tables.append(pa.table({"word": pa.array([END], pa.large_string()), "ending": np.zeros(1, np.int64), "n": np.array([texts], np.int64)}))
        yield from _sent(merged(tables))


def _sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("word", pa.string()), ("ending", pa.int64()), ("n", pa.int64())])
    yield from table.select(kind.names).cast(kind).to_batches(max_chunksize=1 << 14)


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, ending, n) of every token of ``docs``: words of lower-cased texts, and ``END`` once a text."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "word string, ending long, n long")
    return counted.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def ending_bounds(masses: dict[int, int], classes: int) -> list[int]:
    """Ends of the leading classes when sorted groups of endings are cut to equal shares."""
    total, cuts, before = sum(masses.values()), [], 0
    for key in sorted(masses):
        # A cut lies before the group in which a share begins.
        if before and before * classes // total > (len(cuts) and cuts[-1][1]):
            cuts.append((key, before * classes // total))
        before += masses[key]
    return [k for k, _ in cuts][: classes - 1]


def _fit_bounds(vocabulary: DataFrame, classes: int) -> np.ndarray:
    """Bounds of the word classes.

    Token counts by the last two bytes: at most 65,536 groups reach the driver.
    Groups above a class's share, of which there are fewer than classes, are
    seen again by four bytes, at most 65,536 groups each.
    """
    words = vocabulary.filter(F.col("word") != END)

    def masses(rows: DataFrame, bits: int) -> dict[int, int]:
        group = F.shiftrightunsigned("ending", bits).alias("group")
        return {r["group"]: r["n"] for r in rows.groupBy(group).agg(F.sum("n").alias("n")).collect()}

    coarse = masses(words, 48)
    heavy = [k for k, n in coarse.items() if n * classes > sum(coarse.values())]
    fine = {k << 16: n for k, n in coarse.items() if k not in set(heavy)}
    if heavy:
        fine |= masses(words.filter(F.shiftrightunsigned("ending", 48).isin(heavy)), 32)
    return np.array([k << 32 for k in ending_bounds(fine, classes)], np.uint64)


def _classes_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, keys, side="right")


def _class_sizes(bounds: np.ndarray, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
        for batch in batches:
            own = _classes_of(np.asarray(batch.column("ending")).view(np.uint64), bounds)
            own[np.asarray(pc.equal(batch.column("word"), END))] = classes
            np.add.at(tokens, own, np.asarray(batch.column("n")))
            words += np.bincount(own, minlength=classes + 1)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(tokens[used]), pa.array(words[used])], ["class", "tokens", "words"])

    return run


@dataclass(frozen=True)
class Tokens:
    """All tokens of some texts in order, each text followed by its end."""

    classes: np.ndarray
    texts: np.ndarray
    features: np.ndarray  # a column of buckets for each kind of feature
    starts: np.ndarray  # spans of the words alone
    ends: np.ndarray
    words: np.ndarray  # places of the words among the tokens


def tokenize(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, settings: Settings) -> Tokens:
    """Tokens with their classes and hashed features.

    Kinds: the word before; the word before that (a skip); the classes of both;
    the classes of the third and fourth word before (a skip).
    """
    starts, ends, firsts = word_spans(data, offsets)
    n_texts = len(offsets) - 1
    owner = np.repeat(np.arange(n_texts), np.diff(firsts))
    places = np.arange(len(starts)) + owner
    n = len(starts) + n_texts
    texts = np.repeat(np.arange(n_texts), np.diff(firsts) + 1)
    classes = np.full(n, settings.classes, np.int64)
    keys = endings(data, starts, ends)
    classes[places] = _classes_of(keys, bounds)
    # A word's features go by its last eight bytes and its length.
    names = np.zeros(n, np.uint64)
    names[places] = mix(keys + (ends - starts).astype(np.uint64))
    # Places of the four tokens before; texts start anew.
    since = np.arange(n) - np.repeat(firsts[:-1] + np.arange(n_texts), np.diff(firsts) + 1)

    def back(values: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(n, none, values.dtype)
        out[k:] = values[: max(0, n - k)]
        out[since < k] = none
        return out

    c = [back(classes, k, settings.classes + 1) for k in (1, 2, 3, 4)]
    kinds = [
        back(names, 1, 1),
        mix(back(names, 2, 1) + np.uint64(7)),
        mix((c[0] * 1024 + c[1] + (11 << 40)).astype(np.uint64)),
        mix((c[2] * 1024 + c[3] + (13 << 40)).astype(np.uint64)),
    ]
    features = np.stack([(k % np.uint64(settings.buckets)).astype(np.uint16 if settings.buckets <= 1 << 16 else np.int64) for k in kinds])
    return Tokens(classes, texts, features, starts, ends, places)


def class_probabilities(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Softmax over classes for each token; ``features`` has a row of buckets for each kind."""
    scores = np.repeat(weights[-1:], features.shape[1], axis=0)
    for kind in features:
        scores += np.take(weights, kind, axis=0)
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores


def learn(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, features: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One step on a batch of tokens, in place: each row moves against its gradient, less far as its gradients add up.

    ``squares`` has the mean square of the gradients of each row so far,
    ``seen`` how many tokens had it.
    """
    wrong = class_probabilities(weights, features)
    wrong[np.arange(len(classes)), classes] -= 1
    last = len(weights) - 1
    for kind in [*features, None]:
        if kind is None:
            rows, sums, counts = np.array([last]), wrong.sum(0, keepdims=True), np.array([len(classes)])
        else:
            order = np.argsort(kind, kind="stable")
            sorted_kind = kind[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_kind[1:] != sorted_kind[:-1]]))
            rows, sums = sorted_kind[first], np.add.reduceat(np.take(wrong, order, axis=0), first, axis=0)
            counts = np.diff(np.append(first, len(order)))
        squares[rows] += (sums * sums).mean(1)
        seen[rows] += counts
        weights[rows] -= (rate / np.sqrt(squares[rows] + 1e-8))[:, None] * sums


def _updates(start, bounds: np.ndarray, settings: Settings):
    """What a partition's tokens change in the weights, each row times the tokens that had it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = start.value.copy()
        squares, seen = np.zeros(len(weights), np.float32), np.zeros(len(weights), np.float32)
        for batch in batches:
            for _, _, data, offsets in _lowered(batch.column("text")):
                tokens = tokenize(data, offsets, bounds, settings)
                for at in range(0, len(tokens.classes), _STEP):
                    part = slice(at, at + _STEP)
                    learn(weights, squares, seen, tokens.features[:, part], tokens.classes[part], settings.rate)
        weights -= start.value
        weights *= seen[:, None]
        for block in range(0, len(weights), _BLOCK):
            part = slice(block, block + _BLOCK)
            if seen[part].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([seen[part].tobytes()]), pa.array([weights[part].tobytes()])], ["block", "seen", "moved"]
                )

    return run


def _add_updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the messages of each block; they come sorted by block, so one sum is held."""
    block, seen, moved = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], ["block", "seen", "moved"]
        )

    for batch in batches:
        for now, a, b in zip(batch.column("block").to_pylist(), batch.column("seen"), batch.column("moved"), strict=True):
            part = np.frombuffer(a.as_buffer(), np.float32).astype(float), np.frombuffer(b.as_buffer(), np.float32).astype(float)
            if now == block:
                seen, moved = seen + part[0], moved + part[1]
            else:
                if block is not None:
                    yield done()
                block, (seen, moved) = now, part
    if block is not None:
        yield done()


def fit_maxent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> MaxEnt:
    """Fit on every text of ``docs``.

    Counts of all tokens make the vocabulary, the classes and their sizes. The
    texts are dealt to ``rounds`` rounds by a hash; in each, every partition
    takes gradient steps on its texts from the same weights, and the changes
    are averaged, row by row, by the number of tokens that had the row. Between
    partitions and driver go ``buckets * classes`` numbers, whatever the input.

    A null text is an empty one, whose only token is its end. Repeated rows
    count each. Without rows the model knows no token.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    vocabulary = materialize(count_tokens(texts))
    classes = settings.classes
    bounds = _fit_bounds(vocabulary, classes)
    tokens, words = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
    sizes = vocabulary.mapInArrow(_class_sizes(bounds, classes), "class int, tokens long, words long")
    for row in sizes.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        tokens[row["class"]], words[row["class"]] = row["tokens"], row["words"]
    hot, hot_counts = _hot_words(vocabulary)

    weights = np.zeros((settings.buckets + 1, classes + 1), np.float32)
    # Before learning, classes have the shares of all tokens.
    weights[-1] = np.log((tokens + 0.5) / (tokens.sum() + 0.5 * (classes + 1)))
    for number in range(settings.rounds if tokens.any() else 0):
        shared = spark.sparkContext.broadcast(weights)
        dealt = texts.filter(F.pmod("place", F.lit(settings.rounds)) == number).select("text")
        sent = dealt.mapInArrow(_updates(shared, bounds, settings), "block int, seen binary, moved binary")
        summed = sent.repartition("block").sortWithinPartitions("block").mapInArrow(_add_updates, "block int, seen binary, moved binary")
        weights = weights.copy()
        for row in summed.collect():
            seen = np.frombuffer(row["seen"], float)
            moved = np.frombuffer(row["moved"], float).reshape(len(seen), -1)
            weights[row["block"] : row["block"] + len(seen)] += (moved / np.maximum(seen, 1)[:, None]).astype(np.float32)
        shared.unpersist()
    return MaxEnt(settings, bounds, tokens, words, weights, hot, hot_counts, int(tokens[-1]), vocabulary)


def _hot_words(vocabulary: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """At most ``HOT_WORDS`` words and counts: all above a count that a histogram gives."""
    words = vocabulary.filter(F.col("word") != END)
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["level"], r["words"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, n in histogram:
        held += n
        if held > HOT_WORDS:
            break
        least = at
    if least is None:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    rows = words.filter(level >= least).select("word", "n").toArrow()
    return rows["word"].combine_chunks().cast(pa.large_string()), np.asarray(rows["n"], np.int64)


def _scorer(model: dict, shared):
    settings, bounds, end_count = model["settings"], model["bounds"], model["end_count"]
    # log10 of 1 / (tokens and half a token for each word and for unknown ones); the end has no unknown ones.
    share = -np.log10(model["class_tokens"] + 0.5 * (model["class_words"] + 1))
    share[-1] = -np.log10(model["class_tokens"][-1] + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hot, hot_counts = shared.value
        hot_logs = np.log10(hot_counts + 0.5)
        end_log = np.log10(end_count + 0.5)
        for batch in batches:
            for start, end, data, offsets in _lowered(batch.column("text")):
                tokens = tokenize(data, offsets, bounds, settings)
                n = end - start
                logs = share[tokens.classes]
                for at in range(0, len(logs), _SCORED):
                    part = slice(at, at + _SCORED)
                    found = class_probabilities(weights, tokens.features[:, part])
                    logs[part] += np.log10(np.maximum(found[np.arange(len(found)), tokens.classes[part]], 1e-30))
                factor = np.bincount(tokens.texts, logs, n)
                # Counts of frequent words are at hand; the others are looked up by a join.
                names = word_names(data, tokens.starts, tokens.ends).dictionary_encode()
                at = pc.index_in(names.dictionary, value_set=hot).fill_null(-1).to_numpy()
                codes = np.asarray(names.indices)
                own = at[codes]
                texts = tokens.texts[tokens.words]
                known = own >= 0
                counted = np.bincount(texts[known], hot_logs[own[known]], n) + end_log
                n_known = np.bincount(texts[known], minlength=n) + int(end_count > 0)
                row = batch.column("row").slice(start, n)
                yield _rows(
                    row=row,
                    key=batch.column("key").slice(start, n),
                    n_tokens=pa.array(np.bincount(tokens.texts, minlength=n), pa.int64()),
                    n_known=pa.array(n_known, pa.int64()),
                    factor=pa.array(factor),
                    counted=pa.array(counted),
                )
                rare, times = np.unique(texts[~known] * len(names.dictionary) + codes[~known], return_counts=True)
                if len(rare):
                    text, code = np.divmod(rare, len(names.dictionary))
                    for first in range(0, len(rare), 1 << 15):
                        part = slice(first, first + (1 << 15))
                        yield _rows(
                            row=row.take(pa.array(text[part])),
                            key=pa.nulls(len(text[part]), batch.column("key").type),
                            word=names.dictionary.take(pa.array(code[part])).cast(pa.string()),
                            times=pa.array(times[part], pa.int64()),
                        )

    return run


_COLUMNS = {"row": None, "key": None, "n_tokens": pa.int64(), "n_known": pa.int64(), "factor": pa.float64(), "counted": pa.float64(), "word": pa.string(), "times": pa.int64()}


def _rows(**given: pa.Array) -> pa.RecordBatch:
    n = len(given["row"])
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kind) for c, kind in _COLUMNS.items()], list(_COLUMNS))


def score_texts(docs: DataFrame, model: MaxEnt, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``base_score`` is the text's log10 probability when each token has its
    share of the training tokens, with half a token for every distinct one and
    for unknown ones; ``score`` is that of the model. ``n_known`` counts tokens
    with a training count.

    One pass scores whole texts in batches and writes, beside a row for each
    text, the words it has that are not among the frequent ones; these are
    joined to the vocabulary by word and added up by text. Null and empty texts
    have one token, the end. Repeated rows are scored each. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    # Numbers of a scan's rows: both kinds of output are written by one task, so they agree.
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    # buckets * classes * 4 bytes, and HOT_WORDS names.
    shared = spark.sparkContext.broadcast((model.weights, model.hot, model.hot_counts))
    fixed = {"settings": model.settings, "bounds": model.bounds, "class_tokens": model.class_tokens, "class_words": model.class_words, "end_count": model.end_count}
    schema = f"row long, key {kind}, n_tokens long, n_known long, factor double, counted double, word string, times long"
    found = materialize(slim.mapInArrow(_scorer(fixed, shared), schema))
    rare = found.filter("word is not null").select("row", "word", "times")
    counts = F.coalesce("n", F.lit(0))
    joined = rare.join(model.vocabulary.select("word", "n"), "word", "left")
    rest = joined.groupBy("row").agg(
        F.sum(F.log10(counts + 0.5) * F.col("times")).alias("rest"), F.sum(F.when(counts > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    all_logs = F.col("counted") + F.coalesce("rest", F.lit(0.0))
    whole = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    scored = found.filter("word is null").join(rest, "row", "left")
    return scored.select(
        F.col("key").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (all_logs + F.col("factor")).alias("score"),
    )
