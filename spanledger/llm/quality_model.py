"""Quality classifier: averaged hashed subword embeddings with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.bytearrays import Hashed, mix, pieces, utf8, word_spans
from spanledger.llm.common import hash_bits, key_text

#: Most labelled rows that a model is fitted on; those with the smallest id hashes.
SAMPLE_ROWS = 4000
THRESHOLD = 0.7
#: Bytes whose features are held at once.
_PIECE = 1 << 18
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[ord("0") : ord("9") + 1] = ord("0")
_SAME = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dimensions: int = 16
    characters: tuple[int, ...] = (3, 4)
    epochs: int = 4
    rate: float = 0.3
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of all words, word pairs and character n-grams.

    Character n-grams run over the bytes with digits made equal and never cross
    texts. A pair of equal words is one feature whatever the word.
    """
    data = _DIGITS[data]
    hashed = Hashed(data)
    starts, ends, firsts = word_spans(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    words = hashed.spans(starts, ends)
    found, owners = [words], [owner]
    if len(words) > 1:
        pair = owner[1:] == owner[:-1]
        left, right = words[:-1][pair], words[1:][pair]
        found.append(np.where(left == right, _SAME, mix(left * np.uint64(3) + right)))
        owners.append(owner[1:][pair])
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for width in settings.characters:
        grams = hashed.windows(width)
        if len(grams):
            inside = text_of[: len(grams)] == text_of[width - 1 :]
            found.append(grams[inside] + np.uint64(width))
            owners.append(text_of[: len(grams)][inside])
    return (np.concatenate(found) % np.uint64(settings.buckets)).astype(np.int64), np.concatenate(owners)


def _per_text(texts: list[str | None], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    column = pa.array(texts, pa.string())
    data, offsets = utf8(column)
    out = []
    for start, end in pieces(offsets, _PIECE):
        part = offsets[start : end + 1]
        found, owner = features(data[part[0] : part[-1]], part - part[0], settings)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(end - start + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, counts = np.unique(found[order[a:b]], return_counts=True)
            out.append((own, (counts / max(1, b - a)).astype(np.float32)))
    return out


class SubwordClassifier:
    """Embeddings of hashed features, averaged per text, and a two-class softmax."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = settings
        self.embeddings = np.zeros((settings.buckets, settings.dimensions), np.float32)
        self.output = np.zeros((settings.dimensions, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[str | None], labels: list[int]) -> SubwordClassifier:
        """Stochastic gradient descent on cross entropy; classes weigh the same in all."""
        s = self.settings
        rng = np.random.default_rng(s.seed)
        self.embeddings = rng.uniform(-1 / s.dimensions, 1 / s.dimensions, self.embeddings.shape).astype(np.float32)
        self.output = rng.normal(0, 0.3, self.output.shape).astype(np.float32)
        known = np.asarray(labels, int)
        counts = np.bincount(known, minlength=2)
        if not counts.all():
            # One class only: nothing to tell apart.
            self.embeddings[:] = 0
            self.bias = np.log((counts + 1) / (counts.sum() + 2)).astype(np.float32)
            return self
        weights = np.sqrt(counts.sum() / (2 * counts))
        samples = _per_text(texts, s)
        steps, done = s.epochs * len(samples), 0
        for _ in range(s.epochs):
            for i in rng.permutation(len(samples)):
                own, share = samples[i]
                rate = s.rate * (1 - done / steps)
                done += 1
                if not len(own):
                    continue
                hidden = share @ self.embeddings[own]
                logits = hidden @ self.output + self.bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[known[i]] -= 1
                p *= weights[known[i]]
                back = self.output @ p
                self.output -= rate * np.outer(hidden, p)
                self.bias -= rate * 0.1 * p
                # The mean's gradient is scaled by the number of distinct features.
                self.embeddings[own] -= (rate * 4 * np.sqrt(len(own))) * share[:, None] * back
        return self

    def bucket_weights(self) -> np.ndarray:
        """Log odds of class 1 that each bucket adds: the model is linear in its shares."""
        return (self.embeddings @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return score_batch(pa.array(texts, pa.string()), self.bucket_weights(), float(self.bias[1] - self.bias[0]), self.settings)


def score_batch(column: pa.Array, weights: np.ndarray, bias: float, settings: Settings) -> np.ndarray:
    """Probability of class 1 for each text; a text without features gets the bias alone."""
    data, offsets = utf8(column)
    out = np.full(len(column), bias)
    for start, end in pieces(offsets, _PIECE):
        part = offsets[start : end + 1]
        found, owner = features(data[part[0] : part[-1]], part - part[0], settings)
        total = np.bincount(owner, weights[found], minlength=end - start)
        out[start:end] += total / np.maximum(1, np.bincount(owner, minlength=end - start))
    return 1 / (1 + np.exp(-out))


def fit_quality(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> SubwordClassifier:
    """Fit on the ``SAMPLE_ROWS`` labelled rows with the smallest id hashes.

    Rows without a label are left out; a null text is an empty one. The rows
    are few and fixed in number, so the driver learns from them alone. Without
    rows, or with one class, every text gets the same score.
    """
    rows = (
        labelled.filter(F.col(label_col).isin(0, 1))
        .select(hash_bits(key_text(F.col(id_col))).alias("place"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
        .orderBy("place", "text", "label")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    return SubwordClassifier(settings).fit([r["text"] for r in rows], [r["label"] for r in rows])


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``rows`` labels with the smallest id hashes: few enough to broadcast."""
    return (
        labels.filter(F.col(label_col).isin(0, 1))
        .select(F.col(id_col), F.col(label_col))
        .orderBy(hash_bits(key_text(F.col(id_col))), id_col, label_col)
        .limit(rows)
    )


def _scorer(shared, bias: float, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_batch(batch.column("text"), shared.value, bias, settings)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64())], ["key", "score"])

    return run


def score_quality(docs: DataFrame, model: SubwordClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1) and predicted (score >= ``THRESHOLD``).

    Whole texts are scored; a null or empty text gets the score of no feature.
    Rows are independent: no shuffle, equal texts get equal scores. An empty
    table gives no rows. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    # buckets * 4 bytes.
    shared = docs.sparkSession.sparkContext.broadcast(model.bucket_weights())
    bias = float(model.bias[1] - model.bias[0])
    scored = slim.mapInArrow(_scorer(shared, bias, model.settings), f"key {kind}, score double")
    return scored.select(F.col("key").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
