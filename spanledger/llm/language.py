"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import hash_fraction, key_text

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Most languages, samples of one, and characters of a sample: the bound on what is learned from.
MOST_LANGUAGES, SAMPLES, SAMPLE_CHARS = 256, 400, 1024
#: Bytes of a dictionary.
DICTIONARY_BYTES = 1 << 16
#: Texts are compressed in pieces, so that a long one does not become its own dictionary.
PIECE_BYTES = 1024
LEVEL = 5
#: Least saving of the best language over the next, in share of the next's bytes.
LEAST_MARGIN = 0.01


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, the most frequent language first."""

    dictionaries: dict[str, bytes]

    @property
    def languages(self) -> list[str]:
        return list(self.dictionaries)


def letters(text: str) -> bytes:
    """What is compressed: the letters in lower case, a space for each run of others."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode(errors="replace")


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of each language.

    Rows without text or language are left out. For each language about
    ``SAMPLES`` rows with the smallest id hashes give ``SAMPLE_CHARS``
    characters each, cut to ``DICTIONARY_BYTES``. At most ``MOST_LANGUAGES``
    languages are allowed, so the driver holds a bounded amount.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel({})
    # Twice the wanted share is surely enough; the smallest hashes are taken.
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2.0 * SAMPLES / r["count"]))))
    place = hash_fraction(key_text(F.col(id_col)))
    picked = (
        rows.select(
            F.col(lang_col).alias("lang"), place.alias("place"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text")
        )
        .filter(F.col("place") < F.element_at(share, F.col("lang")))
        .collect()
    )
    out: dict[str, bytes] = {}
    # Ties go to the language with more rows, then to the first by name.
    for lang, _ in sorted(((r["lang"], r["count"]) for r in counts), key=lambda x: (-x[1], x[0])):
        own = sorted((r["place"], r["text"]) for r in picked if r["lang"] == lang)[:SAMPLES]
        out[lang] = b" ".join(letters(text) for _, text in own)[:DICTIONARY_BYTES]
    return LanguageModel(out)


class Scorer:
    """Compressed sizes of texts under each dictionary; one per task."""

    def __init__(self, model: LanguageModel) -> None:
        self.languages = model.languages
        self.compressors = []
        for data in model.dictionaries.values():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the whole text under each dictionary, piece by piece."""
        data = letters(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). Unknown if there is no letter or nothing was learned."""
        if not text or not self.compressors or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0
        second = float(np.partition(sizes, 1)[1])
        margin = (second - float(sizes[best])) / second
        # Code lengths are log likelihoods; repeated context makes bytes worth less.
        nats = (sizes - sizes[best]) * (8 * math.log(2) / 8)
        return self.languages[best], float(1 / np.exp(-nats).sum()), margin


def _predictor(shared, least_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(shared.value))
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column("text").to_pylist()]
            best, score, margin = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            columns = [
                batch.column("key"),
                pa.array(best, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(margin, pa.float64()),
                pa.array([b if m >= least_margin else UNKNOWN for b, m in zip(best, margin, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score", "margin", "language"])

    return run


def identify_languages(
    docs: DataFrame,
    model: LanguageModel,
    least_margin: float = LEAST_MARGIN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, lang_pred, score, margin, language.

    ``lang_pred`` is the language whose dictionary compresses the whole text
    best (ties: the more frequent one); ``score`` weighs it against the others by
    code length; ``margin`` is its saving over the next. ``language`` is the
    decision: ``und`` where the margin is under ``least_margin``. A null or
    empty text, and one without a letter, is ``und`` with score 0; so is all
    under an empty model. Rows are independent: no shuffle, equal texts get
    equal answers. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    # At most MOST_LANGUAGES * DICTIONARY_BYTES bytes.
    shared = spark.sparkContext.broadcast(model.dictionaries)
    schema = f"key {kind}, lang_pred string, score double, margin double, language string"
    return slim.mapInArrow(_predictor(shared, least_margin), schema).withColumnRenamed("key", id_col)


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as no text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds
