"""Best-fit packing of documents into fixed-size training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import hash_bits, key_text, lower_ascii, word_count
from spanledger.llm.jaccard_join import jaccard_groups
from spanledger.session import materialize

#: Words in a sequence.
CAPACITY = 2048
#: Mean number of pieces that one packing task places.
GROUP_ROWS = 8192

_PLACED = "doc_id {id}, piece int, first_word long, n_words long, bin_id long, bin_position int, bin_words long"


def cluster_key(text: Column) -> Column:
    """Duplicate cluster of a text: equal words, ASCII case ignored."""
    return F.md5(F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def text_key(text: Column) -> Column:
    """64-bit name of a text; null counts as no text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_clusters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(text_key, cluster, words)`` of every text: one cluster for copies and near copies (``jaccard_groups``), and its number of words.

    Texts are named by their hash, so rows without id and ids with two texts
    have their own clusters.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = jaccard_groups(docs.select(text_key(text).alias("text_key"), text.alias("text")), "text_key")
    return groups.select(F.col("id").alias("text_key"), F.col("component_id").alias("cluster"), F.col("n_words").alias("words")).distinct()


class Bins:
    """Open bins ordered by what they have left.

    Bins with the same residual are grouped by their source bitmap, so one
    test rejects all bins of a group that hold the source already.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residuals: list[int] = []  # sorted, only those with bins
        self.at: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _put(self, number: int) -> None:
        residual = self.left[number]
        if residual == 0:
            return
        if residual not in self.at:
            self.at[residual] = {}
            insort(self.residuals, residual)
        self.at[residual].setdefault(self.sources[number], []).append(number)

    def _take(self, residual: int, mask: int, index: int) -> int:
        group = self.at[residual]
        found = group[mask]
        found[index], found[-1] = found[-1], found[index]
        number = found.pop()
        if not found:
            del group[mask]
            if not group:
                del self.at[residual]
                del self.residuals[bisect_left(self.residuals, residual)]
        return number

    def _find(self, size: int, source: int, cluster: int) -> int | None:
        """Tightest bin without the source and the cluster: successor search upwards."""
        for residual in self.residuals[bisect_left(self.residuals, size) :]:
            for mask, found in self.at[residual].items():
                if mask & source:
                    continue
                for index, number in enumerate(found):
                    if not self.clusters[number] & cluster:
                        return self._take(residual, mask, index)
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, position in it) of a piece; a new bin opens if none is compatible."""
        number = self._find(size, source, cluster)
        if number is None:
            number = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        self.left[number] -= size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.used[number] += 1
        self._put(number)
        return number, self.used[number] - 1


def _bits(values: pd.Series) -> list[int]:
    """One bit for each distinct value; only those that occur again need one."""
    seen: dict[object, int] = {}
    counts = values.value_counts()
    out = []
    for value in values:
        if counts[value] == 1:
            out.append(0)
        else:
            out.append(1 << seen.setdefault(value, len(seen)))
    return out


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        # Decreasing size; then the hash, so that reruns agree.
        group = group.sort_values(
            ["n_words", "place", "source", "cluster", "piece"], ascending=[False, True, True, True, True], kind="stable"
        )
        bins = Bins(capacity)
        where = [
            bins.place(int(size), source, cluster)
            for size, source, cluster in zip(group["n_words"], _bits(group["source"]), _bits(group["cluster"]), strict=True)
        ]
        numbers = [n for n, _ in where]
        base = int(group["part"].iloc[0]) << 32
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"].array,
                "piece": group["piece"].array,
                "first_word": group["first_word"].array,
                "n_words": group["n_words"].array,
                "bin_id": [base + n for n in numbers],
                "bin_position": [p for _, p in where],
                "bin_words": [capacity - bins.left[n] for n in numbers],
            }
        )

    return pack


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    cluster: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Pieces of documents with the bin that holds each.

    A text longer than ``capacity`` words is cut into pieces of ``capacity``
    words and a rest; a full piece is a bin of its own. Other pieces are placed
    by decreasing size into the tightest open bin that holds neither their
    source nor their duplicate cluster (``cluster``, by default equal words, or
    ``clusters``, see :func:`near_clusters`; with its ``words`` it must have every text, and the texts are not parsed again); without such a bin a new one opens. Every word of every text is in exactly
    one bin and no bin exceeds the capacity.

    Columns: id, piece (from 0), first_word, n_words, bin_id, bin_position,
    bin_words (the bin's fill). Pieces are dealt by a hash of id, piece, text
    and copy to tasks of ``group_rows`` pieces on average; each task has bins of
    its own, so a hot id, source or cluster is spread over all of them.

    A null text, and one without words, gives one row of 0 words without a
    bin. Null sources are one source. Repeated rows are placed each. An empty
    table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    counted = clusters is not None and "words" in clusters.columns
    parsed = [] if counted else [(cluster if cluster is not None else cluster_key(text)).cast("string").alias("cluster"), word_count(text).alias("words")]
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("source"),
        *parsed,
        hash_bits(key_text(F.col(id_col))).alias("place"),
        text_key(text).alias("text_key"),
    )
    if counted:
        known = clusters.select("text_key", F.col("cluster").cast("string").alias("cluster"), "words")
        missing = F.raise_error(F.lit("clusters lack a text")).cast("long")
        slim = slim.join(known, "text_key", "left").withColumn("words", F.coalesce("words", missing))
    elif clusters is not None:
        near = clusters.select("text_key", F.col("cluster").cast("string").alias("near"))
        slim = slim.join(near, "text_key", "left").withColumn("cluster", F.coalesce("near", "cluster")).drop("near")
    # The texts are read once; what follows looks at names and sizes alone.
    slim = materialize(slim)
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int")
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select(
        "doc_id",
        "piece",
        first.alias("first_word"),
        F.least(F.lit(capacity), F.col("words") - first).cast("long").alias("n_words"),
        F.coalesce("cluster", F.lit("")).alias("cluster"),
        "source",
        "place",
        "text_key",
    )
    # Rows of the table bound the pieces that need placing: one rest each.
    parts = max(1, -(-slim.count() // group_rows))
    # 60 hash bits; the full bins get ids of their own above those of the tasks.
    whole = (
        pieces.filter(F.col("n_words") == capacity)
        .withColumn("bin", (F.lit(1 << 62) + F.monotonically_increasing_id()).cast("long"))
        .select(
            F.col("doc_id").alias(id_col),
            "piece",
            "first_word",
            "n_words",
            F.col("bin").alias("bin_id"),
            F.lit(0).alias("bin_position"),
            F.lit(capacity).cast("long").alias("bin_words"),
        )
    )
    empty = pieces.filter(F.col("n_words") == 0).select(
        F.col("doc_id").alias(id_col),
        "piece",
        "first_word",
        "n_words",
        F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("int").alias("bin_position"),
        F.lit(None).cast("long").alias("bin_words"),
    )
    rests = pieces.filter((F.col("n_words") > 0) & (F.col("n_words") < capacity))
    # Equal rows are numbered, so that they can be dealt to different tasks.
    copies = rests.groupBy(*rests.columns).agg(F.count("*").alias("copies"))
    rests = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn(
        "part", F.pmod(F.xxhash64("place", "piece", "text_key", "copy"), F.lit(parts)).cast("int")
    )
    placed = rests.groupBy("part").applyInPandas(_packer(capacity), _PLACED.format(id=kind)).withColumnRenamed("doc_id", id_col)
    return placed.unionByName(whole).unionByName(empty)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The pieces of :func:`pack_documents` for each document beside its text.

    Joined by id, so ids must tell documents apart.
    """
    pieces = pack_documents(docs, id_col=id_col, text_col=text_col, **options)
    return pieces.join(docs.select(id_col, text_col), id_col)
