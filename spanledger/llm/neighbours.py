"""Nearest neighbours by inner product: multi-index hashing of learned rotated codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanledger.session import materialize

#: Rows that rotations and the radius are learned from; those with the smallest hashes.
SAMPLE_ROWS = 4000
SAMPLE_QUERIES = 400
#: Bits of a code and of the substrings that are indexed.
CODE_BITS, PART_BITS = 256, 8
#: Share of the sample's true neighbours that the radius has to cover.
COVERAGE = 0.95
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
_ROTATION_ROUNDS = 15


@dataclass(frozen=True)
class CodeModel:
    """Mean, rotations to all code bits, the Hamming radius and the longest norm."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int
    norm: float

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with one more component that makes all norms equal.

        Among vectors of one norm the largest inner product is the smallest
        angle, which codes can measure.
        """
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (vectors**2).sum(1)))
        return np.column_stack((vectors, rest))

    def codes(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Packed sign bits of the rotated vectors."""
        lifted = np.column_stack((vectors, np.zeros(len(vectors)))) if queries else self.lift(vectors)
        if queries:
            # Only a query's direction matters; data have the longest norm.
            lengths = np.sqrt((lifted**2).sum(1, keepdims=True))
            lifted = lifted * (self.norm / np.maximum(lengths, 1e-300))
        return np.packbits((lifted - self.mean) @ self.rotation > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of one packed code to many."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


def _learned_rotation(centred: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Rotation whose signs lose least: alternates codes and the best rotation to them."""
    d = centred.shape[1]
    start, _ = np.linalg.qr(rng.standard_normal((d, d)))
    rotation = start[:, :bits]
    for _ in range(_ROTATION_ROUNDS):
        signs = np.where(centred @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(centred.T @ signs, full_matrices=False)
        rotation = u @ vt
    return rotation


def fit_codes(sample: np.ndarray, norm: float, k: int, seed: int = 11) -> CodeModel:
    """Learn rotations on sample vectors, then the radius that covers their neighbours.

    Several rotations, each learned from another start, give ``CODE_BITS`` bits.
    The radius covers ``COVERAGE`` of the ``k`` nearest inside the sample; nearest
    vectors of the whole table are nearer still.
    """
    rng = np.random.default_rng(seed)
    plain = CodeModel(np.zeros(0), np.zeros((0, 0)), 0, norm)
    lifted = plain.lift(sample)
    mean = lifted.mean(0)
    centred = lifted - mean
    rotations, bits = [], 0
    while bits < CODE_BITS:
        part = min(centred.shape[1], CODE_BITS - bits)
        rotations.append(_learned_rotation(centred, part, rng))
        bits += part
    model = CodeModel(mean, np.hstack(rotations), 0, norm)
    queries = sample[:SAMPLE_QUERIES]
    codes, asked = model.codes(sample), model.codes(queries, queries=True)
    scores = queries @ sample.T
    distances = []
    for i in range(len(queries)):
        scores[i, i] = -np.inf
        near = np.argsort(-scores[i])[: min(k, len(sample) - 1)]
        distances.append(hamming(asked[i], codes[near]))
    found = np.concatenate(distances) if distances else np.zeros(0)
    radius = int(np.quantile(found, COVERAGE)) if len(found) else CODE_BITS
    return CodeModel(mean, model.rotation, radius, norm)


class MultiIndex:
    """Inverted tables of code substrings over one block of rows.

    A table keeps, for each value of its substring, the rows with that value as
    a bitmap. By the pigeonhole principle a code within ``r`` of a query differs
    in at most ``r // parts`` bits in some substring (``r // parts - 1`` in all
    but ``r % parts + 1`` of them), so the union of the probed bitmaps holds
    every such code.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.parts = codes.shape[1]
        self.rows = len(codes)
        self._balls: dict[int, np.ndarray] = {}
        values = np.arange(256)
        self._apart = np.bitwise_count(values[:, None] ^ values[None, :])
        width = -(-self.rows // 8)
        self.tables = np.zeros((self.parts, 256, width), np.uint8)
        at = np.arange(self.rows)
        for part in range(self.parts):
            np.bitwise_or.at(self.tables[part], (codes[:, part], at >> 3), (128 >> (at & 7)).astype(np.uint8))

    def _ball(self, radius: int) -> np.ndarray:
        """Per table and probe value: rows whose substring is within the radius."""
        if radius not in self._balls:
            out = np.zeros_like(self.tables)
            for value in range(256):
                if radius >= 0:
                    out[:, value] = np.bitwise_or.reduce(self.tables[:, self._apart[value] <= radius], axis=1)
            self._balls[radius] = out
        return self._balls[radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: probes, then the full distance."""
        share, extra = divmod(radius, self.parts)
        wide, narrow = self._ball(min(share, PART_BITS)), self._ball(min(share - 1, PART_BITS))
        tables = np.arange(self.parts)
        probed = np.bitwise_or.reduce(
            np.concatenate((wide[tables[: extra + 1], code[: extra + 1]], narrow[tables[extra + 1 :], code[extra + 1 :]])), axis=0
        )
        rows = np.flatnonzero(np.unpackbits(probed, count=self.rows))
        return rows[hamming(code, self.codes[rows]) <= radius]

    def at_least(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        """As :meth:`within`, with the radius widened until ``k`` rows (or all) are found."""
        while True:
            rows = self.within(code, radius)
            if len(rows) >= min(k, self.rows) or radius >= 8 * self.parts:
                return rows
            radius = min(8 * self.parts, radius + self.parts)


def _usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is a direction: no null, no other than finite numbers, not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _searcher(model: CodeModel, k: int):
    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "row": [], "least": [], "score": []}
        if len(index) and len(asked):
            vectors = np.array(index["vector"].tolist(), float)
            queries = np.array(asked["vector"].tolist(), float)
            tables = MultiIndex(model.codes(vectors))
            least = index["least"].to_numpy()
            rows = index["row"].to_numpy()
            for vector, code, number in zip(queries, model.codes(queries, queries=True), asked["row"], strict=True):
                found = tables.at_least(code, model.radius, k)
                scores = (vectors[found] * vector).sum(1)
                best = np.lexsort((least[found], -scores))[:k]
                out["query"] += [number] * len(best)
                out["row"] += rows[found[best]].tolist()
                out["least"] += least[found[best]].tolist()
                out["score"] += scores[best].tolist()
        return pd.DataFrame(out).astype({"query": "object", "row": "object", "least": "int64", "score": "float64"})

    return search


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the largest inner products for each query row.

    ``is_query`` is a condition on ``rows``; candidates are all rows but the
    query's own. Columns: query_id, rank (from 1), the id and score (in double
    precision on the given vectors); ties go to the smaller id. With fewer than
    ``k`` candidates all are returned.

    Equal vectors are one class with its smallest ids, so a vector with very
    many copies is searched for and compared once. Classes are dealt into blocks
    by hash; each block has an index of its own, and every query is probed in
    every block. Codes are learned from ``SAMPLE_ROWS`` classes; every row is
    indexed. A radius that yields fewer than ``k`` rows of a block is widened.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do vectors of another than the most frequent length (ties: the
    longer). Ids are whole numbers; rows with a null id take no part, and
    repeated rows are one row. An empty table gives no rows.
    """
    spark = rows.sparkSession
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"),
        is_query.alias("asked"),
    ).filter("id IS NOT NULL")
    picked = _usable(picked, "vector").dropDuplicates()
    lengths = picked.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())]
    )
    if not lengths:
        return spark.createDataFrame([], schema)
    picked = picked.filter(F.size("vector") == lengths[0]["n"])
    picked = materialize(picked.withColumn("row", F.md5(F.to_json(F.struct("vector")))))
    # One more id than asked for: a query leaves its own out.
    by_id = Window.partitionBy("row").orderBy("id")
    members = picked.select("row", "id", F.row_number().over(by_id).alias("n")).filter(F.col("n") <= k + 1)
    classes = materialize(
        picked.groupBy("row").agg(F.min("id").alias("least"), F.any_value("vector").alias("vector"), F.bool_or("asked").alias("asked"))
    )
    total = classes.agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    sample = classes.orderBy("row").limit(SAMPLE_ROWS).collect()
    model = fit_codes(np.array([r["vector"] for r in sample]), float(np.sqrt(total["norm"])), k)
    blocks = max(1, -(-total["n"] // BLOCK_ROWS))
    query_blocks = max(1, -(-total["q"] // BLOCK_QUERIES))
    index = classes.select(
        "row",
        "least",
        "vector",
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    asked = classes.filter("asked").select(
        "row",
        "vector",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"),
    )
    keys = ["block", "query_block"]
    found = (
        index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_searcher(model, k + 1), "query string, row string, least long, score double")
    )
    # A row among the k best lies in one of the k best classes by (score, smallest id);
    # the query's own class may give nothing.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n", "least")
    expanded = found.join(members.select("row", "id"), "row")
    # Queries with equal vectors share one answer but for their own ids.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    shared = expanded.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    lists = shared.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    answers = (
        picked.filter("asked")
        .select(F.col("id").alias("query_id"), F.col("row").alias("query"))
        .join(lists, "query")
        .select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
        .select("query_id", F.posexplode("near").alias("at", "x"))
    )
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
