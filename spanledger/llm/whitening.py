"""Embedding whitening from exact squares: polarisation gives every covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components given for a vector.
COMPONENTS = 32
#: Integer entries beyond this do not fit the exact sums.
MOST = 1 << 45
#: Entries worked on at once.
_CELLS = 1 << 20
_EXACT = pa.decimal128(38, 0)
#: Eigenvalues below this share of the largest are zero.
_RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Components of all vectors of one length."""

    n: int
    sums: list[int]
    centre: np.ndarray  # integers nearest to the means
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # a column for each of them
    trace: float
    identity_error: float = 0.0

    @property
    def length(self) -> int:
        return len(self.sums)

    @property
    def rest(self) -> np.ndarray:
        """Mean less centre, below one in size."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])

    def directions(self, components: int) -> np.ndarray:
        """Components over the root of their eigenvalue; those of eigenvalue zero are NaN."""
        values, vectors = self.values[:components], self.vectors[:, :components]
        able = values > _RANK * max(self.values[0], 0.0) if len(values) else np.zeros(0, bool)
        return np.where(able, vectors / np.sqrt(np.where(able, values, 1.0)), np.nan)


def integer_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each vector length among the usable rows of a batch."""
    column = column.cast(pa.large_list(pa.float64()))
    filled = column.fill_null([]) if column.null_count else column
    lengths = np.asarray(filled.value_lengths(), np.int64)
    entries = filled.flatten()
    numbers = np.asarray(entries.fill_null(np.nan), float)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * numbers)
        bad = ~(np.abs(scaled) < MOST)
    ends = np.cumsum(lengths)
    faults = np.concatenate([[0], np.cumsum(bad)])
    usable = (faults[ends] == faults[ends - lengths]) & np.asarray(column.is_valid())
    for length in np.unique(lengths[usable]):
        if length:
            rows = np.flatnonzero(usable & (lengths == length))
            at = (ends - lengths)[rows][:, None] + np.arange(length)
            yield rows, scaled[at].astype(np.int64) + SHIFT


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, matrix in integer_vectors(column):
        step = max(1, _CELLS // matrix.shape[1])
        for start in range(0, len(rows), step):
            yield rows[start : start + step], matrix[start : start + step]


def _exact(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _EXACT)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and entry sums of a partition by length and dimension."""
    rows: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _blocks(batch.column("vector")):
            length = x.shape[1]
            rows[length] = rows.get(length, 0) + len(x)
            # At most 2**20 rows of 2**45 a block fit 65 bits; halves do.
            high, low = (x >> 20).sum(0), (x & 0xFFFFF).sum(0)
            sums[length] = sums.get(length, np.zeros(length, object)) + high.astype(object) * (1 << 20) + low.astype(object)
    for length, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(length, length), pa.int32()),
                pa.array(np.arange(length), pa.int32()),
                pa.array(np.full(length, rows[length]), pa.int64()),
                _exact(total),
            ],
            ["length", "dimension", "n", "total"],
        )


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums over rows of (y_i + y_j)^2 for i < j and of y_i^2 on the diagonal, exact Python integers."""
    length = y.shape[1]
    small = len(y) == 0 or (4 * int(np.abs(y).max()) ** 2) * len(y) < 1 << 62
    kind = np.int64 if small else object
    y = np.ascontiguousarray(y.astype(kind).T)
    out = np.zeros((length, length), object)
    for i in range(length):
        both = y[i:] + y[i]
        both[0] = y[i]
        out[i, i:] = np.einsum("ij,ij->i", both, both) if small else (both * both).sum(1)
    return out


def _squares(centres: dict[int, np.ndarray]):
    """Squared centred values of a partition, for every dimension and sum of two dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column("vector")):
                length = x.shape[1]
                found = pair_squares(x - centres[length])
                totals[length] = totals[length] + found if length in totals else found
        for length, total in totals.items():
            for i in range(length):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(length - i, length), pa.int32()),
                        pa.array(np.full(length - i, i), pa.int32()),
                        pa.array(np.arange(i, length), pa.int32()),
                        _exact(total[i, i:]),
                    ],
                    ["length", "i", "j", "total"],
                )

    return run


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance matrix (divisor n) from the squares of centred sums.

    ``rest`` are the sums left after centring at integers. The variance of a
    sum of two dimensions less both variances is twice their covariance; all
    of it is exact until one division.
    """
    length = len(rest)
    variance = {}
    for i in range(length):
        for j in range(i, length):
            left = rest[i] if i == j else rest[i] + rest[j]
            variance[i, j] = n * squares[i, j] - left * left
    out = np.empty((length, length))
    for i in range(length):
        for j in range(i, length):
            if i == j:
                out[i, i] = variance[i, i] / (n * n)
            else:
                out[i, j] = out[j, i] = (variance[i, j] - variance[i, i] - variance[j, j]) / (2 * n * n)
    return out


def _project(x: np.ndarray, model: Whitening, directions: np.ndarray) -> np.ndarray:
    return (x - model.centre - model.rest) @ directions


def _moments(models: dict[int, Whitening], components: int):
    """Sums of the whitened values of a partition and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        ways = {k: m.directions(components) for k, m in models.items()}
        for batch in batches:
            for _, x in _blocks(batch.column("vector")):
                length = x.shape[1]
                w = _project(x, models[length], ways[length])
                w = np.hstack([np.ones((len(w), 1)), w])
                totals[length] = totals.get(length, 0) + w.T @ w
        for length, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), length), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())],
                ["length", "i", "j", "total"],
            )

    return run


def _identity_errors(vectors: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured."""
    sent = vectors.mapInArrow(_moments(models, components), "length int, i int, j int, total double")
    sums: dict[int, np.ndarray] = {k: np.zeros((min(k, components) + 1,) * 2) for k in models}
    for row in sent.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect():
        sums[row["length"]][row["i"], row["j"]] = row["total"]
    errors = {}
    for length, total in sums.items():
        n = models[length].n
        mean = total[0, 1:] / n
        off = total[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean))
        # Directions without variance take no part.
        errors[length] = float(np.nanmax(np.abs(off))) if not np.isnan(off).all() else 0.0
    return errors


def fit_whitening(docs: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> dict[int, Whitening]:
    """One :class:`Whitening` for each vector length of ``docs``, fitted on all usable rows.

    Entries c become integers floor(64 * c) + 1000000. One pass sums them, a
    second sums squares around the integers nearest to the means, for every
    dimension and every sum of two dimensions; both are exact, combine within
    a partition and shuffle by dimension. The driver gets one matrix a length:
    it holds length * length numbers, whatever the rows. A third pass measures
    how far the whitened vectors are from unit covariance.

    Unusable rows: null vectors, and those with a null or non-finite entry or
    one beyond 2**45 / 64. Repeated rows count each. An empty table gives {}.
    """
    vectors = docs.select(F.col(vector_col).cast("array<double>").alias("vector"))
    sums: dict[int, list[tuple]] = {}
    sent = vectors.mapInArrow(_sums, "length int, dimension int, n long, total decimal(38,0)")
    for row in sent.groupBy("length", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        sums.setdefault(row["length"], []).append((row["dimension"], row["n"], int(row["total"])))
    counts = {k: v[0][1] for k, v in sums.items()}
    totals = {k: [s for _, _, s in sorted(v)] for k, v in sums.items()}
    centres = {k: np.array([(2 * s + counts[k]) // (2 * counts[k]) for s in v], np.int64) for k, v in totals.items()}
    squares: dict[int, dict[tuple[int, int], int]] = {k: {} for k in totals}
    sent = vectors.mapInArrow(_squares(centres), "length int, i int, j int, total decimal(38,0)")
    for row in sent.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        squares[row["length"]][row["i"], row["j"]] = int(row["total"])
    models = {}
    for length, total in totals.items():
        n = counts[length]
        matrix = covariance(n, [s - n * int(c) for s, c in zip(total, centres[length], strict=True)], squares.pop(length))
        values, found = np.linalg.eigh(matrix)
        models[length] = Whitening(n, total, centres[length], values[::-1].copy(), found[:, ::-1].copy(), float(np.trace(matrix)))
    errors = _identity_errors(vectors, models, components) if models else {}
    return {k: Whitening(**{**m.__dict__, "identity_error": errors[k]}) for k, m in models.items()}


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Exact sum over dimensions of (n * x - S)^2 for each row."""
    y = x - model.centre
    left = [s - model.n * int(c) for s, c in zip(model.sums, model.centre, strict=True)]
    most = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 62:
        d = model.n * y - np.array(left, np.int64)
        return pa.array(np.einsum("ij,ij->i", d, d), pa.int64()).cast(_EXACT)
    d = y.astype(object) * model.n - np.array(left, object)
    return _exact((d * d).sum(1))


def _whitener(models: dict[int, Whitening], components: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = {k: m.directions(components) for k, m in models.items()}
        for batch in batches:
            for rows, x in _blocks(batch.column("vector")):
                model = models[x.shape[1]]
                w = _project(x, model, ways[model.length])
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                at = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                share = model.values[:components] / model.trace if model.trace else np.zeros(w.shape[1])
                shares = pa.array(np.tile(share, len(w)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(rows)),
                        pa.array(np.full(len(w), model.n), pa.int64()),
                        deviations(x, model),
                        pa.ListArray.from_arrays(at, flat),
                        pa.ListArray.from_arrays(at, shares),
                        pa.array(np.full(len(w), model.identity_error)),
                    ],
                    schema=schema,
                )

    return run


def whiten_vectors(
    docs: DataFrame, models: dict[int, Whitening], components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of every usable row.

    ``whitened`` and ``explained`` are arrays over the components, at most
    ``components`` and the vector's length. Vectors of another length than any
    of the models, and unusable ones (see :func:`fit_whitening`), give no row;
    null ids stay. Directions along which the fitted vectors do not vary have
    null in ``whitened`` and take no part in ``identity_error``. Every length
    is whitened on its own. No shuffle; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(vector_col).cast("array<double>").alias("vector"))
    if not models:
        slim = slim.limit(0)
    kind = slim.schema["key"].dataType
    schema = pa.schema(
        [
            ("key", _arrow(slim, kind)),
            ("n", pa.int64()),
            ("deviation", _EXACT),
            ("whitened", pa.list_(pa.float64())),
            ("explained", pa.list_(pa.float64())),
            ("identity_error", pa.float64()),
        ]
    )
    names = f"key {kind.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    return slim.mapInArrow(_whitener(models, components, schema), names).withColumnRenamed("key", id_col)


def _arrow(slim: DataFrame, kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def components_table(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row for each vector and component (numbered from 1) of :func:`whiten_vectors`."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return whitened.select(id_col, "n", "deviation", "identity_error", pairs).select(
        id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error"
    )
