"""Whitening of embeddings by matrix-free block subspace iteration.

No covariance matrix is made: each Spark pass computes X'(XQ) of the centred rows for a block Q of a few columns, tasks add
up their own rows and hand on one such block, and the driver orthonormalizes it and takes its Ritz pairs. That goes on
until the residual |Vq - eq| of every wanted pair is small, which bounds the error of each of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, with_schema

COMPONENTS = 16
#: Columns of the block beyond the wanted ones: the wanted ones converge by the ratio of the eigenvalue behind the block.
GUARD = 48
#: Residuals in units of the largest eigenvalue; passes at most.
TOLERANCE, MAX_PASSES = 1e-13, 500
#: Eigenvalues of a smaller share of the largest one count as zero; entries are held within these bounds.
RANK_SHARE, LARGEST = 1e-12, 1 << 61
#: Partial blocks that the driver adds up at most.
FAN_IN = 8


@dataclass
class Whitening:
    """n distinct vectors with sums per dimension; components (dimensions, k), eigenvalues (k), trace; the largest entry of
    the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0


def quantize(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with `x`, the vector's entries as little-endian longs floor(64 c) + 1000000, and `dim`; rows whose vector is null or
    holds a null, NaN or infinite entry go. Entries beyond +-2^61 are held there."""
    usable = F.col(f"`{vector}`").isNotNull() & F.forall(f"`{vector}`", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = df.where(usable)
    schema = kept.select("*", F.lit(0).alias("dim"), F.lit(b"").alias("x")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.clip(np.floor(np.clip(flat, -2.0**60, 2.0**60) * 64), -float(LARGEST), float(LARGEST)).astype("<i8") + 1_000_000
            sizes = column.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            made = [x[e - s : e].tobytes() for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], names=[*batch.schema.names, "dim", "x"])

    return kept.mapInArrow(run, schema)


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, (rows, d)."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they hold it, else as Python integers."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; null where a long cannot hold one."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    made = (sum(int(v) * int(v) for v in row) for row in y)
    return [v if v < 1 << 63 else None for v in made]


def _added(parts: DataFrame, shape: tuple[int, ...], dtype: str = "<f8") -> np.ndarray:
    """The sum of partial arrays (g binary), one row a task; tasks add up first, so that the driver gets FAN_IN at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, dtype)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                out += np.frombuffer(g, dtype).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

    total = np.zeros(shape, dtype)
    for row in parts.repartition(FAN_IN).mapInArrow(run, "g binary").collect():
        total += np.frombuffer(row["g"], dtype).reshape(shape)
    return total


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Sums per dimension, exact. Each entry goes as three parts of 21 bits, whose sums stay far below 2^63."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, d), "<i8")
        for batch in batches:
            x = _rows(batch.column(0), d)
            for k, part in enumerate((x & 0x1FFFFF, (x >> 21) & 0x1FFFFF, x >> 42)):
                out[k] += part.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

    low, middle, high = _added(fit.select("x").mapInArrow(run, "g binary"), (3, d), "<i8").tolist()
    return [a + (b << 21) + (c << 42) for a, b, c in zip(low, middle, high)]


def _product(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q of the centred rows' covariance V, and V's trace: one pass."""
    d, b = q.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d + 1, b))
        for batch in batches:
            y = (_from_mean(_rows(batch.column(0), d), n, sums) / n).astype(np.float64)
            out[:d] += y.T @ (y @ q)
            out[d, 0] += np.vdot(y, y)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

    total = _added(fit.select("x").mapInArrow(run, "g binary"), (d + 1, b))
    return total[:d] / n, float(total[d, 0] / n)


def fit_whitening(fit: DataFrame, d: int, k: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES, seed: int = 0) -> Whitening:
    """The first k principal components of distinct vectors (x binary, of d longs).

    Components of zero variance are left out, as nothing can be divided by their deviation. Each component's largest entry
    is positive. Stops when all residuals are within the tolerance, or have stopped falling within a hundred times of it,
    where rounding is all that is left; an error if neither happens within max_passes.
    """
    n = fit.count()
    sums = _sums(fit, d) if n and d else [0] * d
    b = min(d, k + guard)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    least, still = np.inf, 0
    for passes in range(1, max_passes + 1):
        vq, trace = _product(fit, n, sums, q)
        if trace <= 0:
            return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), trace, passes=passes)
        h = q.T @ vq
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz, image = q @ vectors, vq @ vectors
        wanted = min(k, int((values > RANK_SHARE * values[0]).sum()))
        worst = np.linalg.norm(image - ritz * values, axis=0)[:wanted].max() / values[0]
        still = 0 if worst < 0.5 * least else still + 1
        least = min(least, worst)
        if worst <= tolerance or (worst <= 100 * tolerance and still >= 3):
            break
        q = np.linalg.qr(image)[0]
    else:
        raise ValueError(f"residuals of {least:.1e} after {max_passes} passes")
    components, e = ritz[:, :wanted], values[:wanted]
    components = components / np.linalg.norm(components, axis=0)
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(wanted)])
    found = Whitening(n, sums, components, e, trace, passes=passes)
    measured = components / np.sqrt(e)
    found.identity_error = float(np.abs(measured.T @ _product(fit, n, sums, measured)[0] - np.eye(wanted)).max(initial=0.0))
    return found


def whiten(rows: DataFrame, fitted: Whitening, key: str = "vec_id") -> DataFrame:
    """A row for each vector (key, x) and component: n, deviation, whitened, explained, identity_error."""
    n, sums, k = fitted.n, fitted.sums, len(fitted.eigenvalues)
    d, scaled = len(sums), fitted.components / np.sqrt(fitted.eigenvalues)
    share = fitted.eigenvalues / fitted.trace if k else fitted.eigenvalues
    schema = f"`{key}` {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    error = fitted.identity_error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            y = _from_mean(_rows(batch.column(1), d), n, sums)
            made = (y / n).astype(np.float64) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(made.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "x").mapInArrow(run, schema)


def whiten_embeddings(df: DataFrame, k: int = COMPONENTS, guard: int = GUARD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened vectors of df (key, vector), fitted to each distinct quantized vector once.

    Rows without a usable vector (quantize) give no row; repeated rows and null keys give theirs; vectors of another length
    are another space and are fitted on their own; empty vectors and components of zero variance give no row, nor does an
    empty table. Hot vectors are merged before the shuffle. Other columns are left out.
    """
    rows = quantize(with_schema(df, key, vector), vector).select(key, "dim", "x")
    fit, _ = materialize(rows.select("dim", "x").distinct(), "vectors")
    parts = []
    for (d,) in sorted(fit.select("dim").distinct().collect()):
        fitted = fit_whitening(fit.where(F.col("dim") == d), d, k, guard)
        if len(fitted.eigenvalues):
            parts.append(whiten(rows.where(F.col("dim") == d), fitted, key))
    if not parts:
        return whiten(rows.where("false"), Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0), key)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings by component; nulls, repeats, lengths and empty tables as in whiten_embeddings."""
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))
