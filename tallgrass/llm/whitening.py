"""Whitening of embeddings: a randomised range finder over all centred rows, and Rayleigh-Ritz for the components.

1. Every vector becomes whole numbers, ``floor(scale * c) + shift``. Each distinct vector is in the fit list once; counts and sums over it are exact.
2. A random block of ``components + oversampling`` directions is multiplied with the covariance: each task adds up C'(C Q) over its centred rows, and the products of
   all tasks are added up by row of the product. Each pass gives the Rayleigh-Ritz pairs of its block with their residuals, and the next block, its orthonormal basis.
3. If after ``passes`` passes a residual is too large for its component to be right to double precision (it is held against the eigenvalue's distance from
   its neighbours too), the block expands to the full dimension, where the pairs are those of the covariance itself.
4. All rows are projected where they lie, without a shuffle. How far the whitened fit list's covariance is from the identity is measured in one more pass.

The driver and the tasks hold matrices of dimension x block, whatever the number of rows.

Defined cases: a vector that is null, or holds null or non-finite entries, is left out, and so is one with an entry beyond 2^40 (sums of such are not exact any more) or of another length
than the most frequent one (of equally frequent lengths, the longest); a null id is kept; repeated rows are all projected, and fitted once; equal eigenvalues
have any orthonormal basis of their space; directions without variance are no components, so an empty table, a single vector or empty vectors give no rows; other
columns are ignored. ``deviation`` is null if it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import cut

#: The largest entry (absolute) of a vector, and the rows that a task multiplies at a time: whole numbers of 2^46 added up over 2^13 rows fit a long.
_MOST, _ROWS = float(1 << 40), 1 << 13
#: Residuals over the largest eigenvalue, and over the distance from the next one, up to which a component counts as found.
_RESIDUAL, _TURN = 1e-13, 1e-10


def whole(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vectors can be used."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= _MOST))
    return rows.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(vector, lambda e: F.floor(e * scale).cast("bigint") + shift).alias("x"))


def _matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x dim) in steps of _ROWS rows."""
    for at in range(0, batch.num_rows, _ROWS):
        part = batch.column("x").slice(at, _ROWS)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


def _added(fit: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work`` (rows x dim -> a matrix of a fixed shape) over all rows of ``fit``. Each task adds up its own; rows of the products are added up apart from each other."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _matrices(batch, dim):
                done = work(x)
                total = done if total is None else total + done
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "data": pa.array([r.tobytes() for r in total], pa.binary())})

    def joined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "data": [np.sum([np.frombuffer(d) for d in frame["data"]], axis=0).tobytes()]})

    done = fit.mapInArrow(own, "row int, data binary").groupBy("row").applyInPandas(joined, "row int, data binary").collect()  # dim rows
    return np.stack([np.frombuffer(r["data"]) for r in sorted(done, key=lambda r: r["row"])])


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(rows, sums by dimension), exact."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            for _, x in _matrices(batch, dim):
                sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, dim), pa.int32()), "sum": pa.array([str(s) for s in (n, *sums)])})

    rows = fit.mapInArrow(own, "dim int, sum string").groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()  # dim + 1 rows
    by = {r["dim"]: int(r["sum"]) for r in rows}
    return by.get(-1, 0), [by[j] for j in range(dim)] if by else []


@dataclass(frozen=True)
class Whitener:
    """What projects rows: the mean as a whole part and a rest of n-ths, unit components in columns, their eigenvalues, the trace and the error measured on the fit list."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    full: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n x - S)^2, exact; None beyond a long."""
        away = x - self.base
        about = ((self.n * away.astype(float) - self.rest) ** 2).sum(1)
        fits = about < 2.0**62
        out: list[int | None] = [None] * len(x)
        for i, v in zip(np.flatnonzero(fits).tolist(), ((self.n * away[fits] - self.rest) ** 2).sum(1).tolist(), strict=True):
            out[i] = v
        for i in np.flatnonzero(~fits).tolist():
            v = sum((self.n * a - r) ** 2 for a, r in zip(away[i].tolist(), self.rest.tolist(), strict=True))
            out[i] = v if v < 1 << 63 else None
        return out


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values falling, vectors, residuals) of the covariance in the space of ``q``; vq is the covariance times q."""
    small = q.T @ vq
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    return values, q @ turns, np.linalg.norm(vq @ turns - q @ turns * values, axis=0)


def _found(values: np.ndarray, residuals: np.ndarray, k: int) -> bool:
    gaps = np.abs(np.diff(values))
    near = np.minimum(np.r_[np.inf, gaps][:k], np.r_[gaps, 0.0][:k])  # of the last value of a block the next one is not known
    return bool((residuals[:k] <= _RESIDUAL * values[0]).all() and (residuals[:k] <= _TURN * near).all())


def fit(vectors: DataFrame, components: int = 16, oversampling: int = 10, passes: int = 3, seed: int = 42) -> tuple[Whitener | None, int]:
    """The whitener of (vec_id, x) and the dimension; None where nothing varies."""
    longest = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = longest["dim"] if longest else 0
    if not dim:
        return None, 0
    distinct = cut(vectors.where(F.size("x") == dim).select("x").distinct(), "whitening-fit")
    n, sums = _sums(distinct, dim)
    base = np.array([s // n for s in sums])
    rest = np.array([s % n for s in sums])
    mean = rest / n

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times q, and its trace."""

        def work(x: np.ndarray) -> np.ndarray:
            c = (x - base) - mean
            squares = np.zeros((1, q.shape[1]))
            squares[0, 0] = np.square(c).sum()
            return np.vstack([c.T @ (c @ q), squares])

        out = _added(distinct, dim, work) / n
        return out[:-1], float(out[-1, 0])

    width, q = min(dim, components + oversampling), None
    if width < dim:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
        for _ in range(passes):
            vq, trace = times(q)
            values, pairs, residuals = _ritz(q, vq)
            if trace == 0 or _found(values, residuals, min(components, width)):
                break
            q = np.linalg.qr(vq)[0]
        else:
            q = None
    full = q is None
    if full:
        vq, trace = times(np.eye(dim))
        values, pairs, _ = _ritz(np.eye(dim), vq)
    k = int((values[:components] > max(trace, 0.0) * 1e-12).sum()) if trace > 0 else 0
    if not k:
        return None, dim
    made = Whitener(n, base, rest, pairs[:, :k], values[:k], trace, 0.0, full)

    def products(x: np.ndarray) -> np.ndarray:
        w = made.whitened(x)
        return np.vstack([w.T @ w, w.sum(0)])

    out = _added(distinct, dim, products) / n
    error = np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k)).max()
    return Whitener(n, base, rest, made.components, made.eigenvalues, trace, float(error), full), dim


def project(vectors: DataFrame, whitener: Whitener | None, dim: int) -> DataFrame:
    """(vec_id, deviation, whitened array<double>), a row for each vector of the fitted length."""
    id_type = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, deviation long, whitened array<double>"
    if whitener is None:
        return vectors.where("false").select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, dim):
                done = whitener.whitened(x)
                offsets = pa.array(np.arange(0, done.size + 1, done.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(done.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array(whitener.deviations(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return vectors.where(F.size("x") == dim).mapInArrow(run, schema)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, oversampling: int = 10, passes: int = 3, seed: int = 42) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = whole(rows, id_col, vector_col)
    whitener, dim = fit(vectors, components, oversampling, passes, seed)
    shares = [0.0] if whitener is None else (whitener.eigenvalues / whitener.trace).tolist()
    long = project(vectors, whitener, dim).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(whitener.n if whitener else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("explained"),
        F.lit(whitener.identity_error if whitener else 0.0).alias("identity_error"),
    )
