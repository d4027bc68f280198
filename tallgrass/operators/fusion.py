"""Many small classifiers fitted together: expression alone, or with projections onto graph views, fused uniformly or by learned weights.

A run is a feature mode, a set of views with a way to fuse them, and a split of the rows. All runs share the passes over the rows: in each step a task adds up the gradients of every run over its own rows,
what the tasks have is added up by run, and the driver takes one step for each run. No run, and no fold of one, is fitted in one task. The driver and the tasks hold the runs' weights: a stated number of runs
times the width of a row.

The head is logistic: p = 1 / (1 + exp(-(b + w x + u sum_v a_v P_v))) with a = softmax(c); x is the row's features that the mode leaves, P_v the projection of those onto view v, both standardised with the
mean and deviation of the run's training rows (a constant column stays as it is, less its mean). Steps are plain gradient steps with a quadratic penalty; of all steps, the weights with the smallest loss on
the held-out rows of the split are kept.

Defined cases: rows with a null key, label or features are left out, and rows of another width than the most frequent one; a split without held-out rows keeps the last step; a run without training rows
keeps zero weights; an empty table gives runs with zero weights and no predictions; repeated rows count as often as they are there."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, draw_number
from tallgrass.functions.store import stored


@dataclass(frozen=True)
class Run:
    """``low`` to ``high`` is the stretch of a row's draw in the split ``seed`` that is held out."""

    name: str
    mode: str
    views: tuple[str, ...]
    fused: str | None  # None, "uniform" or "learned"
    seed: int
    low: float = 0.0
    high: float = 0.2
    rate: float = 0.5
    penalty: float = 1e-3


@dataclass(frozen=True)
class Design:
    """views: name -> features x dimensions; modes: name -> which features stay."""

    views: dict[str, np.ndarray]
    modes: dict[str, np.ndarray]

    def columns(self, x: np.ndarray, mode: str) -> np.ndarray:
        """The row's features and its projections onto all views, side by side. A feature that the mode takes out is in none of them."""
        left = x * self.modes[mode]
        return np.hstack([left, *[left @ e for e in self.views.values()]])

    @property
    def width(self) -> int:
        return len(next(iter(self.modes.values())))

    @property
    def dim(self) -> int:
        return next((e.shape[1] for e in self.views.values()), 0)

    def place(self, view: str) -> slice:
        at = self.width + list(self.views).index(view) * self.dim
        return slice(at, at + self.dim)


@dataclass
class Weights:
    b: float
    w: np.ndarray
    u: np.ndarray
    c: np.ndarray

    def shares(self) -> np.ndarray:
        e = np.exp(self.c - self.c.max()) if len(self.c) else self.c
        return e / e.sum() if len(e) else e


def variants(views: Sequence[str], merged: str = "merged") -> dict[str, tuple[tuple[str, ...], str | None]]:
    """name -> (views, fused): no graph, all edges as one view, each view alone, all views uniformly and with learned weights, and learned weights without each view."""
    views = tuple(views)
    out: dict[str, tuple[tuple[str, ...], str | None]] = {"no_graph": ((), None), "merged_svd": ((merged,), "uniform")}
    out |= {f"single__{v}": ((v,), "uniform") for v in views}
    out |= {"uniform_multiview": (views, "uniform"), "learned_multiview": (views, "learned")}
    return out | {f"leave_out__{v}": (tuple(o for o in views if o != v), "learned") for v in views}


def matrix_of_runs(views: Sequence[str], modes: Sequence[str], seeds: Sequence[int], **options: float) -> list[Run]:
    return [Run(v, m, own, fused, s, **options) for m in modes for s in seeds for v, (own, fused) in variants(views).items()]


def missing_runs(results: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """(variant, mode, seed) that should be in ``results`` and are not."""
    wanted = results.sparkSession.createDataFrame([(r.name, r.mode, r.seed) for r in runs], "variant string, mode string, seed int").distinct()
    return wanted.join(results.select("variant", "mode", "seed"), ["variant", "mode", "seed"], "left_anti")


def prepared(rows: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """(key, y, x, draw): the rows that can be used, with a number that splits derive their draws from."""
    used = rows.where(F.col(key).isNotNull() & F.col(y).isNotNull() & F.col(x).isNotNull())
    return used.select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"), draw_number(draw_key(0, key)).alias("draw"))


def held_out(draw: np.ndarray, run: Run) -> np.ndarray:
    """The draw of a row in a split is a hash of its number; products of 31 bits stay below 2^62."""
    prime = (1 << 31) - 1
    place = ((draw % prime) * (1 + (run.seed * 2_654_435_761) % (prime - 1)) + (run.seed * 40_503) % prime) % prime / prime
    return (place >= run.low) & (place < run.high)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            yield batch.column("key"), x, batch.column("y").to_numpy(zero_copy_only=False), batch.column("draw").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, work, n: int) -> dict[int, np.ndarray]:
    """``work(x, y, draw)`` gives an array for each of ``n`` numbers; the sums over all rows, by number."""
    width = work.width

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [0.0] * n
        for _, x, y, draw in _batches(batches, width):
            sums = [s + d for s, d in zip(sums, work(x, y, draw), strict=True)]
        if n and not np.isscalar(sums[0]):
            yield pa.RecordBatch.from_pydict({"run": pa.array(range(n), pa.int32()), "data": pa.array([s.tobytes() for s in sums], pa.binary())})

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "data": [np.sum([np.frombuffer(d) for d in parts["data"]], axis=0).tobytes()]})

    done = rows.mapInArrow(own, "run int, data binary").groupBy("run").applyInPandas(added, "run int, data binary").collect()  # a row of fixed size for each run
    return {r["run"]: np.frombuffer(r["data"]) for r in done}


class _Moments:
    """Sums and squares of the columns over training rows, for each (mode, split)."""

    def __init__(self, design: Design, splits: list[Run]):
        self.design, self.splits, self.width = design, splits, design.width

    def __call__(self, x: np.ndarray, y: np.ndarray, draw: np.ndarray) -> list[np.ndarray]:
        out = []
        for run in self.splits:
            g = self.design.columns(x, run.mode)[~held_out(draw, run)]
            out.append(np.r_[len(g), g.sum(0), (g * g).sum(0)])
        return out


class _Gradients:
    """[n, loss, held-out n, held-out loss, gradient of b, w, u and c] of each run."""

    def __init__(self, design: Design, runs: list[Run], weights: list[Weights], scales: dict[tuple, tuple[np.ndarray, np.ndarray]]):
        self.design, self.runs, self.weights, self.scales, self.width = design, runs, weights, scales, design.width

    def __call__(self, x: np.ndarray, y: np.ndarray, draw: np.ndarray) -> list[np.ndarray]:
        out, columns, cache = [], {m: self.design.columns(x, m) for m in {r.mode for r in self.runs}}, {}
        for run, t in zip(self.runs, self.weights, strict=True):
            split = _split(run)
            if split not in cache:
                mean, scale = self.scales[split]
                cache[split] = (columns[run.mode] - mean) / scale, held_out(draw, run)
            z, out_rows = cache[split]
            logit, views, fused = _logits(self.design, run, t, z)
            p = 1 / (1 + np.exp(-logit))
            loss = np.logaddexp(0, logit) - y * logit
            e = np.where(out_rows, 0.0, p - y)
            parts = [e.sum()], z[:, : self.width].T @ e, fused.T @ e if len(t.u) else []
            slope = np.array([(v @ t.u) @ e for v in views]) if run.fused == "learned" else np.zeros(len(views))
            a = t.shares()
            out.append(np.r_[(~out_rows).sum(), loss[~out_rows].sum(), out_rows.sum(), loss[out_rows].sum(), *parts, a * (slope - a @ slope) if len(a) else []])
        return out


def _split(run: Run) -> tuple:
    return run.mode, run.seed, run.low, run.high


def _logits(design: Design, run: Run, t: Weights, z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    views = [z[:, design.place(v)] for v in run.views]
    fused = sum((a * v for a, v in zip(t.shares(), views, strict=True)), np.zeros((len(z), len(t.u))))
    return t.b + z[:, : design.width] @ t.w + (fused @ t.u if len(t.u) else 0.0), views, fused


@dataclass
class Fitted:
    design: Design
    runs: list[Run]
    weights: list[Weights]
    scales: dict[tuple, tuple[np.ndarray, np.ndarray]]
    best_step: list[int]
    held_out_loss: list[float]


def fit(rows: DataFrame, design: Design, runs: list[Run], steps: int = 40, start: list[Weights] | None = None) -> Fitted:
    """``rows`` as from ``prepared``. All runs take ``steps`` gradient steps, from ``start`` if it is given."""
    rows = rows.where(F.size("x") == design.width)
    splits = list({_split(r): r for r in runs}.values())
    scales = {}
    moments = _summed(rows, _Moments(design, splits), len(splits))
    columns = design.width + design.dim * len(design.views)
    for k, run in enumerate(splits):
        n, sums, squares = np.split(moments.get(k, np.zeros(1 + 2 * columns)), [1, 1 + columns])
        mean = sums / max(n[0], 1.0)
        spread = np.sqrt(np.maximum(squares / max(n[0], 1.0) - mean * mean, 0))
        scales[_split(run)] = mean, np.where(spread > 1e-8, spread, 1.0)
    now = start or [Weights(0.0, np.zeros(design.width), np.full(design.dim, 0.01) if r.views else np.zeros(0), np.zeros(len(r.views))) for r in runs]
    best, best_step, best_loss = list(now), [0] * len(runs), [np.inf] * len(runs)
    for step in range(steps + 1):  # the last pass only measures
        sums = _summed(rows, _Gradients(design, runs, now, scales), len(runs))
        following = []
        for k, (run, t) in enumerate(zip(runs, now, strict=True)):
            if k not in sums or not sums[k][0]:
                following.append(t)
                continue
            n, _, m, loss = sums[k][:4]
            held = loss / m if m else -step  # without held-out rows the last step counts
            if held < best_loss[k]:
                best[k], best_step[k], best_loss[k] = t, step, held
            gb, gw, gu, gc = np.split(sums[k][4:] / n, np.cumsum([1, len(t.w), len(t.u)]))
            following.append(Weights(t.b - run.rate * gb[0], t.w - run.rate * (gw + run.penalty * t.w), t.u - run.rate * (gu + run.penalty * t.u), t.c - run.rate * gc))
        now = following
    return Fitted(design, list(runs), best, scales, best_step, [float(b) for b in best_loss])


def predict(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """(variant, mode, seed, key, y, probability) of rows of any cohort, a row for each run."""
    design, runs, weights, scales = fitted.design, fitted.runs, fitted.weights, fitted.scales
    kind = dict(rows.dtypes)["key"]

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, y, _ in _batches(batches, design.width):
            for run, t in zip(runs, weights, strict=True):
                mean, scale = scales[_split(run)]
                p = 1 / (1 + np.exp(-_logits(design, run, t, (design.columns(x, run.mode) - mean) / scale)[0]))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([run.name] * n), pa.array([run.mode] * n), pa.array(np.full(n, run.seed), pa.int32()), key, pa.array(y.astype(np.int32)), pa.array(p)], ["variant", "mode", "seed", "key", "y", "probability"])

    return rows.where(F.size("x") == design.width).mapInArrow(run_all, f"variant string, mode string, seed int, key {kind}, y int, probability double")


def fusion_weights(spark, fitted: Fitted) -> DataFrame:
    """(variant, mode, seed, view, weight) of the runs that fuse views."""
    table = [(r.name, r.mode, r.seed, v, float(a)) for r, t in zip(fitted.runs, fitted.weights, strict=True) for v, a in zip(r.views, t.shares(), strict=True)]
    return spark.createDataFrame(table, "variant string, mode string, seed int, view string, weight double")


def views_of(vectors: DataFrame, features: list[str]) -> dict[str, np.ndarray]:
    """view -> features x dimensions, from (view, node, vector); a feature without a node has zeros. As many rows as features and views."""
    at = {f: i for i, f in enumerate(features)}
    out: dict[str, np.ndarray] = {}
    for r in vectors.where(F.col("node").isin(features)).collect():
        out.setdefault(r["view"], np.zeros((len(features), len(r["vector"]))))[at[r["node"]]] = r["vector"]
    return dict(sorted(out.items()))


def halving(rows: DataFrame, design: Design, trials: dict[str, dict], folds: int, path: str, steps: int = 4, keep: int = 3, seed: int = 42) -> DataFrame:
    """(rung, trial, fold, steps, loss) of a search by successive halving: each rung runs all folds of its trials for ``keep`` times the steps of the one before, and the best ``1 / keep`` of the trials,
    by mean held-out loss, go on from where they are. ``trials``: name -> fields of Run.

    Each rung is a table at ``path``, with the runs' weights. A search that is started again reads the rungs that are complete and goes on with the next."""
    spark, rung, alive, start, out = rows.sparkSession, 0, sorted(trials), None, None
    rows = stored(rows, "search-rows")
    while True:
        runs = [Run(name=t, low=f / folds, high=(f + 1) / folds, seed=seed, **trials[t]) for t in alive for f in range(folds)]
        at = f"{path}/rung={rung}"
        try:
            table = spark.read.parquet(at)
            found = {(r["trial"], r["fold"]): r for r in table.collect()}  # a row for each run
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = {}
        if set(found) != {(r.name, f) for r, f in zip(runs, list(range(folds)) * len(alive), strict=True)}:
            fitted = fit(rows, design, runs, steps * keep**rung, start)
            done = [
                (r.name, k % folds, steps * keep**rung, float(loss), np.r_[t.b, t.w, t.u, t.c].tobytes())
                for k, (r, loss, t) in enumerate(zip(fitted.runs, fitted.held_out_loss, fitted.weights, strict=True))
            ]
            spark.createDataFrame(done, "trial string, fold int, steps int, loss double, weights binary").write.mode("overwrite").parquet(at)
            table = spark.read.parquet(at)
            found = {(r["trial"], r["fold"]): r for r in table.collect()}
        part = table.select(F.lit(rung).alias("rung"), "trial", "fold", "steps", "loss")
        out = part if out is None else out.union(part)
        if len(alive) == 1:
            return out
        mean = {t: sum(found[t, f]["loss"] for f in range(folds)) / folds for t in alive}
        alive = sorted(sorted(alive, key=lambda t: (mean[t], t))[: max(1, len(alive) // keep)])
        start = []
        for t in alive:
            views = len(trials[t]["views"])
            for f in range(folds):
                b, w, u, c = np.split(np.frombuffer(found[t, f]["weights"]), np.cumsum([1, design.width, design.dim if views else 0]))
                start.append(Weights(float(b[0]), w, u, c))
        rung += 1
