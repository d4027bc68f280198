"""Bootstraps over rows that lie anywhere: each row has a Poisson weight in each replicate, from a hash of its key.

A row's key is a number below 2^31 - 1, and replicate b turns it into (a_b * key + c_b) mod (2^31 - 1), whose place among the steps of the Poisson distribution with mean 1 is the weight. Statistics that are
sums come from one aggregation over (row, replicate), combined in the tasks first. AUROC needs the order of the scores: one range shuffle of the rows, then each task runs through its own
scores with all replicates beside each other, and tasks are joined by their totals. Replicate 0 has the weight 1 everywhere: the observed statistic.

Defined cases: rows with a null key, score or label have no part; ties of scores count half in AUROC; a replicate without one of the classes has a null AUROC; repeated keys get
the same weights; an empty table gives null statistics or no rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, draw_number, ratio

PRIME = (1 << 31) - 1
#: A key at or above the k-th step has a weight over k.
STEPS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * PRIME) for k in range(12)]
_ROWS = 512  # rows whose weights a task has at a time


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    """(a, c) of replicates 1 ... n."""
    return [(1 + _number(f"{seed}:a:{b}") % (PRIME - 1), _number(f"{seed}:c:{b}") % PRIME) for b in range(1, n + 1)]


def row_key(key: str | Column, seed: int) -> Column:
    return F.pmod(draw_number(draw_key(seed, key)), F.lit(PRIME))


def replicates(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(boot, a, c), a row for each replicate and one for the observed statistic."""
    return spark.createDataFrame([(0, 0, 0), *((b, *ac) for b, ac in enumerate(coefficients(n, seed), 1))], "boot int, a long, c long")


def weighted(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``rows`` for each replicate in which they have a weight, with boot and weight. The replicates are a stated number, whatever the rows."""
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_key", row_key(key, seed))
    place = (F.col("a") * F.col("_key") + F.col("c")) % F.lit(PRIME)
    steps = sum((F.when(place >= s, 1).otherwise(0) for s in STEPS[1:]), F.when(place >= STEPS[0], 1).otherwise(0))
    both = keyed.join(F.broadcast(replicates(rows.sparkSession, n, seed))).withColumn("weight", F.when(F.col("boot") == 0, 1).otherwise(steps))
    return both.where("weight > 0").drop("_key", "a", "c")


def mcc(rows: DataFrame, y: str, scores: list[str], key: str, n: int, seed: int = 42, at: float = 0.5) -> DataFrame:
    """(boot, mcc_<score>): Matthews' correlation of each score's predictions, positive from ``at`` on."""
    used = rows.where(F.col(y).isNotNull()).select(key, (F.col(y) == 1).alias("pos"), *[(F.col(s) >= at).alias(f"up_{s}") for s in scores])
    cells = {f"{kind}_{s}": F.sum(F.when((F.col("pos") == p) & (F.col(f"up_{s}") == u), F.col("weight")).otherwise(0)).cast("double") for s in scores for kind, p, u in (("tp", True, True), ("fp", False, True), ("tn", False, False), ("fn", True, False))}
    sums = weighted(used, key, n, seed).groupBy("boot").agg(*[c.alias(k) for k, c in cells.items()])

    def value(s: str) -> Column:
        tp, fp, tn, fn = (F.col(f"{k}_{s}") for k in ("tp", "fp", "tn", "fn"))
        return F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))

    return sums.select("boot", *[value(s).alias(f"mcc_{s}") for s in scores])


def weights(keys: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows x replicates; products stay below 2^62."""
    return np.searchsorted(STEPS, (keys[:, None] * a + c) % PRIME, side="right")


def _wins(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.array([(1, 0), *coefficients(n, seed)], np.int64).T
        pos, neg, wins = (np.zeros(n + 1) for _ in range(3))
        open_score, open_pos, open_neg = None, np.zeros(n + 1), np.zeros(n + 1)
        for batch in batches:
            keys, y, score = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "pos", "score"))
            for at in range(0, len(keys), _ROWS):
                w = weights(keys[at : at + _ROWS], a, c).astype(float)
                w[:, 0] = 1
                s, p = score[at : at + _ROWS], y[at : at + _ROWS].astype(bool)
                starts = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
                ups, downs = np.add.reduceat(w * p[:, None], starts), np.add.reduceat(w * ~p[:, None], starts)
                for k, start in enumerate(starts.tolist()):  # a tie may go on in the next batch
                    if open_score is not None and s[start] != open_score:
                        wins += open_pos * (neg + open_neg / 2)
                        pos, neg, open_pos, open_neg = pos + open_pos, neg + open_neg, np.zeros(n + 1), np.zeros(n + 1)
                    open_score, open_pos, open_neg = s[start], open_pos + ups[k], open_neg + downs[k]
        wins += open_pos * (neg + open_neg / 2)
        pos, neg = pos + open_pos, neg + open_neg
        if pos[0] + neg[0]:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, part), pa.int32()), pa.array(np.arange(n + 1), pa.int32()), pa.array(pos), pa.array(neg), pa.array(wins)], ["part", "boot", "pos", "neg", "wins"])

    return run


def auroc(rows: DataFrame, y: str, score: str, key: str, n: int, seed: int = 42, out: str = "auroc") -> DataFrame:
    """(boot, out)."""
    used = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull() & F.col(key).isNotNull())
    slim = used.select(row_key(key, seed).alias("key"), (F.col(y) == 1).cast("int").alias("pos"), F.col(score).cast("double").alias("score"))
    parts = slim.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(_wins(n, seed), "part int, boot int, pos double, neg double, wins double")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("boot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("below", below).groupBy("boot").agg(ratio(F.sum(F.col("wins") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")).alias(out))


def difference(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row of ``values`` (boot, a, b): observed (a - b), n, mean, sd, low, high, p_two (as far from the observed as that is from zero), p_one (not over zero)."""
    each = values.select("boot", (F.col(a) - F.col(b)).alias("d"))
    observed = each.where("boot = 0").select(F.col("d").alias("observed"))
    ends = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))  # of as many values as there are replicates
    drawn = each.where("boot > 0").join(F.broadcast(observed))
    return drawn.groupBy("observed").agg(
        F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), ends[0].alias("low"), ends[1].alias("high"),
        ratio(F.count_if(F.abs(F.col("d") - F.col("observed")) >= F.abs("observed")), F.count("d")).alias("p_two"), ratio(F.count_if(F.col("d") <= 0), F.count("d")).alias("p_one"),
    )


def top_positions(rows: DataFrame, key: str, score: str, n: int, top: int = 20, seed: int = 42) -> DataFrame:
    """(place, key, score, low, high): for the ``top`` rows by score, the interval of the share of a resampled table that scores as high; place 0, without a key, is the interval of the mean."""
    best = rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(key)).limit(top).collect()  # ``top`` rows
    slim = rows.where(F.col(score).isNotNull()).select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"))
    over = [F.sum(F.when(F.col("score") >= F.lit(float(r[score])), F.col("weight")).otherwise(0)) / F.sum("weight") for r in best]
    mean = F.sum(F.col("weight") * F.col("score")) / F.sum("weight")
    each = weighted(slim, "key", n, seed).where("boot > 0").groupBy("boot").agg(F.array(mean, *over).alias("v"))
    ends = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    spread = each.select(F.posexplode("v").alias("place", "v")).groupBy("place").agg(ends[0].alias("low"), ends[1].alias("high"))
    kind = dict(rows.dtypes)[key]
    named = rows.sparkSession.createDataFrame([(0, None, None), *((k, r[key], float(r[score])) for k, r in enumerate(best, 1))], f"place int, key {kind}, score double")
    return named.join(spread, "place").select("place", "key", F.coalesce("score", F.lit(None).cast("double")).alias("score"), "low", "high")
