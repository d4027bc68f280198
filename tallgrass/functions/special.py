"""p-values: Student's t, the normal, and the exact Wilcoxon signed-rank distribution, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    if not x.size:
        return np.zeros(0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, inner, 0.5)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.5, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(good, t, 1.0), np.where(good, df, 1.0)
    return np.where(good, beta_inc(safe_df / 2, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t * safe_t)), np.nan)


def wilcoxon_two_sided(w: float, n: int) -> float:
    """Exact two-sided p of a signed-rank sum w of n differences without ties or zeros."""
    counts = [1]
    for rank in range(1, n + 1):
        grown = counts + [0] * rank
        for i, c in enumerate(counts):
            grown[i + rank] += c
        counts = grown
    tail = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(counts[: int(math.floor(tail)) + 1]) / 2**n)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p))


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def wilcoxon_pvalue(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else wilcoxon_two_sided(float(a), int(b)) for a, b in zip(w, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(at least k of ``drawn`` are good), for over-representation."""

    def one(k: int, n: int, g: int, d: int) -> float:
        return sum(math.comb(g, i) * math.comb(n - g, d - i) for i in range(k, min(g, d) + 1)) / math.comb(n, d)

    return pd.Series([one(*map(int, x)) for x in zip(k, total, good, drawn, strict=True)], dtype=float)
