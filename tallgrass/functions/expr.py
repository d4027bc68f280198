"""Expressions that are safe under ANSI mode: a zero denominator or a constant gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles; null if b is zero."""
    b = col(b).cast("double")
    return col(a).cast("double") / F.when(b != 0, b)


def corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson's r over rows where both are there; null if either is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_t(r: Column | str, n: Column | str, covariates: int = 0) -> Column:
    """The t statistic of a (partial) correlation; null if r is +-1 or n is too small."""
    r, df = col(r), col(n) - 2 - covariates
    rest = 1 - r * r
    return F.when((df > 0) & (rest > 0), r * F.sqrt(df / F.when(rest > 0, rest)))


def partial_corr(rxy: Column | str, rxz: Column | str, ryz: Column | str) -> Column:
    """First-order partial correlation from three correlations; null if the covariate equals a variable."""
    rxy, rxz, ryz = col(rxy), col(rxz), col(ryz)
    left, right = 1 - rxz * rxz, 1 - ryz * ryz
    den = F.when((left > 1e-12) & (right > 1e-12), F.sqrt(left * right))
    return (rxy - rxz * ryz) / den


def fisher_ci(r: Column | str, n: Column | str, less: int = 3, z: float = 1.96) -> tuple[Column, Column]:
    """Fisher interval tanh(atanh r +- z / sqrt(n - less)); ``less`` is 4 after one covariate."""
    r = F.greatest(F.least(col(r), F.lit(0.9999999)), F.lit(-0.9999999))
    half = z / F.sqrt(F.when(col(n) > less, (col(n) - less).cast("double")))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def median(x: Column | str, where: Column | None = None) -> Column:
    return F.median(col(x) if where is None else F.when(where, col(x)))


def mean_if(where: Column, x: Column | str) -> Column:
    return F.avg(F.when(where, col(x)))


def draw_key(*parts: Column | str | int) -> Column:
    """A hash that orders rows at random, the same in every engine that has md5: the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[(F.lit(str(p)) if isinstance(p, int) else col(p).cast("string")) for p in parts]))


def draw_number(key: Column) -> Column:
    """The first 32 bits of an md5 hash as a long."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def first_field(x: Column | str, mark: str) -> Column:
    """What stands before the first ``mark``, trimmed."""
    return F.trim(F.split_part(col(x), F.lit(mark), F.lit(1)))


def last_field(x: Column | str, mark: str) -> Column:
    return F.trim(F.split_part(col(x), F.lit(mark), F.lit(-1)))


def to_double(x: Column | str) -> Column:
    """A number, or null where the text is none."""
    return col(x).try_cast("double")


def has_any(x: Column | str, parts: list[str]) -> Column:
    """Whether any of the strings is in x."""
    found = F.lit(False)
    for p in parts:
        found = found | col(x).contains(p)
    return found
