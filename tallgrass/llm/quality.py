"""Document quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured once. ``base`` rules reject a document by themselves; ``soft`` rules only mark it. The
failures of a host (any rule) are added up, its failure rate is shrunk towards the corpus by a beta prior fitted to the
hosts (moments), and a host whose shrunk rate exceeds ``bad_rate`` is joined back to its documents: there, and only
there, soft failures reject a document as well. A clean document is kept on any host.

Windows are compared by 64-bit hashes of their words.

Defined cases: a null or wordless text has zero counts and fails the base rules; a null host is a host of its own;
repeated rows count as often as they are there; a very long text is measured whole, in its row; a host whose rate equals the limit is not bad, the only
tie there is; an empty table gives no rows; other columns are ignored or, in
``keep_good``, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACE, cut, split_words

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` without ``text`` and with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, under ``prefix``."""
    keep = [c for c in docs.columns if c != text]
    step = docs.withColumn(f"{prefix}t", F.coalesce(F.col(text), F.lit(""))).withColumn(f"{prefix}w", split_words(F.col(f"{prefix}t"), SPACE))
    t, w = F.col(f"{prefix}t"), f"{prefix}w"
    n = F.size(w)
    lines = F.filter(F.split(t, "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    # hashes of the windows at 0 ... n - 3
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(_at(w, i), _at(w, i + 1), _at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias(f"{prefix}n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias(f"{prefix}word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias(f"{prefix}n_symbols"),
        lines.alias(f"{prefix}l"),
        windows.alias(f"{prefix}x"),
    )
    x, p, order, pos = (f"{prefix}{k}" for k in ("x", "p", "order", "pos"))
    # positions of windows that are there twice: only texts with a repeated window sort (hash, position)
    step = step.withColumn(order, F.when(F.size(F.array_distinct(x)) < F.size(x), F.array_sort(F.transform(F.col(x), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn(
        p,
        F.filter(
            F.col(order),
            lambda e, i: (F.get(F.col(order), i - 1)["h"] == e["h"]) | (F.coalesce(F.get(F.col(order), i + 1)["h"] == e["h"], F.lit(False))),
        ),
    ).withColumn(pos, F.array_sort(F.transform(F.col(p), lambda e: e["i"])))
    # a window covers three words, or fewer if the next repeated window begins before its end
    covered = F.aggregate(
        F.transform(F.col(pos), lambda v, i: F.least(F.lit(3), F.coalesce(F.get(F.col(pos), i + 1) - v, F.lit(3)))), F.lit(0), lambda a, v: a + v
    )
    return step.select(
        *[F.col(f"`{c}`") for c in keep],
        f"{prefix}n_words",
        f"{prefix}word_chars",
        f"{prefix}n_symbols",
        (F.size(f"{prefix}l") - F.size(F.array_distinct(f"{prefix}l"))).cast("long").alias(f"{prefix}n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias(f"{prefix}n_repeat_words"),
    )


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def soft_failed(prefix: str = "") -> Column:
    """Many symbols, mostly repeated lines, or words of a very odd mean length."""
    n, chars, symbols, lines = (F.col(f"{prefix}{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))
    return (10 * symbols > n) | (10 * lines > n) | (chars < 2 * n) | (chars > 20 * n)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta distribution with the mean and variance of the hosts' rates (n, failed), weighted by n; one row comes to the driver."""
    rate, n = F.col("failed") / F.col("n"), F.col("n")
    row = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.sum(n * rate * rate).alias("s2"), F.count("*").alias("k")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = row["f"] / row["n"]
    spread = row["s2"] / row["n"] - mean * mean - mean * (1 - mean) * row["k"] / row["n"]  # less what sampling adds
    size = mean * (1 - mean) / spread - 1 if spread > 0 else float(row["n"]) / row["k"]
    size = min(max(size, 1.0), 1e6)
    return max(mean, 1e-6) * size, max(1 - mean, 1e-6) * size


def host_verdicts(measured: DataFrame, host: str, prefix: str = "", bad_rate: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, bad): ``rate`` is the posterior mean of the host's share of failing documents."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum((base_failed(prefix) | soft_failed(prefix)).cast("long")).alias("failed"))
    a, b = beta_prior(hosts)
    rated = hosts.withColumn("rate", (F.col("failed") + a) / (F.col("n") + a + b))
    return rated.withColumn("bad", F.col("rate") > bad_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, the measures, base_failed, soft_failed, host_bad, kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = cut(measure(rows), "quality-measures")
    bad = host_verdicts(measured, "host", bad_rate=bad_rate).where("bad").select(F.col("host").alias("_host"), "bad")
    judged = measured.join(bad, F.col("host").eqNullSafe(F.col("_host")), "left").withColumns(
        {"base_failed": base_failed(), "soft_failed": soft_failed(), "host_bad": F.coalesce("bad", F.lit(False))}
    )
    return judged.select("doc_id", "host", *_MEASURES, "base_failed", "soft_failed", "host_bad", (~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed"))).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", bad_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. They are measured once and stored with their measures, without a shuffle."""
    p = "_tg_"
    copy = docs.withColumn(f"{p}host", F.col(host_col)).withColumn(f"{p}text", F.col(text_col))
    measured = cut(measure(copy, f"{p}text", p), "quality-documents")
    bad = host_verdicts(measured, f"{p}host", p, bad_rate).where("bad").select(F.col("host").alias(f"{p}bad_host"), F.col("bad").alias(f"{p}bad"))
    passed = measured.where(~base_failed(p)).join(bad, F.col(f"{p}host").eqNullSafe(F.col(f"{p}bad_host")), "left")
    return passed.where(F.col(f"{p}bad").isNull() | ~soft_failed(p)).select(*[F.col(f"`{c}`") for c in docs.columns])
