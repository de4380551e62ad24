"""Deterministic rankings and the measures of what a reduction preserves.

Similarity tables hold nonzero pairs only, but measures count all n targets of a query. The
absent zeros enter in closed form: they are the lowest values of a percentile, one tie group of
known size in a ranking, and, where fewer than k targets score, the targets of least id. Nothing
is ever filled out to queries x targets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hetweave.lineage import cut

DIGITS = 9


def rounded(scores: DataFrame) -> DataFrame:
    """Scores at 9 digits, so that the order of a sum can't split a tie."""
    return scores.withColumn("score", F.round("score", DIGITS))


def top_k(scores: DataFrame, k: int, *, by: str = "i", item: str = "j", score: str = "score") -> DataFrame:
    """The k best items of each query: score descending, then item ascending; with rank from 1."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_queries(ids: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(q): all ids if size is 0 or none are spared, else the `size` of least seeded hash."""
    q = ids.select(F.col(ids.columns[0]).alias("q"))
    return q if size <= 0 else q.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("q").cast("string")).cast("binary")), "q").limit(size)


def paired(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """(i, j, a, b) of pairs other than self that score in either table; absent scores are 0."""
    a = rounded(original).where("i <> j").select("i", "j", F.col("score").alias("a"))
    b = rounded(reduced).where("i <> j").select("i", "j", F.col("score").alias("b"))
    both = a.join(b, ["i", "j"], "full")
    return both.select("i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).where("a <> 0 or b <> 0")


def _quantile(position: Column) -> Column:
    """Linear interpolation at a 0-based position over values with a column idx."""
    low, high = F.floor(position), F.ceil(position)
    part = position - low
    return F.coalesce(F.sum(F.when(F.col("idx") == low, F.col("d") * (1 - part))), F.lit(0.0)) + F.coalesce(F.sum(F.when((F.col("idx") == high) & (high > low), F.col("d") * part)), F.lit(0.0))


def error_metrics(pairs: DataFrame, queries: DataFrame, n_targets: int, *, keep_self: bool = False) -> DataFrame:
    """(i, mae, p95, p99, maxe) of |a - b| for each query.

    keep_self counts the query itself as an entry without error, as rankings do that set it to
    the end instead of removing it.
    """
    n = n_targets - (0 if keep_self else 1)
    d = pairs.select("i", F.abs(F.col("a") - F.col("b")).alias("d"))
    m = F.count("*").over(Window.partitionBy("i"))
    d = d.withColumn("idx", F.lit(n) - m + F.row_number().over(Window.partitionBy("i").orderBy("d")) - 1)
    at = {p: F.lit(p) * F.lit(n - 1) for p in (0.95, 0.99)}
    found = d.groupBy("i").agg((F.sum("d") / max(n, 1)).alias("mae"), _quantile(at[0.95]).alias("p95"), _quantile(at[0.99]).alias("p99"), F.max("d").alias("maxe"))
    return queries.select(F.col("q").alias("i")).join(found, "i", "left").na.fill(0.0, ["mae", "p95", "p99", "maxe"])


def fill_zeros(pairs: DataFrame, queries: DataFrame, targets: DataFrame, k: int, column: str) -> DataFrame:
    """(i, j, score): nonzero scores, and for queries with fewer than k the zeros that a top k reaches.

    Those are among the 2k + 1 targets of least id: k to be taken and at most k that score, or
    are the query. targets has (nid).
    """
    scored = pairs.where(F.col(column) != 0).select("i", "j", F.col(column).alias("score"))
    few = queries.select(F.col("q").alias("i")).join(scored.groupBy("i").agg(F.count("*").alias("m")), "i", "left").where(f"coalesce(m, 0) < {k}")
    least = targets.select(F.col("nid").alias("j")).orderBy("j").limit(2 * k + 1)
    zeros = few.select("i").join(F.broadcast(least), F.col("i") != F.col("j")).join(scored.select("i", "j"), ["i", "j"], "left_anti")  # 2k + 1 rows sent
    return scored.unionByName(zeros.withColumn("score", F.lit(0.0)))


def overlap_at_k(pairs: DataFrame, queries: DataFrame, targets: DataFrame, n_targets: int, k: int) -> DataFrame:
    """(i, overlap): share of the top k (by score, then id) that both rankings name."""
    k = min(k, n_targets - 1)
    if k <= 0:
        return queries.select(F.col("q").alias("i"), F.lit(1.0).alias("overlap"))
    a, b = (top_k(fill_zeros(pairs, queries, targets, k, c), k).select("i", "j") for c in "ab")
    both = a.join(b, ["i", "j"]).groupBy("i").agg((F.count("*") / k).alias("overlap"))
    return queries.select(F.col("q").alias("i")).join(both, "i", "left").na.fill(0.0, ["overlap"])


def tie_overlap_at_k(pairs: DataFrame, queries: DataFrame, n_targets: int, k: int) -> DataFrame:
    """(i, tie_overlap): items above the k-th score weigh 1, those at it share what is left of k.

    The overlap sums the lesser of an item's two weights, over k. Zeros are one tie group.
    """
    n = n_targets - 1
    k = min(k, n)
    if k <= 0:
        return queries.select(F.col("q").alias("i"), F.lit(1.0).alias("tie_overlap"))
    rows = pairs
    for c in "ab":
        nonzero = F.col(c) != 0
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col(c).desc(), "j"))
        rows = rows.withColumn(f"rank_{c}", rank)
        w = Window.partitionBy("i")
        kth = F.max(F.when(nonzero & (F.col(f"rank_{c}") == k), F.col(c))).over(w)
        rows = rows.withColumn(f"kth_{c}", F.coalesce(kth, F.lit(0.0))).withColumn(f"pos_{c}", F.sum(nonzero.cast("int")).over(w))
        above = F.sum((F.col(c) > F.col(f"kth_{c}")).cast("int")).over(w)
        ties = F.when(F.col(f"kth_{c}") > 0, F.sum((F.col(c) == F.col(f"kth_{c}")).cast("int")).over(w)).otherwise(F.lit(n) - F.col(f"pos_{c}"))
        rows = rows.withColumn(f"tie_{c}", F.when(ties > 0, (F.lit(k) - above) / ties).otherwise(F.lit(0.0)))
        rows = rows.withColumn(f"w_{c}", F.when(F.col(c) > F.col(f"kth_{c}"), 1.0).when(F.col(c) == F.col(f"kth_{c}"), F.col(f"tie_{c}")).otherwise(0.0))
    zero = {c: F.when(F.max(f"kth_{c}") == 0, F.max(f"tie_{c}")).otherwise(F.lit(0.0)) for c in "ab"}
    rest = (F.lit(n) - F.count("*")) * F.least(zero["a"], zero["b"])  # items that score in neither
    found = rows.groupBy("i").agg(((F.sum(F.least("w_a", "w_b")) + rest) / k).alias("tie_overlap"))
    return queries.select(F.col("q").alias("i")).join(found, "i", "left").na.fill(1.0, ["tie_overlap"])


def _discount_sum(first: Column, last: int) -> Column:
    """Sum of 1 / log2(rank + 1) over ranks from first to last."""
    prefix = np.concatenate(([0.0], np.cumsum(1 / np.log2(np.arange(2, last + 2))))).tolist()
    sums = F.array(*[F.lit(x) for x in prefix])
    return F.when(first <= last, F.lit(prefix[last]) - F.element_at(sums, first.cast("int"))).otherwise(0.0)


def ndcg_at_k(pairs: DataFrame, queries: DataFrame, n_targets: int, k: int) -> DataFrame:
    """(i, ndcg): gains are the scores a, the order is by b, and items that tie in b share their mean gain."""
    n = n_targets - 1
    k = min(k, n)
    if k <= 0:
        return queries.select(F.col("q").alias("i"), F.lit(1.0).alias("ndcg"))

    def dcg(by: str) -> Column:
        in_top = F.col(f"rank_{by}") <= k
        ranked = F.sum(F.when((F.col(by) != 0) & in_top, F.col(f"gain_{by}") / F.log2(F.col(f"rank_{by}") + 1)))
        scored = F.sum((F.col(by) != 0).cast("int"))
        zeros = F.sum(F.when(F.col(by) == 0, F.col("a")).otherwise(0.0)) / F.greatest(F.lit(n) - scored, F.lit(1))
        return F.coalesce(ranked, F.lit(0.0)) + zeros * _discount_sum(scored + 1, k)

    rows = pairs
    for by in "ab":
        rows = rows.withColumn(f"rank_{by}", F.row_number().over(Window.partitionBy("i").orderBy(F.col(by).desc(), "j"))).withColumn(f"gain_{by}", F.avg("a").over(Window.partitionBy("i", by)))
    both = rows.groupBy("i").agg(dcg("a").alias("ideal"), dcg("b").alias("got"))
    found = both.select("i", F.when(F.col("ideal") > 1e-12, F.col("got") / F.col("ideal")).otherwise(1.0).alias("ndcg"))
    return queries.select(F.col("q").alias("i")).join(found, "i", "left").na.fill(1.0, ["ndcg"])


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Chance of a Student t at least this far from 0: the incomplete beta at df / (df + t^2)."""
    from math import lgamma

    x, a, b = df / (df + t * t), df / 2, np.full_like(df, 0.5)
    logs = np.array([lgamma(p + 0.5) - lgamma(p) - lgamma(0.5) for p in a]) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))
    front = np.exp(logs)
    direct = front * _betacf(a, b, x) / a
    other = 1 - front * _betacf(b, a, 1 - x) / b
    return np.clip(np.where(x < (a + 1) / (a + b + 2), direct, other), 0, 1)


def two_sided_p(t: Column, n: int) -> Column:
    """Chance of a t statistic over n pairs; 1 where there is none."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series) -> pd.Series:
        known = t.notna().to_numpy()
        out = np.ones(len(t))
        out[known] = student_two_sided(t.to_numpy()[known], np.full(int(known.sum()), float(n - 1)))
        return pd.Series(out)

    return p_value(t)


def t_statistic(s: Column, ss: Column, most: Column, n: int) -> Column:
    """t of n paired differences from their sum, sum of squares and largest; null where nothing differs."""
    mean, spread = s / n, (ss - s * s / n) / max(n - 1, 1)
    return F.when((most > 1e-12) & (spread > 0) & F.lit(n >= 2), mean / F.sqrt(spread / n))


def paired_t(pairs: DataFrame, queries: DataFrame, n_targets: int, *, keep_self: bool = True) -> DataFrame:
    """(i, t, p) of a two-sided paired t-test over all n entries; p is 1 where nothing differs.

    With fewer than two entries, or differences within 1e-12 throughout, t is null and p is 1.
    """
    n = n_targets - (0 if keep_self else 1)
    d = F.col("a") - F.col("b")
    sums = pairs.groupBy("i").agg(F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.max(F.abs(d)).alias("most"))
    found = queries.select(F.col("q").alias("i")).join(sums, "i", "left").withColumn("t", t_statistic(F.col("s"), F.col("ss"), F.col("most"), n))
    return found.select("i", "t", two_sided_p(F.col("t"), n).alias("p"))


def preservation(original: DataFrame, reduced: DataFrame, queries: DataFrame, targets: DataFrame, *, k: int = 10, keep_self: bool = False) -> DataFrame:
    """All measures of each query, one row each: errors, overlaps, nDCG and the t-test."""
    n = targets.count()
    pairs = cut(paired(original, reduced))  # five measures read it
    out = error_metrics(pairs, queries, n, keep_self=keep_self)
    for more in (overlap_at_k(pairs, queries, targets, n, k), tie_overlap_at_k(pairs, queries, n, k), ndcg_at_k(pairs, queries, n, k), paired_t(pairs, queries, n, keep_self=keep_self)):
        out = out.join(more, "i")
    return out


def shares(queries: DataFrame, a: DataFrame | None, b: DataFrame | None, n_targets: int, ks: tuple[int, ...]) -> DataFrame:
    """(i, top{k} for each k) from the first rows (i, j, rank) of two rankings; 1 where there is nothing to rank."""
    if n_targets <= 1 or max(ks) <= 0:
        return queries.select(F.col("q").alias("i"), *[F.lit(1.0).alias(f"top{k}") for k in ks])
    a, b = (x.select("i", "j", F.col("rank").alias(f"rank_{c}")) for c, x in (("a", a), ("b", b)))
    last = F.greatest("rank_a", "rank_b")
    share = [(F.count_if(last <= min(k, n_targets - 1)) / min(k, n_targets - 1)).alias(f"top{k}") for k in ks]
    both = a.join(b, ["i", "j"]).groupBy("i").agg(*share)
    return queries.select(F.col("q").alias("i")).join(both, "i", "left").na.fill(0.0, [f"top{k}" for k in ks])


def overlaps(pairs: DataFrame, queries: DataFrame, targets: DataFrame, n_targets: int, ks: tuple[int, ...]) -> DataFrame:
    """(i, top{k} for each k): shares of the first k that both rankings name, from one ranking each."""
    most = min(max(ks), n_targets - 1)
    a, b = (top_k(fill_zeros(pairs, queries, targets, most, c), most) for c in "ab") if most > 0 else (None, None)
    return shares(queries, a, b, n_targets, ks)


def ranking_metrics(original: DataFrame, reduced: DataFrame, queries: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(i, mae, p95, p99, maxe, t, p, top{k} for each k, ndcg10) of each query in one call.

    The query itself is an entry without error and ranks last.
    """
    n = targets.count()
    pairs = cut(paired(original, reduced))  # four measures read it
    out = error_metrics(pairs, queries, n, keep_self=True).join(paired_t(pairs, queries, n), "i")
    return out.join(overlaps(pairs, queries, targets, n, ks), "i").join(ndcg_at_k(pairs, queries, n, 10).withColumnRenamed("ndcg", "ndcg10"), "i")


MEASURES = ("mae", "p95", "p99", "overlap", "tie_overlap", "ndcg", "p")


def average(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over queries, and the greatest maximal error."""
    return per_query.groupBy(*by).agg(*[F.avg(m).alias(m) for m in MEASURES], F.max("maxe").alias("maxe"))
