"""Rankings and measures against numpy over dense vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hetweave.operators import ranking
from hetweave.operators.cover import greedy


def top(spark, scores, ids, k):
    df = spark.createDataFrame([(0, i, s) for i, s in zip(ids, scores, strict=True)], "i long, j long, score double")
    return [r.j for r in sorted(ranking.top_k(df, k).collect(), key=lambda r: r.rank)]


def test_top_k_ties(spark):
    assert top(spark, [0.31, 0.82, 0.55, 0.82, 0.55], [7, 5, 9, 2, 4], 3) == [2, 5, 4]
    order = [2, 4, 0, 3, 1]
    s, ids = [0.6, 0.25, 0.6, 0.6, 0.1], [8, 3, 6, 11, 1]
    assert top(spark, s, ids, 2) == top(spark, [s[k] for k in order], [ids[k] for k in order], 2)


def dense(a, b, k):
    """Measures of one query over dense vectors without self."""
    n = len(a)
    k = min(k, n)
    d = np.abs(a - b)
    order = lambda v: np.lexsort((np.arange(n), -v))
    overlap = len(set(order(a)[:k]) & set(order(b)[:k])) / k

    def weights(v):
        kth = v[order(v)[k - 1]]
        w = (v > kth).astype(float)
        w[v == kth] = (k - (v > kth).sum()) / (v == kth).sum()
        return w

    tie = np.minimum(weights(a), weights(b)).sum() / k

    def dcg(by):
        o = order(by)[:k]
        return sum(a[by == by[x]].mean() / np.log2(r + 2) for r, x in enumerate(o))

    ndcg = dcg(b) / dcg(a) if dcg(a) > 1e-12 else 1.0
    return [d.mean(), np.quantile(d, 0.95), np.quantile(d, 0.99), d.max(), overlap, tie, ndcg]


@pytest.mark.parametrize(("seed", "k"), [(0, 1), (1, 3), (2, 10), (3, 3), (3, 50)])
def test_sparse_measures_equal_dense(spark, seed, k):
    rng = np.random.default_rng(seed)
    n = 12
    levels = [0, 0, 0, 0.2, 0.5, 0.5, 1.0]
    a, b = rng.choice(levels, (n, n)), rng.choice(levels, (n, n))
    if seed == 3:
        a[0], b[1] = 0, 0
    table = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, score double")
    targets = spark.range(n).selectExpr("id as nid")
    got = {r.i: r for r in ranking.preservation(table(a), table(b), targets.toDF("q"), targets, k=k).collect()}
    for i in range(n):
        keep = np.arange(n) != i
        want = dense(a[i][keep], b[i][keep], k)
        r = got[i]
        assert [r.mae, r.p95, r.p99, r.maxe, r.overlap, r.tie_overlap, r.ndcg] == pytest.approx(want, abs=1e-9)


def test_keep_self_counts_an_entry(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0, 0.8), (0, 2, 0.0, 0.8)], "i long, j long, a double, b double")
    q = spark.createDataFrame([(0,)], "q long")
    with_self = ranking.error_metrics(pairs, q, 5, keep_self=True).first()
    without = ranking.error_metrics(pairs, q, 5).first()
    assert (with_self.mae, without.mae) == pytest.approx((0.2, 0.25))
    assert with_self.p95 == pytest.approx(np.quantile([0, 0, 0, 0.2, 0.8], 0.95))


def test_identical_rankings(spark):
    s = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.8), (0, 3, 0.8), (0, 4, 0.2)], "i long, j long, score double")
    targets = spark.range(5).selectExpr("id as nid")
    r = ranking.preservation(s, s, spark.createDataFrame([(0,)], "q long"), targets).first()
    assert (r.mae, r.overlap, r.tie_overlap, r.ndcg, r.p) == (0, 1, 1, 1, 1) and r.t is None


def test_student():
    # two-sided chances from printed tables
    t, df = np.array([2.228, 1.96, 12.706, 0.0]), np.array([10.0, 1e6, 1.0, 5.0])
    assert ranking.student_two_sided(t, df) == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=2e-4)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda p: p[0] < p[1])))
def test_greedy_is_complete_link(pairs):
    seeds = greedy(pairs)
    ok = lambda a, b: (min(a, b), max(a, b)) in pairs
    free, want = sorted({x for p in pairs for x in p}), {}
    while free:
        members = [free[0]]
        for x in free[1:]:
            if all(ok(x, m) for m in members):
                members.append(x)
        want |= dict.fromkeys(members, members[0])
        free = [x for x in free if x not in members]
    assert seeds == want
