"""Measures in cluster space against those of expanded pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hetweave.operators import metapath, preserve, quotient, ranking


@pytest.mark.parametrize(("seed", "k", "keep_self"), [(0, 3, True), (1, 10, False)])
def test_cluster_space_equals_expanded_pairs(spark, seed, k, keep_self):
    """Equal rows, clusters that cut across them, a merged middle, targets without links, some queries only."""
    rng = np.random.default_rng(seed)
    n, mids = 16, 5
    rows = rng.integers(0, 3, (n, mids)) * (rng.random((n, mids)) < 0.5)
    rows[3], rows[9], rows[11] = rows[2], rows[2], 0
    links = spark.createDataFrame([("to", i, 100 + j, float(rows[i, j])) for i in range(n) for j in range(mids) if rows[i, j]] + [("on", 100 + j, 200 + j % 2, 1.0) for j in range(mids)], "ltype string, src long, dst long, w double")
    paths = {"TM": ("to",), "TMO": ("to", "on")}
    link = lambda x: links.where(F.col("ltype") == x).select("src", "dst", "w")
    half = {p: metapath.compose(*[link(x) for x in path]) for p, path in paths.items()}
    targets = spark.createDataFrame([(i,) for i in range(n)], "nid long")
    queries = targets.where("nid % 3 <> 1").toDF("q")
    cells = {7: [0, 0, 2, 2, 4, 4, 4, 7, 8, 2, 10, 11, 11, 13, 13, 13], 9: list(range(n))}
    mappings = spark.createDataFrame([(c, i, x) for c, of in cells.items() for i, x in enumerate(of)] + [(7, 100, 100), (7, 101, 100)], "cell int, nid long, cluster_id long")
    found = preserve.preserved(half, links, paths, mappings, targets, queries, k=k, keep_self=keep_self)
    got = {(r.cell, r.path, r.method): r for r in found.collect()}
    assert len(got) == 8
    for cell in list(cells)[seed:]:  # the plain way takes a second a measure
        mapping = mappings.where(F.col("cell") == cell).drop("cell")
        for path in paths:
            small = quotient.reduced_half_path(links, mapping, paths[path])
            for method in metapath.SIMILARITIES:
                reduced = metapath.expand(metapath.similarity(method, small), mapping.join(targets, "nid", "left_semi"))
                each = ranking.preservation(metapath.similarity(method, half[path], queries), reduced.join(queries.toDF("i"), "i", "left_semi"), queries, targets, k=k, keep_self=keep_self)
                want = ranking.average(each).first()
                for m in (*ranking.MEASURES, "maxe"):
                    assert got[cell, path, method][m] == pytest.approx(want[m], abs=1e-8), (cell, path, method, m)


def test_measures_of_clusters_equal_expanded_pairs(spark):
    """Scores of clusters are not given out, with zeros, ties, a cluster of one and few that score: rows are those of expanded pairs."""
    rng = np.random.default_rng(5)
    n, of = 17, [0, 0, 0, 3, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 14, 14, 16]
    levels = [0, 0, 0, 0.2, 0.5, 0.5, 1.0]
    a = rng.choice(levels, (n, n))
    a[2], a[5, 6:] = 0, 0
    heads = sorted(set(of))
    b = {(i, j): float(rng.choice(levels)) for i in heads for j in heads}
    b |= {(3, j): 0.0 for j in heads} | {(16, j): 0.0 for j in heads if j != 14}
    frame = lambda s: spark.createDataFrame([(i, j, float(x)) for (i, j), x in s.items() if x], "i long, j long, score double")
    original, small = frame({(i, j): a[i, j] for i in range(n) for j in range(n)}), frame(b)
    mapping = spark.createDataFrame(list(enumerate(of)), "nid long, cluster_id long")
    targets = mapping.select("nid")
    reduced = metapath.expand(small, mapping)
    for k, keep_self in ((3, False), (10, True)):
        want = {r.i: r for r in ranking.preservation(original, reduced, targets.toDF("q"), targets, k=k, keep_self=keep_self).collect()}
        got = {r.i: r for r in preserve.cluster_measures(original, small, mapping, k, keep_self=keep_self).collect()}
        share = {r.i: r[f"top{k}"] for r in preserve.cluster_overlaps(original, small, mapping, (k,)).collect()}
        assert set(got) == set(want) == set(share)
        for i, r in want.items():
            assert [got[i][c] for c in ("mae", "p95", "p99", "maxe", "p", "tie_overlap", "ndcg")] == pytest.approx([r[c] for c in ("mae", "p95", "p99", "maxe", "p", "tie_overlap", "ndcg")], abs=1e-9)
            assert share[i] == pytest.approx(r.overlap)
    rows = preserve.cluster_groups(original, small, mapping).agg(F.sum("m")).first()[0]
    assert rows == sum(1 for i in range(n) for j in range(n) if i != j and (a[i, j] or b[of[i], of[j]]))
    nearest = [(r.i, r.j) for r in ranking.top_k(reduced.where("i <> j"), 2).orderBy("i", "rank").collect()]
    assert [(r.i, r.j) for r in preserve.cluster_tops(small, mapping, 2, zeros=False).orderBy("i", "rank").collect()] == nearest


def _written(spark):
    """Rows that all shuffles so far have written."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_pairs_of_kinds_are_no_rows(spark):
    """600 targets with rows of their own that all share a middle, in four blocks: 360,000 pairs, and shuffles of far less."""
    rng = np.random.default_rng(3)
    n = 600
    w = np.stack([np.ones(n), rng.permutation(n) + 1.0], axis=1)
    links = spark.createDataFrame([("to", i, 10_000 + j, float(w[i, j])) for i in range(n) for j in range(2)], "ltype string, src long, dst long, w double")
    targets = spark.range(n).toDF("nid")
    mappings = targets.select(F.lit(0).alias("cell"), "nid", (F.col("nid") - F.col("nid") % 2).alias("cluster_id"))
    before = _written(spark)
    got = {r.method: r for r in preserve.preserved({"TM": links.drop("ltype")}, links, {"TM": ("to",)}, mappings, targets, targets.toDF("q"), k=5, block=150).collect()}
    assert n < _written(spark) - before < n * n / 8
    small = w[0::2] + w[1::2]

    def scores(x, method):
        dots, size = x @ x.T, (x * x).sum(axis=1)
        return np.floor((2 * dots / (size[:, None] + size) if method == "pathsim" else dots / np.sqrt(size[:, None] * size)) * 1e9 + 0.5) / 1e9

    for method in metapath.SIMILARITIES:
        d = np.abs(scores(w, method) - np.kron(scores(small, method), np.ones((2, 2))))
        np.fill_diagonal(d, 0)
        assert got[method].mae == pytest.approx(d.mean(), abs=1e-8)
        assert got[method].p95 == pytest.approx(np.quantile(d, 0.95, axis=1).mean(), abs=1e-8)
        assert got[method].maxe == pytest.approx(d.max(), abs=1e-8)
