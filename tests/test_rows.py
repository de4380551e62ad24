"""Rows of ablations, checks and costs, metrics in one call, and pairs in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hetweave.functions import results
from hetweave.operators import audit, clustering, graph, partition, ranking, selection, tiles


def test_metrics_in_one_call(spark):
    """Against numpy: shares of the first 1, 2 and 3, and nDCG, of two score tables with a tie and a zero."""
    n = 5
    a = {(0, 1): 0.9, (0, 2): 0.5, (0, 3): 0.5, (1, 0): 0.4, (1, 4): 0.3, (2, 0): 0.2}
    b = {(0, 1): 0.6, (0, 2): 0.2, (0, 3): 0.7, (1, 0): 0.4, (2, 4): 0.1}
    frame = lambda s: spark.createDataFrame([(i, j, x) for (i, j), x in s.items()], "i long, j long, score double")
    ids = spark.range(n).select(F.col("id").alias("nid"))
    got = {r.i: r for r in ranking.ranking_metrics(frame(a), frame(b), ids.withColumnRenamed("nid", "q"), ids, (1, 2, 3)).collect()}
    for i in range(n):
        va, vb = (np.array([s.get((i, j), 0.0) if j != i else -1.0 for j in range(n)]) for s in (a, b))
        gap = np.abs(va - vb)
        assert got[i].mae == pytest.approx(gap.mean()) and got[i].p95 == pytest.approx(np.percentile(gap, 95)) and got[i].maxe == pytest.approx(gap.max())
        first = lambda v: sorted((j for j in range(n) if j != i), key=lambda j: (-v[j], j))  # noqa: B023, E731
        for k in (1, 2, 3):
            assert got[i][f"top{k}"] == pytest.approx(len(set(first(va)[:k]) & set(first(vb)[:k])) / k)
    same = {r.i: r for r in ranking.ranking_metrics(frame(a), frame(a), ids.withColumnRenamed("nid", "q"), ids).collect()}
    assert all(r.top1 == r.top10 == r.ndcg10 == 1 and r.p == 1 for r in same.values())


def test_all_bounds(spark):
    names = [f"avg_{m}_{x}" for m in selection.METHODS for x in ("mae", "p95e", "p99e", "ndcg10", "top1", "top5", "top10", "pvalue", "maxe")]
    good = [0.0, 0.0, 0.0, 1.0, 0.9, 0.9, 1.0, 1.0, 0.5] * 2
    g = spark.createDataFrame([good, [*good[:4], None, *good[5:]]], ", ".join(f"{n} double" for n in names))
    flags = lambda **o: [r.joint_controllable for r in selection.controllability(g, **o).collect()]
    assert flags() == [1, 0] and flags(top1=0.95) == [0, 0] and flags(top5=0.95) == [0, 0]
    assert flags(maxe=0.6) == [1, 0] and flags(maxe=0.4) == [0, 0]
    bare = g.drop(*[n for n in names if n.endswith(("top1", "top5", "maxe"))])
    assert [r.joint_controllable for r in selection.controllability(bare).collect()] == [1, 1]


def test_pairs_to_show(spark):
    rows = [(1, 2, 0.9, 0.5), (1, 3, 0.9, 0.7), (1, 4, 0.2, 0.9), (2, 3, 0.1, 0.8), (2, 4, 0.8, 0.2), (3, 4, 0.6, 0.1), (5, 6, 0.1, 0.3), (5, 7, 0.1, 0.2)]
    scored = spark.createDataFrame(rows, "i long, j long, term_score double, attr_score double").withColumn("ntype", F.lit("t"))
    got = {r.decision: (r.i, r.j) for r in audit.representative_pairs(audit.judged_pairs(scored, 0.5, 0.45)).collect()}
    assert got == {"accepted": (1, 3), "term_only_reject": (2, 3), "attribute_only_reject": (3, 4), "both_reject": (5, 7)}


def test_guard_rows_and_release_checks(spark):
    mapping = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "nid long, cluster_id long")
    links = spark.createDataFrame([("x", 10, 1, 1.0), ("x", 10, 2, 2.0), ("x", 11, 3, 1.0)], "ltype string, src long, dst long, w double")
    [r] = audit.guard_rows({"both": (mapping, 0.5, None)}, links).collect()
    assert (r.term_guard, r.attribute_guard, r.tau_term, r.tau_attr) == (1, 0, 0.5, None)
    assert (r.nodes, r.reduced_nodes, r.edges, r.reduced_edges) == (3, 2, 3, 2) and r.node_ratio == pytest.approx(1 / 3) and r.edge_ratio == pytest.approx(1 / 3)
    empty = audit.guard_rows({"none": (mapping.limit(0), None, None)}, links.limit(0)).first()
    assert (empty.nodes, empty.node_ratio, empty.edge_ratio) == (0, 0.0, 0.0)
    checks = audit.release_checks(spark, {"mapping": 3, "links": 4, "gone": 1}, {"mapping": mapping, "links": links})
    assert {r.check: (r.found, r.ok) for r in checks.collect()} == {"mapping": (3, True), "links": (3, False), "gone": (None, False)}
    with pytest.raises(ValueError):
        audit.require({"release": checks.where("not ok")})


def test_costs(spark):
    raw = spark.createDataFrame([("full", k, 2.0 + k) for k in range(3)] + [("small", k, 1.0) for k in range(3)] + [("once", 0, 4.0)], "name string, repeat int, seconds double")
    got = {r.name: r for r in results.runtime_rollup(raw, "full").collect()}
    assert got["small"].mean_speedup == 3 and got["small"].median_speedup == 3 and got["once"].std_s == 0 and got["full"].p95_s == pytest.approx(3.9)
    assert results.runtime_rollup(raw, "absent").first().mean_speedup is None
    stages = spark.createDataFrame([("a", 0, 1.0, 5.0), ("b", 0, 3.0, 7.0), ("a", 1, 1.0, 6.0), ("b", 1, 1.0, 2.0)], "stage string, repeat int, seconds double, peak_mb double")
    cost = {r.stage: (r.repeats, r.mean_s, r.share, r.peak_mb) for r in results.construction_cost(stages).collect()}
    assert cost == {"a": (2, 1.0, 0.375, 6.0), "b": (2, 2.0, 0.625, 7.0)}


@pytest.mark.parametrize("block", [1024, 7])
def test_tiles_meet_every_pair(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 5)), 1)
    x[3] = 0
    x[9] = x[8]
    points = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "nid long, vec array<double>, cluster int")
    near = ranking.top_k(tiles.nearest_cosines(points, 4, block=block), 4)
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    score = np.round(unit @ unit.T, 9) + 0.0
    for r in range(40):
        want = sorted((j for j in range(40) if j != r), key=lambda j: (-score[r, j], j))[:4]
        assert [n.j for n in near.where(F.col("i") == r).orderBy("rank").collect()] == want
    sums = {(r.i, r.cj): (r.s, r.n) for r in tiles.distance_sums(points, block).collect()}
    for r in range(40):
        for c in range(3):
            own = [j for j in range(40) if j % 3 == c and j != r]
            assert sums[r, c][1] == len(own) and sums[r, c][0] == pytest.approx(sum(np.linalg.norm(x[r] - x[j]) for j in own))


def test_lloyd_step_and_starts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 3)) for c in (0.0, 4.0, 8.0)])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "nid long, vec array<double>")
    found, centres, cost = clustering.kmeans(points, 3, seeds=4)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.nid // 30)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert cost == pytest.approx(sum(((x[30 * g : 30 * g + 30] - x[30 * g : 30 * g + 30].mean(axis=0)) ** 2).sum() for g in range(3)))
    step = {r.cluster: r for r in clustering.lloyd_step(points, centres).collect()}
    assert sum(r.n for r in step.values()) == 90 and sum(r.cost for r in step.values()) == pytest.approx(cost)
    nothing = clustering.kmeans(points.limit(0), 3)
    assert nothing[0].count() == 0 and clustering.fuzzy_cmeans(points.limit(0), 3)[0].count() == 0
    odd = points.unionByName(spark.createDataFrame([(99, None)], "nid long, vec array<double>"))
    assert clustering.nearest(odd, centres).where("nid = 99").first().cluster is None


def test_loops_end_by_themselves(spark):
    """A long chain: as many rounds as it takes."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    nodes = spark.range(26).select(F.lit("n").alias("ntype"), F.col("id").alias("nid"))
    links = spark.createDataFrame([("next", k, k + 1) for k in range(25)], "ltype string, src long, dst long")
    part, history = partition.counted_partition(nodes, links)
    assert part.select("class_id").distinct().count() == 26 and len(history) > 20
