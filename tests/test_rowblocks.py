"""Measures and nearest few made in blocks of rows, against expanded pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_preserve import _written

from hetweave.operators import metapath, preserve, ranking, rowblocks
from hetweave.plans import similarity


@pytest.mark.parametrize("method", ["pathsim", "hetesim"])
def test_measures_of_blocks_equal_expanded_pairs(spark, monkeypatch, method):
    """Several blocks, cut terms and packets, hubs, weights of both widths, far ids, targets without links, a link of no target."""
    for module, name, value in ((metapath, "BLOCK", 5), (metapath, "TERMS", 7), (rowblocks, "DENSE", 60), (rowblocks, "CHUNK", 11), (rowblocks, "LEAST_ROWS", 1)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(8)
    ids = np.array([3, 4, 9, 11, 12, 40, 41, 42, 77, 90, 91, 95, 2**40, 2**40 + 1, 2**40 + 5])
    n, of = len(ids), [0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    m = rng.integers(0, 3, (n, 7)) * (rng.random((n, 7)) < 0.5)
    m[:6, 0], m[5], m[9] = 1, 0, [0, 0.5, 300, 0, 0, 0, 1]
    links = [(int(ids[i]), d, float(m[i, d])) for i, d in zip(*np.nonzero(m), strict=True)]
    half = spark.createDataFrame([(s, int(d), w) for s, d, w in links] + [(2, 0, 1.0), (4, None, 2.0), (None, 1, 1.0)], "src long, dst long, w double")
    mapping = spark.createDataFrame([(int(ids[i]), c) for i, c in enumerate(of)], "nid long, cluster_id long")
    targets = mapping.select("nid")
    small = spark.createDataFrame([(int(i), int(j), float(rng.choice([0.0, 0.25, 0.5, 1.0]))) for i in range(6) for j in range(6)], "i long, j long, score double")
    inside = metapath.similarity(method, half).join(targets.toDF("i"), "i", "left_semi").join(targets.toDF("j"), "j", "left_semi")
    columns = ("mae", "p95", "p99", "maxe", "p", "tie_overlap", "ndcg")
    for ks, keep_self in (((2, 5), False), ((30,), True)):
        each = preserve.half_measures(method, half, small, mapping, ks, keep_self=keep_self)
        share = {r.i: r for r in preserve.cluster_overlaps(preserve.nearest_of(each), small, mapping, ks).collect()}
        got = {(r.i, r.k): r for r in each.collect()}
        assert len(got) == n * len(ks)
        for k in ks[:1]:
            want = ranking.preservation(inside, metapath.expand(small, mapping), targets.toDF("q"), targets, k=k, keep_self=keep_self).collect()
            assert len(want) == n
            for r in want:
                assert [got[r.i, k][c] for c in columns] == pytest.approx([r[c] for c in columns], abs=1e-9), r.i
                assert share[r.i][f"top{k}"] == pytest.approx(r.overlap)


def test_rows_of_text_ids_and_two_sides(spark):
    """Ids that are no numbers, and halves that differ, give the products of both."""
    a = [("x", 1, 1.0), ("x", 2, 2.0), ("y", 2, 1.0), ("z", 3, 1.0)]
    b = [("y", 1, 3.0), ("x", 2, 1.0), ("w", 2, 1.0)]
    left, right = (spark.createDataFrame(t, "src string, dst long, w double") for t in (a, b))
    got = {(r.i, r.j): r.score for r in metapath.hetesim(left, right=right).collect()}
    assert got == pytest.approx({("x", "y"): 1 / 5**0.5, ("x", "x"): 2 / 5**0.5, ("x", "w"): 2 / 5**0.5, ("y", "x"): 1.0, ("y", "w"): 1.0})
    one = spark.createDataFrame([("x",)], "q string")
    assert {(r.i, r.j) for r in metapath.hetesim(left, one, right).collect()} == {("x", "y"), ("x", "x"), ("x", "w")}
    assert {(r.i, r.j): r.score for r in metapath.pathsim(left, one).collect()} == pytest.approx({("x", "x"): 1.0, ("x", "y"): 4 / 6})


def test_pairs_of_queries_are_no_rows(spark, tmp_path):
    """300 suppliers that share parts in no order: 90,000 pairs, and measures and nearest few shuffle far fewer rows."""
    rng = np.random.default_rng(1)
    n = 300
    spark.createDataFrame([(i, i % 25) for i in range(n)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(int(s), int(p)) for s, p in zip(rng.permutation(np.repeat(np.arange(n), 20)), rng.integers(0, 60, 20 * n), strict=True)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = similarity.m4_hetesim_whole_path(spark, str(tmp_path)).count()
    assert pairs > 0.9 * n * n
    for query, many in ((similarity.r8_ranking_metrics, n), (similarity.m1_pathsim_topk, 10 * n)):
        before = _written(spark)
        assert len(query(spark, str(tmp_path)).collect()) == many
        assert _written(spark) - before < 0.8 * pairs, query.__name__


def test_clusters_with_equal_reduced_rows_are_one_kind(spark, monkeypatch):
    """200 targets that all stay alone, of four rows: four kinds are measured, not 200."""
    seen = []
    real = preserve.block_measures
    monkeypatch.setattr(preserve, "block_measures", lambda rows, *args: seen.append(rows.count()) or real(rows, *args))
    n = 200
    links = spark.createDataFrame([("to", i, 1000 + i % 4, 1.0) for i in range(n)] + [("to", i, 2000, 2.0) for i in range(n)], "ltype string, src long, dst long, w double")
    targets = spark.range(n).toDF("nid")
    mappings = targets.select(F.lit(0).alias("cell"), "nid", F.col("nid").alias("cluster_id"))
    found = preserve.preserved({"TM": links.drop("ltype")}, links, {"TM": ("to",)}, mappings, targets, targets.toDF("q"), k=3).collect()
    assert seen == [4]
    assert all(r.mae == 0 and r.maxe == 0 and r.overlap == r.tie_overlap == r.ndcg == 1 for r in found) and len(found) == 2
