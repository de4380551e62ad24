"""Selection, labels, clustering and audits on small tables."""

from itertools import permutations

import numpy as np
import pytest

from hetweave.operators import audit, clustering, labels, selection
from hetweave.operators.graph import connected_components
from hetweave.sources import archive


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 9), (None, 4)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5} | {100 + k: 100 for k in range(41)} | {200 + k: 200 for k in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pareto(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 3, 80), rng.integers(0, 6, 80), rng.integers(0, 6, 80), strict=True)] + [(0, None, 9.0)]
    got = sorted((r.g, r.a, r.b) for r in selection.pareto(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ("g",)).collect())
    known = [r for r in rows if r[1] is not None]
    want = sorted(r for r in known if not any(o[0] == r[0] and o[1] >= r[1] and o[2] >= r[2] and o != r for o in known))
    assert got == want


def test_float_grid_and_lists():
    assert selection.float_grid(0.1, 1.0, 0.1) == [round(0.1 * k, 6) for k in range(1, 11)]
    with pytest.raises(ValueError):
        selection.float_grid(0, 1, 0)
    assert archive.parse_list(" 1, 2,,3 ", int) == [1, 2, 3]


def figures(spark, rows):
    names = [f"avg_{m}_{n}" for m in selection.METHODS for n in ("mae", "p95e", "p99e", "ndcg10", "top10", "pvalue")]
    cols = ["dataset string", "reduction_setting string", "semantic_threshold double", "attribute_threshold double", "fullgraph_reduction_ratio double", "main_reduction_ratio double", "fullgraph_edge_reduction_ratio double", *[f"{n} double" for n in names]]
    return spark.createDataFrame([(d, "x", t, t, rr, rr, 0.1, *vals, *vals) for d, t, rr, vals in rows], ", ".join(cols))


def test_selection_fallbacks(spark):
    good, bad = [0.01, 0.1, 0.1, 0.99, 0.95, 0.5], [0.3, 0.1, 0.1, 0.99, 0.95, 0.5]
    missing = [None, 0.1, 0.1, 0.99, 0.95, 0.5]
    g = figures(spark, [("a", 0.1, 0.5, good), ("a", 0.2, 0.7, good), ("a", 0.3, 0.9, bad), ("b", 0.1, 0.5, bad), ("b", 0.2, 0.9, [0.2, *bad[1:]]), ("c", 0.1, 0.5, missing)])
    pick = lambda df: {r.dataset: (r.semantic_threshold, r.selection_source) for r in df.collect()}
    risked = selection.normalized_risk(g)
    assert pick(selection.select_normalized(risked)) == {"a": (0.2, "normalized_risk"), "b": (0.2, "normalized_best_effort"), "c": (0.1, "normalized_best_effort")}
    assert pick(selection.select_normalized(risked, fallback="none")) == {"a": (0.2, "normalized_risk")}
    floored = selection.floored_risk(g)
    assert pick(selection.select_by_objective(floored, "fullgraph_reduction_ratio"))["c"] == (0.1, "feasible")  # missing figures don't count there
    assert pick(selection.select_by_objective(floored, "fullgraph_reduction_ratio", fallback="max_node_reduction"))["b"] == (0.2, "fallback_max_node_reduction")
    flags = selection.row_score(selection.controllability(g))
    assert pick(selection.select_controllable(flags)) == {"a": (0.2, "joint"), "b": (0.2, "best_effort"), "c": (0.1, "best_effort")}
    with pytest.raises(ValueError):
        selection.select_controllable(flags, "other")


def test_zero_budget(spark):
    g = figures(spark, [("a", 0.1, 0.5, [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]), ("b", 0.1, 0.5, [0.1, 0.0, 0.0, 1.0, 1.0, 1.0])])
    assert {r.dataset: r.joint_risk for r in selection.normalized_risk(g, 0.0).collect()} == {"a": 0.0, "b": float("inf")}


def test_labels(spark):
    rows = spark.createDataFrame([(1, "b,a"), (2, "a"), (3, ""), (4, None), (5, "c")], "nid long, y string")
    assert sorted((r.nid, r.y, r.code) for r in labels.target_labels(rows).collect()) == [(1, "b", 1), (2, "a", 0), (5, "c", 2)]
    assert sorted((r.nid, r.code) for r in labels.target_labels(rows, "drop").collect()) == [(2, 0), (5, 1)]
    with pytest.raises(ValueError):
        labels.target_labels(rows, "last")


def test_votes(spark):
    own = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "nid long, y string")
    s = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (1, 4, 0.3), (2, 3, -0.5), (2, 4, -0.1), (3, 9, 1.0)], "i long, j long, score double")
    got = {r.q: r.vote for r in labels.neighbour_vote(s, own, 3).collect()}
    assert got == {1: "y", 2: "y"}
    m = labels.vote_measures(labels.neighbour_vote(s, own, 3)).first()
    assert (m.accuracy, m.macro_precision, m.macro_f1) == (0.0, 0.0, 0.0)


def test_hungarian():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 2), (2, 5), (5, 5)):
        gain = rng.integers(0, 20, (n, m)).astype(float)
        match = clustering.hungarian(gain)
        got = sum(gain[match[j], j] for j in range(m) if match[j] < n)
        size = max(n, m)
        pad = np.zeros((size, size))
        pad[:n, :m] = gain
        assert got == max(sum(pad[p[j], j] for j in range(size)) for p in permutations(range(size)))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    return spark.createDataFrame([(i, int(i // 30), v.tolist()) for i, v in enumerate(x)], "nid long, y int, vec array<double>"), x


@pytest.mark.parametrize("algorithm", ["kmeans", "fcm", "bsas", "xmeans"])
def test_clusterers_find_blobs(blobs, algorithm):
    points, _ = blobs
    options = {"theta": 2.0} if algorithm == "bsas" else {}
    found = clustering.cluster(algorithm, points.select("nid", "vec"), 3, **options).join(points.select("nid", "y"), "nid")
    assert clustering.accuracy(clustering.contingency(found)) == 1.0
    assert clustering.nmi(clustering.contingency(found)).first().nmi == pytest.approx(1.0)


def test_unknown_clusterer(blobs):
    with pytest.raises(ValueError):
        clustering.cluster("other", blobs[0], 2)


def test_cluster_measures(blobs):
    points, x = blobs
    own = points.selectExpr("nid", "y as cluster", "vec")
    y = np.repeat(np.arange(3), 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(90):
        a = d[i][(y == y[i]) & (np.arange(90) != i)].mean()
        b = min(d[i][y == c].mean() for c in range(3) if c != y[i])
        s.append((b - a) / max(a, b))
    assert clustering.silhouette(own).first().silhouette == pytest.approx(np.mean(s))
    g = x.mean(axis=0)
    between = sum(30 * ((x[y == c].mean(axis=0) - g) ** 2).sum() for c in range(3))
    within = sum(((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum() for c in range(3))
    assert clustering.calinski_harabasz(own).first().calinski_harabasz == pytest.approx(between / 2 / (within / 87))


def test_audits(spark):
    fine = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "nid long, cluster_id long")
    coarse = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "nid long, cluster_id long")
    assert audit.spanning_clusters(fine, coarse).isEmpty() and audit.spanning_clusters(coarse, fine).count() == 1
    assert audit.split_pairs(fine, coarse).first().split_pairs == 2
    runs = audit.random_refinements(fine, coarse, 6, seed=1).collect()
    for run in range(1, 7):
        sizes = {}
        for r in runs:
            if r.run == run:
                sizes.setdefault(r.cluster_id, set()).add(r.nid)
        assert sorted(len(v) for v in sizes.values()) == [1, 1, 2] and sizes[4] == {4}
    assert {r.cluster_id: r.members for r in audit.grouped_members(fine).collect()}[1] == [1, 2]
    with pytest.raises(ValueError, match="bad"):
        audit.require({"fine": spark.range(0), "bad": spark.range(1)})


def test_dealt_members_are_sent_once(spark):
    """Members of a coarse cluster are dealt in a task as by windows, carry columns along, and no run is shuffled."""
    n, runs = 60, 40
    fine = spark.createDataFrame([(i, i - i % (2 + i // 30), i * 10) for i in range(n)], "nid long, cluster_id long, size int")
    coarse = spark.createDataFrame([(i, i // 30) for i in range(n)], "nid long, cluster_id long")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)

    def written():
        every = stages()
        return sum(every.apply(i).shuffleWriteRecords() for i in range(every.size()))

    before = written()
    dealt = {tuple(r) for r in audit.random_refinements(fine, coarse, runs, seed=7, carry=("size",)).collect()}
    assert written() - before < n * runs / 4
    assert len(dealt) == n * runs and all(r[3] == r[1] * 10 for r in dealt)
    assert dealt == {tuple(r) for r in audit.random_refinements(fine, coarse, runs, seed=7, carry=("size",), held=0).collect()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.5), ("B", 0.7)], "dataset string, x double")
    archive.write_results(df, str(tmp_path / "r"))
    assert archive.read_results(spark, str(tmp_path / "r"), dataset=["a"]).collect()[0].x == 0.5
    with pytest.raises(Exception, match="exists"):
        archive.write_results(df, str(tmp_path / "r"))
    assert archive.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "r")]) == str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        archive.first_existing(spark, [str(tmp_path / "no")])
    s = spark.createDataFrame([("d", "p", "original", 1, 2, 0.5)], "dataset string, path string, matrix_type string, i long, j long, score double")
    assert archive.write_similarities(s, str(tmp_path / "s")).first().pairs == 1
    assert archive.content_hashes(spark, str(tmp_path / "r/*.csv")).where("length(sha256) = 64").count() >= 1


def test_clusterings_run_to_their_end(spark, monkeypatch):
    """Registered clusterings have the reference's starts and rounds; a limit that ends a run is told."""
    from hetweave.plans import analytics

    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 2)))], "nid long, y int, vec array<double>")
    for run in (lambda: clustering.kmeans(points, 4, seeds=1, rounds=1), lambda: clustering.fuzzy_cmeans(points, 3, rounds=1)):
        with pytest.warns(RuntimeWarning, match="not converged"):
            run()
    asked, kmeans = [], clustering.kmeans
    monkeypatch.setattr(clustering, "kmeans", lambda p, k, **o: asked.append((o["seeds"], o["rounds"])) or kmeans(p, k, **o | {"seeds": 1}))
    clustering.xmeans(points, 2)
    assert asked == [(5, 300)]
    monkeypatch.setattr(analytics.src, "vectors", lambda *_: points)
    monkeypatch.setattr(clustering, "cluster", lambda name, p, k, **o: asked.append((name, k, o)) or p.select("nid"))
    analytics.l9_kmeans(spark, "")
    analytics.l10_fuzzy_cmeans(spark, "")
    assert asked[1:] == [("kmeans", 10, {"seeds": 10, "rounds": 300}), ("fcm", 10, {"rounds": 150})]
