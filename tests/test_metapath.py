"""Compositions and similarities of the hand-checkable network."""

import json
import zipfile

import numpy as np
import pytest

from hetweave.network import LinkType, NetworkConfig
from hetweave.operators import channels, cover, metapath, partition, quotient
from hetweave.operators.evaluate import Prepared, dense_index, evaluate_grid, message_pass, project_plane, training_views
from hetweave.sources import archive

AP = [(0, 10), (0, 11), (1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (3, 13), (4, 14)]
PV = [(10, 20), (11, 20), (12, 20), (13, 21), (14, 21)]
PT = [(10, 30), (11, 31), (12, 31), (13, 32), (14, 32)]
FEATURES = {0: [1.0, 0.0, 1.0], 1: [2.0, 0.0, 2.0], 2: [0.0, 1.0, 0.0], 3: [1.0, 1.0, 0.0]}
LINKS = {"AP": (AP, "A", "P"), "PA": ([(b, a) for a, b in AP], "P", "A"), "PV": (PV, "P", "V"), "VP": ([(b, a) for a, b in PV], "V", "P"), "PT": (PT, "P", "T")}
LAYERS = {
    "target": "A",
    "main_types": ("A", "P", "V"),
    "core_links": ("0", "1", "2", "3"),
    "term_paths": {"A": ("0", "4"), "P": ("4",), "V": ("3", "4")},
    "half_paths": {"APA": ("0",), "APVPA": ("0", "2"), "APTPA": ("0", "4")},
    "semantic_types": ("T",),
    "strong_types": ("A",),
}


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    """The network by way of an archive with a folder, junk, blank lines and absent weights."""
    path = tmp_path_factory.mktemp("archive") / "tiny.zip"
    types = ["A", "P", "V", "T"]
    of = lambda n: 0 if n < 10 else 1 if n < 20 else 2 if n < 30 else 3
    nodes = "\n".join("\t".join([str(n), f"n{n}", str(of(n)), *([",".join(map(str, FEATURES[n]))] if n in FEATURES else [])]) for n in [*range(5), *range(10, 15), 20, 21, 30, 31, 32])
    lines = [f"{a}\t{b}\t{k}" + ("\t1.0" if (a + b) % 2 else "") for k, (es, _, _) in enumerate(LINKS.values()) for a, b in es]
    lines += ["0\t20\t0\t5.0", ""]  # its end is no P
    info = {"node.dat": {"node type": {str(k): t for k, t in enumerate(types)}}, "link.dat": {"link type": {str(k): {"start": str(types.index(s)), "end": str(types.index(e)), "meaning": n} for k, (n, (_, s, e)) in enumerate(LINKS.items())}}}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("tiny/node.dat", nodes + "\n\n")
        z.writestr("tiny/link.dat", "\n".join(lines))
        z.writestr("tiny/label.dat", "0\tn0\t0\tx,y\n1\tn1\t0\ty\n")
        z.writestr("tiny/label.dat.test", "3\tn3\t0\tz\n")
        z.writestr("tiny/info.dat", json.dumps(info))
        z.writestr("__MACOSX/tiny/node.dat", "junk")
        z.writestr("tiny/._node.dat", "junk")
    return archive.load_archive(spark, str(path), **LAYERS)


def scores(df):
    return {(r.i, r.j): r.score for r in df.collect()}


def test_archive(net):
    assert net.nodes.groupBy("ntype").count().collect() and {r.ntype: r["count"] for r in net.nodes.groupBy("ntype").count().collect()} == {"A": 5, "P": 5, "V": 2, "T": 3}
    assert net.features.count() == 4
    assert sorted((r.nid, r.ntype, r.y, r.split) for r in net.labels.collect()) == [(0, "A", "x,y", "train"), (1, "A", "y", "train"), (3, "A", "z", "test")]
    rows = net.link_matrices().where("ltype = '0'").collect()
    assert sorted((r.src, r.dst) for r in rows) == sorted(AP) and {r.w for r in rows} == {1.0}


def test_archive_without_nodes():
    with pytest.raises(ValueError):
        archive.wanted(["a.txt"])


def test_similarities(net):
    half = {n: metapath.compose(*[net.link(x) for x in p]) for n, p in LAYERS["half_paths"].items()}
    apa = scores(metapath.pathsim(half["APA"]))
    assert {k: v for k, v in apa.items() if k[0] != k[1]} == {(i, j): 1.0 for i in range(3) for j in range(3) if i != j}
    s, h = scores(metapath.pathsim(half["APVPA"])), scores(metapath.hetesim(half["APVPA"]))
    assert s[0, 3] == pytest.approx(2 / 3) and s[3, 4] == pytest.approx(2 / 3)
    assert h[0, 3] == pytest.approx(0.5**0.5) and h[3, 4] == pytest.approx(0.5**0.5)
    s, h = scores(metapath.pathsim(half["APTPA"])), scores(metapath.hetesim(half["APTPA"]))
    assert s[0, 3] == pytest.approx(0.5) and s[3, 4] == pytest.approx(2 / 3) and h[0, 3] == pytest.approx(0.5)
    assert all(abs(s[a, b] - s[b, a]) < 1e-12 for a, b in s)
    with pytest.raises(ValueError):
        metapath.similarity("other", half["APA"])
    with pytest.raises(ValueError):
        metapath.hetesim_of_path([net.link("0")], same_type=True)


def test_partition_and_cover(spark, net):
    main = net.nodes.where("ntype in ('A', 'P', 'V')")
    core = net.link_matrices().where("ltype in ('0', '1', '2', '3')")
    part = partition.entity_partition(main, core)
    groups = {}
    for r in part.collect():
        groups.setdefault((r.ntype, r.class_id), set()).add(r.nid)
    want = {("A", 0): {0, 1, 2}, ("A", 3): {3}, ("A", 4): {4}, ("P", 10): {10, 11}, ("P", 12): {12}, ("P", 13): {13}, ("P", 14): {14}, ("V", 20): {20}, ("V", 21): {21}}
    assert groups == want
    counted, history = partition.counted_partition(main, core)
    got = {}
    for r in counted.collect():
        got.setdefault((r.ntype, r.class_id), set()).add(r.nid)
    assert got == want and history[-1][2] == 0 and len(history) == 3
    terms = channels.term_channel(net.link("0"), net.link("4"))
    a = part.where("ntype = 'A'")
    s = {(r.i, r.j): (r.term_score, r.attr_score) for r in channels.scored_pairs(a.withColumn("class_id", a.class_id * 0), terms, net.features).collect()}
    assert s[0, 1] == pytest.approx((1, 1)) and s[0, 2] == pytest.approx((1, 0)) and s[0, 3] == pytest.approx((0.5, 0.5))
    assert s[3, 4] == pytest.approx((0.5**0.5, 0)) and s[0, 4] == pytest.approx((0, 0)) and s[2, 3][1] == pytest.approx(0.5**0.5)
    for tau in (1.0, 0.1):
        m = {r.nid: r.cluster_id for r in cover.guarded_cover(a, terms, net.features, 0.4, tau).collect()}
        assert m == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r.nid: r.cluster_id for r in cover.guarded_cover(a, None, None, 0.4, 1).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_quotient(net):
    prepared = Prepared(net)
    mapping = prepared.cover(0.4, 1.0)
    small = quotient.quotient_links(prepared.matrices.where("ltype = '0'"), mapping)
    assert sorted((r.src, r.dst, r.w) for r in small.collect()) == [(0, 10, 2.0), (0, 11, 2.0), (2, 10, 1.0), (2, 11, 1.0), (3, 12, 1.0), (3, 13, 1.0), (4, 14, 1.0)]
    reduced = metapath.expand(metapath.pathsim(small.drop("ltype")), mapping.where("ntype = 'A'"))
    s = {k: v for k, v in scores(reduced).items() if k[0] != k[1]}
    assert s[0, 1] == pytest.approx(1) and s[0, 2] == pytest.approx(0.8) and s[1, 2] == pytest.approx(0.8) and (0, 3) not in s


def test_grid(net):
    rows = {(r.semantic_threshold, r.attribute_threshold): r for r in evaluate_grid(Prepared(net), [(0.4, 1.0)], dataset="tiny").collect()}
    r = rows[0.4, 1.0]
    assert (r.main_nodes, r.reduced_main_nodes, r.full_nodes) == (12, 11, 15)
    assert 0 < r.avg_pathsim_mae < 0.1 and r.avg_pathsim_ndcg10 > 0.9


def test_whole_grid(spark, tmp_path, monkeypatch):
    """t1_evaluated_grid asks for every pair of thresholds and every part; cells against loops over more than fifty parts."""
    from hetweave.plans import evaluation

    rng = np.random.default_rng(3)
    vectors, parts = [(0, 1.0), (1, 1.0), (2, 0.0)], []
    for i in range(60):
        size, price = vectors[rng.integers(3)]
        parts.append((i, f"w{rng.integers(4)}", f"b{rng.integers(2)}", f"t{rng.integers(2)}", size, price))
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    asked = {}

    def stop(prepared, pairs, **options):
        asked.update(prepared=prepared, pairs=pairs, options=options)
        raise InterruptedError

    monkeypatch.setattr(evaluation.evaluate, "select_over_grid", stop)
    with pytest.raises(InterruptedError):
        evaluation.t1_evaluated_grid(spark, str(tmp_path))
    taus = [round(0.1 * k, 6) for k in range(1, 11)]
    assert sorted(asked["pairs"]) == [(t, a) for t in taus for a in taus] and asked["options"].get("queries") is None
    # terms are equal or not, cosines of vectors 0, 0.707 or 1; equal term sets are a rule of their own
    first = asked["prepared"].alike(asked["pairs"])
    groups = {}
    for (t, a), k in zip(asked["pairs"], first, strict=True):
        groups.setdefault((t == 1.0, a > 0.75), set()).add(k)
    assert all(len(g) == 1 for g in groups.values()) and len(set(first)) == 4
    got = {(r.semantic_threshold, r.attribute_threshold): r for r in evaluate_grid(asked["prepared"], [(0.3, 0.2), (0.7, 0.5)]).collect()}
    assert len(got) == 2

    def passes(i, j, a):
        x, y = (np.array(parts[k][4:], float) for k in (i, j))
        return parts[i][1] == parts[j][1] and x @ y / np.sqrt((x @ x) * (y @ y)) >= a - 1e-10

    def pathsim(half):
        m = half @ half.T
        return 2 * m / (m.diagonal()[:, None] + m.diagonal())

    for (_, a), r in got.items():
        seed = {}
        for i in range(60):
            if i not in seed:
                own = [i]
                own += [j for j in range(i + 1, 60) if j not in seed and parts[i][2:4] == parts[j][2:4] and all(passes(x, j, a) for x in own) and not own.append(j)]
                seed |= dict.fromkeys(own, i)
        names, mae = sorted(set(seed.values())), []
        at = [names.index(seed[i]) for i in range(60)]
        for column in (1, 3):
            kinds = sorted({p[column] for p in parts})
            half = np.array([[float(p[column] == k) for k in kinds] for p in parts])
            small = np.array([sum(half[i] for i in range(60) if at[i] == c) for c in range(len(names))])
            off = np.abs(pathsim(half) - pathsim(small)[np.ix_(at, at)])
            np.fill_diagonal(off, 0)
            mae.append(off.mean())
        assert r.reduced_main_nodes == len(names) and r.avg_pathsim_mae == pytest.approx(np.mean(mae), abs=1e-7)


def test_training_views(net):
    prepared = Prepared(net)
    own = net.labels.where("split = 'train'").selectExpr("nid", "split(y, ',')[0] as y")
    views = training_views(prepared, prepared.cover(0.4, 1.0), own, net.labels.where("split = 'test'"))
    assert sorted(r.idx for r in views["original_index"].collect()) == list(range(12))
    assert sorted(r.idx for r in views["reduced_index"].collect()) == list(range(11))
    norm = {}
    for r in views["reduced_edges"].collect():
        norm[r.rel, r.dst] = norm.get((r.rel, r.dst), 0) + r.norm
    assert all(v == pytest.approx(1) for v in norm.values())
    assert views["reduced_labels"].count() == 0  # nodes 0 and 1 merge and disagree
    assert [(r.verdict, r.clusters) for r in views["excluded"].collect()] == [("mixed", 1)]


def test_dense_index_and_messages(spark):
    ids = spark.createDataFrame([(t, i * 7) for t in "ab" for i in range(50)], "ntype string, id long")
    got = [(r.ntype, r.id) for r in sorted(dense_index(ids, 8).collect(), key=lambda r: r.idx)]
    assert got == sorted(got)
    edges = spark.createDataFrame([("r", 0, 2, 0.5), ("r", 1, 2, 0.5), ("s", 0, 1, 1.0)], "rel string, src long, dst long, norm double")
    states = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "idx long, vec array<double>")
    assert {r.idx: r.vec for r in message_pass(edges, states, {"s": 2.0}).collect()} == {2: [0.5, 1.0], 1: [2.0, 0.0]}


def test_plane(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 0.1]
    [p] = project_plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "nid long, vec array<double>"))
    got = np.array([(r.x, r.y) for r in sorted(p.collect(), key=lambda r: r.nid)])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_config():
    links = (LinkType("ab", "a", "b"), LinkType("bc", "b", "c"), LinkType("ba", "b", "a"))
    good = NetworkConfig("a", ("a", "b", "c"), links, ("ab", "bc", "ba"), half_paths={"ABC": ("ab", "bc")})
    good.check()
    assert sorted(metapath.half_paths(good)) == [("a", ("ab",), "ABA"), ("a", ("ab", "bc"), "ABCBA"), ("b", ("ba",), "BAB"), ("b", ("bc",), "BCB")]
    for bad in ({"half_paths": {"x": ("ab", "ab")}}, {"half_paths": {"x": ("zz",)}}, {"term_paths": {"b": ("ab",)}}):
        with pytest.raises(ValueError):
            NetworkConfig("a", ("a",), links, ("ab",), **bad).check()


def test_tasks(spark, net, tmp_path, tmp_path_factory):
    """Every task of the command line, on the same archive; types go by number."""
    from hetweave.__main__ import main

    path = next(tmp_path_factory.getbasetemp().glob("archive*/tiny.zip"))
    layers = LAYERS | {"target": "0", "main_types": ["0", "1", "2"], "semantic_types": ["3"], "strong_types": ["0"], "term_paths": {"0": ["0", "4"], "1": ["4"], "2": ["3", "4"]}}
    (tmp_path / "layers.json").write_text(json.dumps(layers))
    common = ["--archive", str(path), "--layers", str(tmp_path / "layers.json"), "--out", str(tmp_path / "out"), "-k", "2"]
    read = lambda folder, name: spark.read.csv(f"{folder}/{name}", header=True, inferSchema=True)
    out = main(["reduce", *common])
    assert {r.ntype: r.clusters for r in read(out, "by_type").collect()} == {"A": 4, "P": 5, "V": 2}
    assert read(main(["topk", *common]), "topk").where("i = 0 and path = 'APA' and method = 'pathsim'").count() == 2
    out = main(["pairs", *common])
    assert {(r.ntype, r.decision): r.n for r in read(out, "counts").collect()}["A", "accepted"] == 1
    assert read(main(["predict", *common]), "votes").count() == 2
    assert read(main(["matrices", *common]), "manifest").count() == 12
    out = main(["select", *common, "--term-taus", "0.4", "--attr-taus", "1.0"])
    assert read(out, "selected").first().semantic_threshold == 0.4
    again = main(["reselect", "--results", f"{out}/grid", "--out", str(tmp_path / "out"), "--budget-scales", "0.5,2"])
    assert read(again, "sensitivity").count() == 2


@pytest.mark.parametrize("method", ["pathsim", "hetesim"])
def test_tiles_of_blocks_equal_whole_products(spark, monkeypatch, method):
    """Many blocks, cut terms, hubs and ties: the scores of a dense product, and the nearest few of each row."""
    monkeypatch.setattr(metapath, "BLOCK", 5)
    monkeypatch.setattr(metapath, "TERMS", 7)
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, (23, 9)) * (rng.random((23, 9)) < 0.4)
    m[:, 0] = 1
    m[4] = m[11] = m[12] = m[20]
    half = spark.createDataFrame([(int(i), int(d), float(m[i, d])) for i, d in zip(*np.nonzero(m), strict=True)], "src long, dst long, w double")
    dots, n = m @ m.T, (m * m).sum(axis=1)
    want = 2 * dots / (n[:, None] + n[None, :]) if method == "pathsim" else dots / np.sqrt(n[:, None] * n[None, :])
    got = np.zeros((23, 23))
    rows = metapath.similarity(method, half).collect()
    for r in rows:
        got[r.i, r.j] = r.score
    assert len(rows) == (dots > 0).sum() and got == pytest.approx(want)
    some = spark.createDataFrame([(3,), (20,)], "q long")
    asked = {(r.i, r.j): r.score for r in metapath.similarity(method, half, some).collect()}
    assert asked == pytest.approx({(i, j): want[i, j] for i in (3, 20) for j in range(23) if want[i, j]})
    few = metapath.similarity(method, half, best=4)
    assert few.count() < len(rows)
    best = {i: [] for i in range(23)}
    for r in sorted(few.collect(), key=lambda r: (-round(r.score, 9), r.j)):
        best[r.i].append(r.j)
    assert all(best[i][:4] == sorted((j for j in range(23) if j != i), key=lambda j: (-round(want[i, j], 9), j))[:4] for i in range(23))


def test_links_move_and_products_do_not(spark):
    """500 rows that all share 40 columns: their 10 million terms are never rows."""
    half = spark.range(20_000).selectExpr("id % 500 as src", "id div 500 as dst", "1.0D as w")
    out = metapath.pathsim(half)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0] and "FlatMapGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("score = 1").count() == 250_000
