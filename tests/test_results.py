"""Result helpers and the link stream."""

import pytest

from hetweave.functions.results import fresh_dir, paired_by, speedups, timed
from hetweave.operators import evaluate
from hetweave.operators.clustering import preservation_summary
from hetweave.streaming.links import keep_link_table, link_table


def test_fresh_dir(spark, tmp_path):
    a, b = fresh_dir(spark, str(tmp_path), "run"), fresh_dir(spark, str(tmp_path), "run")
    assert a != b and a.startswith(f"{tmp_path}/run_")
    assert fresh_dir(spark, str(tmp_path), "x", overwrite=True) == f"{tmp_path}/x"


def test_paired_by(spark):
    rows = [("m", s, n, v) for s, vals in (("a", [0.5, 0.6, 0.8]), ("b", [0.4, 0.55, 0.65])) for n, v in enumerate(vals)] + [("one", "a", 0, 0.5), ("one", "b", 0, 0.1), ("same", "a", 0, 0.5), ("same", "a", 1, 0.6), ("same", "b", 0, 0.5), ("same", "b", 1, 0.6)]
    got = {r.k: r for r in paired_by(spark.createDataFrame(rows, "k string, setting string, seed int, x double"), ("k",), "x", "a", "b").collect()}
    assert got["m"].n == 3 and got["m"].t == pytest.approx(3.4641016) and got["m"].p == pytest.approx(0.0742, abs=1e-3)
    assert got["one"].p is None and got["same"].p == 1.0


def test_timed(spark):
    rows = timed({"a": lambda: spark.range(10), "b": lambda: spark.range(20)}, repeats=2, warm_up=1)
    assert len(rows) == 4 and {r.name: r.speedup for r in speedups(spark, rows, "a").collect()}["a"] == 1.0


def test_cluster_settings(spark):
    data = [(k, [float(k % 2) * 9 + k * 0.01, 1.0]) for k in range(20)]
    points = spark.createDataFrame(data, "nid long, vec array<double>")
    own = spark.createDataFrame([(k, k % 2) for k in range(20)], "nid long, y int")
    raw = evaluate.cluster_settings({"original": points, "reduced": points}, own, 2, ("kmeans",), (1, 2))
    assert {r.acc for r in raw.collect()} == {1.0}
    summary = preservation_summary(raw, ("algorithm",), ("nmi", "acc")).collect()
    assert {r.nmi_delta for r in summary} == {0.0} and {r.acc_std for r in summary} == {0.0}
    assert evaluate.typical_seed(raw, ("setting",), ("nmi", "acc")).where("seed = 1").count() == 2


def test_link_stream(spark, tmp_path):
    schema = "ltype string, src long, dst long, w double"
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    for rows in ([("a", 1, 2, 1.0), ("a", 1, 2, None)], [("a", 1, 2, 0.5), ("b", 1, 2, 3.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        keep_link_table(spark.readStream.schema(schema).parquet(source), out, check).awaitTermination()
    assert sorted(map(tuple, link_table(spark, out).collect())) == [("a", 1, 2, 2.5), ("b", 1, 2, 3.0)]
