"""The greedy cover: in groups, in rounds, and with equal nodes merged."""

import random

import pytest
from pyspark.sql import functions as F

from hetweave.operators import cover
from hetweave.operators.channels import TERM_MEASURES


@pytest.mark.parametrize(("seed", "share"), [(1, 0.3), (2, 0.85)])
def test_rounds_equal_greedy(spark, seed, share):
    """A sparse and a dense class, with ids in no order of the graph."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 26)
    pairs = [(min(a, b), max(a, b)) for k, a in enumerate(ids) for b in ids[:k] if rng.random() < share]
    got = cover.cover_in_rounds(spark.createDataFrame(pairs, "i long, j long"))
    want = cover.greedy(pairs)
    assert {n: n for n in want} | {r.nid: r.cluster_id for r in got.collect()} == want


def plain(rows, tau_term, tau_attr, measure):
    """Cluster of each (nid, class, terms, feat), class by class in order of ids."""

    def passes(x, y):
        c, a, b = len(x[2] & y[2]), len(x[2]), len(y[2])
        score = {"cosine": c / (a * b) ** 0.5 if a and b else 0.0, "jaccard": c / (a + b - c) if a or b else 1.0, "overlap": c / min(a, b) if a and b else float(not a and not b)}[measure]
        dot = sum(p * q for p, q in zip(x[3], y[3], strict=True))
        size = (sum(p * p for p in x[3]) * sum(q * q for q in y[3])) ** 0.5
        return score >= tau_term - 1e-8 and (dot / size if size else 0.0) >= tau_attr - 1e-10

    out = {}
    for row in sorted(rows):
        free = [s for s in sorted({out[r[0]] for r in rows if r[0] in out and r[1] == row[1]}) if all(passes(row, r) for r in rows if out.get(r[0]) == s)]
        out[row[0]] = None
        out[row[0]] = free[0] if free else row[0]
    return out


@pytest.mark.parametrize(("measure", "small"), [(m, s) for m in TERM_MEASURES for s in (10**6, 5)][:4])
def test_cover_with_equal_nodes(spark, measure, small):
    """Copies of nodes, nodes without terms, zero vectors; one class by rounds where small is 5."""
    rng = random.Random(7)
    kinds = [(frozenset(rng.sample("abcdef", rng.randint(0, 4))), rng.choice([(0.0, 0.0), (1.0, 0.2), (0.3, 1.0), (2.0, 1.9)])) for _ in range(9)]
    rows = [(k, 0 if k < 30 else k % 3 + 1, *rng.choice(kinds)) for k in rng.sample(range(40), 36)]
    part = spark.createDataFrame([("t", r[0], r[1]) for r in rows], "ntype string, nid long, class_id long")
    terms = spark.createDataFrame([(r[0], t) for r in rows for t in r[2]], "nid long, term string")
    feats = spark.createDataFrame([(r[0], list(r[3])) for r in rows], "nid long, feat array<double>")
    for tau_term, tau_attr in ((0.4, 0.6), (0.0, 0.0)):
        got = {r.nid: r.cluster_id for r in cover.guarded_cover(part, terms, feats, tau_term, tau_attr, measure, small=small).collect()}
        assert got == plain(rows, tau_term, tau_attr, measure), (tau_term, tau_attr)


@pytest.mark.parametrize("measure", TERM_MEASURES)
def test_points_and_pairs_give_one_cover(spark, measure, monkeypatch):
    """A class covered from its points draws no pairs and is what its pairs give; odd vectors go by pairs."""
    rng = random.Random(11)
    rows = [(k, k % 2, frozenset(rng.sample("abcdefgh", rng.randint(0, 3))), (rng.random(), rng.random(), rng.choice([0.0, 1.0]))) for k in rng.sample(range(200), 70)]
    part = spark.createDataFrame([("t", r[0], r[1]) for r in rows], "ntype string, nid long, class_id long")
    terms = spark.createDataFrame([(r[0], t) for r in rows for t in r[2]], "nid long, term string")
    feats = spark.createDataFrame([(r[0], list(r[3])) for r in rows], "nid long, feat array<double>")
    clusters = lambda f, small: {r.nid: r.cluster_id for r in cover.guarded_cover(part, terms, f, 0.4, 0.9, measure, small=small).collect()}
    by_pairs = clusters(feats, 3)
    odd = feats.unionByName(spark.createDataFrame([(rows[0][0], None)], "nid long, feat array<double>")).where(f"nid <> {rows[0][0]} or feat is null")
    longer = feats.withColumn("feat", F.when(F.col("nid") == rows[0][0], F.concat("feat", F.array(F.lit(0.0)))).otherwise(F.col("feat")))
    assert clusters(longer, 10**6) == by_pairs
    without = clusters(odd, 3)
    monkeypatch.setattr(cover, "passing_pairs", None)  # not called
    assert clusters(feats, 10**6) == by_pairs == plain(rows, 0.4, 0.9, measure)
    assert clusters(odd, 10**6) == without
