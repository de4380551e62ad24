"""Pairs of class members: drawn up in tiles, scored by sets of terms, and audited without a sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hetweave.operators import audit, channels, tiles


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(3)
    rows = [(k, k % 2, sorted(rng.sample("abcd", rng.randint(0, 2))), [rng.random(), rng.random()]) for k in rng.sample(range(99), 40)]
    return rows, spark.createDataFrame([("t", r[1], r[0]) for r in rows], "ntype string, class_id long, nid long")


def test_tiles_meet_each_pair_once(members):
    """Whatever the blocks, each pair of a class comes once, lesser id first."""
    rows, df = members
    want = sorted((c, i, j) for i, c, *_ in rows for j, d, *_ in rows if c == d and i < j)
    for block in (3, 1000):
        assert sorted((r.class_id, r.i, r.j) for r in channels.class_tiles(df, block).collect()) == want


@pytest.mark.parametrize("measure", channels.TERM_MEASURES)
def test_members_of_equal_sets_score_alike(spark, members, measure):
    """Scores given from sets to their members are those of the pairs, and no pair of members is in a join on terms."""
    rows, df = members
    terms = spark.createDataFrame([(r[0], t) for r in rows for t in r[2]], "nid long, term string")
    got = {(r.i, r.j): r.score for r in channels.term_scores(df, terms, measure).collect()}
    want = {}
    for i, c, a, _ in rows:
        for j, d, b, _ in rows:
            if c == d and i < j and set(a) & set(b):
                n = len(set(a) & set(b))
                want[i, j] = {"cosine": n / (len(a) * len(b)) ** 0.5, "jaccard": n / (len(a) + len(b) - n), "overlap": n / min(len(a), len(b))}[measure]
    assert got == pytest.approx(want)
    every = {(r.i, r.j): r.term_score for r in channels.scored_pairs(df, terms, None, measure).collect()}
    empty = {r[0] for r in rows if not r[2]}
    assert every == pytest.approx({p: want.get(p, 1.0 if measure != "cosine" and empty.issuperset(p) else 0.0) for p in every})


def test_representatives_are_not_sorted(spark, members):
    """The plan holds no window and no sort over the pairs."""
    rows, df = members
    feats = spark.createDataFrame([(r[0], r[3]) for r in rows], "nid long, feat array<double>")
    scored = channels.scored_pairs(df, None, feats).withColumn("term_score", F.lit(0.5))
    judged = audit.judged_pairs(scored, 0.4, 0.9)
    found = audit.representative_pairs(judged)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(r.attr_score, r.i, r.j, r.decision) for r in judged.collect()]
    best = min((-round(a, 9), i, j) for a, i, j, d in pairs if d == "accepted")
    least = min((round(a, 9), i, j) for a, i, j, d in pairs if d == "attribute_only_reject")
    assert {r.decision: (r.i, r.j) for r in found.collect()} == {"accepted": best[1:], "attribute_only_reject": least[1:]}


@pytest.mark.parametrize("block", [None, 7])
def test_all_pairs_in_strips(spark, monkeypatch, block):
    """The nearest few, ties to the least id, and sums of distances, with strips of a row or two; copies are at distance 0."""
    monkeypatch.setattr(tiles, "STRIP", 40)
    rng = random.Random(8)
    vecs = {k: [rng.choice([-1.0, 0.0, 1.0]), rng.choice([1.0, 2.0]), 1e4 + rng.random() * (k % 3)] for k in rng.sample(range(99), 30)}
    df = spark.createDataFrame([(k, k % 4, v) for k, v in vecs.items()], "nid long, cluster int, vec array<double>")
    x = {k: np.array(v[:2]) / np.linalg.norm(v[:2]) for k, v in vecs.items()}
    near = tiles.nearest_cosines(df.withColumn("vec", F.slice("vec", 1, 2)), 4, block=block).collect()
    for i in vecs:
        want = sorted((-round(float(x[i] @ x[j]), 9), j) for j in vecs if j != i)[:4]
        assert sorted((-r.score, r.j) for r in near if r.i == i)[:4] == want
    got = {(r.i, r.cj): (r.s, r.n) for r in tiles.distance_sums(df, block).collect()}
    for i in vecs:
        for c in range(4):
            others = [j for j in vecs if j % 4 == c and j != i]
            total = sum(float(np.linalg.norm(np.array(vecs[i]) - np.array(vecs[j]))) for j in others)
            assert got.get((i, c), (0.0, 0)) == (pytest.approx(total, rel=1e-12), len(others))


def test_points_go_to_few_blocks():
    """Each point is sent to every block, so these grow large before they grow many."""
    assert [tiles.blocks_of(n) for n in (0, 1, 1025, 100_000, 300_000)] == [1, 1, 2, 8, 19]
