"""Documents with like sets of shingles, against all pairs."""

import random

import brute
import pytest
from conftest import CLASHES, SCHEMA, sentence
from pyspark.sql import functions as F

from hetweave.llm import similar


@pytest.fixture(scope="module")
def near_rows(rows):
    """A crowd of near copies of one text, chains of edits, and copies that differ in white space only."""
    rng = random.Random(11)
    out = [r for r in rows if len(r[1] or "") < 5000]
    base = sentence(rng, 90).split(" ")
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append((1000 + k, " ".join(w), "en", "s0", 1))
    chain = list(base)
    for k in range(6):
        chain[15 * k] = f"link{k}"
        out.append((2000 + k, "  ".join(chain).upper(), "en", "s0", 1))
    return out + [(3000, "a b", "en", "s0", 1), (3001, "A  b ", "en", "s0", 1), (3002, "a b c", "en", "s0", 1)]


def plain_groups(rows):
    sets = [brute.shingles(r[1]) for r in rows]
    roots = brute.components(len(rows), lambda a, b: brute.alike(sets[a], sets[b]))
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    return sorted((str(r[0]), str(least.get(root))) for r, root in zip(rows, roots, strict=True))


@pytest.mark.parametrize("block", [256, 4])
def test_similar_documents(spark, near_rows, monkeypatch, block):
    """Every link that all pairs have; with small blocks most keys go by tiles."""
    monkeypatch.setattr(similar, "BLOCK", block)
    docs = spark.createDataFrame(near_rows, SCHEMA).repartition(3)
    got = similar.similar_documents(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == plain_groups(near_rows)


def test_drop_similar(spark, near_rows, none):
    docs = spark.createDataFrame(near_rows, SCHEMA).withColumns({c: F.lit("mine") for c in (*CLASHES, "p", "key", "root")})
    out = similar.drop_similar(docs)
    assert out.columns == docs.columns and {r.p for r in out.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted({c for _, c in plain_groups(near_rows)})
    assert similar.drop_similar(none).count() == 0


def test_sketches_join_before_blocks(spark):
    """A key of several blocks sends its rows to each of them, but the join with sketches has one row for each of the key's."""
    points = spark.createDataFrame([(p, bytes([p % 3] * 8)) for p in range(30)], "p long, marks binary")
    open_ = spark.createDataFrame([(1, p, 3 * similar.BLOCK, p) for p in range(30)], "key long, p long, n long, c long")
    pairs = similar._candidates(open_, points, 0.8, best=False)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the join is below: it comes first
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 == b % 3}


def test_crowd_apart_draws_up_no_pairs(spark, monkeypatch):
    """Sixty texts that nearly link with each other: no step writes more pairs than there are texts."""
    rng = random.Random(5)
    base = sentence(rng, 430).split(" ")
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(5, 425), 6):
            w[at] = f"new{rng.randrange(10**9)}"
        rows.append((k, " ".join(w), "en", "s0", 1))
    asked, verified = [], similar.verified

    def counted(pairs, *args):
        asked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(similar, "verified", counted)
    got = similar.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(asked) <= len(rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == plain_groups(rows)
