"""Filter audit, Merkle manifest and MinHash fingerprints against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from brute import crc
from conftest import CLASHES, SCHEMA
from pyspark.sql import functions as F

from hetweave.llm import filter_audit, fingerprints, merkle, queries


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 3 % 2, int(k % 7 == 0)) for k in range(0, 320, 2)] + [(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 ----------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """{(part, order, step): figures}, by running every order over every row."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    cases = defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and t in first and i > first[t],
        }
        cases[source or ""].append(({f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, share = {}, Counter()
    for part, of in cases.items():
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [c for c in of if f in c[0] and not c[0] & before]
                kept = sum(not c[0] & (before | {f}) for c in of)
                late = sum(f in c[0] and bool(c[0] & before) for c in of)
                out[part, order, k + 1] = [kept, len(gone), late, sum(c[0] == {f} for c in of), sum(c[1] for c in gone), sum(c[2] for c in gone)]
                share[part, f] += len(gone)
    return {key: (*v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.fixture(scope="module")
def odd_rows(rows):
    extra = [(500 + k, "Word " * 60 + "#" * (k % 2), "en", None, 1) for k in range(4)] + [(510, "AA BB CC", "en", "s1", 1), (511, "  lead\u000bing &\x1c space\n", "en", "s1", 1)]
    return rows + extra + extra[:1] * 3 + [(None, "Word " * 60, "en", None, 1), (500, "other text", "en", "s2", 1)]


def test_audit(spark, odd_rows):
    labels = [(k, k % 3 % 2, int(k % 7 == 0)) for k in range(0, 520, 2)] + [(4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3).withColumns({c: F.lit("mine") for c in (*CLASHES, "mask", "digest", "word", "n")})
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == plain_audit(odd_rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in odd_rows})


def test_audit_query(spark, sf, rows):
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = queries.op11_filter_audit(spark, sf).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == plain_audit(rows, labels)


def test_audit_empty(spark, none):
    assert filter_audit.filter_audit(none).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).where("filter_order = 'ABCDE'").collect()
    assert {r.step: (r.part, r.kept, r.removed, r.shapley) for r in one} == {1: ("", 0, 1, 120)} | {k: ("", 0, 0, 0) for k in range(2, 6)}


# 12 ----------------------------------------------------------------------------------------


def plain_manifest(leaves, fanout=3):
    """[(subroot, root, proof as a list of sibling lists)] of (group, order, leaf) leaves, in their order."""

    def tree(level):
        """Levels of nodes, from the leaves to the top."""
        levels = [level]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([sha("".join(at[k : k + fanout])) for k in range(0, len(at), fanout)])
        return levels

    def siblings(levels, k):
        out = []
        for level in levels[:-1]:
            run = k - k % fanout
            out.append((level[run:k], level[k + 1 : run + fanout]))
            k //= fanout
        return out

    groups = defaultdict(list)
    for n, (group, order, leaf) in enumerate(leaves):
        groups[group].append(((order is not None, order, leaf), n))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaves[n][2] for _, n in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = {}
    for g in names:
        for k, (_, n) in enumerate(sorted(groups[g])):
            out[n] = (trees[g][-1][0], top[-1][0], siblings(trees[g], k) + siblings(top, names.index(g)))
    return [out[n] for n in range(len(leaves))]


def joined(proof):
    return [("".join(a), "".join(b)) for a, b in proof]


@pytest.mark.parametrize("fanout,levels", [(3, 6), (3, 1), (2, 2), (5, 3)])
def test_manifest(spark, fanout, levels):
    rng = np.random.default_rng(fanout)
    sources = [None, "", "a", "é", "z", "~"]
    leaves = [(sources[k % 6] if k % 2 else "hot", int(rng.integers(0, 90)) if k % 11 else None, sha(str(k % 97))) for k in range(260)]
    leaves += [("alone", 1, sha("x"))] + [("same", 1, sha("y"))] * 7
    df = spark.createDataFrame(leaves, "source string, doc_id long, leaf string").withColumns({c: F.lit("mine") for c in ("root", "proof", "copies", "idx", "merkle", "c0")}).repartition(4)
    found, name = merkle.manifest(df, fanout=fanout, levels=levels)
    assert {tuple(r[c] for c in ("root", "proof", "copies", "idx", "merkle", "c0")) for r in found.collect()} == {("mine",) * 6}
    m = F.col(name)
    got = found.select("source", "doc_id", "leaf", m["subroot"], m["root"], m["proof"], merkle.proof_hash(m["proof"]), merkle.fold(F.col("leaf"), m["proof"])).collect()
    want = Counter((*x, s, r, str(joined(p))) for x, (s, r, p) in zip(leaves, plain_manifest(leaves, fanout), strict=True))
    assert Counter((*r[:5], str([(s.before.hex(), s.after.hex()) for s in r[5]])) for r in got) == want
    assert all(r[7] == r[4] for r in got)
    assert all(r[6] == sha("".join(s.before.hex() + s.after.hex() for s in r[5])) for r in got)


def test_merkle_query(spark, sf, rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, lang, source, n):
        return sha("".join(map(field, (i, source, lang, n, t))))

    leaves = [(r[3], r[0], leaf(*r)) for r in rows]
    want = Counter()
    for r, (_, i, at), (subroot, root, proof) in zip(rows, leaves, plain_manifest(leaves), strict=True):
        text = r[1].replace("\n", "") if r[1] is not None and i is not None and crc(i) % 2 == 0 else r[1]
        folded = leaf(i, text, *r[2:])
        for a, b in joined(proof):
            folded = sha(a + folded + b)
        want[i, at, subroot, root, sha("".join(a + b for a, b in joined(proof))), folded, folded == root] += 1
    assert Counter(tuple(r) for r in queries.op12_merkle(spark, sf).collect()) == want
    assert {k[-1] for k in want} == {True, False}


def test_manifest_empty(spark):
    found, _ = merkle.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string"))
    assert found.count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string"), fanout=1)


# 13 ----------------------------------------------------------------------------------------


def plain_print(text):
    raw = (text or "").encode()
    return fingerprints.registers_of(fingerprints.minhash(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fingerprints.permutations()))[0]


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def check_prints(rows, got):
    texts = defaultdict(list)  # blank texts share a fingerprint
    for t in {r[1] or "" for r in rows}:
        texts[plain_print(t).tobytes().hex()].append(t)
    order = sorted(((i is None, i, t or "") for i, t, *_ in rows), key=lambda x: x[:1] + ((x[1],) if x[1] is not None else ()))
    follow = defaultdict(set)  # ties of an id may come in any order, so its rows may end in several ways
    ids = [x[:2] for x in order]
    for k, (_, i, t) in enumerate(order):
        same = [n for n in range(len(order)) if ids[n] == ids[k]]
        after = order[(same[-1] + 1) % len(order)]
        nexts = [order[n] for n in same if n != k] + [o for o in order if o[:2] == after[:2]]
        follow[i, t] |= {x[2] for x in nexts}
    assert len(got) == len(rows)
    for r in got:
        [t] = [t for t in texts[r.fingerprint] if r.n_chars == len(t) and (r.doc_id, t) in follow]
        fits = [x for x in follow[r.doc_id, t] if sha(t[: len(t) - len(t) // 4] + x[: len(t) // 4]) == r.edited_sha256]
        assert fits, (r.doc_id, t[:40])
        a, b = plain_print(t), plain_print(t[: len(t) - len(t) // 4] + fits[0][: len(t) // 4])
        assert r.edited_fingerprint == b.tobytes().hex() and r.near_edited == pytest.approx((a == b).mean())
        assert any(r.near_next == pytest.approx((a == plain_print(x)).mean()) for x in fits)


def test_fingerprint_query(spark, sf, rows):
    check_prints(rows, queries.op13_fingerprints(spark, sf).collect())


def test_edits_in_small_blocks(spark, rows, docs, monkeypatch):
    """A block of one row, ids in many copies, and rows without an id, in any number of buckets."""
    monkeypatch.setattr(fingerprints, "_BLOCK", 7)
    some = [r for r in rows if len(r[1] or "") < 5000][:40]
    many = some + [(7, f"the same id {k} times and more words to make shingles of", "en", "s0", 1) for k in range(60)] + [(None, f"no id, number {k}", "en", None, 1) for k in range(40)]
    check_prints(many, fingerprints.edited_likeness(spark.createDataFrame(many, SCHEMA).repartition(3)).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = fingerprints.edited_likeness(spark.createDataFrame(many, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    check_prints(many, got)


def test_registers_estimate_jaccard(spark):
    rng = np.random.default_rng(3)
    errors = []
    for n in (30, 200, 3000):
        for cut in (0.02, 0.1, 0.4):
            w = [str(x) for x in rng.integers(0, 10**6, n)]
            v = w[: int(n * (1 - cut))] + [str(x) for x in rng.integers(0, 10**6, int(n * cut))]
            a, b = shingles(" ".join(w)), shingles(" ".join(v))
            errors.append((plain_print(" ".join(w)) == plain_print(" ".join(v))).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.15


def test_fingerprints_of_odd_tables(spark, docs, wide, none):
    found, name = fingerprints.with_fingerprints(wide)
    assert all(r[c] == "mine" for r in found.select(*CLASHES).distinct().collect() for c in CLASHES)
    by_text = defaultdict(set)
    for r in found.select("text", name).collect():
        by_text[" ".join((r.text or "").split())].add(bytes(r[1]))
    assert all(len(p) == 1 for p in by_text.values())
    assert fingerprints.edited_likeness(none).count() == 0 and fingerprints.with_fingerprints(none)[0].count() == 0
    [one] = fingerprints.edited_likeness(spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1)], SCHEMA)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == sha("a b c d e f a b")
