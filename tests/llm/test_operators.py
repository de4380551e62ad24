"""Operators against plain versions, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import CLASHES, SCHEMA, sentence
from pyspark.sql import functions as F

from hetweave.llm import chat, decontaminate, embeddings, html_text, mixing, pii, quality, queries, sharding, simhash, url_filter


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    """The fixture as a folder of tables, for the queries."""
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


def untouched(out, wide):
    """Own columns come out as they went in."""
    assert all(r[c] == "mine" for r in out.select(*CLASHES).distinct().collect() for c in CLASHES)


# 1 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(9)
    long_ = next(t for i, t, *_ in rows if i == 400).split(" ")
    base = next(t for i, t, *_ in rows if i == 100).split(" ")
    return [(1, " ".join(long_[500:530])), (2, sentence(rng, 30)), (3, "one"), (4, " ".join(base[3:15])), (5, " ".join(base[3:15])), (10, ". , -"), (11, None), (None, "one"), (12, "no id here")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, docs, wide, rows, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, name = decontaminate.find_contamination(wide, bench, block_bytes=block)
    untouched(found, wide)
    got = [(r.doc_id, c.n_words, c.n_hit, len(c.item_ids), hashlib.sha256(",".join(c.item_ids).encode()).hexdigest(), c.n_hit > 0) for r in found.select("doc_id", F.col(name).alias("c")).collect() for c in [r.c]]
    want = brute.contamination([r[:2] for r in rows], items)
    assert Counter(got) == Counter(want)
    longest = {r.doc_id: [(m.item_id, m.item_word, m.doc_word, m.n_words) for m in r.c.matches] for r in found.select("doc_id", F.col(name).alias("c")).collect()}
    assert ("1", 0, 500, 30) in longest[400] and ("4", 0, 3, 12) in longest[100]
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[-1])


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10])
def test_fewer_words_than_a_window(n):
    """A batch may hold fewer words than the window looked for."""
    block = decontaminate.Suffixes([("1", " ".join("abcdefghijkl"))], 10)
    raw = np.frombuffer(" ".join("abcdefghij"[:n]).encode(), np.uint8)
    counts, found = decontaminate._look_up(raw, np.array([0, len(raw)]), block, True)
    assert counts.tolist() == [n]
    assert found == ({0: ([(0, 10)], ["1"], [{"item_id": "1", "item_word": 0, "doc_word": 0, "n_words": 10}])} if n == 10 else {})


def test_contamination_empty(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    found, name = decontaminate.find_contamination(docs, bench)
    assert found.where(F.col(name)["n_hit"] > 0).isEmpty() and found.count() == docs.count()
    assert decontaminate.decontaminate(none, bench).count() == 0


# 2 -----------------------------------------------------------------------------------------


def test_masks_cover():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_fingerprint_is_xxh64(spark, rows):
    for _, text, *_ in rows:
        assert simhash.fingerprint((text or "").encode()) == brute.fingerprint(text)
    h = spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).first().h
    assert simhash.fingerprint("A b é".encode()) == h % (1 << 64)


def test_near_duplicates(spark, docs, rows, sf):
    prints = [brute.fingerprint(r[1]) for r in rows]
    roots = brute.components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[roots[k]].append(r[0])
    want = Counter((r[0], f"{prints[k]:016x}", min(least[roots[k]], default=None)) for k, r in enumerate(rows))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter({c for _, _, c in want})


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_of_large_buckets(spark, bucket):
    """Chains and balls of near fingerprints: any bucket size gives the components of all pairs."""
    rng = random.Random(bucket)
    points = {0, 1, 3, 7, 15, (1 << 63) | 15}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            points.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    points = sorted(points)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "simhash long")
    from hetweave.llm.common import connected_components

    found = {r.node % (1 << 64): r.component for r in connected_components(simhash.near_links(df, bucket=bucket)).collect()}
    roots = brute.components(len(points), lambda a, b: (points[a] ^ points[b]).bit_count() <= 2)
    groups = defaultdict(set)
    for p, r in zip(points, roots, strict=True):
        groups[r].add(found.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


# 3 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(3)
    junk = lambda: " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in sentence(rng, rng.randint(5, 60)).split(" "))
    rows = [(k, sentence(rng, rng.randint(20, 90)).capitalize() + "." if k % 3 else junk(), "en", "s", k) for k in range(400)]
    labels = [(k, int(k % 3 > 0)) for k in range(400)] + [(None, 1), (7, None), (9999, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(marked, wide, none):
    docs, labels = marked
    held = F.col("doc_id") % 4 == 0
    model = quality.train(docs, labels.where(~held))
    scored, name = quality.with_scores(docs, model)
    rows = scored.join(labels, "doc_id").where(held).select(F.col(name).alias("s"), "quality").collect()
    assert sum((r.s >= 0.3) == (r.quality == 1) for r in rows) / len(rows) >= 0.97
    again = quality.train(docs, labels.where(~held))
    assert np.allclose(again.weights, model.weights)
    out, name = quality.with_scores(wide, model)
    untouched(out, wide)
    values = [r[0] for r in out.select(name).collect()]
    assert len(values) == wide.count() and all(0 <= v <= 1 for v in values)
    assert len({r[0] for r in out.where("doc_id in (300, 301)").select(name).collect()}) == 1  # null and empty alike
    assert quality.keep_good(none, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_fit_takes_packed_rows():
    """Packed rows give the model of dense ones, and no more of them are dense at once than a step takes."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, quality.N_FEATURES)) * (rng.random((300, quality.N_FEATURES)) < 0.05)).astype(np.float32)
    y = (rng.random(300) < 0.5).astype(np.float32)
    rows = quality.PackedRows([np.concatenate((where := np.flatnonzero(r).astype("<i4"), r[where].view("<i4"))).tobytes() for r in x])
    asked = []

    class Watched:
        def __getitem__(self, rows_):
            asked.append(len(rows_))
            return rows[rows_]

    a, b = quality.fit(x, y, epochs=2), quality.fit(Watched(), y, epochs=2)
    assert max(asked) <= 128 and np.array_equal(a.score(x), b.score(x))


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    n = quality.N_FEATURES
    m = quality.FactorisationMachine(0.3, rng.normal(size=n) / 50, rng.normal(size=(n, 4)) / 50, np.zeros(n), np.ones(n))
    x = np.zeros((1, n))
    on = rng.choice(n, 12, replace=False)
    x[0, on] = rng.normal(size=12)
    z = 0.3 + x[0] @ m.weights + sum((m.factors[a] @ m.factors[b]) * x[0, a] * x[0, b] for p, a in enumerate(on) for b in on[p + 1 :])
    assert m.score(x)[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_without_labels(docs, none, marked):
    empty = marked[1].limit(0)
    assert quality.train(docs, empty).score(np.zeros((1, quality.N_FEATURES)))[0] == pytest.approx(0.5)
    one = quality.train(none, marked[1])
    assert 0 <= one.score(np.zeros((1, quality.N_FEATURES)))[0] <= 1


# 4 -----------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows, sf):
    import zlib

    got = queries.op4_sharding(spark, sf).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = queries.op4_sharding(spark, sf).collect()
    key = lambda r: (r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_shards_are_even(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.choice([5, 50, 500, 5000]), "en", "s", 1) for k in range(4000)]
    placed, plan = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA))
    loads = [r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    assert plan.version == 1 and all(plan.shards[s] == b for s, _, b in plan.edits)


def test_slot_map_versions():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(512)]
    m = sharding.SlotMap.start(8, 512).balance(sizes)
    grown = m.grow(sizes)
    assert grown.version == 2 and all(b == 8 for _, _, b in grown.edits)
    loads = grown.loads(sizes)
    assert min(loads) > 0.9 * sum(sizes) / 9 and max(loads) < 1.15 * sum(sizes) / 9
    again = grown.balance(sizes)
    assert max(again.loads(sizes)) - min(again.loads(sizes)) <= 0.01 * sum(sizes) / 9
    moved = sum(a != b for a, b in zip(m.shards, again.shards, strict=True))
    assert moved < 512 / 9 * 2
    assert sharding.SlotMap.start(3, 8).balance([0] * 8).shards == sharding.SlotMap.start(3, 8).shards


def test_shards_of_repeated_rows(spark, wide):
    """Rows that repeat each other in full are spread, so sizes stay near equal; own columns may clash."""
    rows = [(1, "same text", "en", "s", 1)] * 9000 + [(k, "x" * (k % 50), "en", "s", 1) for k in range(2000)]
    placed, _ = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA))
    loads = [r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()]
    assert placed.count() == len(rows) and max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    clash = wide.withColumns({c: F.lit("mine") for c in ("size", "shard", "copies", "copy", "virtual_slot", "n")})
    assert sharding.assign_shards(clash)[0].count() == wide.count()


def test_map_is_taken_up_again(spark, tmp_path):
    """Two loads and a new shard over one store: few records move, and all versions can be read."""
    rng = random.Random(12)
    store = str(tmp_path / "map")
    assert sharding.SlotMap.load(spark, store) is None
    rows = [(k, "x" * rng.choice([5, 50, 500]), "en", "s", 1) for k in range(3000)]
    first, m1 = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), n_slots=512, store=store)
    was = {r.doc_id: r.shard for r in first.collect()}
    more = rows + [(3000 + k, "y" * rng.choice([5, 50, 900]), "en", "s", 1) for k in range(600)]
    second, m2 = sharding.assign_shards(spark.createDataFrame(more, SCHEMA), n_slots=512, store=store)
    now = {r.doc_id: r.shard for r in second.collect()}
    loads = Counter()
    for r in second.collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8
    moved = sum(was[k] != now[k] for k in was)
    slots = {s for s, _, _ in m2.edits}
    assert m2.version == m1.version + 1 and 0 < moved < 0.1 * len(was) and len(slots) < 51
    again = sharding.SlotMap.load(spark, store)
    assert again == m2 and sharding.SlotMap.load(spark, store, m1.version) == m1
    _, m3 = sharding.assign_shards(spark.createDataFrame(more, SCHEMA), n_slots=512, store=store)
    assert m3 == m2  # nothing to move: no new version
    third, m4 = sharding.assign_shards(spark.createDataFrame(more, SCHEMA), 9, n_slots=512, store=store)
    grown = {r.doc_id: r.shard for r in third.collect()}
    assert m4.n_shards == 9 and sum(now[k] != grown[k] for k in now) < 0.25 * len(now)
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.createDataFrame(more, SCHEMA), 8, n_slots=512, store=store)


def test_sharding_empty(none):
    placed, plan = sharding.assign_shards(none)
    assert placed.count() == 0 and plan.edits == ()


# 5 -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now.</div><article><h1>A  title &eacute;&#233;</h1><p><b>First   line<br>goes on.<p>Second &lt;b&gt; one</p>
<p>Last <a href="x">link</a>\tends</p></article><aside><h3>More</h3><p>Other things</p></aside><div class="cookie-notice"><p>We use cookies</p></div>
<section class="comments"><h3>Comments</h3><div><p>Nice one</p></div></section><form><p>Sign up</p><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages())


def test_main_text(model):
    assert html_text.main_text(PAGE, model) == "A title éé\nFirst line goes on.\nSecond <b> one\nLast link ends"
    assert html_text.main_text("", model) == ""
    assert html_text.main_text("<nav><a href=x>a</a></nav>", model) == ""


def test_held_out_pages(model):
    hit = wrong = missed = 0
    for nodes in html_text.labelled_pages(200, seed=77):
        for v, p in zip(nodes, model.marginals(nodes), strict=True):
            if v.runs and v.tag not in html_text.NEVER:
                hit, wrong, missed = hit + (p >= 0.5 and v.label), wrong + (p >= 0.5 and not v.label), missed + (p < 0.5 and v.label)
    assert 2 * hit / (2 * hit + wrong + missed) > 0.95


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small tree."""
    from itertools import product
    from math import exp

    nodes = html_text.parse("<body><div class=ad><p>x</p></div><article><p>text of some length</p></article></body>")
    f = html_text._features(nodes)
    kinds = [html_text._kind(v) for v in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for ys in product((0, 1), repeat=len(nodes)):
        z = sum(model.emission.get((y, x), model.unseen) for y, xs in zip(ys, f, strict=True) for x in xs)
        z += sum(model.pair.get((kinds[v.parent], kinds[k], ys[v.parent], ys[k]), -0.7) for k, v in enumerate(nodes) if k)
        total += exp(z)
        for k, y in enumerate(ys):
            on[k] += y * exp(z)
    assert model.marginals(nodes) == pytest.approx([x / total for x in on])


def test_odd_pages(model):
    deep = html_text.main_text("<div>" * 30_000 + "deep", model)
    assert isinstance(deep, str)
    for page in ("<a \"" * 5000, "<" * 5000, "<p " * 5000, "<!--", "<script>", "</p></p></div>", "<p>&am", "<p>&amp", "<article><p>cut <b"):
        assert isinstance(html_text.main_text(page, model), str)
    assert html_text.main_text("<article><p>one<p>two &am</article>", model) == "one\ntwo &am"


def test_extract(spark, model):
    rows = [(1, "u", PAGE, "mine"), (2, None, None, "mine"), (2, None, None, "mine"), (None, "u", "", "mine")]
    out, name = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string"), model)
    got = Counter((r.page_id, len(r[name])) for r in out.collect())
    assert got == Counter({(1, len("A title éé\nFirst line goes on.\nSecond <b> one\nLast link ends")): 1, (2, 0): 2, (None, 0): 1})
    assert {r.main_text for r in out.collect()} == {"mine"}


# 6 -----------------------------------------------------------------------------------------


def cheapest(roles):
    """Dijkstra over (turns read, state)."""
    import heapq

    nexts, heap, seen = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}, [(0, 0, 0)], set()
    while heap:
        c, k, s = heapq.heappop(heap)
        if (k, s) in seen:
            continue
        seen.add((k, s))
        if k == len(roles) and s in (0, 3) and (s or not roles):
            return c
        if k < len(roles):
            r = roles[k]
            if s:
                heapq.heappush(heap, (c + (chat.MERGE if s == r else chat.MERGE + chat.RELABEL), k + 1, s))
            for b in nexts[s]:
                heapq.heappush(heap, (c + (chat.KEEP if b == r else chat.RELABEL), k + 1, b))
        for b in nexts[s]:
            heapq.heappush(heap, (c + chat.INSERT, k, b))
    return None


@pytest.mark.parametrize("chunk", [4096, 2])
def test_role_repair(spark, chunk):
    rng = random.Random(4)
    known = {"system": 1, "user": 2, "assistant": 3}
    data, want = [], {}
    for c in [None, *range(40)]:
        roles = [rng.choice(["system", "user", "assistant", " User", None, "tool"]) for _ in range(rng.randint(1, 8))]
        data += [(c, t, r, None if t == 3 else f"text {t}") for t, r in enumerate(roles)]
        want[c] = cheapest([known.get((r or "").strip().lower(), 0) for r in roles])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("mine"))
    out = chat.repair_roles(df, chunk=chunk).collect()
    price = {"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "relabel_merge": chat.MERGE + chat.RELABEL, "insert": chat.INSERT}
    cost = Counter()
    for r in out:
        cost[r.conv_id] += price[r.action]
    assert {c: cost[c] for c in want} == want
    assert Counter((r.conv_id, r.turn) for r in out if r.action != "insert") == Counter((c, t) for c, t, *_ in data)
    for r in chat.render(chat.repair_roles(df, chunk=chunk)).collect():
        names = [x.split("|>\n")[0] for x in r.rendered.split("<|end|>\n") if x]
        names = [n.removeprefix("<|") for n in names]
        rest = names[1:] if names[0] == "system" else names
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
    assert chat.repair_roles(df.limit(0)).count() == 0


def test_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None)], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.repair_roles(df)).first().rendered == "<|system|>\n<|end|>\n<|user|>\na\n\na<|end|>\n<|assistant|>\n<|end|>\n"


# 7 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filter(spark, limit):
    """Both ways of meeting the list, against a scan of it."""
    from datetime import date, timedelta

    rng = random.Random(6)
    keys = ["bad.com", "a.bad.com", "ok.org/x", "ok.org/x/y", "com", "1.2.3.4"]
    start = date(2024, 1, 1)
    history = [(rng.choice(keys), rng.choice(["add", "remove"]), start + timedelta(rng.randint(0, 60)), rng.choice(["p", "q"])) for _ in range(40)] + [(None, "add", start, "p"), ("com", "add", None, "p")]
    urls = ["http://bad.com/", "https://A.Bad.com:80/q?x", "http://notbad.com", "http://u@ok.org/x/y/z#f", "http://ok.org/xy", "ftp://ok.org/x", "http://1.2.3.4/", "nonsense", "", None, "http://"]
    captures = [(k, rng.choice(urls), rng.choice([None, *[start + timedelta(d) for d in range(70)]])) for k in range(300)] + [(0, urls[0], start)] * 2
    lists = spark.createDataFrame(history, "key string, action string, at date, category string")
    df = spark.createDataFrame(captures, "id long, url string, fetched_at date").withColumns({"active": F.lit("mine"), "list_0": F.lit("mine"), "u": F.lit("mine")})
    out, name = url_filter.filter_urls(df, lists, broadcast_bytes=limit)
    got = Counter((r.id, r.url, r.fetched_at, tuple((e.key, e.category, e.valid_from) for e in r[name])) for r in out.collect())

    def covers(key, url):
        import re

        m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::\d+)?(/[^?#]*)?", url or "")
        if not m or not m[1]:
            return False
        host, path = m[1].lower(), [p for p in (m[2] or "").lower().split("/") if p]
        if "/" in key:
            h, *steps = key.split("/")
            return host == h and path[: len(steps)] == steps
        return host == key or host.endswith("." + key)

    def active(url, when):
        out = []
        for key, cat in sorted({(h[0], h[3]) for h in history if h[0] and h[2]}):
            events = sorted({(h[2], h[1] == "remove") for h in history if h[0] == key and h[3] == cat and h[2]})
            past = [e for e in events if when and e[0] <= when]
            if past and not past[-1][1] and covers(key, url):
                out.append((key, cat, past[-1][0]))
        return tuple(out)

    assert got == Counter((k, u, w, active(u, w)) for k, u, w in captures)
    assert url_filter.drop_listed(df, lists.limit(0), broadcast_bytes=limit).count() == len(captures)


# 8 -----------------------------------------------------------------------------------------


def exact_links(rows, least=0.93):
    n = len(rows)
    good = []
    for _, e, label in rows:
        v = None if e is None or label is None or not len(e) or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e, np.float32).astype(float)
        good.append(v)

    def linked(a, b):
        u, v = good[a], good[b]
        return u is not None and v is not None and rows[a][2] == rows[b][2] and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= least

    roots = brute.components(n, linked)
    links = [sum(linked(a, b) for b in range(n) if b != a) for a in range(n)]
    least_id = [min((rows[b][0] for b in range(n) if roots[b] == roots[a] and rows[b][0] is not None), default=None) for a in range(n)]
    return Counter((r[0], links[k], least_id[k], r[0] == least_id[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 5])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(120):
        v = centres[k % 12] + rng.normal(scale=0.16, size=16)
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    rows += [(200 + k, rows[0][1], 0) for k in range(9)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [], 1), (305, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("mine") for c in ("e", "pid", "keys")})
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df, tile=tile, recall=1 - 1e-9, bits=4).collect())
    assert got == exact_links(rows)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x + rng.normal(scale=0.05, size=x.shape)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    _, signs, factors = embeddings.code(x)
    guess, bound = embeddings.estimate(embeddings.code(q)[0], signs, factors)
    off = guess - q @ x.T
    assert abs(off.mean()) < 0.005 and (np.abs(off) <= bound[None, :]).all()
    assert embeddings.tables_needed(0.93, 7, 0.999) > embeddings.tables_needed(0.99, 7, 0.999)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in the usual settings."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        w = rng.normal(size=64)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        rows += [(2 * k, u.tolist(), 0), (2 * k + 1, (0.94 * u + (1 - 0.94**2) ** 0.5 * w).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links > 0 for r in embeddings.near_duplicate_vectors(df).collect()) / 800
    assert found >= 0.98


# 9 -----------------------------------------------------------------------------------------


def test_pii(spark, rows):
    rng = random.Random(7)
    parts = ["a", "b", "@", ".", "-", "_", "%", "+", "1", "2", "25", "255", "256", "007", "(", ")", " ", "é", "\U0001f600", "x.y", "@b.c", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "\n"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(1500)]
    texts += [(5000, None), (5001, ""), (5002, "1" * 20_000), (5003, "a" * 50_000 + "@"), (5004, "1 " * 20_000), (5005, 'call me: token = "' + "ab12" * 10 + '" ok'), (5005, 'call me: token = "' + "ab12" * 10 + '" ok'), (None, "x@y.zz")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit("mine"))
    out = pii.find_pii(df).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()
    assert Counter((r.doc_id, r.base) for r in out) == Counter((k, ",".join(brute.pii(t))) for k, t in texts)
    for r in out:
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
    assert [r.spans for r in out if r.doc_id == 5005] == ["secret:18:58"] * 2
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_query(spark, sf, rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op9_pii(spark, sf).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        found = brute.pii(text)
        n = Counter(f.split(":")[0] for f in found)
        want[(doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(found).encode()).hexdigest())] += 1
    assert got == want


def test_label_model_tells_reliable_labelers():
    rng = random.Random(1)
    counts, truth = Counter(), Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if y else -1) * (1 if rng.random() < p else -1) if rng.random() < 0.9 else 0 for p in (0.95, 0.9, 0.85, 0.6, 0.5))
        counts[0, votes] += 1
        truth[0, votes] += y
    chance = pii.label_model(counts)
    weights = pii.train_classifier(counts, chance)
    right = 0
    for (k, votes), n in counts.items():
        z = weights[(k,)] + sum(weights[k, j, v] for j, v in enumerate(votes) if v)
        right += truth[k, votes] if z > 0 else n - truth[k, votes]
    assert right / 4000 > 0.93
    assert pii.label_model({}) == {} and pii.train_classifier({}, {}) == {}


# 10 ----------------------------------------------------------------------------------------


def test_mixture(spark, sf, rows):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    goal = brute.targets(sizes)
    got = queries.op10_mixing(spark, sf).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    plan = mixing.plan_mixture(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    taken = Counter()
    for r in plan:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"] and 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert all(taken[s] == int(goal[s]) for s in goal)
    assert Counter(map(tuple, got)) == Counter(map(tuple, queries.op10_mixing(spark, sf).collect()))


def test_mix(spark, docs, wide, none):
    plan = mixing.plan_mixture(docs).collect()
    out = mixing.mix(wide)
    assert out.columns == wide.columns
    untouched(out, wide)
    n = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    # whole rows for each pass that takes words of them; only repeated rows at the end may differ
    want = Counter()
    for r in plan:
        if r.taken:
            want[(r.doc_id, r.source, r["size"])] += 1 + (r.taken > r["size"])
    assert n == want
    assert mixing.mix(none).count() == 0 and mixing.plan_mixture(none).count() == 0


def test_mix_by_shuffle(spark, docs, monkeypatch):
    want = Counter(r.doc_id for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == want


def test_positions_follow_the_schedule(spark):
    """Under a rising weight half the words come after the middle of training; order follows offsets."""
    rows = [(k, "w " * 10, "en", f"s{k % 3}", 1) for k in range(900)]
    plan = mixing.plan_mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    share = {s: np.mean([r.position < 0.5 for r in plan if r.source == s and r.taken]) for s in ("s0", "s1", "s2")}
    assert share["s1"] < share["s0"] < share["s2"] or share["s1"] < share["s2"]


def integral(schedule, t):
    """The area under a schedule up to t, by a fine sum."""
    xs = np.linspace(0, t, 20_001)
    return np.trapezoid(np.interp(xs, *zip(*schedule, strict=True)), xs)


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, (((0.0, 0.0), (0.2, 2.0), (0.6, 0.0), (0.8, 0.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 3.0), (1.0, 3.0)))])
def test_positions_invert_the_integrals(spark, schedules):
    """Against numerical integration: at its position a row's first word is due, and rows come in that order."""
    rows = [(k, "w " * (1 + k % 7), "en", f"s{k % 4}", 1) for k in range(600)]
    out = mixing.plan_mixture(spark.createDataFrame(rows, SCHEMA), schedules=schedules)
    plan = out.collect()
    assert [r.position for r in plan] == sorted(r.position for r in plan)
    for k in range(4):
        own = [r for r in plan if r.source == f"s{k}"]
        schedule = schedules[k % len(schedules)]
        whole, due = integral(schedule, 1.0), 0
        for r in own:
            if r.passes:
                assert integral(schedule, r.position) / whole * r.target == pytest.approx(due, abs=1e-4 * r.target + 0.01)
            due += r["size"]
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all((r.passes == 0) == (r.taken == 0) and r.taken <= r.passes * r["size"] for r in own)


def test_mixing_query_goes_by_the_schedule(spark, sf):
    """The plan of the query holds the inverse of the integrals and a range exchange."""
    plan = queries.op10_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "SQRT" in plan.upper() and "rangepartitioning(" in plan


def test_wrong_schedules():
    for wrong in ([(0.0, 1.0)], [(0.0, 1.0), (0.5, 1.0)], [(0.0, 1.0), (0.0, 2.0), (1.0, 1.0)], [(0.0, -1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)]):
        with pytest.raises(ValueError):
            mixing._pieces(wrong)


def test_repeated_rows_in_the_mixture(spark):
    """A source that is one row many times over, and rows without ids: targets are met all the same."""
    rows = [(7, "a b c", "en", "s0", 1)] * 9000 + [(None, f"x{k % 5} y", "en", "s1", 1) for k in range(500)] + [(k, "p q", "en", None, 1) for k in range(50)]
    plan = mixing.plan_mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(plan) == len(rows)
    for s in ("s0", "s1", None):
        own = [r for r in plan if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r["size"] for r in own)


def test_pii_of_many_matches(spark):
    """One text of very many matches of several kinds: same spans as the plain version, in moderate time."""
    import time

    one = "é a@b.cc, 1.2.3.4 4111111111111111 +1 (017) 555-7713 password: abcd1234abcd1234abcd " * 4000
    df = spark.createDataFrame([(1, one), (2, "a@b.cc " * 64_000)], "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in pii.find_pii(df).select("doc_id", pii.written(F.col("base")).alias("base"), "spans").collect()}
    assert time.monotonic() - began < 90
    assert out[1].base == ",".join(brute.pii(one)) and out[2].base == ",".join(brute.pii("a@b.cc " * 64_000))
    secrets = [(s.start, s.end) for s in out[1].spans if s.k == pii.KINDS.index("secret")]
    assert len(secrets) == 4000 and all(one[a:b] == "abcd1234abcd1234abcd" for a, b in secrets)


def test_added_spans_stay_apart(spark):
    """From the left: proposals that meet no base span and no proposal kept before, against all pairs."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(200):
        spans = lambda n: [(rng.randrange(5), a, a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(n))]
        base, more = spans(rng.randint(0, 5)), spans(rng.randint(0, 8))
        kept = []
        for s in sorted(more, key=lambda s: (s[1], s[2], s[0])):
            if all(s[2] <= o[1] or o[2] <= s[1] for o in base + kept):
                kept.append(s)
        want[k] = kept
        rows.append((k, base, more))
    place = "array<struct<k:int,start:int,end:int>>"
    out = spark.createDataFrame(rows, f"id long, base {place}, more {place}").select("id", pii._apart(F.col("base"), F.col("more")).alias("kept")).collect()
    assert {r.id: [tuple(s) for s in r.kept] for r in out} == want


@pytest.mark.parametrize("dim", [1, 3, 16, 64, 100])
def test_stored_records_estimate(dim):
    """The packed form agrees with the plain one up to the four bits, and holds its bound at the threshold."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    q = x if dim == 1 else 0.93 * x + (1 - 0.93**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embeddings.records(q), embeddings.records(x)
    guess = embeddings.estimate_records(a, b, dim)
    off = np.diag(guess) - (q * x).sum(axis=1)
    assert (np.diag(guess) >= 0.93 - np.diag(embeddings.reach(a, b, dim, 0.93))).all()
    if dim >= 16:
        assert abs(off.mean()) < 0.01 and abs((guess - q @ x.T).mean()) < 0.01


def clustered(n, dim=32, seed=4):
    """Vectors of one label in crowds that are no links, with planted pairs and a tight group."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(6, dim)))
    base = unit(centres[rng.integers(0, 6, n) * (rng.random(n) < 0.66)] + 1.3 * unit(rng.normal(size=(n, dim))))
    near = unit(base[: n // 10] + 0.25 * unit(rng.normal(size=(n // 10, dim))))
    tight = unit(centres[0] + 0.15 * unit(rng.normal(size=(n // 20, dim))))
    return np.concatenate([base, near, tight]).astype(np.float32)


def test_clustered_vectors(spark, tmp_path):
    """The query, in its usual settings, on crowds and planted pairs: recall against brute force, and no false link."""
    x = clustered(3000)
    spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op8_embeddings(spark, str(tmp_path)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert links.sum() > 20_000 and all(got[k].n_links <= links[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.995 * links.sum()


@pytest.mark.parametrize("bits, tile", [(6, 300), (0, 500)])
def test_crowded_buckets(spark, bits, tile, monkeypatch):
    """Keys and blocks in use, joins by shuffle: the same components up to the recall asked for."""
    monkeypatch.setattr(embeddings, "BROADCAST_ROWS", 0)
    x = clustered(1200)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicate_vectors(df, bits=bits, tile=tile).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert sum(r.n_links for r in got) >= 0.99 * links.sum() and all(r.n_links <= links[r.vec_id] for r in got)


def test_bits_part_a_crowd(spark):
    """A label in one direction gets more bits than evenly spread ones; a tight one is not helped by bits."""
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(4000, 32))
    crowd = wide / np.linalg.norm(wide, axis=1, keepdims=True) * 1.2 + np.eye(32)[0]
    tight = wide * 0.01 + np.eye(32)[0]
    rows = [(v.tolist(), which) for which, m in enumerate((wide, crowd, tight)) for v in m]
    df = spark.createDataFrame(rows, "e array<double>, label int").withColumns({"dim": F.size("e"), "h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e")})
    k = {r.label: r.k for r in embeddings._bits(df, 0.93, 0.999, np.float64, 6000, 50).collect()}
    assert k[1] >= k[0] > 0 and k[2] <= k[0]


PROSE = "The council met on Tuesday, and after some hours it agreed. Nobody had expected that; the vote was close."
LAYOUTS = {
    "plain": "<body><div>{}</div></body>",
    "camel": "<body><div class='mainContent'>{}</div></body>",
    "state in an id": "<body><div id='comments-enabled' class='story'>{}</div></body>",
    "told": "<body><div class='story'>{}</div></body>",
    "legal": "<body><div>{}</div><div>Copyright 2024 Example Corp. All things.</div></body>",
    "readers": "<body><div>{}</div><div><h3>Readers say</h3><p>Nice one.</p><p>I agree with that.</p></div></body>",
    "layout table": "<body><table><tr><td><a href=a>Home</a> <a href=b>News</a> <a href=c>Sport</a></td><td>{}</td></tr></table></body>",
    "word in a value": "<body><article data-title='the hidden cost of'>{}</article></body>",
    "word in a class": "<body><div class='card hidden md-block'>{}</div></body>",
    "no body tag": "<head><title>x</title><meta name=a><article>{}</article>",
    "blog": "<html><head><title>b</title></head><body class='post-template'><header id='masthead'><a href='/'>My blog</a></header><div id='primary' class='content-area'><article id='post-7'>{}<footer class='entry-meta'>Posted in <a href='/c'>cats</a></footer></article><div id='comments'><ol><li>Great post!</li><li>Thanks.</li></ol></div></div><aside id='secondary'><h2>Recent posts</h2><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></aside></body></html>",
    "hashed names": "<html><body><div id='root'><div class='css-1a2b'><a href='/'>Home</a><a href='/w'>World</a><a href='/b'>Business</a></div><div class='css-9zz'><section class='css-77'>{}</section></div><div class='css-ft'>© 2023 The Paper. All rights reserved.</div></div></body></html>",
    "portal": "<body><ul class='topnav'><li><a href=/>Start</a><li><a href=/x>Shop</a></ul><div class='cookie-banner'><p>We use cookies to make things better.</p><button>OK</button></div><div class='col-8'><div class='inner'>{}</div><div class='sharing'><a href=#>Tweet</a> <a href=#>Mail</a></div></div><div class='col-4 sidebar'><h4>Weather</h4><p>Rain later.</p></div><form><p>Get our letter</p><input></form></body>",
}


def test_other_layouts(spark, model, tmp_path):
    """The query over pages that training never made: the whole article and nothing else, null and empty pages too."""
    blocks = ["A council decides", f"{PROSE} {PROSE}", f"{PROSE} A second part &amp; more.", "Short one.", f"In the end, {PROSE.lower()}"]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    want = "\n".join(blocks).replace("&amp;", "&")
    rows = [(k, name, page.format(body)) for k, (name, page) in enumerate(LAYOUTS.items())] + [(100, "null", None), (101, "empty", ""), (101, "empty", ""), (None, None, "<p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in queries.op5_html_text(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter((k, name, want if k is not None and k < 100 else "", len(want) if k is not None and k < 100 else 0) for k, name, _ in rows)


def test_extract_empty(spark, model):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string"), model)[0].count() == 0


def test_labels_come_from_marks():
    nodes = html_text.label(html_text.parse(f"<div class='ad'><p>{html_text.MARK}kept text</p></div><div class='story'><p>not kept</p></div>"))
    assert [(v.label, v.size) for v in nodes if v.runs] == [(1, 9), (0, 8)] and all(html_text.MARK not in t for v in nodes for _, t in v.runs)


def test_suffix_arrays_are_sorted():
    """Parts of a long row included: the array holds every suffix, in the order of its first words."""
    rng = np.random.default_rng(2)
    words = rng.integers(1, 6, 500).astype(np.uint64)
    before = np.array([0, 3, 3, 120, 499, 500])
    row = np.repeat(np.arange(5), np.diff(before))
    left = before[row + 1] - np.arange(500)
    for depth in (1, 3, 10):
        array = decontaminate.suffix_array(words, left, 400, depth)
        keys = [tuple(words[p : p + min(depth, left[p])]) for p in array.tolist()]
        assert sorted(array.tolist()) == list(range(400)) and keys == sorted(keys)


def test_contamination_query(spark, docs, rows, items, tmp_path):
    """The query against the plain version."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op1_decontaminate(spark, str(tmp_path)).collect())
    assert got == Counter(brute.contamination([r[:2] for r in rows], items))


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_matches_against_all_diagonals(size, monkeypatch):
    """Longest matches of random texts over few words against a plain search, with rows longer than a shard too."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", size)
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for trial in range(30):
        items = [(str(k), text(rng.randint(0, 14))) for k in range(6)]
        docs = [text(rng.randint(0, 60)) for _ in range(5)]
        raw = [d.encode() for d in docs]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        window = rng.choice([2, 4, 5])
        _, found = decontaminate._look_up(np.frombuffer(b"".join(raw), np.uint8), offsets, decontaminate.Suffixes(items, window), True)
        for r, doc in enumerate(docs):
            w, want = doc.split(), set()
            for i, t in items:
                v = t.split()
                for p in range(len(w)):
                    for k in range(len(v)):
                        n = 0
                        while p + n < len(w) and k + n < len(v) and w[p + n] == v[k + n]:
                            n += 1
                        starts = p == 0 or k == 0 or w[p - 1] != v[k - 1]
                        if starts and n >= min(window, len(v)):
                            want.add((i, k, p, n))
            got = [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in found.get(r, ([], [], []))[2]]
            assert sorted(got) == sorted(want) and len(got) == len(set(got)), trial


def test_blocks_in_turns(spark, docs, items, rows):
    """More blocks than are held at a time: written in between, same results."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, name = decontaminate.find_contamination(docs, bench, block_bytes=60, live=2)
    got = Counter((r.doc_id, r.n) for r in found.select("doc_id", F.col(name)["n_hit"].alias("n")).collect())
    assert got == Counter((w[0], w[2]) for w in brute.contamination([r[:2] for r in rows], items))


def test_one_id_with_two_texts(spark):
    """Each text stands for its own component; of full repeats one row stays; clashing names pass through."""
    rows = [(1, "a b c d e f"), (1, "something else entirely here now"), (2, "a b c d e f"), (3, "third text of its own kind"), (3, "third text of its own kind"), (None, "no id but words too"), (None, "no id but words too"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("simhash", "row_hash", "kept_id", "kept_hash")})
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and {r.kept_id for r in out.collect()} == {"mine"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({(1, rows[0][1]): 1, (1, rows[1][1]): 1, (3, rows[3][1]): 1, (None, rows[5][1]): 1, (4, None): 1})
