"""Guarded complete-link cover: which nodes of a candidate class merge.

The cover is greedy and in order of ids: the least free node seeds a cluster, and each later node
joins if it passes both guards with all members so far. Nodes of a class with equal terms and
equal features that pass each other always end together, so they are one point.

Classes whose points and terms are up to HELD are dealt into groups and covered where they lie,
from the points themselves: each member that joins is held against the candidates that are left,
and no pair is ever a row. For larger classes, and odd features, pairs of points that pass both
guards come from joins. Of those, classes of up to SMALL passing pairs, by count, are dealt into
groups of about that many pairs, and each group is covered where it lies; a larger one is covered
in rounds of joins, all its seeds that can't disturb each other at once (see cover_in_rounds).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hetweave.lineage import cut
from hetweave.operators.channels import TERM_MEASURES, cosine, exact_groups, norm, scored_pairs, term_scores

#: How far below its threshold a score may lie.
TERM_SLACK, ATTR_SLACK, STRICT = 1e-8, 1e-10, 1e-12
#: Passing pairs that one task covers, and the usual number of them in a group.
SMALL, USUAL = 500_000, 20_000
#: Points and their terms, together, of a class that one task covers without its pairs.
HELD = 100_000


def term_passes(score: Column, tau: float) -> Column:
    return score.isNull() | (score >= tau - TERM_SLACK)


def attr_passes(score: Column, tau: float, slack: float = ATTR_SLACK) -> Column:
    return score.isNull() | (score >= tau - slack)


def passing_pairs(members: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float, measure: str = "cosine") -> DataFrame:
    """(ntype, class_id, i, j), i < j, of pairs that pass both guards.

    With a term threshold above 0 only pairs that share a term can pass (and, under jaccard and
    overlap, pairs of empty sets), so the join is on class and term, not on the class alone.
    """
    if terms is not None and tau_term > TERM_SLACK and measure == "cosine":
        pairs = term_scores(members, terms, measure).where(term_passes(F.col("score"), tau_term)).drop("score")
        if features is None:
            return pairs
        f = features.select("nid", "feat")
        pairs = pairs.join(f.toDF("i", "fi"), "i", "left").join(f.toDF("j", "fj"), "j", "left")
        return pairs.where(attr_passes(cosine(F.col("fi"), F.col("fj")), tau_attr)).drop("fi", "fj")
    scored = scored_pairs(members, terms, features, measure)
    return scored.where(term_passes(F.col("term_score"), tau_term) & attr_passes(F.col("attr_score"), tau_attr)).select("ntype", "class_id", "i", "j")


def strict(tau_term: float, measure: str = "cosine") -> bool:
    """Whether the term guard asks for equal term sets."""
    return measure == "cosine" and tau_term >= 1 - STRICT


def count_passing(part: DataFrame, terms: DataFrame | None, features: DataFrame | None, cells: list[tuple[float, float]], measure: str = "cosine") -> list[int]:
    """How many pairs pass both guards at each (tau_term, tau_attr), in one pass over the pairs."""
    members = part.select("ntype", "class_id", "nid")
    if terms is not None and measure == "cosine" and min(t for t, _ in cells) > TERM_SLACK:
        pairs = term_scores(members, terms, measure).withColumnRenamed("score", "term_score")
        attr = F.lit(None).cast("double")
        if features is not None:
            f = features.select("nid", "feat")
            pairs = pairs.join(f.toDF("i", "fi"), "i", "left").join(f.toDF("j", "fj"), "j", "left")
            attr = cosine(F.col("fi"), F.col("fj"))
        pairs = pairs.select("term_score", attr.alias("attr_score"))
    else:
        pairs = scored_pairs(members, terms, features, measure)
    return list(pairs.agg(*[F.count_if(term_passes(F.col("term_score"), t) & attr_passes(F.col("attr_score"), a)) for t, a in cells]).first())


def greedy(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Seed of each node, over passing pairs of one component."""
    near: dict[int, set[int]] = {}
    for i, j in pairs:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    seed: dict[int, int] = {}
    for s in sorted(near):
        if s in seed:
            continue
        seed[s] = s
        free = sorted(x for x in near[s] if x not in seed)
        passing = set(free)  # with all members so far
        for x in free:
            if x in passing:
                seed[x] = s
                passing &= near[x]
    return seed


def equal_points(members: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float, measure: str = "cosine") -> DataFrame:
    """(ntype, class_id, nid, point): nodes of a class with equal terms and features are one point, its least node.

    Only nodes that pass the guards with their equals are merged: under cosine, nodes without
    terms, and zero vectors, pass nothing at a threshold above 0. Sets of terms are compared by
    size and two hashes of 64 bits that don't depend on order.
    """
    rows, key, alike = members, [], F.lit(True)
    if terms is not None:
        mark = terms.groupBy("nid").agg(F.count("*").alias("t0"), F.bit_xor(F.xxhash64("term")).alias("t1"), F.bit_xor(F.xxhash64(F.lit("term"), "term")).alias("t2"))
        rows, key = rows.join(mark, "nid", "left"), [*key, "t0", "t1", "t2"]
        alike &= F.lit(tau_term <= 1) & (F.col("t0").isNotNull() | F.lit(measure != "cosine" or tau_term <= TERM_SLACK))
    if features is not None:
        rows, key = rows.join(features.select("nid", "feat"), "nid", "left"), [*key, "feat"]
        alike &= F.lit(tau_attr <= 1) & (F.coalesce(norm(F.col("feat")) > 0, F.lit(False)) | F.lit(tau_attr <= ATTR_SLACK))
    rows = rows.withColumn("apart", F.when(alike, F.lit(None)).otherwise(F.col("nid")))
    key = ["ntype", "class_id", *key, "apart"]
    least = rows.groupBy(*key).agg(F.min("nid").alias("point"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key]
    on = same[0]
    for x in same[1:]:
        on &= x
    return rows.alias("r").join(least.alias("l"), on).select("r.ntype", "r.class_id", "r.nid", "l.point")


def _below(rows: DataFrame, flag: Column) -> DataFrame:
    """rows (seed, x, part) with below: how many flagged rows of the seed are less than x.

    part is the range that x lies in, so what a task sorts is bounded and only counts go on.
    """
    rows = rows.withColumn("flag", flag.cast("long"))
    sums = rows.groupBy("seed", "part").agg(F.sum("flag").alias("flags"))
    earlier = F.sum("flags").over(Window.partitionBy("seed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("flag").over(Window.partitionBy("seed", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("inside", inside).join(sums.withColumn("earlier", earlier).drop("flags"), ["seed", "part"])
    return joined.withColumn("below", F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))).drop("flag", "inside", "earlier")


def _grow(candidates: DataFrame, within: DataFrame) -> DataFrame:
    """(seed, x) of the candidates that join their seed's cluster.

    within has the pairs (seed, x, y), y < x, of a seed's candidates that pass. In each round a
    candidate that passes with all lesser ones still there is in, whatever becomes of those, and
    one that fails with a lesser one that is in is out. The least one open is always settled.
    """
    rows = cut(candidates.repartitionByRange("seed", "x").withColumn("part", F.spark_partition_id())).withColumn("joined", F.lit(False))
    while True:
        here = rows.select("seed", F.col("x").alias("y"), F.col("joined").alias("y_in"))
        near = within.join(rows.select("seed", "x"), ["seed", "x"]).join(here, ["seed", "y"]).groupBy("seed", "x").agg(F.count("*").alias("near"))
        ranked = _below(rows, F.lit(1)).join(near, ["seed", "x"], "left")
        rows = cut(ranked.select("seed", "x", "part", (F.col("joined") | (F.coalesce("near", F.lit(0)) == F.col("below"))).alias("joined")))
        inside = rows.where("joined").select("seed", F.col("x").alias("y"))
        near = within.join(inside, ["seed", "y"]).groupBy("seed", "x").agg(F.count("*").alias("near"))
        ranked = _below(rows, F.col("joined")).join(near, ["seed", "x"], "left")
        rows = cut(ranked.where(F.col("joined") | (F.coalesce("near", F.lit(0)) == F.col("below"))).select("seed", "x", "part", "joined"))
        if rows.where("not joined").isEmpty():
            return rows.select("seed", "x")


def cover_in_rounds(pairs: DataFrame) -> DataFrame:
    """(nid, cluster_id) over passing pairs (i, j) of any number, as greedy() gives it; nodes left alone have no row.

    A free node less than all free ones at one or two steps is the next seed there: no lesser seed
    can take its neighbours. All such seeds grow at once. Every step is a join or a grouping over
    pairs and is written.
    """
    edges = cut(pairs.select(F.col("i").alias("u"), F.col("j").alias("v")).unionAll(pairs.select(F.col("j").alias("u"), F.col("i").alias("v"))).distinct())
    done = []
    while not edges.isEmpty():
        near = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        around = edges.join(near.toDF("v", "least"), "v").groupBy("u").agg(F.min("least").alias("around"))
        seeds = around.where(F.col("around") >= F.col("u")).select("u")  # u is one step from its neighbours
        candidates = cut(edges.join(seeds, "u", "left_semi").toDF("seed", "x"))
        ends = candidates.toDF("seed", "u").join(edges.where("v < u"), "u").join(candidates.toDF("seed", "v"), ["seed", "v"])
        within = cut(ends.select("seed", F.col("u").alias("x"), F.col("v").alias("y")))
        joined = _grow(candidates, within)
        new = cut(joined.unionAll(candidates.select("seed", F.col("seed").alias("x")).distinct()))
        done.append(new)
        gone = new.select("x")
        edges = cut(edges.join(gone.toDF("u"), "u", "left_anti").join(gone.toDF("v"), "v", "left_anti").select("u", "v"))
    spark = pairs.sparkSession
    out = spark.createDataFrame([], "seed long, x long")
    for new in done:
        out = out.unionAll(new)
    return out.select(F.col("x").alias("nid"), F.col("seed").alias("cluster_id"))


def cover_pairs(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(nid, cluster_id) over the passing pairs (ntype, class_id, i, j) of all classes.

    Pairs of different classes have nothing to do with each other, so a group of classes is
    covered like one.
    """
    pairs = cut(pairs)
    key = ["ntype", "class_id"]
    sizes = pairs.groupBy(*key).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    total, most = total or 0, most or 0
    few = pairs if most <= small else pairs.join(sizes.where(F.col("n") <= small), key, "left_semi")

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        seeds = greedy(zip(group.i.tolist(), group.j.tolist(), strict=True))
        return pd.DataFrame({"nid": list(seeds), "cluster_id": list(seeds.values())})

    groups = F.pmod(F.xxhash64(*key), F.lit(max(1, total // USUAL)))
    out = few.select(groups.alias("deal"), "i", "j").groupBy("deal").applyInPandas(cover, "nid long, cluster_id long")
    if most <= small:
        return out
    return out.unionByName(cover_in_rounds(pairs.join(sizes.where(F.col("n") > small), key, "left_semi").select("i", "j")))


def greedy_points(n: int, passes: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Seed of each of n points in order, where passes(x, others) says which others pass with x.

    As greedy() over all passing pairs, but memory grows with the points only.
    """
    seed = np.full(n, -1)
    for s in range(n):
        if seed[s] >= 0:
            continue
        seed[s] = s
        left = s + 1 + np.flatnonzero(seed[s + 1 :] < 0)
        left = left[passes(s, left)]
        while len(left):
            x, left = left[0], left[1:]
            seed[x] = s
            left = left[passes(x, left)]
    return seed


def _term_guard(words: pd.Series, tau: float, measure: str) -> Callable[[int, np.ndarray], np.ndarray]:
    """The term guard over points' lists of terms; the scores are those of channels.scored_pairs."""
    lists = [[] if w is None else list(w) for w in words]
    size = np.array([len(w) for w in lists], np.int64)
    codes = pd.factorize(pd.Series([t for w in lists for t in w], dtype=object))[0]
    own = np.split(codes, np.cumsum(size)[:-1])
    order = np.argsort(codes, kind="stable")
    where = np.repeat(np.arange(len(lists)), size)[order]
    holders = np.split(where, np.flatnonzero(np.diff(codes[order])) + 1)

    def passes(x: int, others: np.ndarray) -> np.ndarray:
        common = np.zeros(len(lists), np.int64)
        for t in own[x]:
            common[holders[t]] += 1
        c, ni, nj = common[others], size[x], size[others]
        below = {"cosine": np.sqrt(ni * nj), "jaccard": ni + nj - c, "overlap": np.minimum(ni, nj)}[measure]
        none = (ni + nj == 0) & (measure != "cosine")
        score = np.where(none, 1.0, np.minimum(c / np.where(below > 0, below, 1), 1.0))
        return score >= tau - TERM_SLACK

    return passes


def _attr_guard(feats: pd.Series, tau: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """The attribute guard over points' vectors of one length, or None; sums run in the order of channels.dot."""
    width = max((len(f) for f in feats if f is not None), default=0)
    x = np.ascontiguousarray(np.stack([np.zeros(width) if f is None else np.asarray(f, float) for f in feats]).T)

    def dots(k: int | slice, others: np.ndarray | slice) -> np.ndarray:
        out = np.zeros(x.shape[1])[others]
        for row in x:
            out = out + row[k] * row[others]
        return out

    norms = np.sqrt(dots(slice(None), slice(None)))

    def passes(k: int, others: np.ndarray) -> np.ndarray:
        length = norms[k] * norms[others]
        cos = np.where(length > 0, np.clip(dots(k, others) / np.where(length > 0, length, 1.0), -1.0, 1.0), 0.0)
        return cos >= tau - ATTR_SLACK

    return passes


def cover_points(points: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float, measure: str, deals: int) -> DataFrame:
    """(nid, cluster_id) of the points (ntype, class_id, nid), each class covered in one task."""
    if measure not in TERM_MEASURES:
        raise ValueError(f"unknown term measure {measure!r}: {TERM_MEASURES}")
    key, empty = ["ntype", "class_id"], "array<{}>".format
    rows = points.select(F.pmod(F.xxhash64(*key), F.lit(deals)).alias("deal"), *key, "nid")
    if terms is not None:
        words = terms.join(points.select("nid"), "nid", "left_semi").groupBy("nid").agg(F.collect_list(F.col("term").cast("string")).alias("words"))
        rows = rows.join(words, "nid", "left")
    else:
        rows = rows.withColumn("words", F.lit(None).cast(empty("string")))
    if features is not None:
        rows = rows.join(features.select("nid", F.col("feat").cast(empty("double")).alias("feat")), "nid", "left")
    else:
        rows = rows.withColumn("feat", F.lit(None).cast(empty("double")))
    by_term, by_attr = terms is not None, features is not None

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in group.groupby(key, sort=False):
            one = one.sort_values("nid")
            guards = [_term_guard(one.words, tau_term, measure)] if by_term else []
            guards += [_attr_guard(one.feat, tau_attr)] if by_attr else []

            def passes(x: int, others: np.ndarray) -> np.ndarray:
                ok = guards[0](x, others)
                for guard in guards[1:]:
                    ok[ok] = guard(x, others[ok])
                return ok

            nid = one.nid.to_numpy()
            out.append(pd.DataFrame({"nid": nid, "cluster_id": nid[greedy_points(len(nid), passes)]}))
        return pd.concat(out)

    return rows.groupBy("deal").applyInPandas(cover, "nid long, cluster_id long")


def class_loads(points: DataFrame, terms: DataFrame | None, features: DataFrame | None) -> DataFrame:
    """(ntype, class_id, load, odd): points and their terms of each class; odd if its vectors differ in length or hold null, NaN or infinity."""
    rows = points.select("ntype", "class_id", "nid")
    load, odd = F.lit(1), F.lit(False)
    if terms is not None:
        rows = rows.join(terms.groupBy("nid").agg(F.count("*").alias("n")), "nid", "left")
        load = 1 + F.coalesce("n", F.lit(0))
    if features is not None:
        strange = F.exists("feat", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        rows = rows.join(features.select("nid", F.size("feat").alias("width"), strange.alias("strange"), F.isnotnull("feat").alias("known")), "nid", "left")
        width = F.when(F.col("known"), F.col("width"))
        odd = F.coalesce(F.max("strange"), F.lit(False)) | F.coalesce(F.max(width) > F.min(width), F.lit(False))
    return rows.groupBy("ntype", "class_id").agg(F.sum(load).alias("load"), odd.alias("odd"))


def cover_of_points(own: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float, measure: str, small: int) -> DataFrame:
    """(nid, cluster_id) of the points (ntype, class_id, nid): from the points, or from their passing pairs where a class is large or odd."""
    key = ["ntype", "class_id"]
    loads = cut(class_loads(own, terms, features).withColumn("held", (F.col("load") <= min(HELD, small)) & ~F.col("odd")))
    total = loads.where("held").agg(F.sum("load")).first()[0]
    rest = loads.where("not held").select(*key)
    every = rest.isEmpty()
    held = own if every else own.join(rest, key, "left_anti")
    out = cover_points(held, terms, features, tau_term, tau_attr, measure, max(1, (total or 0) // USUAL))
    if every:
        return out
    pairs = passing_pairs(own.join(rest, key, "left_semi"), terms, features, tau_term, tau_attr, measure)
    return out.unionByName(cover_pairs(pairs, small))


def guarded_cover(part: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float, measure: str = "cosine", *, small: int = SMALL) -> DataFrame:
    """(ntype, nid, cluster_id) of every node of a partition (ntype, nid, class_id).

    cluster_id is the cluster's seed, its least node. A channel that is None passes. At a term
    threshold of 1 under cosine, classes are first split by equal term sets and the term guard
    is done with. Where both channels are off, classes are clusters.
    """
    members = part.select("ntype", "class_id", "nid")
    if terms is not None and strict(tau_term, measure):
        members = exact_groups(members, terms).select("ntype", F.col("group_id").alias("class_id"), "nid")
        terms = None
    if terms is None and features is None:
        return members.join(members.groupBy("ntype", "class_id").agg(F.min("nid").alias("cluster_id")), ["ntype", "class_id"]).select("ntype", "nid", "cluster_id")
    shared = members.groupBy("ntype", "class_id").agg(F.count("*").alias("n")).where("n > 1").select("ntype", "class_id")
    points = cut(equal_points(members.join(shared, ["ntype", "class_id"], "left_semi"), terms, features, tau_term, tau_attr, measure))
    seeds = cover_of_points(points.where("nid = point").select("ntype", "class_id", "nid"), terms, features, tau_term, tau_attr, measure, small)
    ends = points.join(seeds.toDF("point", "seed"), "point", "left").select("nid", F.coalesce("seed", "point").alias("seed"))
    return members.join(ends, "nid", "left").select("ntype", "nid", F.coalesce("seed", "nid").alias("cluster_id"))


def identity(nodes: DataFrame) -> DataFrame:
    """Every node its own cluster: the exact mode, and what semantic types get."""
    return nodes.select("ntype", "nid", F.col("nid").alias("cluster_id"))


MODES = ("exact", "semantic_channel_only", "layered_semantic_attribute")


def cover_for_mode(mode: str, part: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float | None = None, tau_attr: float | None = None, measure: str = "cosine") -> DataFrame:
    """The mapping of a named mode; term-only leaves the attribute guard on, at threshold 0."""
    if mode == "exact":
        return identity(part)
    if mode == "semantic_channel_only":
        return guarded_cover(part, terms, features, tau_term, 0.0, measure)
    if mode == "layered_semantic_attribute":
        if tau_attr is None:
            raise ValueError("the layered mode needs an attribute threshold")
        return guarded_cover(part, terms, features, tau_term, tau_attr, measure)
    raise ValueError(f"unknown mode {mode!r}: {MODES}")


def component_covers(part: DataFrame, terms: DataFrame | None, features: DataFrame | None, tau_term: float, tau_attr: float) -> dict[str, DataFrame]:
    """The 2 x 2 of guards: neither, the term guard, the attribute guard, both."""
    return {
        "structure": guarded_cover(part, None, None, tau_term, tau_attr),
        "term": guarded_cover(part, terms, None, tau_term, tau_attr),
        "attribute": guarded_cover(part, None, features, tau_term, tau_attr),
        "both": guarded_cover(part, terms, features, tau_term, tau_attr),
    }
