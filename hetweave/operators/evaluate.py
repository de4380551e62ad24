"""Evaluation of reductions over a grid of thresholds, and the views that models train on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hetweave.lineage import cut
from hetweave.network import Network
from hetweave.operators import channels, cover, labels, metapath, partition, preserve, quotient, ranking, selection


class Prepared:
    """What all cells of a grid share: link matrices, partition, channels and original half-paths."""

    def __init__(self, net: Network) -> None:
        net.config.check()
        self.net, c = net, net.config
        self.matrices = cut(net.link_matrices())
        core = self.matrices.where(F.col("ltype").isin(*c.core_links))
        main = net.nodes.where(F.col("ntype").isin(*c.main_types))
        self.partition = cut(partition.entity_partition(main, core))
        self.terms = {t: cut(channels.term_channel(*[net.link(x, self.matrices) for x in path])) for t, path in c.term_paths.items() if path}
        self.half = {name: cut(metapath.compose(*[net.link(x, self.matrices) for x in path])) for name, path in c.half_paths.items()}
        self.targets = net.of_type(c.target).select("nid")

    def features(self, ntype: str) -> DataFrame | None:
        """The attribute channel of a type; None (off) for types that have none."""
        if self.net.features is None or ntype not in self.net.config.strong_types:
            return None
        return self.net.features.where(F.col("ntype") == ntype).select("nid", "feat")

    def cover(self, tau_term: float | None, tau_attr: float | None, mode: str = "layered_semantic_attribute", measure: str = "cosine") -> DataFrame:
        """The mapping of all main types; semantic types stay as they are."""
        parts = [cover.cover_for_mode(mode, self.partition.where(F.col("ntype") == t), self.terms.get(t), self.features(t), tau_term, tau_attr, measure) for t in self.net.config.main_types]
        return cut(reduce(DataFrame.unionByName, parts))

    def alike(self, pairs: list[tuple[float, float]], mode: str = "layered_semantic_attribute", measure: str = "cosine") -> list[int]:
        """For each cell the first one that the same pairs of nodes pass, which thus has its mapping.

        What passes only shrinks as a threshold rises. So two cells are passed by the same pairs
        if both, and the cell of their higher thresholds, are passed by as many.
        """
        if mode != "layered_semantic_attribute":
            return list(range(len(pairs)))
        corners = sorted({(t, a) for t, _ in pairs for _, a in pairs})
        counts = [dict(zip(corners, cover.count_passing(self.partition.where(F.col("ntype") == t), self.terms.get(t), self.features(t), corners, measure), strict=True)) for t in self.net.config.main_types]
        out: list[int] = []
        for k, (t, a) in enumerate(pairs):
            same = [j for j in sorted(set(out)) if cover.strict(t, measure) == cover.strict(pairs[j][0], measure) and all(c[t, a] == c[pairs[j]] == c[max(t, pairs[j][0]), max(a, pairs[j][1])] for c in counts)]
            out.append(same[0] if same else k)
        return out


def evaluate_mappings(prepared: Prepared, mappings: DataFrame, queries: DataFrame | None = None, *, k: int = 10, keep_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """Measures of the mappings (cell, ntype, nid, cluster_id) by cell, path and method, averaged over queries; and by cell.

    A cell's one row has the figures' names of a grid: avg_{method}_{mae,p95e,p99e,top10,ndcg10,pvalue},
    averaged over paths, and the greatest avg_{method}_maxe.
    """
    q = (prepared.targets if queries is None else queries).toDF("q")
    by_path = cut(preserve.preserved(prepared.half, prepared.matrices, prepared.net.config.half_paths, mappings, prepared.targets, q, k=k, keep_self=keep_self))
    names = {"mae": "mae", "p95": "p95e", "p99": "p99e", "overlap": "top10", "ndcg": "ndcg10", "p": "pvalue"}
    over = [F.avg(F.when(F.col("method") == m, F.col(c))).alias(f"avg_{m}_{n}") for m in preserve.METHODS for c, n in names.items()]
    most = [F.max(F.when(F.col("method") == m, F.col("maxe"))).alias(f"avg_{m}_maxe") for m in preserve.METHODS]
    return by_path, by_path.groupBy("cell").agg(*over, *most)


def evaluate_mapping(prepared: Prepared, mapping: DataFrame, queries: DataFrame | None = None, *, k: int = 10, keep_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """evaluate_mappings() of a single mapping (ntype, nid, cluster_id)."""
    by_path, one = evaluate_mappings(prepared, mapping.withColumn("cell", F.lit(0)), queries, k=k, keep_self=keep_self)
    return by_path.drop("cell"), one.drop("cell")


def evaluate_grid(prepared: Prepared, pairs: Iterable[tuple[float, float]], *, dataset: str = "", setting: str = "layered_semantic_attribute", queries: DataFrame | None = None, measure: str = "cosine") -> DataFrame:
    """A row for each pair of thresholds: reduction figures and measures, ready for selection.

    Cells that the same pairs of nodes pass share a mapping; the different mappings are measured
    in one plan, over shared, written tables.
    """
    net = prepared.net
    semantic = net.nodes.where(~F.col("ntype").isin(*net.config.main_types)).count()
    pairs = list(pairs)
    first = prepared.alike(pairs, setting, measure)
    mappings, sizes = [], []
    for k in sorted(set(first)):
        mapping = prepared.cover(*pairs[k], setting, measure)
        mappings.append(mapping.withColumn("cell", F.lit(k)))
        sizes.append(quotient.reduction_ratios(mapping, semantic, net.links, prepared.matrices).withColumn("cell", F.lit(k)))
    _, measured = evaluate_mappings(prepared, reduce(DataFrame.unionByName, mappings), queries)
    found = reduce(DataFrame.unionByName, sizes).join(measured, "cell")  # a row for each mapping
    measures = [c for c in found.columns if c != "cell"]
    cells = net.nodes.sparkSession.createDataFrame([(k, dataset, setting, *pair) for k, pair in zip(first, pairs, strict=True)], "cell int, dataset string, reduction_setting string, semantic_threshold double, attribute_threshold double")
    return cut(found.join(F.broadcast(cells), "cell").select(*measures, *cells.columns[1:]))  # a row for each cell


def guard_covers(prepared: Prepared, tau_term: float, tau_attr: float) -> dict[str, tuple[DataFrame, float | None, float | None]]:
    """The 2 x 2 of guards as settings: (mapping of all main types, term threshold, attribute threshold); None is off."""
    taus = {"structure": (None, None), "term": (tau_term, None), "attribute": (None, tau_attr), "both": (tau_term, tau_attr)}
    by_type = [cover.component_covers(prepared.partition.where(F.col("ntype") == t), prepared.terms.get(t), prepared.features(t), tau_term, tau_attr) for t in prepared.net.config.main_types]
    return {name: (reduce(DataFrame.unionByName, [c[name] for c in by_type]), *of) for name, of in taus.items()}


def evaluate_settings(prepared: Prepared, settings: dict[str, tuple[DataFrame, float | None, float | None]], queries: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """What each named setting of the guards reduces, what it preserves and its risk; and the measures by path.

    settings gives (mapping (ntype, nid, cluster_id) of all main types, tau_term, tau_attr); a
    threshold that is None means that guard is off. A row has configuration, term_guard,
    attribute_guard, tau_term, tau_attr, {full,main,target}_nodes and reduced_*, edges,
    reduced_edges, {full,main,target}_node_ratio and edge_ratio (0 where there was nothing), the
    figures of evaluate_mappings(), r_sem, the largest share of an error or ranking budget that is
    used, and feasible (r_sem up to 1). Main nodes are of all main types, target nodes of the
    target type, full ones also of the types that stay as they are; edges before are raw rows,
    repeats included. All settings are measured in one plan. Serves the ablation over both guards,
    the sensitivity to one threshold and controls on other networks.
    """
    net, spark = prepared.net, prepared.net.nodes.sparkSession
    rows = [m.select("ntype", "nid", "cluster_id").withColumn("cell", F.lit(k)) for k, (m, _, _) in enumerate(settings.values())]
    mappings = cut(reduce(DataFrame.unionByName, rows))
    by_path, measured = evaluate_mappings(prepared, mappings, queries, **options)
    target = F.col("ntype") == net.config.target
    by_type = mappings.groupBy("cell", "ntype").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("c"))
    sizes = by_type.groupBy("cell").agg(F.sum("n").alias("main_nodes"), F.sum("c").alias("reduced_main_nodes"), F.sum(F.when(target, F.col("n")).otherwise(0)).alias("target_nodes"), F.sum(F.when(target, F.col("c")).otherwise(0)).alias("reduced_target_nodes"))
    still = net.nodes.where(~F.col("ntype").isin(*net.config.main_types)).agg(F.count("*").alias("still"))
    before = net.links.agg(F.count("*").alias("edges"))
    of = mappings.select("cell", "nid", "cluster_id")
    cells = F.broadcast(spark.createDataFrame([(k, name, int(t is not None), int(a is not None), t, a) for k, (name, (_, t, a)) in enumerate(settings.items())], "cell int, configuration string, term_guard int, attribute_guard int, tau_term double, tau_attr double"))  # a row for each setting
    ends = prepared.matrices.select("ltype", "src", "dst").join(cells.select("cell")).join(of.toDF("cell", "src", "cs"), ["cell", "src"], "left").join(of.toDF("cell", "dst", "cd"), ["cell", "dst"], "left")
    after = ends.select("cell", "ltype", F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")).distinct().groupBy("cell").agg(F.count("*").alias("reduced_edges"))
    found = cells.join(sizes, "cell", "left").join(after, "cell", "left").join(measured, "cell", "left").join(still).join(before)
    found = found.na.fill(0, ["main_nodes", "reduced_main_nodes", "target_nodes", "reduced_target_nodes", "reduced_edges"])
    found = found.withColumns({"full_nodes": F.col("main_nodes") + F.col("still"), "reduced_full_nodes": F.col("reduced_main_nodes") + F.col("still")})

    def saved(now: str, was: str) -> Column:
        return F.when(F.col(was) > 0, 1 - F.col(now) / F.col(was)).otherwise(0.0)

    ratios = {f"{x}_node_ratio": saved(f"reduced_{x}_nodes", f"{x}_nodes") for x in ("full", "main", "target")} | {"edge_ratio": saved("reduced_edges", "edges")}
    found = selection.semantic_risk(found.withColumns(ratios)).withColumnRenamed("risk", "r_sem").withColumn("feasible", (F.col("r_sem") <= selection.FEASIBLE).cast("int"))
    return found.drop("cell", "still"), by_path.join(cells.select("cell", "configuration"), "cell").drop("cell")


def predict_preservation(scores: dict[str, DataFrame], own: DataFrame, ks: Iterable[int]) -> DataFrame:
    """Neighbour-vote measures of each setting and k, with deltas to the setting named original."""
    rows = []
    for setting, s in scores.items():
        for k in ks:
            votes = labels.neighbour_vote(ranking.rounded(s), own, k)
            rows.append(labels.vote_measures(votes.withColumns({"setting": F.lit(setting), "k": F.lit(k)}), "setting", "k"))
    raw = reduce(DataFrame.unionByName, rows)
    measures = ("accuracy", "macro_precision", "macro_f1")
    base = raw.where("setting = 'original'").select("k", *[F.col(m).alias(f"original_{m}") for m in measures])
    return raw.join(base, "k").withColumns({f"delta_{m}": F.col(m) - F.col(f"original_{m}") for m in measures})


def select_over_grid(prepared: Prepared, pairs: Iterable[tuple[float, float]], *, dataset: str, scale: float = 1.0, fallback: str = "best_effort", **options) -> tuple[DataFrame, DataFrame]:
    """The evaluated grid with its risks, and the settings chosen from it."""
    from hetweave.operators.selection import normalized_risk, row_score, select_normalized

    risked = normalized_risk(row_score(evaluate_grid(prepared, pairs, dataset=dataset, **options)), scale)
    return risked, select_normalized(risked, fallback=fallback)


def retrieval_at(original: DataFrame, reduced: DataFrame, targets: DataFrame, ks: Iterable[int]) -> DataFrame:
    """(k, mae, p95, overlap, tie_overlap, ndcg, ...) averaged over all targets as queries, self left out."""
    q = targets.toDF("q")
    rows = [cut(ranking.average(ranking.preservation(original, reduced, q, targets, k=k).withColumn("k", F.lit(k)), "k")) for k in ks]
    return reduce(DataFrame.unionByName, rows)


def retrieval_of_clusters(original: DataFrame, small: DataFrame, mapping: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """As retrieval_at(), with scores small (i, j, score) of clusters and the mapping (nid, cluster_id) of all targets."""
    original = cut(original)
    top = cut(preserve.cluster_overlaps(original, small, mapping, ks))
    groups = cut(preserve.cluster_groups(original, small, mapping))
    rows = [ranking.average(preserve.measured(groups, mapping, k).join(top.select("i", F.col(f"top{k}").alias("overlap")), "i").withColumn("k", F.lit(k)), "k") for k in ks]
    return reduce(DataFrame.unionByName, rows)


def retrieval_of_half(method: str, half: DataFrame, small: DataFrame, mapping: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """As retrieval_of_clusters(), of a similarity over half, whose scores are measured where they are made."""
    each = preserve.half_measures(method, half, small, mapping, ks)
    top = cut(preserve.cluster_overlaps(preserve.nearest_of(each), small, mapping, ks))
    top = top.select("i", F.explode(F.create_map(*[x for k in ks for x in (F.lit(k), F.col(f"top{k}"))])).alias("k", "overlap"))
    return ranking.average(each.join(top, ["i", "k"]), "k")


def attribute_ladder(prepared: Prepared, tau_term: float, rungs: Iterable[float] = (0.1, 0.5, 1.0)) -> dict[str, DataFrame]:
    """Mappings with all types under the term guard alone, and the target's attribute guard raised in steps."""
    c = prepared.net.config
    terms_only = {t: cover.guarded_cover(prepared.partition.where(F.col("ntype") == t), prepared.terms.get(t), None, tau_term, 0.0) for t in c.main_types}
    rest = [m for t, m in terms_only.items() if t != c.target]
    own = prepared.partition.where(F.col("ntype") == c.target)
    out = {"term_only": reduce(DataFrame.unionByName, rest, terms_only[c.target])}
    for tau in rungs:
        out[f"attribute_{tau:g}"] = reduce(DataFrame.unionByName, rest, cover.guarded_cover(own, prepared.terms.get(c.target), prepared.features(c.target), tau_term, tau))
    return out


def cluster_settings(points: dict[str, DataFrame], own: DataFrame, k: int, algorithms: Iterable[str], seeds: Iterable[int]) -> DataFrame:
    """(setting, algorithm, seed, nmi, acc, macro_precision) of clusterings of each setting's points.

    Points (nid, vec) are standardised by the setting named original. A row each; summaries and
    deltas are preservation_summary()'s.
    """
    from hetweave.operators import clustering

    spark = own.sparkSession
    names = sorted(points)
    scaled = dict(zip(names, clustering.standardize(points["original"], *[points[n] for n in names]), strict=True))
    rows = []
    for name in names:
        for algorithm in algorithms:
            for seed in seeds:
                found = clustering.cluster(algorithm, scaled[name], k, seed=seed).join(own.select("nid", "y"), "nid")
                cells = cut(clustering.contingency(found))
                rows.append((name, algorithm, seed, clustering.nmi(cells).first()[0], clustering.accuracy(cells), clustering.macro_precision(cells).first()[0]))
    return spark.createDataFrame(rows, "setting string, algorithm string, seed int, nmi double, acc double, macro_precision double")


def typical_seed(raw: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """(keys, seed) of the run whose measures lie nearest their means; ties to the least seed."""
    w = Window.partitionBy(*keys)
    far = reduce(lambda a, b: a + b, [F.abs(F.col(m) - F.avg(m).over(w)) for m in measures])
    ranked = raw.withColumn("far", F.round(far, 12)).withColumn("k", F.row_number().over(w.orderBy("far", "seed")))
    return ranked.where("k = 1").select(*keys, "seed")


def training_views(prepared: Prepared, mapping: DataFrame, own: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Tables a graph model trains on, original and reduced.

    edges: (rel, src, dst, w, norm) over dense indices, types end to end; index: (ntype, id, idx);
    labels: (idx, y). Reduced labels leave out clusters that hold a test node or several labels;
    excluded counts them by reason.
    """
    core = prepared.matrices.where(F.col("ltype").isin(*prepared.net.config.core_links))
    out: dict[str, DataFrame] = {}
    for view, links in (("original", core), ("reduced", quotient.quotient_links(core, mapping))):
        ids = mapping.select("ntype", (F.col("nid") if view == "original" else F.col("cluster_id")).alias("id")).distinct()
        index = dense_index(ids)
        ends = index.select("id", "idx")
        rows = links.join(ends.toDF("src", "s"), "src").join(ends.toDF("dst", "d"), "dst")
        out[f"{view}_index"] = index
        out[f"{view}_edges"] = metapath.edge_norms(rows.select(F.col("ltype").alias("rel"), F.col("s").alias("src"), F.col("d").alias("dst"), "w"))
    units = labels.cluster_units(own, mapping, test)
    out["original_labels"] = own.join(out["original_index"].select(F.col("id").alias("nid"), "idx"), "nid").select("idx", "y")
    kept = units.where("verdict = 'kept'")
    out["reduced_labels"] = kept.join(out["reduced_index"].select(F.col("id").alias("cluster_id"), "idx"), "cluster_id").select("idx", "y")
    out["excluded"] = units.where("verdict <> 'kept'").groupBy("verdict").agg(F.count("*").alias("clusters"))
    return out


def dense_index(ids: DataFrame, buckets: int = 256) -> DataFrame:
    """(ntype, id, idx): 0, 1, 2, ... in order of type and id, types end to end.

    Ids are dealt into ranges; counts of ranges are summed, and each range is numbered inside, so
    no task sorts all ids.
    """
    ranged = cut(ids.repartitionByRange(buckets, "ntype", "id").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")  # a row for each range
    starts = F.broadcast(counts.select("part", start.alias("start")))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("ntype", "id"))
    return ranged.withColumn("k", inside).join(starts, "part").select("ntype", "id", (F.col("start") + F.col("k") - 1).alias("idx"))


def project_plane(points: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """(nid, x, y) of each table of (nid, vec): the first two principal axes of all of them together.

    The covariance is summed in long form on the executors; its size is the square of the
    vectors' length, and only that is solved on the driver. Axes point to their largest entry.
    """
    import numpy as np

    every = reduce(DataFrame.unionByName, [p.select("vec") for p in (points, *others)])
    n, dim = every.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return [p.select("nid", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")) for p in (points, *others)]
    mean = np.array(every.agg(*[F.avg(F.col("vec")[d]) for d in range(dim)]).first(), float)

    def moments(batches):
        """Products of a partition, summed where it is."""
        import pandas as pd

        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b.vec.to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"m": [total.reshape(-1).tolist()]})

    parts = every.mapInPandas(moments, "m array<double>").select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    cov = np.zeros(dim * dim)
    for r in parts.collect():  # dim * dim figures
        cov[r.k] = r.v
    _, axes = np.linalg.eigh(cov.reshape(dim, dim) / max(n - 1, 1))
    first = axes[:, ::-1][:, :2].T if dim > 1 else np.array([axes[:, 0], np.zeros(1)])
    first = np.array([a * (1 if a[np.abs(a).argmax()] >= 0 else -1) for a in first])

    def along(axis):
        centred = F.zip_with("vec", F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m)
        return F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(a)) for a in axis]), lambda v, a: v * a), F.lit(0.0), lambda s, x: s + x)

    return [p.select("nid", along(first[0]).alias("x"), along(first[1]).alias("y")) for p in (points, *others)]


def message_pass(edges: DataFrame, states: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One relational propagation step: (idx, vec) from the normed edges (rel, src, dst, norm).

    Each node gets the sum over relations of weight * norm * the neighbour's vector; weights are
    1 unless given. The step of relational graph models that is a join and a sum; stacked, it
    gives fixed propagation features without training.
    """
    scale = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("rel")], F.lit(1.0))
    rows = edges.join(states.select(F.col("idx").alias("src"), F.posexplode("vec").alias("dim", "v")), "src")
    sums = rows.groupBy("dst", "dim").agg(F.sum(scale * F.col("norm") * F.col("v")).alias("s"))
    return sums.groupBy(F.col("dst").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("vec"))
