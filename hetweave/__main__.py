"""Tasks over an archive from the command line: python -m hetweave TASK --archive PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.functions.results import fresh_dir
from hetweave.operators import audit, channels, evaluate, labels, metapath, partition, quotient, ranking, selection
from hetweave.sources.archive import load_archive, parse_list, read_results, write_results, write_similarities
from hetweave.sources.presets import PRESETS


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hetweave", description=__doc__)
    p.add_argument("task", choices=sorted(TASKS))
    p.add_argument("--archive", help="ZIP of a network, at any path Spark reads")
    p.add_argument("--preset", help=f"layers of a known network: {', '.join(PRESETS)}")
    p.add_argument("--layers", help="JSON file with layers, instead of a preset")
    p.add_argument("--results", help="CSV of an evaluated grid, for reselect")
    p.add_argument("--out", required=True, help="folder of results")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--term-taus", default="0.1,0.4,0.7,1.0")
    p.add_argument("--attr-taus", default="0.1,0.5,1.0")
    p.add_argument("--tau-term", type=float, default=0.4)
    p.add_argument("--tau-attr", type=float, default=1.0)
    p.add_argument("--term-sim", default="cosine", choices=channels.TERM_MEASURES)
    p.add_argument("--sample", type=int, default=1000, help="queries drawn for evaluation; 0 takes all")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--budget-scale", type=float, default=1.0)
    p.add_argument("--budget-scales", default="0.5,1.0,1.5")
    p.add_argument("--fallback", default="best_effort", choices=("best_effort", "none"))
    p.add_argument("--label-policy", default="first", choices=("first", "drop"))
    return p


def _prepared(spark: SparkSession, a: argparse.Namespace) -> evaluate.Prepared:
    if a.layers:
        with open(a.layers) as f:
            layers = json.load(f)
        layers = {k: tuple(v) if isinstance(v, list) else {n: tuple(x) for n, x in v.items()} if isinstance(v, dict) else v for k, v in layers.items()}
    else:
        layers = dict(PRESETS[a.preset])
    return evaluate.Prepared(load_archive(spark, a.archive, **layers))


def _grid(a: argparse.Namespace) -> list[tuple[float, float]]:
    return [(t, x) for t in parse_list(a.term_taus, float) for x in parse_list(a.attr_taus, float)]


def _queries(p: evaluate.Prepared, a: argparse.Namespace) -> DataFrame:
    return ranking.sample_queries(p.targets, a.sample, a.seed).toDF("nid")


def select(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Evaluate a grid of thresholds and choose from it."""
    p = _prepared(spark, a)
    risked, chosen = evaluate.select_over_grid(p, _grid(a), dataset=a.preset or "network", scale=a.budget_scale, fallback=a.fallback, queries=_queries(p, a), measure=a.term_sim)
    return {"grid": risked, "selected": chosen, "pareto": selection.pareto(risked, "fullgraph_reduction_ratio", "avg_pathsim_ndcg10")}


def reselect(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Choose again from an evaluated grid, at several scales of the budgets."""
    grid = read_results(spark, a.results)
    known = [c for c in grid.columns if not c.endswith(("_risk", "_diagnostic")) and c not in ("feasible", "reduction_gain")]
    return {"sensitivity": selection.budget_sensitivity(grid.select(*known), parse_list(a.budget_scales, float))}


def reduce_(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Reduce a network at one pair of thresholds: mapping, quotient and figures."""
    p = _prepared(spark, a)
    mapping = p.cover(a.tau_term, a.tau_attr, measure=a.term_sim)
    semantic = p.net.nodes.where(~F.col("ntype").isin(*p.net.config.main_types)).count()
    return {
        "mapping": mapping,
        "links": quotient.quotient_links(p.matrices, mapping),
        "by_type": quotient.reduction_by_type(mapping),
        "ratios": quotient.reduction_ratios(mapping, semantic, p.net.links, p.matrices),
        "partition": partition.partition_summary(p.partition),
    }


def topk(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """The most similar nodes of drawn queries, by path and method."""
    p = _prepared(spark, a)
    q = _queries(p, a).toDF("q")
    out = None
    for path, half in p.half.items():
        for method in metapath.SIMILARITIES:
            s = ranking.rounded(metapath.similarity(method, half, q)).where("i <> j")
            rows = ranking.top_k(s, a.k).withColumns({"path": F.lit(path), "method": F.lit(method)})
            out = rows if out is None else out.unionByName(rows)
    return {"topk": out}


def retrieval(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """What a reduction keeps of similarities and rankings, by path and method."""
    p = _prepared(spark, a)
    by_path, one = evaluate.evaluate_mapping(p, p.cover(a.tau_term, a.tau_attr, measure=a.term_sim), _queries(p, a), k=a.k, keep_self=False)
    return {"by_path": by_path, "average": one}


def predict(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Neighbour votes for labels on the original and the reduced graph, mean of all paths."""
    p = _prepared(spark, a)
    mapping = p.cover(a.tau_term, a.tau_attr, measure=a.term_sim)
    target = mapping.where(F.col("ntype") == p.net.config.target)
    own = labels.target_labels(p.net.labels.where(F.col("ntype") == p.net.config.target), a.label_policy)
    original, reduced = {}, {}
    for path, half in p.half.items():
        original[path] = metapath.pathsim(half)
        reduced[path] = metapath.expand(metapath.pathsim(quotient.reduced_half_path(p.matrices, mapping, p.net.config.half_paths[path])), target)
    return {"votes": evaluate.predict_preservation({"original": metapath.combine(original, "mean"), "reduced": metapath.combine(reduced, "mean")}, own, (a.k,))}


def pairs(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """What the guards decide on every pair of a candidate class."""
    p = _prepared(spark, a)
    out = None
    for t in p.net.config.main_types:
        judged = audit.judged_pairs(channels.scored_pairs(p.partition.where(F.col("ntype") == t), p.terms.get(t), p.features(t), a.term_sim), a.tau_term, a.tau_attr)
        out = judged if out is None else out.unionByName(judged)
    return {"pairs": out, "counts": audit.decision_counts(out), "examples": audit.representative_pairs(out)}


def matrices(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Similarities of all paths, original and reduced, as partitioned parquet with a manifest."""
    p = _prepared(spark, a)
    target = p.cover(a.tau_term, a.tau_attr, measure=a.term_sim)
    out = None
    for path, half in p.half.items():
        small = quotient.reduced_half_path(p.matrices, target, p.net.config.half_paths[path])
        for method in metapath.SIMILARITIES:
            for kind, h in (("original", half), ("reduced", small)):
                rows = metapath.similarity(method, h).withColumns({"dataset": F.lit(a.preset or "network"), "path": F.lit(path), "matrix_type": F.lit(f"{kind}_{method}")})
                out = rows if out is None else out.unionByName(rows)
    return {"manifest": write_similarities(out, f"{a.out}/similarities")}


TASKS = {"select": select, "reselect": reselect, "reduce": reduce_, "topk": topk, "retrieval": retrieval, "predict": predict, "pairs": pairs, "matrices": matrices}


def main(argv: list[str] | None = None) -> str:
    """Run a task; returns the folder its tables were written to."""
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("hetweave").getOrCreate()
    folder = fresh_dir(spark, a.out, a.task, overwrite=a.overwrite)
    for name, df in TASKS[a.task](spark, a).items():
        write_results(df, f"{folder}/{name}", overwrite=a.overwrite)
    return folder


if __name__ == "__main__":
    print(main())
