"""Scores, risks and the choice of thresholds over a grid of evaluated settings.

A grid is a table with a row for each evaluated pair of thresholds. Choosing is a window over a
full lexicographic order, so ties have one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("pathsim", "hetesim")
#: Error budgets at scale 1 and the least retention: fixed values.
BUDGETS = {"mae": 0.10, "p95e": 0.30, "p99e": 0.50}
NDCG_FLOOR, TOP10_FLOOR = 0.95, 0.90
FEASIBLE = 1 + 1e-12


def _m(method: str, name: str) -> Column:
    return F.col(f"avg_{method}_{name}")


def quality_scores(grid: DataFrame) -> DataFrame:
    """{pathsim,hetesim,joint}_score: ranking kept and p, less the errors."""
    one = {m: _m(m, "ndcg10") + _m(m, "top10") + _m(m, "pvalue") - _m(m, "mae") - 0.5 * _m(m, "p95e") - 0.25 * _m(m, "p99e") for m in METHODS}
    return grid.withColumns({f"{m}_score": c for m, c in one.items()} | {"joint_score": one["pathsim"] + one["hetesim"]})


def row_score(grid: DataFrame) -> DataFrame:
    """semantic_score: as above without p, both methods summed, missing figures as 0."""
    z = lambda m, n: F.coalesce(_m(m, n), F.lit(0.0))
    total = sum((z(m, "ndcg10") + z(m, "top10") - z(m, "mae") - 0.5 * z(m, "p95e") - 0.25 * z(m, "p99e") for m in METHODS), F.lit(0.0))
    return grid.withColumn("semantic_score", total)


def controllability(grid: DataFrame, *, mae: float = 0.10, p95e: float = 0.30, p99e: float = 0.50, ndcg10: float = 0.95, top1: float = 0.0, top5: float = 0.0, top10: float = TOP10_FLOOR, pvalue: float = 0.05, maxe: float | None = None) -> DataFrame:
    """{pathsim,hetesim,joint}_controllable: 1 if all bounds hold; a missing figure fails.

    Bounds of 0 on top1 and top5 ask nothing of a grid that lacks those columns; the greatest
    error is bounded where maxe is given.
    """
    has = set(grid.columns)
    flags = {}
    for m in METHODS:
        ok = (_m(m, "mae") <= mae) & (_m(m, "p95e") <= p95e) & (_m(m, "p99e") <= p99e) & (_m(m, "ndcg10") >= ndcg10) & (_m(m, "top10") >= top10) & (_m(m, "pvalue") >= pvalue)
        for name, least in (("top1", top1), ("top5", top5)):
            if least > 0 or f"avg_{m}_{name}" in has:
                ok = ok & (_m(m, name) >= least)
        if maxe is not None:
            ok = ok & (_m(m, "maxe") <= maxe)
        flags[f"{m}_controllable"] = F.coalesce(ok, F.lit(False)).cast("int")
    return grid.withColumns(flags).withColumn("joint_controllable", F.col("pathsim_controllable") * F.col("hetesim_controllable"))


def _ratio(value: Column, budget: Column) -> Column:
    """value / budget; a budget of 0 allows 0 only; a missing value is unbounded risk."""
    return F.when(value.isNull(), F.lit(float("inf"))).when(budget <= 0, F.when(value <= 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(value / F.when(budget > 0, budget))


def normalized_risk(grid: DataFrame, scale: float | Column = 1.0, *, with_top10: bool = False, node_weight: float = 0.7, edge_weight: float = 0.3) -> DataFrame:
    """Risk as the largest share of a budget that is used; feasible up to 1.

    Error budgets grow with the scale; what a retention may lose does too, within 0 and 1.
    Missing figures are infinite risk. Adds {pathsim,hetesim,joint}_risk, feasible (joint) and
    reduction_gain, the weighted sum of node and edge reduction.
    """
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale

    def lost(value: Column, floor: float) -> Column:
        return _ratio(1 - value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.lit(floor)) * s)))

    risks = {}
    for m in METHODS:
        parts = [_ratio(_m(m, n), F.lit(b) * s) for n, b in BUDGETS.items()] + [lost(_m(m, "ndcg10"), NDCG_FLOOR)]
        risks[f"{m}_risk"] = F.greatest(*parts, *([lost(_m(m, "top10"), TOP10_FLOOR)] if with_top10 else []))
    out = grid.withColumns(risks).withColumn("joint_risk", F.greatest("pathsim_risk", "hetesim_risk"))
    gain = node_weight * F.col("fullgraph_reduction_ratio") + edge_weight * F.col("fullgraph_edge_reduction_ratio")
    return out.withColumn("feasible", (F.col("joint_risk") <= FEASIBLE).cast("int")).withColumn("reduction_gain", gain)


def floored_risk(grid: DataFrame, scale: float | Column = 1.0) -> DataFrame:
    """The same risk with budgets of at least 1e-12, where missing figures don't count.

    Adds each component, the risks, feasible, and the top-10 share as a diagnostic.
    """
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    added = {}
    for m in METHODS:
        parts = {n: _m(m, n) / F.greatest(F.lit(b) * s, F.lit(1e-12)) for n, b in BUDGETS.items()}
        parts["ndcg10"] = (1 - _m(m, "ndcg10")) / F.greatest(1 - F.greatest(F.lit(0.0), 1 - (1 - F.lit(NDCG_FLOOR)) * s), F.lit(1e-12))
        added |= {f"{m}_{n}_risk": c for n, c in parts.items()} | {f"{m}_risk": F.greatest(*parts.values())}
        added[f"{m}_top10_diagnostic"] = (1 - _m(m, "top10")) / F.greatest(1 - F.greatest(F.lit(0.0), 1 - (1 - F.lit(TOP10_FLOOR)) * s), F.lit(1e-12))
    out = grid.withColumns(added).withColumn("joint_risk", F.greatest(*[added[f"{m}_risk"] for m in METHODS]))
    return out.withColumn("feasible", (F.col("joint_risk") <= FEASIBLE).cast("int"))


def semantic_risk(metrics: DataFrame) -> DataFrame:
    """risk: the largest of the eight figures of both methods over their fixed budgets, top 10 included."""
    parts = [_m(m, n) / b for m in METHODS for n, b in BUDGETS.items()] + [(1 - _m(m, "ndcg10")) / (1 - NDCG_FLOOR) for m in METHODS]
    return metrics.withColumn("risk", F.greatest(*parts))


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("pick = 1").drop("pick")


def _down(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def _up(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


#: Last of every order, so that no two rows tie.
TIE = ("semantic_threshold", "attribute_threshold")


def select_normalized(risked: DataFrame, objective: str = "reduction_gain", by: tuple[str, ...] = ("dataset", "reduction_setting"), fallback: str = "best_effort") -> DataFrame:
    """One row for each group: the feasible one of most gain, else (best_effort) the least risky.

    selection_source is normalized_risk or normalized_best_effort; with fallback none, groups
    without a feasible row are left out.
    """
    usual = _first(risked.where("feasible = 1"), list(by), [*_down(objective), *_up("joint_risk", "pathsim_risk", "hetesim_risk"), *_down("fullgraph_edge_reduction_ratio", "avg_pathsim_ndcg10", "avg_hetesim_ndcg10", "avg_pathsim_top10", "avg_hetesim_top10"), *_up(*TIE)])
    usual = usual.withColumn("selection_source", F.lit("normalized_risk"))
    if fallback == "none":
        return usual
    without = risked.join(usual.select(*by).distinct(), list(by), "left_anti")
    other = _first(without, list(by), [*_up("joint_risk"), *_down(objective, "fullgraph_edge_reduction_ratio"), *_up(*TIE)])
    return usual.unionByName(other.withColumn("selection_source", F.lit("normalized_best_effort")))


def select_by_objective(risked: DataFrame, objective: str, by: tuple[str, ...] = ("dataset", "reduction_setting"), fallback: str = "min_risk") -> DataFrame:
    """As select_normalized, with the other order and fallbacks none, min_risk, max_node_reduction."""
    keep = [*_down(objective), *_up("joint_risk"), *_down("fullgraph_edge_reduction_ratio", "avg_pathsim_ndcg10", "avg_hetesim_ndcg10", "avg_pathsim_top10", "avg_hetesim_top10"), *_up(*TIE)]
    usual = _first(risked.where("feasible = 1"), list(by), keep).withColumn("selection_source", F.lit("feasible"))
    if fallback == "none":
        return usual
    orders = {"min_risk": [*_up("joint_risk"), *_down(objective), *_up(*TIE)], "max_node_reduction": [*_down(objective), *_up("joint_risk"), *_up(*TIE)]}
    if fallback not in orders:
        raise ValueError(f"unknown fallback {fallback!r}: none or {sorted(orders)}")
    without = risked.join(usual.select(*by).distinct(), list(by), "left_anti")
    return usual.unionByName(_first(without, list(by), orders[fallback]).withColumn("selection_source", F.lit(f"fallback_{fallback}")))


def select_controllable(flagged: DataFrame, mode: str = "joint", by: tuple[str, ...] = ("dataset", "reduction_setting")) -> DataFrame:
    """The hard rule: rows whose flags hold, by most reduction; else other flags; else best effort.

    flagged has the controllable flags and semantic_score. Modes: joint, pathsim, hetesim.
    """
    if mode not in ("joint", *METHODS):
        raise ValueError(f"unknown mode {mode!r}")
    order = [mode, *(m for m in ("joint", *METHODS) if m != mode)]
    rank = F.coalesce(*[F.when(F.col(f"{m}_controllable") == 1, F.lit(k)) for k, m in enumerate(order)], F.lit(len(order)))
    found = _first(
        flagged.withColumn("rank_", rank),
        list(by),
        [F.col("rank_"), *[F.when(F.col("rank_") == len(order), F.col("semantic_score")).desc_nulls_last()], *_down("fullgraph_reduction_ratio", "main_reduction_ratio", "fullgraph_edge_reduction_ratio", "semantic_score", "avg_pathsim_ndcg10", "avg_hetesim_ndcg10", "avg_pathsim_top10", "avg_hetesim_top10"), *_up("avg_pathsim_mae", "avg_hetesim_mae", *TIE)],
    )
    names = F.array(*[F.lit(m) for m in order], F.lit("best_effort"))
    return found.withColumn("selection_source", F.element_at(names, F.col("rank_") + 1)).drop("rank_")


def recommend(scored: DataFrame, criterion: str) -> DataFrame:
    """One row for each dataset: feasible for the criterion and most reduced, else the best scored."""
    if criterion not in ("joint", *METHODS):
        raise ValueError(f"unknown criterion {criterion!r}")
    ok = F.col(f"{criterion}_controllable") == 1
    ms = METHODS if criterion == "joint" else (criterion,)
    order = [F.when(ok, 0).otherwise(1), *[F.when(~ok, F.col(f"{criterion}_score")).desc_nulls_last()], *_down("fullgraph_reduction_ratio", "fullgraph_edge_reduction_ratio", *[f"avg_{m}_ndcg10" for m in ms], *[f"avg_{m}_top10" for m in ms]), *_up(*TIE)]
    return _first(scored, ["dataset"], order).withColumn("status", F.when(ok, "feasible").otherwise("fallback"))


def pareto(rows: DataFrame, reduction: str, quality: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that none of their group beats: at least as good in both and better in one.

    The best quality among rows of more reduction, and the best among those of as much, decide;
    so it is a sort of distinct values, not a comparison of all pairs. Rows with a null are out.
    """
    keys = list(by)
    known = rows.where(F.col(reduction).isNotNull() & F.col(quality).isNotNull())
    best = known.groupBy(*keys, reduction).agg(F.max(quality).alias("best_"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = F.max("best_").over(w.orderBy(F.col(reduction).desc()).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("above_", above).where("above_ is null or best_ > above_").drop("above_")
    return known.join(front, [*keys, reduction]).where(F.col(quality) == F.col("best_")).drop("best_")


def budget_sensitivity(grid: DataFrame, scales: list[float], objective: str = "fullgraph_reduction_ratio") -> DataFrame:
    """The selection at each scale of the budgets, in one pass."""
    scaled = grid.withColumn("budget_scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return select_by_objective(floored_risk(scaled, F.col("budget_scale")), objective, ("dataset", "reduction_setting", "budget_scale"))


def threshold_pairs(spark, taus: list[float] | None = None, term_taus: list[float] | None = None, attr_taus: list[float] | None = None) -> DataFrame:
    """(tau_term, tau_attr): one list gives its diagonal, two their product."""
    pairs = [(t, t) for t in taus] if taus else [(a, b) for a in term_taus or [] for b in attr_taus or []]
    return spark.createDataFrame(pairs, "tau_term double, tau_attr double")


def float_grid(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high, itself included, at 6 digits."""
    if step <= 0:
        raise ValueError("step must be positive")
    out, x = [], low
    while x <= high + 1e-12:
        out.append(round(x, 6))
        x = low + len(out) * step
    return out
