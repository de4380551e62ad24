"""Queries of scores, risks and threshold selection over a grid made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.operators import selection as sel
from hetweave.plans.registry import query
from hetweave.sources.tables import table

# the grid: a row for each return flag, status, line number and supplier residue, with figures
# that are rounded aggregates, so both engines have the same ones; one setting lacks a figure
FIGURES = {
    "avg_pathsim_mae": "nullif(round(avg(l_discount) * (0.4 + 0.3 * st), 6), case when st > 0.65 then round(avg(l_discount) * (0.4 + 0.3 * st), 6) else -1.0 end)",
    "avg_pathsim_p95e": "round(avg(l_discount) * 4 * (1 + xt), 6)",
    "avg_pathsim_p99e": "round(avg(l_tax) * 8 * (1 + xt), 6)",
    "avg_pathsim_top10": "round(1 - avg(l_tax) * 2 * xt, 6)",
    "avg_pathsim_ndcg10": "round(1 - avg(l_discount) * (0.4 + xt), 6)",
    "avg_pathsim_pvalue": "round(avg(l_quantity) / 50, 6)",
    "avg_hetesim_mae": "round(avg(l_tax) * (1 + st), 6)",
    "avg_hetesim_p95e": "round(avg(l_tax) * 5 * (1 + xt), 6)",
    "avg_hetesim_p99e": "round(avg(l_discount) * 7 * (1 + xt), 6)",
    "avg_hetesim_top10": "round(1 - avg(l_discount) * 2 * st, 6)",
    "avg_hetesim_ndcg10": "round(1 - avg(l_tax) * (0.4 + st), 6)",
    "avg_hetesim_pvalue": "round(avg(l_quantity) / 60, 6)",
    "fullgraph_reduction_ratio": "round(avg(l_discount) * 8 * (1 - st), 6)",
    "main_reduction_ratio": "round(avg(l_discount) * 9 * (1 - st), 6)",
    "fullgraph_edge_reduction_ratio": "round(avg(l_tax) * 10 * (1 - xt), 6)",
}
GRID = f"""grid as (
  select dataset, reduction_setting, st as semantic_threshold, xt as attribute_threshold, {", ".join(f"{e} as {n}" for n, e in FIGURES.items())}
  from (select l_returnflag as dataset, l_linestatus as reduction_setting, cast(l_linenumber as double) / 10 as st, cast(l_suppkey % 5 + 1 as double) / 10 as xt, l_discount, l_tax, l_quantity from lineitem) as rows_
  group by dataset, reduction_setting, st, xt
)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("reduction_setting"), (F.col("l_linenumber").cast("double") / 10).alias("st"), ((F.col("l_suppkey") % 5 + 1).cast("double") / 10).alias("xt"), "l_discount", "l_tax", "l_quantity"
    )
    figures = [F.expr(e).alias(n) for n, e in FIGURES.items()]
    return t.groupBy("dataset", "reduction_setting", "st", "xt").agg(*figures).withColumnsRenamed({"st": "semantic_threshold", "xt": "attribute_threshold"})


KEYS = ("dataset", "reduction_setting", "semantic_threshold", "attribute_threshold")


def _score(m: str, p: str = "1") -> str:
    return f"avg_{m}_ndcg10 + avg_{m}_top10 + {p} * avg_{m}_pvalue - avg_{m}_mae - 0.5::double * avg_{m}_p95e - 0.25::double * avg_{m}_p99e"


@query(f"with {GRID} select {', '.join(KEYS)}, round({_score('pathsim')}, 9) as pathsim_score, round({_score('hetesim')}, 9) as hetesim_score, round({_score('pathsim')} + {_score('hetesim')}, 9) as joint_score from grid")
def t3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each setting by method."""
    return sel.quality_scores(grid(spark, sf_dir)).select(*KEYS, *[F.round(f"{m}_score", 9).alias(f"{m}_score") for m in (*sel.METHODS, "joint")])


ROW_SCORE = " + ".join(
    f"coalesce(avg_{m}_ndcg10, 0) + coalesce(avg_{m}_top10, 0) - coalesce(avg_{m}_mae, 0) - 0.5::double * coalesce(avg_{m}_p95e, 0) - 0.25::double * coalesce(avg_{m}_p99e, 0)" for m in sel.METHODS
)


@query(f"with {GRID} select {', '.join(KEYS)}, round({ROW_SCORE}, 9) as semantic_score from grid")
def t3b_row_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality without p values, missing figures as zeros."""
    return sel.row_score(grid(spark, sf_dir)).select(*KEYS, F.round("semantic_score", 9).alias("semantic_score"))


FLAG = {m: f"cast(coalesce(avg_{m}_mae <= 0.10 and avg_{m}_p95e <= 0.30 and avg_{m}_p99e <= 0.50 and avg_{m}_ndcg10 >= 0.95 and avg_{m}_top10 >= 0.90 and avg_{m}_pvalue >= 0.05, false) as integer)" for m in sel.METHODS}
FLAGGED = f"flagged as (select *, {FLAG['pathsim']} as pathsim_controllable, {FLAG['hetesim']} as hetesim_controllable, {FLAG['pathsim']} * {FLAG['hetesim']} as joint_controllable, round({ROW_SCORE}, 9) as semantic_score, round({_score('pathsim')}, 9) as pathsim_score, round({_score('hetesim')}, 9) as hetesim_score, round({_score('pathsim')} + {_score('hetesim')}, 9) as joint_score from grid)"


@query(f"with {GRID}, {FLAGGED} select {', '.join(KEYS)}, pathsim_controllable, hetesim_controllable, joint_controllable from flagged")
def t4_controllability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings hold all bounds."""
    return sel.controllability(grid(spark, sf_dir)).select(*KEYS, *[f"{m}_controllable" for m in (*sel.METHODS, "joint")])


MORE = {f"avg_{m}_{n}": e.format(m=m) for m in sel.METHODS for n, e in {"top1": "avg_{m}_top10 - 0.02", "top5": "avg_{m}_top10 - 0.01", "maxe": "2 * avg_{m}_p99e"}.items()}
ALL_BOUNDS = {m: f"cast(coalesce(avg_{m}_mae <= 0.10 and avg_{m}_p95e <= 0.30 and avg_{m}_p99e <= 0.50 and avg_{m}_ndcg10 >= 0.90 and {MORE[f'avg_{m}_top1']} >= 0.93 and {MORE[f'avg_{m}_top5']} >= 0.94 and avg_{m}_top10 >= 0.90 and avg_{m}_pvalue >= 0.05 and {MORE[f'avg_{m}_maxe']} <= 0.8, false) as integer)" for m in sel.METHODS}


@query(f"with {GRID} select {', '.join(KEYS)}, {ALL_BOUNDS['pathsim']} as pathsim_controllable, {ALL_BOUNDS['hetesim']} as hetesim_controllable, {ALL_BOUNDS['pathsim']} * {ALL_BOUNDS['hetesim']} as joint_controllable from grid")
def t4_all_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings also hold bounds on the first, the first five and the greatest error."""
    more = grid(spark, sf_dir).withColumns({n: F.expr(e) for n, e in MORE.items()})
    return sel.controllability(more, ndcg10=0.90, top1=0.93, top5=0.94, maxe=0.8).select(*KEYS, *[f"{m}_controllable" for m in (*sel.METHODS, "joint")])


def _risk(m: str, scale: str = "1.0::double") -> str:
    parts = [f"coalesce(avg_{m}_{n} / ({b}::double * {scale}), 'inf'::double)" for n, b in sel.BUDGETS.items()]
    return f"greatest({', '.join(parts)}, coalesce((1 - avg_{m}_ndcg10) / greatest(0, least(1, (1 - 0.95::double) * {scale})), 'inf'::double))"


RISKED = f"""risk0 as (select *, {_risk('pathsim')} as pathsim_risk, {_risk('hetesim')} as hetesim_risk from grid),
risked as (select *, greatest(pathsim_risk, hetesim_risk) as joint_risk, cast(greatest(pathsim_risk, hetesim_risk) <= 1 + 1e-12 as integer) as feasible, 0.7::double * fullgraph_reduction_ratio + 0.3::double * fullgraph_edge_reduction_ratio as reduction_gain from risk0)"""
RISK_OUT = ("pathsim_risk", "hetesim_risk", "joint_risk", "reduction_gain")


@query(f"with {GRID}, {RISKED} select {', '.join(KEYS)}, {', '.join(f'round({c}, 9) as {c}' for c in RISK_OUT)}, feasible from risked")
def t7_normalized_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk over budgets; a missing figure is infinite risk."""
    found = sel.normalized_risk(grid(spark, sf_dir))
    return found.select(*KEYS, *[F.round(c, 9).alias(c) for c in RISK_OUT], "feasible")


def _floored(scale: str = "1.0::double") -> str:
    part = lambda m: f"greatest(avg_{m}_mae / (0.10::double * {scale}), avg_{m}_p95e / (0.30::double * {scale}), avg_{m}_p99e / (0.50::double * {scale}), (1 - avg_{m}_ndcg10) / greatest(1 - greatest(0, 1 - (1 - 0.95::double) * {scale}), 1e-12))"
    return f"{part('pathsim')} as pathsim_risk, {part('hetesim')} as hetesim_risk"


@query(f"with {GRID}, f as (select *, {_floored()} from grid) select {', '.join(KEYS)}, round(pathsim_risk, 6) as pathsim_risk, round(hetesim_risk, 6) as hetesim_risk, round(greatest(pathsim_risk, hetesim_risk), 6) as joint_risk, cast(greatest(pathsim_risk, hetesim_risk) <= 1 + 1e-12 as integer) as feasible from f")
def t8_floored_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk that passes over missing figures."""
    found = sel.floored_risk(grid(spark, sf_dir))
    return found.select(*KEYS, *[F.round(f"{m}_risk", 6).alias(f"{m}_risk") for m in (*sel.METHODS, "joint")], "feasible")


LAST = "fullgraph_edge_reduction_ratio desc, avg_pathsim_ndcg10 desc, avg_hetesim_ndcg10 desc, avg_pathsim_top10 desc, avg_hetesim_top10 desc, semantic_threshold, attribute_threshold"


@query(
    f"""with {GRID}, {RISKED},
a as (select *, row_number() over (partition by dataset, reduction_setting order by reduction_gain desc, joint_risk, pathsim_risk, hetesim_risk, {LAST}) as k from risked where feasible = 1),
b as (select r.*, row_number() over (partition by r.dataset, r.reduction_setting order by joint_risk, reduction_gain desc, fullgraph_edge_reduction_ratio desc, semantic_threshold, attribute_threshold) as k from risked r where not exists (select 1 from a where a.dataset = r.dataset and a.reduction_setting = r.reduction_setting))
select {', '.join(KEYS)}, 'normalized_risk' as selection_source from a where k = 1 union all select {', '.join(KEYS)}, 'normalized_best_effort' from b where k = 1"""
)
def t9_select_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting of most gain within budget, or the least risky."""
    return sel.select_normalized(sel.normalized_risk(grid(spark, sf_dir))).select(*KEYS, "selection_source")


def _by_objective(scaled: str, keys: str, extra: str = "") -> str:
    return f"""fl as (select *, {_floored(scaled)} from {'scaled' if extra else 'grid'}), fr as (select *, greatest(pathsim_risk, hetesim_risk) as joint_risk, cast(greatest(pathsim_risk, hetesim_risk) <= 1 + 1e-12 as integer) as feasible from fl),
a as (select *, row_number() over (partition by {keys} order by fullgraph_reduction_ratio desc, joint_risk, {LAST}) as k from fr where feasible = 1),
b as (select r.*, row_number() over (partition by {keys.replace('dataset', 'r.dataset').replace('reduction_setting', 'r.reduction_setting')} order by joint_risk, fullgraph_reduction_ratio desc, semantic_threshold, attribute_threshold) as k from fr r where not exists (select 1 from a where a.dataset = r.dataset and a.reduction_setting = r.reduction_setting{' and a.budget_scale = r.budget_scale' if extra else ''}))
select {extra}{', '.join(KEYS)}, 'feasible' as selection_source from a where k = 1 union all select {extra}{', '.join(KEYS)}, 'fallback_min_risk' from b where k = 1"""


@query(f"with {GRID}, {_by_objective('1.0::double', 'dataset, reduction_setting')}")
def t10_select_by_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most reduced setting within budget, or the least risky."""
    return sel.select_by_objective(sel.floored_risk(grid(spark, sf_dir)), "fullgraph_reduction_ratio").select(*KEYS, "selection_source")


@query(f"with {GRID}, scaled as (select g.*, s.budget_scale from grid g, (values (0.5::double), (0.8::double), (1.0::double), (1.5::double)) s(budget_scale)), {_by_objective('budget_scale', 'dataset, reduction_setting, budget_scale', 'budget_scale, ')}")
def t12_budget_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection at four scales of the budgets."""
    return sel.budget_sensitivity(grid(spark, sf_dir), [0.5, 0.8, 1.0, 1.5]).select("budget_scale", *KEYS, "selection_source")


@query(
    f"""with {GRID}, {FLAGGED}, r as (select *, case when joint_controllable = 1 then 0 when pathsim_controllable = 1 then 1 when hetesim_controllable = 1 then 2 else 3 end as rk from flagged),
o as (select *, row_number() over (partition by dataset, reduction_setting order by rk, case when rk = 3 then semantic_score end desc nulls last, fullgraph_reduction_ratio desc nulls last, main_reduction_ratio desc nulls last, fullgraph_edge_reduction_ratio desc nulls last, semantic_score desc nulls last, avg_pathsim_ndcg10 desc nulls last, avg_hetesim_ndcg10 desc nulls last, avg_pathsim_top10 desc nulls last, avg_hetesim_top10 desc nulls last, avg_pathsim_mae nulls last, avg_hetesim_mae nulls last, semantic_threshold, attribute_threshold) as k from r)
select {', '.join(KEYS)}, case rk when 0 then 'joint' when 1 then 'pathsim' when 2 then 'hetesim' else 'best_effort' end as selection_source from o where k = 1"""
)
def t11_select_controllable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard rule with its fallbacks."""
    flagged = sel.row_score(sel.controllability(grid(spark, sf_dir))).withColumn("semantic_score", F.round("semantic_score", 9))
    return sel.select_controllable(flagged).select(*KEYS, "selection_source")


@query(
    f"""with {GRID}, {FLAGGED}, o as (select *, row_number() over (partition by dataset order by 1 - joint_controllable, case when joint_controllable = 0 then joint_score end desc nulls last, fullgraph_reduction_ratio desc nulls last, fullgraph_edge_reduction_ratio desc nulls last, avg_pathsim_ndcg10 desc nulls last, avg_hetesim_ndcg10 desc nulls last, avg_pathsim_top10 desc nulls last, avg_hetesim_top10 desc nulls last, semantic_threshold, attribute_threshold) as k from flagged)
select {', '.join(KEYS)}, case when joint_controllable = 1 then 'feasible' else 'fallback' end as status from o where k = 1"""
)
def t5_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recommended setting for each dataset."""
    g = sel.quality_scores(sel.controllability(grid(spark, sf_dir))).withColumns({f"{m}_score": F.round(f"{m}_score", 9) for m in (*sel.METHODS, "joint")})
    return sel.recommend(g, "joint").select(*KEYS, "status")


@query(
    f"""with {GRID} select {', '.join('g.' + k for k in KEYS)} from grid g where not exists (select 1 from grid o where o.dataset = g.dataset and o.fullgraph_reduction_ratio >= g.fullgraph_reduction_ratio and o.avg_hetesim_ndcg10 >= g.avg_hetesim_ndcg10 and (o.fullgraph_reduction_ratio > g.fullgraph_reduction_ratio or o.avg_hetesim_ndcg10 > g.avg_hetesim_ndcg10))"""
)
def t6_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that no other of their dataset beats in reduction and ranking kept."""
    return sel.pareto(grid(spark, sf_dir), "fullgraph_reduction_ratio", "avg_hetesim_ndcg10", ("dataset",)).select(*KEYS)


@query(f"with {GRID} select {', '.join(KEYS)}, round(greatest({', '.join(f'avg_{m}_{n} / {b}::double' for m in sel.METHODS for n, b in sel.BUDGETS.items())}, (1 - avg_pathsim_ndcg10) / (1 - 0.95::double), (1 - avg_hetesim_ndcg10) / (1 - 0.95::double)), 6) as risk from grid")
def t14_semantic_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of eight shares of fixed budgets."""
    return sel.semantic_risk(grid(spark, sf_dir)).select(*KEYS, F.round("risk", 6).alias("risk"))


@query("select a.t as tau_term, b.t as tau_attr from (values (0.1::double), (0.4), (0.7), (1.0)) a(t), (values (0.1::double), (0.5), (0.9)) b(t)")
def s17_threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product grid of thresholds."""
    return sel.threshold_pairs(spark, term_taus=sel.float_grid(0.1, 1.0, 0.3), attr_taus=sel.float_grid(0.1, 0.9, 0.4))
