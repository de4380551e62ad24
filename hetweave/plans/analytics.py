"""Queries of labels, neighbour votes, clustering measures and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.functions import results
from hetweave.operators import clustering, labels, ranking
from hetweave.operators.tiles import nearest_cosines
from hetweave.plans.registry import query
from hetweave.plans.selection import GRID, grid
from hetweave.sources import tables as src


def _part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.col("p_type").alias("y"))


@query("select p_partkey as nid, p_type as y, dense_rank() over (order by p_type) - 1 as code from part")
def l1_label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types numbered in order of their names."""
    return labels.target_labels(_part_labels(spark, sf_dir))


UNITS = """lab as (select p_partkey as nid, p_type as y, min(p_partkey) over (partition by p_brand, p_size) as cid, p_partkey % 10 = 0 as test from part),
units as (select cid as cluster_id, min(y) as y, min(nid) as nid, case when exists (select 1 from lab t where t.test and t.cid = l.cid) then 'overlaps_test' when count(distinct y) > 1 then 'mixed' else 'kept' end as verdict from lab l where not test group by cid)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = src.table(spark, sf_dir, "part")
    mapping = part.join(part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("cluster_id")), ["p_brand", "p_size"]).select(F.col("p_partkey").alias("nid"), "cluster_id")
    own = _part_labels(spark, sf_dir)
    return labels.cluster_units(own.where("nid % 10 <> 0"), mapping, own.where("nid % 10 = 0"))


@query(f"with {UNITS} select cluster_id, y, nid, verdict from units")
def l2_cluster_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by brand and size: which may train, given a tenth of parts as test nodes."""
    return _units(spark, sf_dir)


@query(
    f"""with {UNITS}, r as (select *, row_number() over (partition by y order by md5('42:' || cast(cluster_id as varchar)), cluster_id) as k, count(*) over (partition by y) as n from units)
select cluster_id, y, nid, verdict, case when k <= floor(0.8::double * n) then 'train' else 'valid' end as split from r"""
)
def l4_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of each label's clusters for training."""
    return labels.stratified_split(_units(spark, sf_dir))


VEC = "v as (select vec_id as nid, label as y, list_transform(embedding, lambda x: x::double) as vec from embeddings)"
COSINES = f"{VEC}, c as (select a.nid as i, b.nid as j, a.y as yi, b.y as yj, round(list_cosine_similarity(a.vec, b.vec), 9) as score from v a join v b on a.nid <> b.nid)"
VOTES = f"""{COSINES}, n as (select * from (select *, row_number() over (partition by i order by score desc, j) as k from c) where k <= 5),
w as (select i, yi, yj, sum(greatest(score, 0)) as s, count(*) as n from n group by 1, 2, 3),
u as (select *, case when max(s) over (partition by i) > 1e-12 then round(s, 9) else n end as weight from w),
votes as (select i as q, yi as y, yj as vote from (select *, row_number() over (partition by i order by weight desc, yj) as k from u) where k = 1)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the five nearest of all vectors, by cosine over all pairs of the evaluation set."""
    v = src.vectors(spark, sf_dir)
    return labels.neighbour_vote(nearest_cosines(v, 5), v.select("nid", "y"), 5)


@query(f"with {VOTES} select q, y, vote from votes")
def l5_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label that each vector's five nearest vote for."""
    return _votes(spark, sf_dir)


@query(
    f"""with {VOTES}, l as (select distinct y as label from votes union select vote from votes),
e as (select label, (select count(*) from votes where y = label and vote = label) as hit, (select count(*) from votes where y = label) as t, (select count(*) from votes where vote = label) as s from l)
select round(sum(hit) / cast(sum(t) as double), 9) as accuracy, round(avg(case when s > 0 then hit / cast(s as double) else 0 end), 9) as macro_precision, round(avg(case when s + t > 0 then 2 * hit / cast(s + t as double) else 0 end), 9) as macro_f1 from e"""
)
def l6_vote_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro precision and F1 of those votes."""
    found = labels.vote_measures(_votes(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    """with s as (select avg(p_size) as ms, stddev_pop(p_size) as ss, avg(p_retailprice) as mp, stddev_pop(p_retailprice) as sp from part)
select p_partkey as nid, round((p_size - ms) / ss, 6) as size_z, round((p_retailprice - mp) / sp, 6) as price_z from part, s"""
)
def l8_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and price of parts, centred and scaled."""
    vec = src.part_features(spark, sf_dir).withColumnRenamed("feat", "vec")
    [z] = clustering.standardize(vec)
    return z.select("nid", F.round(F.col("vec")[0], 6).alias("size_z"), F.round(F.col("vec")[1], 6).alias("price_z"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustering that SQL can state: the vector's largest of its first eight coordinates."""
    v = src.vectors(spark, sf_dir)
    head = F.slice("vec", 1, 8)
    return v.withColumn("cluster", (F.array_position(head, F.array_max(head)) - 1).cast("int"))


ASSIGNED = f"{VEC}, a as (select nid, y, vec, cast(list_position(vec[1:8], list_max(vec[1:8])) - 1 as integer) as cluster from v)"


@query(
    f"""with {ASSIGNED}, c as (select cluster, y, cast(count(*) as double) as n from a group by 1, 2), t as (select sum(n) as t from c), r as (select cluster, sum(n) as n from c group by 1), s as (select y, sum(n) as n from c group by 1)
select round(2 * (select sum(c.n / t.t * ln(c.n * t.t / (r.n * s.n))) from c join r on r.cluster = c.cluster join s on s.y = c.y, t) / ((select -sum(n / t.t * ln(n / t.t)) from r, t) + (select -sum(n / t.t * ln(n / t.t)) from s, t)), 9) as nmi"""
)
def l17_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised mutual information of clusters and labels."""
    return clustering.nmi(clustering.contingency(_assigned(spark, sf_dir))).withColumn("nmi", F.round("nmi", 9))


@query(f"with {ASSIGNED}, c as (select cluster, y, count(*) as n from a group by 1, 2) select cluster, y as label from (select *, row_number() over (partition by cluster order by n desc, y) as k from c) where k = 1")
def l16_majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent label of each cluster."""
    return clustering.majority_labels(clustering.contingency(_assigned(spark, sf_dir)))


@query(
    f"""with {ASSIGNED}, c as (select cluster, y, count(*) as n from a group by 1, 2), m as (select cluster, y as label from (select *, row_number() over (partition by cluster order by n desc, y) as k from c) where k = 1),
e as (select label, sum(case when y = label then n else 0 end) / cast(sum(n) as double) as p from c join m using (cluster) group by 1)
select round(avg(coalesce(e.p, 0)), 9) as macro_precision from (select distinct y as label from c) l left join e using (label)"""
)
def l17_macro_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision averaged over labels, clusters named by majority."""
    return clustering.macro_precision(clustering.contingency(_assigned(spark, sf_dir))).withColumn("macro_precision", F.round("macro_precision", 9))


@query(
    f"""with {ASSIGNED}, l as (select cluster, d, vec[d] as x from a, (select unnest(range(1, 65)) as d)), c as (select cluster, d, count(*) as n, avg(x) as m, sum(x * x) as ss from l group by 1, 2),
g as (select d, sum(n * m) / sum(n) as g from c group by 1), k as (select count(*) as n, count(distinct cluster) as k from a)
select round((select sum(c.n * (c.m - g.g) ** 2) from c join g using (d)) / (k.k - 1) / ((select sum(ss - n * m * m) from c) / (k.n - k.k)), 5) as calinski_harabasz from k"""
)
def l17_calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread between over spread within clusters."""
    return clustering.calinski_harabasz(_assigned(spark, sf_dir)).withColumn("calinski_harabasz", F.round("calinski_harabasz", 5))


@query(
    f"""with {ASSIGNED}, d as (select a.nid as i, a.cluster as ci, b.cluster as cj, avg(list_distance(a.vec, b.vec)) as d from a join a b on a.nid <> b.nid group by 1, 2, 3),
e as (select i, min(d) filter (where ci = cj) as own, min(d) filter (where ci <> cj) as other from d group by 1)
select round(avg(case when own is null then 0 else (other - own) / greatest(own, other) end), 8) as silhouette from e"""
)
def l17_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette over all vectors."""
    return clustering.silhouette(_assigned(spark, sf_dir)).withColumn("silhouette", F.round("silhouette", 8))


CENTRES = [[1.0 if d == k else 0.0 for d in range(64)] for k in range(4)]


@query(
    f"""with {VEC}, k as (select unnest(range(0, 4)) as cluster), s as (select nid, cluster, 1 / (1 + list_sum(list_transform(vec, lambda x: x * x)) - 2 * vec[cluster + 1] + 1) as s from v, k),
q as (select nid, cluster, s / sum(s) over (partition by nid) as q from s), t as (select *, q * q / sum(q) over (partition by cluster) as t from q)
select nid, cast(cluster as integer) as cluster, round(q, 8) as q, round(t / sum(t) over (partition by nid), 8) as p from t"""
)
def l13_soft_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student-t closeness to four unit centres, and its sharpened target."""
    found = clustering.soft_assignment(src.vectors(spark, sf_dir), CENTRES)
    return found.select("nid", "cluster", F.round("q", 8).alias("q"), F.round("p", 8).alias("p"))


def _clusters(algorithm: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = src.vectors(spark, sf_dir)
        found = clustering.cluster(algorithm, v.select("nid", "vec"), 10, **options)
        return found.join(v.select("nid", "y"), "nid")

    run.__name__ = {"kmeans": "l9_kmeans", "fcm": "l10_fuzzy_cmeans", "bsas": "l11_sequential_scheme", "xmeans": "l12_xmeans"}[algorithm]
    run.__doc__ = f"Clusters of all vectors by {algorithm}."
    return query()(run)


l9_kmeans, l10_fuzzy_cmeans = _clusters("kmeans", seeds=10, rounds=300), _clusters("fcm", rounds=150)
l11_sequential_scheme, l12_xmeans = _clusters("bsas"), _clusters("xmeans")


@query(
    f"""with {VEC}, k as (select unnest(range(0, 4)) as cluster), s as (select nid, vec, cluster, list_sum(list_transform(vec, lambda x: x * x)) - 2 * vec[cluster + 1] + 1 as d2 from v, k),
a as (select * from (select *, row_number() over (partition by nid order by d2, cluster) as r from s) where r = 1),
l as (select cluster, d, avg(vec[d]) as m from a, (select unnest(range(1, 65)) as d) group by 1, 2)
select cast(a.cluster as integer) as cluster, cast(l.d as integer) as dim, a.n, round(a.cost, 6) as cost, round(l.m, 8) as m from (select cluster, count(*) as n, sum(d2) as cost from a group by 1) a join l on l.cluster = a.cluster"""
)
def l9_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of k-means from four given centres: sizes, costs and new means."""
    found = clustering.lloyd_step(src.vectors(spark, sf_dir), CENTRES)
    long = found.select("cluster", "n", F.round("cost", 6).alias("cost"), F.posexplode("vec").alias("dim", "m"))
    return long.select("cluster", (F.col("dim") + 1).alias("dim"), "n", "cost", F.round("m", 8).alias("m"))


@query(
    f"""with recursive {ASSIGNED}, c as (select cluster, y, count(*) as n from a group by 1, 2),
cl as (select cluster, row_number() over (order by cluster) as k from (select distinct cluster from c)), lab as (select y, row_number() over (order by y) - 1 as b from (select distinct y from c)),
walk(k, taken, hit) as (select 0::bigint, 0::bigint, 0::bigint
  union all select w.k + 1, w.taken | (1::bigint << cast(l.b as integer)), w.hit + coalesce(c.n, 0) from walk w join cl on cl.k = w.k + 1 join lab l on (w.taken & (1::bigint << cast(l.b as integer))) = 0 left join c on c.cluster = cl.cluster and c.y = l.y)
select max(hit) / cast((select count(*) from a) as double) as accuracy from walk where k = (select count(*) from cl)"""
)
def l15_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of clusters under the best one-to-one naming."""
    return spark.createDataFrame([(clustering.accuracy(clustering.contingency(_assigned(spark, sf_dir))),)], "accuracy double")


@query(
    """with r as (select l_returnflag as setting, l_linestatus as algorithm, l_linenumber as seed, avg(l_discount) as nmi, avg(l_tax) as acc from lineitem group by 1, 2, 3),
s as (select setting, algorithm, avg(nmi) as nmi_mean, avg(acc) as acc_mean, stddev_samp(nmi) as nmi_std, stddev_samp(acc) as acc_std from r group by 1, 2)
select s.setting, s.algorithm, round(s.nmi_mean, 8) as nmi_mean, round(s.acc_mean, 8) as acc_mean, round(s.nmi_std, 8) as nmi_std, round(s.acc_std, 8) as acc_std, round(s.nmi_mean - b.nmi_mean, 8) as nmi_delta, round(s.acc_mean - b.acc_mean, 8) as acc_delta, round(abs(s.nmi_mean - b.nmi_mean), 8) as nmi_abs_delta, round(abs(s.acc_mean - b.acc_mean), 8) as acc_abs_delta
from s left join s b on b.setting = 'A' and b.algorithm = s.algorithm"""
)
def l18_preservation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations over seeds, and deltas to a baseline setting."""
    raw = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("setting"), F.col("l_linestatus").alias("algorithm"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("nmi"), F.avg("l_tax").alias("acc"))
    found = clustering.preservation_summary(raw, ("algorithm",), ("nmi", "acc"), baseline="A").drop("nmi_base", "acc_base")
    return found.select("setting", "algorithm", *[F.round(c, 8).alias(c) for c in found.columns if c not in ("setting", "algorithm")])


@query(
    f"""with {GRID} select dataset, attribute_threshold, {", ".join(f"round(avg(case when semantic_threshold = {k}::double / 10 then avg_hetesim_ndcg10 end), 9) as st_{k}" for k in range(1, 8))} from grid group by 1, 2"""
)
def b4_threshold_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG over the grid of thresholds, one column for each term threshold."""
    g = grid(spark, sf_dir).withColumn("col", F.concat(F.lit("st_"), F.round(F.col("semantic_threshold") * 10).cast("int").cast("string")))
    wide = g.groupBy("dataset", "attribute_threshold").pivot("col", [f"st_{k}" for k in range(1, 8)]).agg(F.round(F.avg("avg_hetesim_ndcg10"), 9))
    return wide


@query(f"with {GRID} select dataset, reduction_setting, semantic_threshold, avg_hetesim_ndcg10, fullgraph_reduction_ratio from grid where abs(semantic_threshold - attribute_threshold) <= 1e-8 + 1e-5 * abs(attribute_threshold)")
def b4_diagonal_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with both thresholds alike."""
    a, b = F.col("semantic_threshold"), F.col("attribute_threshold")
    return grid(spark, sf_dir).where(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)).select("dataset", "reduction_setting", "semantic_threshold", "avg_hetesim_ndcg10", "fullgraph_reduction_ratio")


@query(
    """with v as (select user_id as q, event_type as j, round(avg(value), 6) as score from events group by 1, 2) select q, j, score, rank from (select *, row_number() over (partition by q order by score desc, j) as rank from v) where rank <= 2"""
)
def r1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two event types of most mean value for each user."""
    rows = src.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("q"), F.col("event_type").alias("j")).agg(F.round(F.avg("value"), 6).alias("score"))
    return ranking.top_k(rows, 2, by="q")


@query(
    """with t as (select o_orderpriority as name, o_orderstatus as dataset, o_orderkey % 10 as repeat, avg(o_totalprice) / 1000 as seconds from orders group by 1, 2, 3),
s as (select dataset, name, count(*) as repeats, avg(seconds) as mean_s, coalesce(stddev_samp(seconds), 0) as std_s, quantile_cont(seconds, 0.5) as median_s, quantile_cont(seconds, 0.95) as p95_s from t group by 1, 2)
select s.dataset, s.name, s.repeats, round(s.mean_s, 6) as mean_s, round(s.std_s, 6) as std_s, round(s.median_s, 6) as median_s, round(s.p95_s, 6) as p95_s, round(b.median_s / s.median_s, 6) as median_speedup, round(b.mean_s / s.mean_s, 6) as mean_speedup
from s left join s b on b.dataset = s.dataset and b.name = '1-URGENT'"""
)
def b2_runtime_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings rolled up by data set and variant, with ratios to a baseline."""
    o = src.table(spark, sf_dir, "orders")
    raw = o.groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("dataset"), (F.col("o_orderkey") % 10).alias("repeat")).agg((F.avg("o_totalprice") / 1000).alias("seconds"))
    found = results.runtime_rollup(raw, "1-URGENT", "dataset")
    return found.select("dataset", "name", "repeats", *[F.round(c, 6).alias(c) for c in ("mean_s", "std_s", "median_s", "p95_s", "median_speedup", "mean_speedup")])


@query(
    """with t as (select o_orderpriority as stage, o_orderkey % 5 as repeat, sum(o_totalprice) / 1e6 as seconds, max(o_totalprice) / 1000 as peak_mb from orders group by 1, 2),
r as (select repeat, sum(seconds) as total from t group by 1)
select stage, count(*) as repeats, round(avg(seconds), 6) as mean_s, round(avg(seconds / total), 9) as share, round(max(peak_mb), 6) as peak_mb from t join r using (repeat) group by 1"""
)
def b3_construction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each stage of a construction: mean seconds, mean share of its run, greatest memory."""
    o = src.table(spark, sf_dir, "orders")
    raw = o.groupBy(F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 5).alias("repeat")).agg((F.sum("o_totalprice") / 1e6).alias("seconds"), (F.max("o_totalprice") / 1000).alias("peak_mb"))
    found = results.construction_cost(raw)
    return found.select("stage", "repeats", F.round("mean_s", 6).alias("mean_s"), F.round("share", 9).alias("share"), F.round("peak_mb", 6).alias("peak_mb"))
