"""Queries of meta-path similarity, channels and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.lineage import cut
from hetweave.operators import channels, classblocks, metapath, preserve, quotient, ranking
from hetweave.plans.registry import query
from hetweave.sources import tables as src

SP = "sp as (select l_suppkey as src, l_partkey as dst, cast(count(*) as double) as w from lineitem group by 1, 2)"
PATHSIM = """norms as (select src, sum(w * w) as n from {t} group by src),
dots as (select a.src as i, b.src as j, sum(a.w * b.w) as d from {t} a join {t} b on a.dst = b.dst group by 1, 2),
{out} as (select d.i, d.j, round(2 * d.d / (x.n + y.n), 9) as score from dots d join norms x on x.src = d.i join norms y on y.src = d.j)"""


def _ranked(df: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top_k(ranking.rounded(df.where("i <> j")), k).select("i", "j", "score", "rank")


@query(
    f"with {SP}, {PATHSIM.format(t='sp', out='s')}, r as (select *, row_number() over (partition by i order by score desc, j) as rank from s where i <> j) select i, j, score, rank from r where rank <= 10"
)
def m1_pathsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten suppliers most alike each supplier through the parts they supply."""
    return _ranked(metapath.pathsim(src.supplier_part(spark, sf_dir), best=10))


HETESIM = """unit as (select src, dst, w / sqrt(sum(w * w) over (partition by src)) as w from {t}),
{out} as (select a.src as i, b.src as j, round(sum(a.w * b.w), 9) as score from unit a join unit b on a.dst = b.dst group by 1, 2)"""


@query(f"with {SP}, {HETESIM.format(t='sp', out='s')}, r as (select *, row_number() over (partition by i order by score desc, j) as rank from s where i <> j) select i, j, score, rank from r where rank <= 10")
def m3_hetesim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above by HeteSim."""
    return _ranked(metapath.hetesim(src.supplier_part(spark, sf_dir), best=10))


@query(f"with {SP}, {HETESIM.format(t='sp', out='s')} select i, j, score from s")
def m4_hetesim_whole_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HeteSim of supplier, part, supplier, given as a whole path and split in its middle."""
    there = src.supplier_part(spark, sf_dir)
    back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return ranking.rounded(metapath.hetesim_of_path([there, back], same_type=True))


@query(
    """select 'supplies' as ltype, l_suppkey as src, 1000000000000 + l_partkey as dst, cast(count(*) as double) as w from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 2, 3
union all select 'supplied', 1000000000000 + l_partkey, l_suppkey, cast(count(*) as double) from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 2, 3
union all select 'based', s_suppkey, 2000000000000 + s_nationkey, 1.0 from supplier join nation on n_nationkey = s_nationkey
union all select 'hosts', 2000000000000 + s_nationkey, s_suppkey, 1.0 from supplier join nation on n_nationkey = s_nationkey
union all select 'within', 2000000000000 + n_nationkey, 3000000000000 + n_regionkey, 1.0 from nation join region on r_regionkey = n_regionkey"""
)
def s3_link_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed links between nodes of the declared types, parallel ones summed."""
    return src.supply_network(spark, sf_dir).link_matrices()


@query(f"with {SP} select sp.src, p.p_brand as dst, sum(sp.w) as w from sp join part p on p.p_partkey = sp.dst group by 1, 2")
def k1_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each supplier by brand: two links composed."""
    brand = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"), F.lit(1.0).alias("w"))
    return metapath.compose(src.supplier_part(spark, sf_dir), brand)


@query("select distinct l_suppkey as nid, t.term from lineitem join (select p_partkey, unnest(string_split(lower(p_name), ' ')) as term from part) t on t.p_partkey = l_partkey where t.term <> ''")
def k2_term_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that suppliers reach through part names."""
    words = src.part_tokens(spark, sf_dir).select(F.col("nid").alias("src"), F.col("term").alias("dst"))
    return channels.term_channel(src.supplier_part(spark, sf_dir), words)


@query("select distinct s.s_nationkey as src, p.p_brand as dst from lineitem join supplier s on s.s_suppkey = l_suppkey join part p on p.p_partkey = l_partkey")
def m10_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and the brands reached from them: nation, supplier, part, brand."""
    home = src.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    brand = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    return metapath.reached(home, src.supplier_part(spark, sf_dir), brand)


@query(f"with {SP} select src, dst, 'supplies' as rel, w, round(w / sum(w) over (partition by dst), 9) as norm from sp")
def m11_edge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link's share of what enters its end."""
    links = src.supplier_part(spark, sf_dir).withColumn("rel", F.lit("supplies"))
    return metapath.edge_norms(links).withColumn("norm", F.round("norm", 9))


@query(
    """with c as (select 0 as pos, 'supplier' as ntype, count(*) as n from supplier union all select 1, 'part', count(*) from part union all select 2, 'nation', count(*) from nation)
select ntype, pos, n, cast(sum(n) over (order by pos) - n as bigint) as start from c"""
)
def m11_type_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each type starts when all are laid end to end."""
    counts = [src.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("pos"), F.lit(t).alias("ntype"), "n") for k, t in enumerate(("supplier", "part", "nation"))]
    return metapath.type_offsets(counts[0].unionByName(counts[1]).unionByName(counts[2]))


LINKS = ", ".join(f"('{t.name}', '{t.start}', '{t.end}')" for t in src.SUPPLY.link_types)


@query(
    f"""with recursive l(name, a, b) as (values {LINKS}),
paths as (select a as start, name as links, b as last, 1 as n, upper(left(a, 1)) || upper(left(b, 1)) as initials from l
  union all select p.start, p.links || ',' || l.name, l.b, p.n + 1, p.initials || upper(left(l.b, 1)) from paths p join l on l.a = p.last where p.n < 2)
select start, links, initials || reverse(left(initials, length(initials) - 1)) as label from paths where last <> start"""
)
def m9_half_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta-paths of the supply network with halves of up to two links."""
    return spark.createDataFrame([(s, ",".join(links), label) for s, links, label in metapath.half_paths(src.SUPPLY)], "start string, links string, label string")


CLASSES = "cls as (select p_partkey as nid, min(p_partkey) over (partition by p_brand, p_type) as class_id from part)"
TERMS = "terms as (select distinct p_partkey as nid, unnest(string_split(lower(p_name), ' ')) as term from part)"
SETS = "sets as (select c.nid, c.class_id, list_sort(list(t.term)) as ts from cls c join terms t on t.nid = c.nid group by 1, 2)"


def _term_query(measure: str, score: str):
    sql = f"with {CLASSES}, {TERMS}, {SETS}, p as (select a.class_id, a.nid as i, b.nid as j, len(list_intersect(a.ts, b.ts)) as c, len(a.ts) as ni, len(b.ts) as nj from sets a join sets b on a.class_id = b.class_id and a.nid < b.nid) select class_id, i, j, round({score}, 9) as score from p where c > 0"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = channels.term_scores(src.part_classes(spark, sf_dir), src.part_tokens(spark, sf_dir), measure)
        return ranking.rounded(found).drop("ntype")

    run.__name__, run.__doc__ = {"cosine": "k3_term_cosine", "jaccard": "k4_term_jaccard", "overlap": "k5_term_overlap"}[measure], f"Pairs of a candidate class with common words, by {measure}."
    return query(sql)(run)


k3_term_cosine = _term_query("cosine", "c / sqrt(ni * nj)")
k4_term_jaccard = _term_query("jaccard", "c / cast(ni + nj - c as double)")
k5_term_overlap = _term_query("overlap", "c / cast(least(ni, nj) as double)")

FEATS = "feats as (select p_partkey as nid, cast(p_size as double) as x, p_retailprice as y from part)"
ATTR = "greatest(-1.0, least(1.0, (a.x * b.x + a.y * b.y) / (sqrt(a.x * a.x + a.y * a.y) * sqrt(b.x * b.x + b.y * b.y))))"


@query(
    f"""with {CLASSES}, {TERMS}, {SETS}, {FEATS}
select a.class_id, a.nid as i, b.nid as j, round(len(list_intersect(a.ts, b.ts)) / sqrt(len(a.ts) * len(b.ts)), 9) as term_score, round({ATTR.replace('a.', 'f.').replace('b.', 'g.')}, 9) as attr_score
from sets a join sets b on a.class_id = b.class_id and a.nid < b.nid join feats f on f.nid = a.nid join feats g on g.nid = b.nid"""
)
def k6_channel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of each candidate class with both channels' scores."""
    found = classblocks.every_pair(src.part_classes(spark, sf_dir), src.part_tokens(spark, sf_dir), src.part_features(spark, sf_dir))
    return found.select("class_id", "i", "j", F.round("term_score", 9).alias("term_score"), F.round("attr_score", 9).alias("attr_score"))


@query(f"with {CLASSES}, {TERMS}, {SETS} select nid, class_id, min(nid) over (partition by class_id, ts) as group_id from sets")
def k7_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a class with equal sets of words."""
    return channels.exact_groups(src.part_classes(spark, sf_dir), src.part_tokens(spark, sf_dir)).drop("ntype")


# the reduced graph of the ranking queries: suppliers of a nation as one
NATION = "m as (select s_suppkey as nid, min(s_suppkey) over (partition by s_nationkey) as cid from supplier)"
BOTH = f"""{SP}, {PATHSIM.format(t='sp', out='o')}, {NATION},
q as (select m.cid as src, sp.dst, sum(sp.w) as w from sp join m on m.nid = sp.src group by 1, 2),
qn as (select src, sum(w * w) as n from q group by src),
qd as (select a.src as i, b.src as j, sum(a.w * b.w) as d from q a join q b on a.dst = b.dst group by 1, 2),
qs as (select d.i, d.j, round(2 * d.d / (x.n + y.n), 9) as score from qd d join qn x on x.src = d.i join qn y on y.src = d.j),
r as (select a.nid as i, b.nid as j, s.score from qs s join m a on a.cid = s.i join m b on b.cid = s.j),
grid as (select x.s_suppkey as i, y.s_suppkey as j from supplier x, supplier y where x.s_suppkey <> y.s_suppkey),
ab as (select g.i, g.j, coalesce(o.score, 0.0) as a, coalesce(r.score, 0.0) as b from grid g left join o on o.i = g.i and o.j = g.j left join r on r.i = g.i and r.j = g.j),
cnt as (select count(*) - 1 as n from supplier)"""


def _original(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    return metapath.pathsim(src.supplier_part(spark, sf_dir), best=best)


def _of_nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Similarities of the quotient by nation, a row for each pair of nations, and whom they are of."""
    mapping = src.supplier_nation(spark, sf_dir)
    links = src.supplier_part(spark, sf_dir).join(mapping.select(F.col("nid").alias("src"), "cluster_id"), "src")
    small = links.groupBy(F.col("cluster_id").alias("src"), "dst").agg(F.sum("w").alias("w"))
    return cut(metapath.pathsim(small)), mapping


def _measures(spark: SparkSession, sf_dir: str, keep_self: bool = False) -> DataFrame:
    """Measures of every supplier as a query."""
    return preserve.half_measures("pathsim", src.supplier_part(spark, sf_dir), *_of_nations(spark, sf_dir), keep_self=keep_self)


@query(f"with {BOTH} select i, j, score from r where score <> 0")
def m5_reduced_pathsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PathSim over the quotient by nation, given to all pairs of suppliers."""
    return ranking.rounded(metapath.expand(*_of_nations(spark, sf_dir)))


@query(
    f"""with {BOTH} select i, round(sum(abs(a - b)) / max(n), 6) as mae, round(quantile_cont(abs(a - b), 0.95), 6) as p95, round(quantile_cont(abs(a - b), 0.99), 6) as p99, round(max(abs(a - b)), 6) as maxe from ab, cnt group by i"""
)
def r9_errors_without_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the reduced similarities, the query itself left out."""
    found = _measures(spark, sf_dir)
    return found.select("i", *[F.round(c, 6).alias(c) for c in ("mae", "p95", "p99", "maxe")])


@query(
    f"""with {BOTH}, e as (select i, abs(a - b) as d from ab union all select s_suppkey, 0.0 from supplier) select i, round(sum(d) / count(*), 6) as mae, round(quantile_cont(d, 0.95), 6) as p95, round(quantile_cont(d, 0.99), 6) as p99, round(max(d), 6) as maxe from e group by i"""
)
def r8_errors_with_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the reduced similarities, the query itself as an entry without error."""
    found = _measures(spark, sf_dir, keep_self=True)
    return found.select("i", *[F.round(c, 6).alias(c) for c in ("mae", "p95", "p99", "maxe")])


@query(
    f"""with {BOTH}, k as (select i, j, row_number() over (partition by i order by a desc, j) as ra, row_number() over (partition by i order by b desc, j) as rb from ab)
select i, round(sum(case when ra <= kk and rb <= kk then 1.0 else 0.0 end) / max(kk), 9) as overlap from k, (select least(10, n) as kk from cnt) group by i"""
)
def r9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the top ten kept."""
    found = preserve.cluster_overlaps(cut(_original(spark, sf_dir, best=10)), *_of_nations(spark, sf_dir), (10,))
    return found.select("i", F.round("top10", 9).alias("overlap"))


@query(
    f"""with {BOTH}, e as (select i, abs(a - b) as d from ab union all select s_suppkey, 0.0 from supplier),
err as (select i, round(sum(d) / count(*), 6) as mae, round(quantile_cont(d, 0.95), 6) as p95, round(quantile_cont(d, 0.99), 6) as p99, round(max(d), 6) as maxe from e group by i),
k as (select i, j, a, row_number() over (partition by i order by a desc, j) as ra, row_number() over (partition by i order by b desc, j) as rb, avg(a) over (partition by i, b) as gb, avg(a) over (partition by i, a) as ga from ab),
firsts as (select i, {", ".join(f"round(count(*) filter (where greatest(ra, rb) <= least({x}, n)) / cast(max(least({x}, n)) as double), 9) as top{x}" for x in (1, 5, 10))},
  sum(ga / log2(ra + 1)) filter (where ra <= 10) as ideal, sum(gb / log2(rb + 1)) filter (where rb <= 10) as got from k, cnt group by i)
select err.*, top1, top5, top10, round(case when ideal > 1e-12 then got / ideal else 1.0 end, 6) as ndcg10 from err join firsts using (i)"""
)
def r8_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, shares of the first one, five and ten kept, and nDCG, in one call."""
    of_nations = _of_nations(spark, sf_dir)
    each = preserve.half_measures("pathsim", src.supplier_part(spark, sf_dir), *of_nations, keep_self=True)
    found = each.withColumnRenamed("ndcg", "ndcg10").join(preserve.cluster_overlaps(preserve.nearest_of(each), *of_nations, (1, 5, 10)), "i")
    digits = {c: 6 for c in ("mae", "p95", "p99", "maxe", "ndcg10")} | {c: 9 for c in ("top1", "top5", "top10")}
    return found.select("i", *[F.round(c, n).alias(c) for c, n in digits.items()])


def _weights(c: str) -> str:
    return f"case when {c} > k{c} then 1.0 when {c} = k{c} then (kk - above{c}) / ties{c} else 0.0 end"


@query(
    f"""with {BOTH}, kk as (select cast(least(10, n) as bigint) as kk from cnt),
k as (select i, j, a, b, row_number() over (partition by i order by a desc, j) as ra, row_number() over (partition by i order by b desc, j) as rb from ab),
t as (select i, max(case when ra = kk then a end) as ka, max(case when rb = kk then b end) as kb from k, kk group by i),
u as (select k.*, t.ka, t.kb, kk.kk, count(*) filter (where a > t.ka) over w as abovea, count(*) filter (where b > t.kb) over w as aboveb, count(*) filter (where a = t.ka) over w as tiesa, count(*) filter (where b = t.kb) over w as tiesb
  from k join t on t.i = k.i, kk window w as (partition by k.i))
select i, round(sum(least({_weights('a')}, {_weights('b')})) / max(kk), 6) as tie_overlap from u group by i"""
)
def r5_tie_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware share of the top ten kept."""
    return _measures(spark, sf_dir).select("i", F.round("tie_overlap", 6).alias("tie_overlap"))


@query(
    f"""with {BOTH}, g as (select i, j, a, row_number() over (partition by i order by a desc, j) as ra, row_number() over (partition by i order by b desc, j) as rb, avg(a) over (partition by i, b) as gb, avg(a) over (partition by i, a) as ga from ab),
d as (select i, sum(ga / log2(ra + 1)) filter (where ra <= 10) as ideal, sum(gb / log2(rb + 1)) filter (where rb <= 10) as got from g group by i)
select i, round(case when ideal > 1e-12 then got / ideal else 1.0 end, 6) as ndcg from d"""
)
def r4_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-averaged nDCG of the top ten."""
    return _measures(spark, sf_dir).select("i", F.round("ndcg", 6).alias("ndcg"))


@query(
    f"""with {BOTH}, e as (select i, a - b as d from ab union all select s_suppkey, 0.0 from supplier)
select i, case when max(abs(d)) > 1e-12 and stddev_samp(d) > 0 then round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) end as t from e group by i"""
)
def r6_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t statistic of original against reduced similarities."""
    return _measures(spark, sf_dir, keep_self=True).select("i", F.round("t", 5).alias("t"))


@query()
def r11_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of both similarities, averaged over queries."""
    half, mapping = src.supplier_part(spark, sf_dir), src.supplier_nation(spark, sf_dir)
    links = half.withColumn("ltype", F.lit("supplies"))
    small = quotient.quotient_links(links, mapping).drop("ltype")
    out = []
    for method in metapath.SIMILARITIES:
        reduced = cut(metapath.similarity(method, small))
        each = preserve.half_measures(method, half, reduced, mapping, keep_self=True)
        overlap = preserve.cluster_overlaps(preserve.nearest_of(each), reduced, mapping, (10,)).withColumnRenamed("top10", "overlap")
        out.append(ranking.average(each.join(overlap, "i").withColumn("method", F.lit(method)), "method"))
    return out[0].unionByName(out[1])


@query("select q from (select s_suppkey as q, row_number() over (order by md5('42:' || cast(s_suppkey as varchar)), s_suppkey) as k from supplier) where k <= 20")
def r13_sample_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty queries drawn by a seeded hash."""
    return ranking.sample_queries(src.table(spark, sf_dir, "supplier").select("s_suppkey"), 20)


@query(
    f"""with {SP}, {PATHSIM.format(t='sp', out='s')}, nat as (select s_suppkey as src, s_nationkey as dst from supplier),
o as (select i, j, score from s union all select a.src, b.src, 1.0 from nat a join nat b on a.dst = b.dst)
select i, j, round(sum(score) / 2, 8) as score from o group by 1, 2"""
)
def m7_mean_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean similarity over two meta-paths."""
    based = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit(1.0).alias("w"))
    scores = {"SPS": ranking.rounded(_original(spark, sf_dir)), "SNS": metapath.pathsim(based)}
    return metapath.combine(scores, "mean").withColumn("score", F.round("score", 8))
