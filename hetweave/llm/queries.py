"""One query for each training-data operator, over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.llm import chat, decontaminate, embeddings, filter_audit, fingerprints, html_text, merkle, mixing, pii, quality, sharding, simhash, url_filter
from hetweave.llm.common import table

SCORE_AT_LEAST = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a benchmark window covers, and the items that it meets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    c = F.col(name)
    longest = F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["n_words"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ",").cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
        longest.alias("longest_match"),
    )


OP1_SQL = """
with w as (
  select 'b' as kind, row_number() over () as rid, cast(item_id as varchar) as id, text from benchmark where item_id is not null
  union all select 'd', row_number() over (), cast(doc_id as varchar), text from documents
),
t as (
  select kind, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from w
),
windows as (
  select id as item_id, k, least(10, len(words)) as n, array_to_string(words[k + 1 : k + least(10, len(words))], ' ') as gram
  from t, unnest(range(greatest(len(words) - 9, 1))) as u(k) where kind = 'b' and len(words) > 0
),
grams as (
  select rid, p, n, array_to_string(words[p + 1 : p + n], ' ') as gram
  from t, (select distinct n from windows) as l, unnest(range(greatest(len(words) - n + 1, 0))) as u(p) where kind = 'd'
),
met as (select g.rid, g.p, g.n, v.item_id, v.k from grams g join windows v on v.n = g.n and v.gram = g.gram),
hit as (select rid, count(distinct x) as n_hit from met, unnest(range(p, p + n)) as u(x) group by rid),
ids as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct rid, item_id from met) group by rid),
stretch as (
  select rid, max(p) - min(p) + max(n) as n from (
    select rid, item_id, p, n, k - p as diagonal, p - row_number() over (partition by rid, item_id, k - p order by p) as island from met
  ) group by rid, item_id, diagonal, island
)
select cast(t.id as bigint) as doc_id, cast(len(t.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  sha256(coalesce(i.items, '')) as items_sha256, h.n_hit is not null as contaminated, cast(coalesce(s.n, 0) as bigint) as longest_match
from t left join hit h using (rid) left join ids i using (rid) left join (select rid, max(n) as n from stretch group by rid) s using (rid)
where t.kind = 'd'
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.FactorisationMachine:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = quality.with_scores(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= SCORE_AT_LEAST).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of each document, and its place there."""
    return shard_table(table(spark, sf_dir, "documents"))


def shard_table(docs: DataFrame) -> DataFrame:
    """Shard of each row by the law of bytes; the map that placed it is written and read back."""
    placed, plan = sharding.assign_shards(docs, 8, store=sharding.new_store(docs.sparkSession))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(plan.version).alias("map_version"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    pages, name = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the rendered conversations after role repair."""
    return chat.repair_roles(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries active for each page when it was fetched."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_on", url_filter.fetch_date(F.col("page_id")))
    found, name = url_filter.filter_urls(captures, url_filter.default_list(spark), fetched="fetched_on")
    a = F.col(name)
    return found.select(
        "page_id",
        "url",
        "fetched_on",
        url_filter.url_host(F.col("url")).alias("host"),
        F.size(a).cast("long").alias("n_active"),
        F.array_join(F.transform(a, lambda e: F.concat_ws("@", e["key"], e["valid_from"].cast("string"))), ",").alias("entries"),
        (F.size(a) > 0).alias("blocked"),
    )


OP7_SQL = f"""
with history(key, action, day, category) as (values {", ".join(f"('{k}', '{a}', date '{d}', '{c}')" for k, a, d, c in url_filter.DEFAULT_LIST)}),
spans as (
  select key, category, day as valid_from, action, lead(day) over (partition by key, category order by day, action = 'remove') as valid_to from history
),
captures as (
  select page_id, url, cast(date '2024-01-01' + cast(((page_id % 366) + 366) % 366 as integer) as date) as fetched_on,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:@]*)', 1), '\\.+$', ''), '') as host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) as path
  from pages
),
met as (
  select c.page_id, s.key, s.valid_from, s.category, s.valid_to
  from captures c join spans s on s.action = 'add' and c.fetched_on >= s.valid_from and (s.valid_to is null or c.fetched_on < s.valid_to)
    and case when strpos(s.key, '/') = 0 then c.host = s.key or ends_with(c.host, '.' || s.key)
        else starts_with(c.host || regexp_replace(c.path, '/+', '/', 'g') || '/', s.key || '/') end
)
select c.page_id, c.url, c.fetched_on, c.host, coalesce(m.n, 0) as n_active, coalesce(m.entries, '') as entries, m.n is not null as blocked
from captures c left join (
  select page_id, count(*) as n, string_agg(key || '@' || cast(valid_from as varchar), ',' order by key, category, valid_from) as entries from met group by page_id
) m on m.page_id = c.page_id
"""


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93
),
walk as (
  with recursive r(node, reached) as (select a, b from links union select r.node, l.b from r join links l on l.a = r.reached) select node, min(reached) as least from r group by node
)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(w.least, e.vec_id)) as component_id, e.vec_id <= coalesce(w.least, e.vec_id) as kept
from embeddings e left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id left join walk w on w.node = e.vec_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in each document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s, k=k: s["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in training order: words that the mixture takes of each, and when it comes up."""
    plan = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), "passes")


OP10_SQL = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5(concat(coalesce(cast(doc_id as varchar), ''), ':', md5(coalesce(text, '')))) as key from documents
),
s as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
    row_number() over (order by source nulls last) as rank from d group by source
),
l as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight::double, rank rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(weight) over () - coalesce(sum(weight) over (order by 2 * source_size / weight::double, rank rows between unbounded preceding and 1 preceding), 0))::double as level
  from s
),
f as (select arg_min(level, (2 * source_size / weight::double, rank)) as level from l where level <= 2 * source_size / weight::double),
t as (
  select l.source, l.source_size, l.rank, least(2.0::double * l.source_size, coalesce(l.weight * f.level, 2.0::double * l.source_size)) as target from l, f
),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.rank, floor(t.target)::bigint as demand,
    (sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size)::bigint as first
  from d join t on d.source is not distinct from t.source
),
p as (
  select *, case when first < demand then first / target end as share,
    case (rank - 1) % 3 when 0 then 1.0::double when 1 then 0.5::double else 1.5::double end as w,
    case (rank - 1) % 3 when 0 then 0.0::double when 1 then 1.0::double else -1.0::double end as slope
  from r
)
select doc_id, size::bigint as size, source_size, target,
  (least(size, greatest(demand - first, 0)) + least(size, greatest(demand - source_size - first, 0)))::bigint as taken,
  round(least(case when share > 0 then 2 * share / (w + sqrt(greatest(w * w + 2 * slope * share, 0))) else coalesce(share, 1.0::double) end, 1.0::double), 9) as position,
  ((size > 0 and first < demand)::int + (size > 0 and first + source_size < demand)::int)::int as passes
from p
"""

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as first,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
l as (select doc_id, max((quality = 1)::int) as q, max((toxic = 1)::int) as t from labels where doc_id is not null group by doc_id),
f as (
  select part, coalesce(l.q, 0) as q, coalesce(l.t, 0) as t,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first, false)::int as mask
  from d left join l on l.doc_id = d.doc_id
),
c as (select part, mask, count(*) as n, sum(q) as good, sum(t) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
s as (select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as before from o, unnest(range(1, 6)) as u(k)),
r as (
  select part, filter_order, step, bit, coalesce(sum(n) filter (where mask & (before | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & bit > 0 and mask & before > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost
  from c, s group by 1, 2, 3, 4
)
select part, filter_order, cast(step as integer) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and the root that its tampered text would give."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.document_leaf().alias("leaf"), merkle.document_leaf(tampered).alias("now"))
    found, name = merkle.manifest(leaves)
    m = F.col(name)
    found = found.select("doc_id", "leaf", m["subroot"].alias("subroot"), m["root"].alias("root"), merkle.proof_hash(m["proof"]).alias("proof_sha256"), merkle.fold(F.col("now"), m["proof"]).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _levels_sql(name: str, start: str) -> str:
    """Nodes (g, lvl, idx, n, digest) of all levels over those of `start`."""
    return f"""{name} as (
  select * from {start}
  union all select g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by idx)) from {name} where n > 1 group by g, lvl, idx // 3, (n + 2) // 3
)"""


_CRC_SQL = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)), lambda c, x: list_reduce([xor(c, x)::bigint] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
OP12_SQL = f"""
with recursive d as (
  select doc_id, source, lang, n_chars, text, case when xor({_CRC_SQL}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as changed from documents
),
h as (
  select row_number() over () as rid, doc_id, source, sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) as leaf,
    sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "changed")))}) as now from d
),
l as (
  select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, leaf, now, rid) - 1 as idx, count(*) over (partition by source) as n from h
),
leaves as (select g, 0 as lvl, idx, n, leaf as digest from l),
{_levels_sql("up", "leaves")},
subs as (select 0 as g, 0 as lvl, g as idx, count(*) over () as n, digest from up where n = 1),
{_levels_sql("top", "subs")},
sib as (
  select l.rid, u.lvl, u.idx, u.idx < l.idx // (3 ** u.lvl)::bigint as earlier, u.digest from l join up u on u.g = l.g and u.n > 1 and u.idx // 3 = l.idx // (3 ** (u.lvl + 1))::bigint and u.idx <> l.idx // (3 ** u.lvl)::bigint
  union all
  select l.rid, 1000 + u.lvl, u.idx, u.idx < l.g // (3 ** u.lvl)::bigint, u.digest from l join top u on u.n > 1 and u.idx // 3 = l.g // (3 ** (u.lvl + 1))::bigint and u.idx <> l.g // (3 ** u.lvl)::bigint
),
levels as (
  select rid, lvl, row_number() over (partition by rid order by lvl) as k from (
    select distinct l.rid, u.lvl from l join up u on u.g = l.g and u.n > 1 union select distinct l.rid, 1000 + u.lvl from l join top u on u.n > 1
  )
),
steps as (
  select v.rid, v.k, coalesce(string_agg(s.digest, '' order by s.idx) filter (where s.earlier), '') as before, coalesce(string_agg(s.digest, '' order by s.idx) filter (where not s.earlier), '') as after
  from levels v left join sib s on s.rid = v.rid and s.lvl = v.lvl group by 1, 2
),
fold as (
  select rid, 0 as k, now as acc from l union all select f.rid, f.k + 1, sha256(s.before || f.acc || s.after) from fold f join steps s on s.rid = f.rid and s.k = f.k + 1
),
proofs as (select rid, string_agg(before || after, '' order by k) as p from steps group by rid)
select l.doc_id, l.leaf, s.digest as subroot, t.digest as root, sha256(coalesce(p.p, '')) as proof_sha256, f.acc as folded_root, f.acc = t.digest as verified
from l join subs s on s.idx = l.g join top t on t.n = 1 left join proofs p on p.rid = l.rid join (select rid, arg_max(acc, k) as acc from fold group by rid) f on f.rid = l.rid
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprint of each document and of its edited text, and what they share."""
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_html_text": op5_html_text,
    "op6_chat_repair": op6_chat_repair,
    "op7_url_filter": op7_url_filter,
    "op8_embeddings": op8_embeddings,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op7_url_filter": OP7_SQL, "op8_embeddings": OP8_SQL, "op10_mixing": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle": OP12_SQL}
