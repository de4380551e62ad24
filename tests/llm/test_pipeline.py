"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from hetweave.llm import quality, queries, sharding


def test_stages(spark, docs, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    text = docs.where("doc_id = 5").first().text
    spark.createDataFrame([(1, text), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        after = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "quality":
            scored, score = quality.with_scores(now, queries.quality_model(spark, d, now))
            assert after == Counter((r.doc_id, r.text) for r in scored.where(F.col(score) >= 0.3).collect())
        if name == "near_duplicates":
            sets = [brute.shingles(t) for _, t in before]
            roots = brute.components(len(before), lambda a, b: brute.alike(sets[a], sets[b]))  # noqa: B023
            least = {r: min((before[k][0] for k in range(len(before)) if roots[k] == r and before[k][0] is not None), default=None) for r in set(roots)}
            assert Counter(i for i, _ in after.elements()) == Counter(least.values())
        if name == "decontamination":
            clean = {w[0]: not w[-1] for w in brute.contamination(before, [(1, text), (2, None)])}
            assert after == Counter(b for b in before if clean[b[0]])
        if name == "mixing":
            assert set(after) <= set(before) and max(after.values()) <= 2
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, d)
    loads = [r[1] for r in last.groupBy("shard").agg(F.sum("size")).collect()]
    assert last.count() == now.count() and sum(loads) == now.agg(F.sum(sharding.size_of(F.col("text")))).first()[0]


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_plain_versions(spark, docs, wide, tmp_path):
    """run() end to end: what each stage keeps by the plain versions, and the law of shards."""
    import zlib

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    text = docs.where("doc_id = 5").first().text
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    whole = spark.read.parquet(f"{d}/documents.parquet")
    scored, score = quality.with_scores(whole, queries.quality_model(spark, d, whole))
    rows = [(r.doc_id, r.text, r.source) for r in scored.where(F.col(score) >= 0.3).collect()]
    sets = [brute.shingles(t) for _, t, _ in rows]
    roots = brute.components(len(rows), lambda a, b: brute.alike(sets[a], sets[b]))
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    kept = [rows[min((k for k in range(len(rows)) if roots[k] == r), key=order)] for r in sorted(set(roots))]
    clean = {w[0]: not w[-1] for w in brute.contamination([r[:2] for r in kept], [(1, text)])}
    kept = [r for r in kept if clean[r[0]]]
    times = brute.passes(kept)
    want = Counter()
    for i, t, _ in kept:
        want[i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())] += times[i, t]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == +want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_stages_with_own_columns(spark, wide, tmp_path):
    """Columns beside those of documents pass through the stages that filter and mix, whatever their names."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    wide.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality")).write.parquet(f"{d}/labels.parquet")
    extra = wide.withColumns({c: F.lit("mine") for c in ("kept_hash", "row_hash", "size", "position")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, d)
        assert out.columns == extra.columns, name
        assert {r.row_hash for r in out.select("row_hash").distinct().collect()} <= {"mine"}, name
        assert stage(spark, extra.limit(0), d).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, extra.limit(0), d).count() == 0


def test_run_of_no_documents(spark, none, tmp_path):
    d = str(tmp_path)
    none.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
