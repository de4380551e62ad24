"""Similarity channels between members of a candidate class.

A term channel is a table (nid, term) of distinct pairs, an attribute channel (nid, feat). A
channel that a type doesn't have is None and lets every pair pass; a node without terms, or with
a zero vector, is a member like others and scores by the rules below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hetweave.lineage import cut

#: Members of a class that meet as many in one task.
BLOCK = 1024
TERM_MEASURES = ("cosine", "jaccard", "overlap")


def term_channel(*links: DataFrame) -> DataFrame:
    """(nid, term) reached by a path of links, whatever the weights."""
    from hetweave.operators.metapath import reached

    return reached(*links).select(F.col("src").alias("nid"), F.col("dst").alias("term"))


def class_tiles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of rows (ntype, class_id, nid, *more) of a class: (ntype, class_id, i, j, more_i, more_j), i < j.

    A class is dealt into blocks of about `block` rows and each two blocks meet once, so a row is
    sent once for each block of its class, and no pair is sent anywhere.
    """
    key = ["ntype", "class_id"]
    more = [c for c in rows.columns if c not in (*key, "nid")]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    first = own.withColumn("high", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumnRenamed("own", "low")
    second = own.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).withColumnRenamed("own", "high")
    a = first.select(*key, "low", "high", F.struct("nid", *more).alias("a"))
    b = second.select(*key, "low", "high", F.struct("nid", *more).alias("b"))
    pairs = a.join(b, [*key, "low", "high"]).where("low < high or a.nid < b.nid")
    ahead = F.col("a.nid") < F.col("b.nid")
    i, j = F.when(ahead, F.col("a")).otherwise(F.col("b")), F.when(ahead, F.col("b")).otherwise(F.col("a"))
    pairs = pairs.where("a.nid <> b.nid").select(*key, i.alias("x"), j.alias("y"))
    return pairs.select(*key, F.col("x.nid").alias("i"), F.col("y.nid").alias("j"), *[F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in more for s, t in (("x", "i"), ("y", "j"))])


def equal_sets(members: DataFrame, terms: DataFrame) -> DataFrame:
    """(ntype, class_id, nid, n, point) of members with terms: those of a class with equal sets are one point, its least node.

    Sets are compared by size and two hashes of 64 bits that don't depend on order.
    """
    marks = terms.groupBy("nid").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("term")).alias("t1"), F.bit_xor(F.xxhash64(F.lit("term"), "term")).alias("t2"))
    rows = members.select("ntype", "class_id", "nid").join(marks, "nid")
    key = ["ntype", "class_id", "n", "t1", "t2"]
    return rows.join(rows.groupBy(*key).agg(F.min("nid").alias("point")), key).select("ntype", "class_id", "nid", "n", "point")


def term_scores(members: DataFrame, terms: DataFrame, measure: str = "cosine") -> DataFrame:
    """(ntype, class_id, i, j, score), i < j, of class members that share a term.

    Pairs without a common term score 0, but jaccard and overlap give 1 to two empty sets; those
    pairs are absent here, see scored_pairs. Equal sets of a class are scored once, and the scores
    of pairs of sets given to their members last, so that no pair of members is shuffled twice.
    """
    if measure not in TERM_MEASURES:
        raise ValueError(f"unknown term measure {measure!r}: {TERM_MEASURES}")
    same = cut(equal_sets(members, terms))
    points = same.where("nid = point").drop("point")
    rows = points.join(terms, "nid")
    a = rows.select("ntype", "class_id", "term", F.col("nid").alias("i"), F.col("n").alias("ni"))
    b = rows.select("ntype", "class_id", "term", F.col("nid").alias("j"), F.col("n").alias("nj"))
    both = a.join(b, ["ntype", "class_id", "term"]).where("i < j")
    common = both.groupBy("ntype", "class_id", "i", "j").agg(F.count("*").alias("c"), F.max("ni").alias("ni"), F.max("nj").alias("nj"))
    score = {"cosine": F.col("c") / F.sqrt(F.col("ni") * F.col("nj")), "jaccard": F.col("c") / (F.col("ni") + F.col("nj") - F.col("c")), "overlap": F.col("c") / F.least("ni", "nj")}[measure]
    scored = common.select("ntype", "class_id", "i", "j", F.least(score, F.lit(1.0)).alias("score"))
    if same.where("nid <> point").isEmpty():
        return scored
    own = points.select("ntype", "class_id", F.col("nid").alias("i"), F.col("nid").alias("j"), F.lit(1.0).alias("score"))
    left = scored.unionByName(own).join(same.select("ntype", "class_id", F.col("point").alias("i"), F.col("nid").alias("x")), ["ntype", "class_id", "i"])
    each = left.join(same.select("ntype", "class_id", F.col("point").alias("j"), F.col("nid").alias("y")), ["ntype", "class_id", "j"]).where("i <> j or x < y")
    return each.select("ntype", "class_id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "score")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; the shorter one counts as padded with zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where either vector is zero or missing."""
    return cosine_of(dot(a, b), norm(a), norm(b))


def cosine_of(inner: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine() from the inner product and both norms."""
    length = norm_a * norm_b
    return F.coalesce(F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner / length))), F.lit(0.0))


def scored_pairs(members: DataFrame, terms: DataFrame | None, features: DataFrame | None, measure: str = "cosine") -> DataFrame:
    """Every pair of a class with term_score and attr_score; null where a channel is off.

    Terms and vectors go with the nodes into the tiles of class_tiles, and pairs are scored there.
    """
    if measure not in TERM_MEASURES:
        raise ValueError(f"unknown term measure {measure!r}: {TERM_MEASURES}")
    rows = members.select("ntype", "class_id", "nid")
    term_score = attr_score = F.lit(None).cast("double")
    if terms is not None:
        held = terms.join(rows.select("nid"), "nid", "left_semi").groupBy("nid").agg(F.collect_list("term").alias("terms"), F.count("*").alias("n"))
        rows = rows.join(held, "nid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        c, ni, nj = F.size(F.array_intersect("terms_i", "terms_j")), F.col("n_i"), F.col("n_j")
        below = {"cosine": F.sqrt(ni * nj), "jaccard": ni + nj - c, "overlap": F.least(ni, nj)}[measure]
        score = F.when((ni > 0) & (nj > 0), F.least(c / below, F.lit(1.0)))
        if measure != "cosine":
            score = score.when((ni == 0) & (nj == 0), 1.0)
        term_score = score.otherwise(0.0)
    if features is not None:
        rows = rows.join(features.select("nid", "feat", norm(F.col("feat")).alias("norm")), "nid", "left")
        attr_score = cosine_of(dot(F.col("feat_i"), F.col("feat_j")), F.col("norm_i"), F.col("norm_j"))
    return class_tiles(rows).select("ntype", "class_id", "i", "j", term_score.alias("term_score"), attr_score.alias("attr_score"))


def exact_groups(members: DataFrame, terms: DataFrame) -> DataFrame:
    """(ntype, class_id, nid, group_id): equal sets of terms; nodes without terms stay alone."""
    sets = terms.groupBy("nid").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("term"))), 256).alias("key"))
    rows = members.join(sets, "nid", "left").withColumn("key", F.coalesce("key", F.concat(F.lit("alone "), F.col("nid").cast("string"))))
    least = rows.groupBy("ntype", "class_id", "key").agg(F.min("nid").alias("group_id"))
    return rows.join(least, ["ntype", "class_id", "key"]).select("ntype", "class_id", "nid", "group_id")
