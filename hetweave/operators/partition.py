"""Structural candidate partitions: nodes that their core links can't tell apart."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetweave.lineage import cut


def entity_partition(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(ntype, nid, class_id): same type and the same set of neighbours under every core link.

    The fixed point of refinement by neighbour identities, which one grouping reaches: ids of
    neighbours already determine their classes. class_id is the class's least node. Weights and
    repeated links don't count; nodes without links of a type agree on its empty set.

    Neighbour sets are compared by their size and two 64-bit hashes that don't depend on order,
    so a hub's neighbours are hashed where they are read and never gathered.
    """
    signature = set_marks(links.select("ltype", "src", "dst").distinct(), "src", "ltype", "dst")
    marked = nodes.select("ntype", "nid").join(signature.withColumnRenamed("src", "nid"), "nid", "left").na.fill(0, list(MARKS))
    least = marked.groupBy("ntype", *MARKS).agg(F.min("nid").alias("class_id"))
    return marked.join(least, ["ntype", *MARKS]).select("ntype", "nid", "class_id")


MARKS = ("set_size", "set_hash", "set_mark")


def set_marks(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, set_size, set_hash, set_mark) of the distinct rows of each key: equal for equal sets of the columns."""
    return rows.groupBy(by).agg(F.count("*").alias(MARKS[0]), F.bit_xor(F.xxhash64(*columns)).alias(MARKS[1]), F.bit_xor(F.xxhash64(F.lit("mark"), *reversed(columns))).alias(MARKS[2]))


def counted_partition(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Counted bisimulation: nodes of a class have as many distinct neighbours in each other class.

    Returns the partition and its history (round, classes, changed). A round is a join, two
    groupings and a written table. Refinement only splits, so it ends, at the latest when every
    node is a class of its own: the loop has no other limit.
    """
    pairs = cut(links.select("ltype", "src", "dst").distinct())
    part = cut(nodes.select("ntype", "nid").join(nodes.groupBy("ntype").agg(F.min("nid").alias("class_id")), "ntype"))
    history, before = [], part.select("class_id").distinct().count()
    for n in count(1):
        new = refine(part, pairs)
        changed = new.join(part.select("nid", F.col("class_id").alias("old")), "nid").where("class_id <> old").count()
        classes = new.select("ntype", "class_id").distinct().count()
        history.append((n, classes, changed))
        part = new
        if classes == before and not changed:
            return part, history
        before = classes
    raise AssertionError("unreachable")


def refine(part: DataFrame, pairs: DataFrame) -> DataFrame:
    """One round: split classes by their members' counts of neighbours in each class."""
    ends = pairs.join(part.select(F.col("nid").alias("dst"), F.col("class_id").alias("there"), F.col("ntype").alias("t")), "dst")
    counts = ends.groupBy("src", "ltype", "t", "there").agg(F.count("*").alias("n"))
    seen = set_marks(counts, "src", "ltype", "t", "there", "n")
    marked = part.join(seen.withColumnRenamed("src", "nid"), "nid", "left").na.fill(0, list(MARKS))
    least = marked.groupBy("ntype", "class_id", *MARKS).agg(F.min("nid").alias("least"))
    return cut(marked.join(least, ["ntype", "class_id", *MARKS]).select("ntype", "nid", F.col("least").alias("class_id")))


def partition_summary(part: DataFrame) -> DataFrame:
    """Per type: nodes, classes, classes of more than one node, the largest, and the most that merging can save."""
    sizes = part.groupBy("ntype", "class_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("ntype").agg(
        F.sum("n").alias("nodes"),
        F.count("*").alias("classes"),
        F.sum((F.col("n") > 1).cast("long")).alias("merged_classes"),
        F.max("n").alias("largest"),
        (1 - F.count("*") / F.sum("n")).alias("upper_bound"),
    )


def mixed_partition(nodes: DataFrame, core_links: DataFrame, term_links: DataFrame) -> DataFrame:
    """The single-layer control: core links and all links of term paths refine together."""
    return entity_partition(nodes, core_links.unionByName(term_links).select("ltype", "src", "dst"))
