"""Merkle manifests of a table: one root for all rows, and for each row the proof that it belongs.

Rows of a group (a source) are leaves in order; runs of `fanout` nodes become their parent until
one is left, the group's subroot; the subroots become the root in the same way. The tree is made
in superblocks: nodes of a group are dealt into buckets of fanout ** levels consecutive ones, a
task collapses `levels` levels of a bucket at a time and gives each of its nodes the lower part
of its proof, and the buckets' roots are the nodes of the next round. A bucket holds a bounded
number of digests whatever the group's size. At last the parts of each proof are joined.

Texts are read once, for their leaves. What moves afterwards are digests and ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hetweave.llm.common import cut, free_name, numbered_copies

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests of the siblings before and after a node in its run, end to end; one entry for a level.
STEP = "struct<before: binary, after: binary>"


def node_hash(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value, so that no two rows look alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column | str) -> Column:
    """The leaf of a row: the hash of its fields."""
    return node_hash(*[field(F.col(c) if isinstance(c, str) else c) for c in columns])


def indexed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with idx, their place from 0 in their group, and n, the group's size. Nulls come first.

    Rows are dealt into ranges of (by, order), which are sorted where they lie and written; only
    counts by range and group are summed beyond that, so a group of any size is spread. Rows
    that are equal in all of these columns should be told apart by one of them, or share a task.
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = cut(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33)))
    runs = ranged.groupBy(*by, "range").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy(*by)
    earlier = F.sum("rows").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("range").alias("of_range"), (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    same = F.col("range") == F.col("of_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return ranged.join(runs, same).withColumn("idx", F.col("row") + F.col("shift")).drop("row", "range", "shift", "of_range", *[f"of_{c}" for c in by])


def _collapse(digests: list[bytes], fanout: int, levels: int) -> tuple[bytes, list[list[dict]]]:
    """The node that `levels` levels above these consecutive ones, and each one's steps to it."""
    steps: list[list[dict]] = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    for _ in range(levels):
        hexes = [d.hex() for d in digests]
        parents, over = [], []
        for at in range(0, len(digests), fanout):
            run = digests[at : at + fanout]
            for k in range(len(run)):
                step = {"before": b"".join(run[:k]), "after": b"".join(run[k + 1 :])}
                for x in under[at + k]:
                    steps[x].append(step)
            parents.append(hashlib.sha256("".join(hexes[at : at + fanout]).encode()).digest())
            over.append([x for u in under[at : at + fanout] for x in u])
        digests, under = parents, over
    return digests[0], steps


def collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, idx, bucket, top, steps) of nodes (tree, idx, n, digest): one round of the reduction.

    A bucket is fanout ** levels consecutive nodes of a tree. top is the digest that replaces it,
    steps the siblings on the way there. A tree of fewer nodes ends where one is left, so one of a
    single node stays as it is.
    """
    span = fanout**levels

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        n, height = int(group.n.iloc[0]), 0
        while height < levels and fanout**height < n:
            height += 1
        top, steps = _collapse([bytes(d) for d in group.digest], fanout, height)
        return pd.DataFrame({"tree": group.tree, "idx": group.idx, "bucket": np.full(len(group), key[1]), "n": -(-group.n // span), "top": [top] * len(group), "steps": steps})

    dealt = nodes.select("tree", "idx", "n", "digest", F.floor(F.col("idx") / span).cast("long").alias("bucket"))
    return dealt.groupBy("tree", "bucket").applyInPandas(run, f"tree long, idx long, bucket long, n long, top binary, steps array<{STEP}>")


def reduce_trees(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of collapse() until each tree is one node; each round is written."""
    span, rounds = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not rounds:
        rounds.append(cut(collapse(nodes, fanout, levels)))
        most = -(-most // span)
        nodes = rounds[-1].where(F.col("idx") % span == 0).select("tree", F.col("bucket").alias("idx"), "n", F.col("top").alias("digest"))
    return rounds


def _paths(rounds: list[DataFrame]) -> DataFrame:
    """(tree, idx, steps, top): each first-round node's steps to its tree's top, lower and upper parts joined."""
    upper = rounds[-1].select("tree", "idx", "steps", "top")
    for lower in reversed(rounds[:-1]):
        above = upper.select("tree", F.col("idx").alias("bucket"), F.col("steps").alias("upper"), F.col("top").alias("end"))
        upper = lower.drop("top").join(above, ["tree", "bucket"]).select("tree", "idx", F.concat("steps", "upper").alias("steps"), F.col("end").alias("top"))
    return upper


def manifest(leaves: DataFrame, *, group: str = "source", order: tuple[str, ...] = ("doc_id",), leaf: str = "leaf", fanout: int = 3, levels: int = 6) -> tuple[DataFrame, str]:
    """leaves with a column (subroot, root, proof), and that column's name; proof leads from leaf to root.

    leaf holds lowercase hex digests, as subroot and root do. Groups are ordered by their bytes,
    null first; inside a group leaves go by `order`, nulls first, and ties by digest and then by
    the other columns. Rows that repeat each other in full are leaves of their own, side by side;
    they are counted before they are sent and numbered where they are dealt again, so a row with
    any number of copies is spread like others. An empty table has an empty manifest. All columns
    of `leaves` are carried along, so keep long texts out of it.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a run has two nodes at least, a round one level")
    name, own = free_name(leaves, "merkle"), leaves.columns
    short = {c: f"c{k}" for k, c in enumerate(own)}  # no name in here meets one of the caller's
    group, leaf, order = short[group], short[leaf], [short[c] for c in order]
    counted = cut(leaves.toDF(*short.values()).groupBy(*short.values()).agg(F.count("*").alias("copies")))
    single = numbered_copies(counted, "copies", "copy")
    rest = [c for c in short.values() if c not in (group, leaf, *order)]
    groups = indexed(counted.select(group).distinct(), [], [group]).select(F.col(group).alias("named"), F.col("idx").alias("tree"), F.col("n").alias("trees"))
    placed = indexed(single, [group], [*order, leaf, *rest, "copy"])
    placed = cut(placed.join(groups, F.col(group).eqNullSafe(F.col("named"))).drop("named", "trees", "copy"))
    rounds = reduce_trees(placed.select("tree", "idx", "n", F.unhex(leaf).alias("digest")), fanout, levels)
    tops = rounds[-1].where("idx = 0").select("tree", "top")
    subroots = cut(tops.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), F.col("top").alias("digest")))
    over = _paths(reduce_trees(subroots, fanout, levels)).select(F.col("idx").alias("tree"), F.col("steps").alias("upper"), F.col("top").alias("root"))
    # the few nodes of the last round take up the way to the root, lower rounds take it from them
    rounds[-1] = rounds[-1].join(over, "tree").select("tree", "idx", F.concat("steps", "upper").alias("steps"), F.struct(F.col("top").alias("subroot"), "root").alias("top"))
    found = placed.join(_paths(rounds), ["tree", "idx"])
    made = F.struct(_hex(F.col("top.subroot")).alias("subroot"), _hex(F.col("top.root")).alias("root"), F.col("steps").alias("proof"))
    return found.select(*[F.col(c).alias(o) for o, c in short.items()], made.alias(name)), name


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give; equal to the root if neither was changed."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(_hex(s["before"]), at, _hex(s["after"])).cast("binary"), 256))


def document_leaf(changed: Column | None = None, names: Iterable[str] = FIELDS) -> Column:
    """The leaf of a document; `changed` stands in for its text."""
    return leaf(*[changed if changed is not None and c == "text" else F.col(c) for c in names])
