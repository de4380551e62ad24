"""Meta-path composition and the similarities over it.

A link table (src, dst, w) is a sparse matrix: composing is a join and a sum. A symmetric
meta-path is given by its half, so a similarity is the product of the half-path table with itself
over the path's middle. It is made in blocks of rows: links go to the blocks that share their
middle, and what a task sums never is a row. Norms go to all blocks, and queries filter the left
side only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.lineage import cut
from hetweave.network import NetworkConfig
from hetweave.operators import rowblocks

#: Rows and links of a block, about; terms of an inner product that a task holds at once.
BLOCK, BLOCK_LINKS, TERMS = 2048, 1_000_000, 1 << 22


def compose(*links: DataFrame) -> DataFrame:
    """(src, dst, w) of the chained links: sums over all path instances of products of weights.

    Each step is summed before the next, so intermediate rows are node pairs, not instances.
    """

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        return a.join(right, a.dst == right.mid).groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))

    return reduce(step, links)


def reached(*links: DataFrame) -> DataFrame:
    """(src, dst) joined by at least one instance of the path, weights aside."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        return a.join(right, a.dst == right.mid).select("src", F.col("to").alias("dst")).distinct()

    return reduce(step, [x.select("src", "dst") for x in links]).distinct()


def lengths(half: DataFrame) -> DataFrame:
    """(src, n, links) of rows: the sum of squares, and links."""
    found = half.groupBy("src").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("n"), F.count("*").alias("links"))
    return found.where("src is not null and n is not null")


def _sizes(half: DataFrame, right: DataFrame | None) -> DataFrame:
    """Written (src, n, own_n, links, cluster) of rowblocks.over_rows(), for targets without clusters."""
    found = lengths(half)
    if right is None:
        found = found.withColumn("own_n", F.col("n"))
    else:
        found = lengths(right).drop("links").join(found.withColumnRenamed("n", "own_n"), "src", "full").na.fill(0, ["n", "own_n", "links"])
    return cut(found.withColumn("cluster", F.lit(0).cast("long")))


def path_score(products: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(n + m > 0, 2 * products / np.where(n + m > 0, n + m, 1.0), 0.0)


def cosine_score(products: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    size = np.sqrt(n) * np.sqrt(m)
    return np.where(size == 0, 0.0, products / np.where(size == 0, 1.0, size))


SCORES = {"pathsim": path_score, "hetesim": cosine_score}


def _products(method: str, half: DataFrame, queries: DataFrame | None, right: DataFrame | None, best: int | None) -> DataFrame:
    """(i, j, score) of rows (src, dst, w) that share a dst; right None is half itself.

    Links are sent to the blocks of rows that share their dst (see rowblocks): they are shuffled, not
    the terms of the products. With best, pairs of a row with itself are left out, and of each row only
    what can be among its best that many is given.
    """
    own, to = half.schema["src"].dataType, (half if right is None else right).schema["src"].dataType
    sides, codes = [half] if right is None else [half, right], None
    if not all(rowblocks.as_long(x, "src") for x in sides):
        sides, codes = rowblocks.coded(*sides)
        if queries is not None:
            queries = queries.select(F.col("q").alias("src")).join(codes, "src").select(F.col("code").alias("q"))
    dims, asked = _sizes(sides[0], None if right is None else sides[1]), queries
    if right is not None and queries is not None:
        sides[0], asked = sides[0].join(queries.select(F.col("q").alias("src")), "src", "left_semi"), None
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("score", T.DoubleType())])
    give = rowblocks.all_scores if best is None else rowblocks.nearest_scores(best)
    found = rowblocks.over_rows(sides[0], None if right is None else sides[1], dims, SCORES[method], give, schema, BLOCK, BLOCK_LINKS, TERMS, queries=None if asked is None else asked.select(F.col("q").alias("src")))
    if codes is None:
        return found.select(F.col("i").cast(own).alias("i"), F.col("j").cast(to).alias("j"), "score") if (own, to) != (T.LongType(), T.LongType()) else found
    return found.join(codes.toDF("own", "i"), "i").join(codes.toDF("to", "j"), "j").select(F.col("own").alias("i"), F.col("to").alias("j"), "score")


def pathsim(half: DataFrame, queries: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(i, j, score) with 2 <B_i, B_j> / (|B_i|^2 + |B_j|^2); absent pairs score 0.

    queries (q) restricts i. Rows of only zeros score 0 and are absent. With best, only pairs i <> j
    are given, and of each i at least the best that many by rounded score, then j.
    """
    return _products("pathsim", half, queries, None, best)


def hetesim(half: DataFrame, queries: DataFrame | None = None, right: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(i, j, score): cosine of half-path rows. right is the other half where the path isn't symmetric.

    queries and best are those of pathsim().
    """
    return _products("hetesim", half, queries, right, best)


def hetesim_of_path(links: list[DataFrame], same_type: bool) -> DataFrame:
    """HeteSim of a whole path: from one type to itself it is split in the middle.

    The second half is turned round, so both halves end in the middle type whatever its size. A
    path between two types is compared as it is. A path from a type to itself needs even length.
    """
    if not same_type:
        return hetesim(compose(*links))
    if len(links) % 2:
        raise ValueError("a path from a type to itself needs an even number of links")
    mid = len(links) // 2
    back = [x.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") for x in reversed(links[mid:])]
    return hetesim(compose(*links[:mid]), right=compose(*back))


SIMILARITIES = {"pathsim": pathsim, "hetesim": hetesim}


def similarity(method: str, half: DataFrame, queries: DataFrame | None = None, best: int | None = None) -> DataFrame:
    if method not in SIMILARITIES:
        raise ValueError(f"unknown similarity {method!r}: {sorted(SIMILARITIES)}")
    return SIMILARITIES[method](half, queries, best=best)


def expand(reduced: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores of cluster pairs given to all pairs of their members, a cluster with itself included.

    mapping has (nid, cluster_id). Done last, after top-k where that is enough.
    """
    of = mapping.select("nid", "cluster_id")
    left = reduced.withColumnsRenamed({"i": "ci", "j": "cj"}).join(of.toDF("i", "ci"), "ci")
    return left.join(of.toDF("j", "cj"), "cj").select("i", "j", "score")


def combine(scores: dict[str, DataFrame], how: str) -> DataFrame:
    """Several paths' scores as features: concat gives (i, path, j, score), mean (i, j, score)."""
    every = reduce(DataFrame.unionByName, [s.select("i", F.lit(p).alias("path"), "j", "score") for p, s in sorted(scores.items())])
    if how == "concat":
        return every
    if how == "mean":
        return every.groupBy("i", "j").agg((F.sum("score") / len(scores)).alias("score"))
    raise ValueError(f"combine by concat or mean, not {how!r}")


def half_paths(config: NetworkConfig, max_length: int = 2) -> list[tuple[str, tuple[str, ...], str]]:
    """(start type, links, label) of core-link paths between main types that end in another type.

    Works on the schema, which is small. The label mirrors the types' initials.
    """
    out: dict[tuple[str, tuple[str, ...]], str] = {}
    for start in config.main_types:
        front: list[tuple[tuple[str, ...], tuple[str, ...]]] = [((), (start,))]
        for _ in range(max_length):
            front = [((*links, t.name), (*types, t.end)) for links, types in front for t in config.link_types if t.name in config.core_links and t.start == types[-1] and t.end in config.main_types]
            for links, types in front:
                if types[-1] != start:
                    initials = "".join(t[0].upper() for t in types)
                    out.setdefault((start, links), initials + initials[-2::-1])
    return [(s, links, label) for (s, links), label in out.items()]


def edge_norms(links: DataFrame) -> DataFrame:
    """links (src, dst, rel, w) with norm, the weight's share among those that enter dst by rel."""
    total = F.sum("w").over(Window.partitionBy("rel", "dst"))
    return links.withColumn("norm", F.col("w") / F.greatest(total, F.lit(1e-12)))


def type_offsets(counts: DataFrame) -> DataFrame:
    """(ntype, n, start) with each type's first index when types are laid end to end by pos."""
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a row for each type
    return counts.withColumn("start", F.sum("n").over(run) - F.col("n"))
