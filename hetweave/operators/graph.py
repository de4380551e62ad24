"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetweave.lineage import cut


#: Edges that a partition of a round holds, about.
EDGES = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in edges; component is the least node reachable.

    Alternating large-star and small-star steps: each step is an aggregation and a join on
    the edge list, and no node's neighbours are ever gathered. Every round is written to the
    checkpoint folder. Rounds grow with the logarithm of the longest chain. Edges with a null
    end are ignored; an empty edge list gives no rows.
    """
    rows = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    rows = cut(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        n, nodes = rows.agg(F.count("*"), F.count_distinct("u")).first()
        # by number of rows, dealt by u: grouping, join and distinct of a step read the same deal
        parts = max(1, n // EDGES)
        if n == nodes and rows.join(rows.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break  # every node hangs on a root, and steps keep each root the least of its component
        both = rows.unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").repartition(parts, "u").distinct())
        least = large.repartition(parts, "u").groupBy("u").agg(F.min("v").alias("m"))
        small = large.repartition(parts, "u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v")))
        rows = cut(small.where("u <> v").repartition(parts, "u").distinct())
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
