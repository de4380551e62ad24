"""Quotient graphs: links between clusters, and how much smaller they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hetweave.operators.metapath import compose


def quotient_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """links (ltype, src, dst, w) between clusters, weights summed; unmapped nodes stay themselves."""
    of = mapping.select("nid", "cluster_id")
    rows = links.join(of.toDF("src", "cs"), "src", "left").join(of.toDF("dst", "cd"), "dst", "left")
    return rows.groupBy("ltype", F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")).agg(F.sum("w").alias("w"))


def reduced_half_path(links: DataFrame, mapping: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """The half-path over the quotient: every relation is reduced before it is composed."""
    small = quotient_links(links.where(F.col("ltype").isin(*path)), mapping)
    return compose(*[small.where(F.col("ltype") == name).select("src", "dst", "w") for name in path])


def reduction_by_type(mapping: DataFrame) -> DataFrame:
    """(ntype, nodes, clusters, ratio)."""
    return mapping.groupBy("ntype").agg(F.count("*").alias("nodes"), F.count_distinct("cluster_id").alias("clusters"), (1 - F.count_distinct("cluster_id") / F.count("*")).alias("ratio"))


def reduction_ratios(mapping: DataFrame, semantic_nodes: int, raw_links: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes and links before and after, over main types and over all.

    Links before are raw rows, repeats included; after, distinct links of the quotient.
    """
    nodes = reduction_by_type(mapping).agg(F.sum("nodes").alias("main_nodes"), F.sum("clusters").alias("reduced_main_nodes"))
    before = raw_links.agg(F.count("*").alias("original_edges"))
    after = quotient_links(links, mapping).agg(F.count("*").alias("reduced_edges"))
    row = nodes.join(before).join(after)  # three tables of one row
    row = row.withColumn("full_nodes", F.col("main_nodes") + semantic_nodes).withColumn("reduced_full_nodes", F.col("reduced_main_nodes") + semantic_nodes)

    def saved(after: str, before: str):
        return F.when(F.col(before) > 0, 1 - F.col(after) / F.col(before)).otherwise(0.0)

    return row.withColumns(
        {
            "main_reduction_ratio": saved("reduced_main_nodes", "main_nodes"),
            "fullgraph_reduction_ratio": saved("reduced_full_nodes", "full_nodes"),
            "fullgraph_edge_reduction_ratio": saved("reduced_edges", "original_edges"),
        }
    )


def cluster_means(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cluster_id, dim, value): the mean of members' vectors, members without one as zeros.

    features has (nid, feat); the result is in long form, so a wide vector is no wide row.
    """
    sizes = mapping.groupBy("cluster_id").agg(F.count("*").alias("n"))
    long = mapping.select("nid", "cluster_id").join(features.select("nid", F.posexplode("feat").alias("dim", "x")), "nid")
    return long.groupBy("cluster_id", "dim").agg(F.sum("x").alias("s")).join(sizes, "cluster_id").select("cluster_id", "dim", (F.col("s") / F.col("n")).alias("value"))


def with_singletons(mapping: DataFrame, *others: DataFrame) -> DataFrame:
    """The mapping with further nodes (ntype, nid) as clusters of their own."""
    return reduce(DataFrame.unionByName, [o.select("ntype", "nid", F.col("nid").alias("cluster_id")) for o in others], mapping.select("ntype", "nid", "cluster_id"))
