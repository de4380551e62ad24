"""Entity partitions by hashes of neighbour sets."""

from collections import defaultdict

from pyspark.sql import functions as F

from hetweave.operators import partition


def test_entity_partition_against_sets(spark):
    """Equal sets under several link types, repeated links, nodes without links, ids that are shared by types of links."""
    links = [("a", k, k % 4) for k in range(20)] + [("b", k, k % 3) for k in range(0, 20, 2)] + [("a", 4, 0)] * 2 + [("b", 21, 1), ("a", 22, 1)]
    nodes = [("x" if k < 12 else "y", k) for k in range(26)]
    got = partition.entity_partition(spark.createDataFrame(nodes, "ntype string, nid long"), spark.createDataFrame(links, "ltype string, src long, dst long"))
    near, least = defaultdict(set), {}
    for t, a, b in links:
        near[a].add((t, b))
    for t, k in nodes:
        least.setdefault((t, frozenset(near[k])), k)
    assert {r.nid: r.class_id for r in got.collect()} == {k: least[t, frozenset(near[k])] for t, k in nodes}


def test_a_hub_and_its_twin(spark):
    """Two nodes with a million common neighbours are a class; one neighbour less is another."""
    n = 1_000_000
    ends = spark.range(n).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, -2, -3)])).alias("src"), F.col("id").alias("dst"))
    links = ends.where("src <> -3 or dst <> 7").withColumn("ltype", F.lit("to"))
    nodes = spark.createDataFrame([("hub", -1), ("hub", -2), ("hub", -3)], "ntype string, nid long")
    assert {r.nid: r.class_id for r in partition.entity_partition(nodes, links).collect()} == {-1: -2, -2: -2, -3: -3}
