"""Networks over the test tables: link tables and channels by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.network import LinkType, Network, NetworkConfig

#: Node ids are unique over types: each type's keys start at its own base.
BASE = {"supplier": 0, "part": 10**12, "nation": 2 * 10**12, "region": 3 * 10**12, "customer": 4 * 10**12, "brand": 5 * 10**12, "ptype": 6 * 10**12, "token": 7 * 10**12, "vec": 8 * 10**12}

SUPPLY = NetworkConfig(
    target="supplier",
    main_types=("supplier", "part", "nation", "region"),
    link_types=(LinkType("supplies", "supplier", "part"), LinkType("supplied", "part", "supplier"), LinkType("based", "supplier", "nation"), LinkType("hosts", "nation", "supplier"), LinkType("within", "nation", "region")),
    core_links=("supplies", "supplied", "based", "hosts", "within"),
    half_paths={"SPS": ("supplies",), "SNS": ("based",), "SNRNS": ("based", "within")},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark so that any path Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src supplier, dst part, w line items)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, term): distinct lower-case words of part names."""
    words = F.explode(F.split(F.lower("p_name"), " "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), words.alias("term")).where("term <> ''").distinct()


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ntype, nid, class_id): parts of one brand and type."""
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("ntype"), F.col("p_partkey").alias("nid"), "p_brand", "p_type")
    least = part.groupBy("p_brand", "p_type").agg(F.min("nid").alias("class_id"))
    return part.join(least, ["p_brand", "p_type"]).select("ntype", "nid", "class_id")


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, feat): size and price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("feat"))


def supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ntype, nid, cluster_id): suppliers of a nation as one cluster."""
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("ntype"), F.col("s_suppkey").alias("nid"), "s_nationkey")
    return s.join(s.groupBy("s_nationkey").agg(F.min("nid").alias("cluster_id")), "s_nationkey").select("ntype", "nid", "cluster_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, y, vec) of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("nid"), F.col("label").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def supply_network(spark: SparkSession, sf_dir: str) -> Network:
    """Suppliers, parts, nations and regions with links both ways."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = lambda kind, c: (F.col(c).cast("long") + BASE[kind])
    node = lambda df, kind, c: df.select(key(kind, c).alias("nid"), F.lit(kind).alias("ntype"), F.col(c).cast("string").alias("name"))
    nodes = node(s, "supplier", "s_suppkey").unionByName(node(table(spark, sf_dir, "part"), "part", "p_partkey")).unionByName(node(n, "nation", "n_nationkey")).unionByName(node(table(spark, sf_dir, "region"), "region", "r_regionkey"))
    one = F.lit(1.0).alias("w")
    raw = table(spark, sf_dir, "lineitem")
    supplies = raw.select(F.lit("supplies").alias("ltype"), key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"), one)
    based = s.select(F.lit("based").alias("ltype"), key("supplier", "s_suppkey").alias("src"), key("nation", "s_nationkey").alias("dst"), one)
    within = n.select(F.lit("within").alias("ltype"), key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"), one)
    back = lambda df, name: df.select(F.lit(name).alias("ltype"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    links = supplies.unionByName(back(supplies, "supplied")).unionByName(based).unionByName(back(based, "hosts")).unionByName(within)
    return Network(SUPPLY, nodes, links)
