"""Network archives: a ZIP with node, link, label and info files, and the sinks of results."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.network import LinkType, Network, NetworkConfig

LINES = 50_000
MEMBERS = ("node.dat", "link.dat", "label.dat", "label.dat.test", "info.dat")


def wanted(names: list[str]) -> dict[str, str]:
    """Member name of each file: below any folder, without what archivers of other systems add."""
    clean = [n for n in names if not n.startswith("__MACOSX") and "/._" not in n and not n.endswith(".DS_Store")]
    root = next((n[: -len("node.dat")] for n in sorted(clean, key=len) if n.endswith("node.dat")), None)
    if root is None:
        raise ValueError("the archive has no node.dat")
    return {m: root + m for m in MEMBERS if root + m in clean}


def member_lines(spark: SparkSession, path: str) -> DataFrame:
    """(member, line) of an archive at any path Spark can read; blank lines are left out.

    A ZIP is one stream, so a task reads one archive and sends its lines on in batches; more
    archives are read in parallel.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member, name in wanted(z.namelist()).items():
                        if member == "info.dat":
                            yield pd.DataFrame({"member": [member], "line": [z.read(name).decode("utf-8")]})
                            continue
                        block: list[str] = []
                        with z.open(name) as f:
                            for line in io.TextIOWrapper(f, "utf-8"):
                                if line.strip():
                                    block.append(line.rstrip("\r\n"))
                                if len(block) == LINES:
                                    yield pd.DataFrame({"member": member, "line": block})
                                    block = []
                        if block:
                            yield pd.DataFrame({"member": member, "line": block})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, line string")


def load_archive(spark: SparkSession, path: str, **layers) -> Network:
    """The network of an archive. layers are the fields of NetworkConfig that the file can't tell.

    Nodes: id, name, type and, of strong types, comma-separated features. Links: ends, type and
    weight (1 if absent). Labels: type and label in the last two fields. Types go by the names
    in info.dat, which layers may also give by number; links go by their numbers.
    """
    lines = member_lines(spark, path)
    info = json.loads(lines.where("member = 'info.dat'").first().line)  # the archive's schema
    types = {str(k): v for k, v in info["node.dat"]["node type"].items()}
    links = tuple(LinkType(str(k), types[str(v["start"])], types[str(v["end"])]) for k, v in sorted(info["link.dat"]["link type"].items(), key=lambda x: int(x[0])))
    named = lambda t: types.get(str(t), t)  # noqa: E731  types by number or by name
    for key in ("main_types", "semantic_types", "strong_types"):
        layers[key] = tuple(named(t) for t in layers.get(key, ()))
    layers |= {"target": named(layers["target"]), "term_paths": {named(t): tuple(p) for t, p in layers.get("term_paths", {}).items()}}
    config = NetworkConfig(link_types=links, **layers)
    config.check()
    name_of = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    part = F.split("line", "\t")
    field = lambda k: F.get(part, F.lit(k))
    rows = lines.where("member = 'node.dat'").select(field(0).cast("long").alias("nid"), field(1).alias("name"), name_of[F.trim(field(2))].alias("ntype"), field(3).alias("f"))
    nodes = rows.select("nid", "ntype", "name")
    feats = rows.where(F.col("ntype").isin(*config.strong_types) & (F.coalesce(F.trim("f"), F.lit("")) != ""))
    feats = feats.select("nid", "ntype", F.split("f", ",").cast("array<double>").alias("feat"))
    edge = lines.where("member = 'link.dat'").select(field(2).alias("ltype"), field(0).cast("long").alias("src"), field(1).cast("long").alias("dst"), F.coalesce(F.nullif(F.trim(field(3)), F.lit("")).cast("double"), F.lit(1.0)).alias("w"))
    n = F.size(part)
    label = lines.where("member in ('label.dat', 'label.dat.test')").select(field(0).cast("long").alias("nid"), name_of[F.trim(F.get(part, n - 2))].alias("ntype"), F.get(part, n - 1).alias("y"), F.when(F.col("member") == "label.dat", "train").otherwise("test").alias("split"))
    return Network(config, nodes, edge.withColumn("ltype", F.trim("ltype")), feats if config.strong_types else None, label)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists in its file system; FileNotFoundError if none does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(f"none of {candidates}")


def read_results(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A CSV of results with a header, types inferred, filtered by column = value (or any of a list)."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    for column, value in equal.items():
        df = df.where(F.lower(F.col(column).cast("string")).isin(*[str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]))
    return df


def write_results(df: DataFrame, path: str, *, overwrite: bool = False, fmt: str = "csv") -> None:
    """Results as CSV with a header, parquet or JSON; an existing path is an error unless overwritten."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_similarities(scores: DataFrame, path: str) -> DataFrame:
    """scores (dataset, path, matrix_type, i, j, score) as partitioned parquet; returns the manifest."""
    scores.write.mode("errorifexists").partitionBy("dataset", "path", "matrix_type").parquet(path)
    return scores.groupBy("dataset", "path", "matrix_type").agg(F.count("*").alias("pairs"), F.count_distinct("i").alias("rows"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def parse_list(text: str, kind=str) -> list:
    """Items of a comma list, trimmed, empty ones dropped."""
    return [kind(x.strip()) for x in text.split(",") if x.strip()]
