"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint holds the majority of each bit over the XXH64 hashes of a text's word
shingles. Two fingerprints within the radius r must meet in a table: give each bit position a
nonzero vector of r + 1 bits, and let mask v keep the positions whose vector has an odd product
with v. Any r positions leave some v orthogonal to all their vectors, so under mask v the
differing bits vanish. 2 ** (r + 1) - 1 tables thus miss no pair, whatever the data.

Equal fingerprints are one point, however many rows hold them. Pairs are compared only inside
buckets of a bounded size. In a larger bucket the points meet through their neighbours instead:
for r = 2 each point names itself and the 64 fingerprints one bit away, and two points name a
common one exactly if they differ in 2 bits or fewer. So a bucket of any size costs work in
proportion to its points, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import add_column, connected_components, cut, free_name, small_batches, text_buffer

BITS = 64
SLICE = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[len(parts) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, SLICE):
        bits = np.unpackbits(hashes[k : k + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> tuple[DataFrame, str]:
    """docs with a column of signed 64-bit fingerprints, and that column's name.

    Null and empty texts, and those of white space only, have fingerprint 0. A text of fewer
    words than a shingle is one shingle. All other columns pass through.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.names.index(text)))
            view = data.tobytes()
            prints = [fingerprint(view[s:e], words) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield add_column(batch, name, pa.array(np.array(prints, np.uint64).view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])), name


def covering_masks(radius: int) -> list[int]:
    """The masks as unsigned integers; any `radius` bits are all outside at least one of them."""
    span = 1 << (radius + 1)
    vectors = [1 + k % (span - 1) for k in range(BITS)]  # each nonzero vector equally often
    return [sum(1 << k for k, p in enumerate(vectors) if (p & v).bit_count() % 2) for v in range(1, span)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(points: DataFrame, radius: int = 2, bucket: int = 64, column: str = "simhash") -> DataFrame:
    """Links (a, b) that join all points within the radius, directly or through what they share.

    points has distinct fingerprints. The components of these links are those of all pairs
    within the radius. In buckets of up to `bucket` points the links are the pairs themselves;
    for larger ones see the module's text (there b may be a fingerprint that no row holds).
    """
    if radius != 2:
        raise ValueError("larger buckets are linked through neighbours at distance 1, which fits radius 2 only")
    masks = covering_masks(radius)
    x = F.col(column)
    tables = points.select(x.alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("t"), x.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("s")).select("p", "s.t", "s.key")
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(tables.join(sizes, ["t", "key"]).select("p", "t", "key", "n"))
    small = shared.where(F.col("n") <= bucket)
    pairs = small.select(F.col("p").alias("a"), "t", "key").join(small.select(F.col("p").alias("b"), "t", "key"), ["t", "key"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b")
    hot = shared.where(F.col("n") > bucket).select("p").distinct()
    around = F.array(*[F.col("p").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)], F.col("p"))
    named = hot.select("p", F.explode(around).alias("q"))
    # a fingerprint that several points name joins them to the least of them
    first = named.groupBy("q").agg(F.min("p").alias("a"), F.count("*").alias("n")).where("n > 1")
    through = named.join(first, "q").where("p <> a").select("a", F.col("p").alias("b"))
    return pairs.unionAll(through).distinct()


def _classes(docs: DataFrame, doc_id: str, text: str, words: int, radius: int) -> DataFrame:
    """(doc_id, simhash, row_hash, root, component_id) of each row; root names the component in any case."""
    prints, name = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words)
    prints = cut(prints.select("doc_id", F.col(name).alias("simhash"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash")))
    points = cut(prints.groupBy("simhash").agg(F.min("doc_id").alias("rep")))
    found = connected_components(near_links(points, radius))
    joined = points.join(found, F.col("simhash") == F.col("node"), "left").select("simhash", "rep", F.coalesce("component", "simhash").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_point = joined.join(least, "root").select("simhash", "root", "component_id")
    return prints.join(of_point, "simhash").select("doc_id", "simhash", "row_hash", "root", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, simhash, component_id) of each row; component_id is the least id reachable by links.

    Rows link at fingerprints that differ in `radius` bits or fewer; equal ones always do, so
    all texts without words are linked to each other. Rows with a null id have a component but
    never name one; a component of null ids only is null. Repeated rows are each returned.
    """
    return _classes(docs, doc_id, text, words, radius).drop("root", "row_hash")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each component, that of its least id, with the columns of docs.

    See keep_one() for which row stays.
    """
    return keep_one(docs, _classes(docs, doc_id, text, words, radius), doc_id, text)


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay of their components: found has (doc_id, row_hash, root) of each.

    Which row stays is decided on ids and hashes: of a component the least id, null ids last,
    and of rows that share it the text of least hash; an id whose texts lie in several
    components may stay in each. Rows that repeat each other in id and text leave one. Texts
    move once: the join by id and hash and the choice among repeats share it.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("kept")
    kept = cut(found.groupBy("root").agg(least).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.row_hash").alias("kept_hash")))
    # keys that are never null: one partitioning serves the join and the choice among repeats
    names = {x: free_name(docs, x) for x in ("id_key", "row_hash", "kept_key", "kept_hash")}
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    kept = kept.select(key("kept_id").alias(names["kept_key"]), F.col("kept_hash").alias(names["kept_hash"])).distinct()
    own = docs.withColumns({names["id_key"]: key(doc_id), names["row_hash"]: F.xxhash64(F.coalesce(text, F.lit("")))})
    same = (F.col(names["id_key"]) == F.col(names["kept_key"])) & (F.col(names["row_hash"]) == F.col(names["kept_hash"]))
    return own.join(kept, same, "left_semi").dropDuplicates([names["id_key"], names["row_hash"]]).drop(names["id_key"], names["row_hash"])
