"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector o is rotated at random and each coordinate cut to its sign; the code o_bar of signs
over sqrt(D) is stored with the correction factor <o_bar, o>. For another unit vector q,
<o_bar, q> / <o_bar, o> estimates <o, q> without bias, and its error is bounded, with a
confidence that epsilon sets, by sqrt(1 - f^2) / f * epsilon / sqrt(D - 1) times the part of q
that is orthogonal to o. For a pair at the threshold that part is known, so a pair whose
estimate lies further below the threshold than the bound can't be a link and is done with. Only
for the points of the other pairs are the vectors fetched and compared in double precision.

What is stored for a point, once, is a record of a few bytes: its rotated coordinates in four
bits each, as bit planes of which the highest is the code, the factor and the step. As the coded
side of a pair the record gives its highest plane, as the query side all four, and the product of
the two is a few ANDs and counts of bits.

Which records meet is decided by the same kind of signs: keys of k bits from independent
rotations in L tables, L chosen so that a pair at the threshold is missed in all of them with
probability 1 - recall at most. k is chosen for each label by what pairs and records would cost;
how often two points of the label share k bits is measured on a bounded sample, so a label with
a crowded direction gets more bits where they part the crowd, and none where they don't. Every
row is indexed. Equal vectors are one point with a count. A bucket above TILE points is cut into
blocks, and each pair of blocks is a task of its own. Tasks return points, counts and a spanning
forest of the links found, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import connected_components, cut, small_batches

TILE = 2048
EPSILON = 6.0
SEED = 20
LEVELS = 16
#: Choosing k: points of the sample, bits looked at, tables they are counted in, and what a
#: record costs in units of a compared pair.
SAMPLE = 100_000
MOST_BITS = 30
PROBES = 2
RECORD_COST = 1500.0
#: Rows of a table up to which it is sent to all executors (a row is under 100 bytes).
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=64)
def rotation(dim: int, which: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, abs(which), int(which < 0)]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def code(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes as signs over sqrt(D), and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    signs = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, signs, (signs * turned).sum(axis=1)


def estimate(turned: np.ndarray, signs: np.ndarray, factors: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and each coded vector's error bound."""
    return (turned @ signs.T) / factors, epsilon * _spread(factors, signs.shape[1] - 1)


def _spread(factors: np.ndarray, freedom: int) -> np.ndarray:
    """The standard error of an estimate for a query orthogonal to the coded vector."""
    return np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(freedom, 1))


def turns(dim: int) -> int:
    """Rotations that a code joins: one, and more for vectors of fewer than 64 components."""
    return -(-64 // dim)


def record_type(dim: int) -> np.dtype:
    words = -(-turns(dim) * dim // 64)
    return np.dtype([("planes", np.uint64, (4, words)), ("factor", np.float32), ("step", np.float32)])


def records(unit: np.ndarray) -> np.ndarray:
    """The stored record of each unit vector."""
    n, dim = unit.shape
    r = turns(dim)
    turned = np.concatenate([unit @ rotation(dim, -1 - k) for k in range(r)], axis=1) / math.sqrt(r)
    step = np.maximum(np.abs(turned).max(axis=1), 1e-30) / (LEVELS / 2)
    level = np.clip(np.floor(turned / step[:, None]) + LEVELS // 2, 0, LEVELS - 1).astype(np.uint8)
    out = np.zeros(n, record_type(dim))
    room = out["planes"].shape[2] * 64
    for j in range(4):
        bits = np.zeros((n, room), np.uint8)
        bits[:, : r * dim] = level >> j & 1
        out["planes"][:, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    signs = np.where(level >= LEVELS // 2, 1.0, -1.0) / math.sqrt(r * dim)
    out["factor"], out["step"] = (signs * turned).sum(axis=1), step
    return out


def estimate_records(queries: np.ndarray, coded: np.ndarray, dim: int) -> np.ndarray:
    """Estimated inner products from stored records: ANDs of bit planes with codes, and counts."""
    m = turns(dim) * dim
    codes = coded["planes"][:, 3]
    total = np.zeros((len(queries), len(coded)), np.int32)
    for j in range(4):
        for w in range(codes.shape[1]):
            total += np.bitwise_count(queries["planes"][:, j, w][:, None] & codes[:, w][None, :]).astype(np.int32) << (j + 1)
    # coordinates are (level - 7.5) steps and code bits stand for +1 and -1
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    levels = sum(np.bitwise_count(queries["planes"][:, j]).sum(axis=1, dtype=np.int32) << j for j in range(4))
    middle = (LEVELS - 1) / 2
    inner = total - levels[:, None] - (middle * (2 * ones - m))[None, :]
    return inner * (queries["step"][:, None] / math.sqrt(m)) / coded["factor"][None, :]


def reach(queries: np.ndarray, coded: np.ndarray, dim: int, least: float, epsilon: float = EPSILON) -> np.ndarray:
    """How far below the threshold the estimate of a pair at or above it may lie."""
    turn = _spread(coded["factor"].astype(np.float64), turns(dim) * (dim - 1)) * math.sqrt(max(0.0, 1 - least * least))
    cut_off = queries["step"].astype(np.float64)[:, None] / math.sqrt(12) / coded["factor"][None, :]
    return epsilon * np.sqrt(turn[None, :] ** 2 + cut_off**2)


def tables_needed(least: float, bits: int, recall: float) -> int:
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """An integer of `bits` signs for each table; tables share a rotation while it has fresh ones."""
    dim = unit.shape[1]
    each = max(1, dim // max(bits, 1))
    out = np.zeros((len(unit), tables), np.int64)
    for t in range(tables):
        if t % each == 0:
            turned = unit @ rotation(dim, 1 + t // each) >= 0
        columns = [(t % each * bits + b) % dim for b in range(bits)]
        out[:, t] = turned[:, columns] @ (1 << np.arange(bits)) if bits else 0
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n points reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _vectors(column: pa.Array, dims: np.ndarray, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of a column of lists without nulls."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(dims)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.stack([values[ends[i] - dim : ends[i]] for i in at])


def _bits(sound: DataFrame, least: float, recall: float, kind: type, sample: int, tile: int) -> DataFrame:
    """(label, dim, k): the bits of the keys of each label, of least cost.

    A table costs its records, which go to as many tiles as a bucket has blocks, and its pairs.
    The share of pairs that meet is what the sample's distinct points of the label show, at
    least half of what evenly spread points would.
    """
    sizes = sound.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sound.count()
    share = min(1.0, sample / max(total, 1))
    some = sound.where(F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else sound
    some = some.dropDuplicates(["label", "h1", "h2"]).select("label", "dim", "e")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for _, at, raw in _vectors(batch.column(2), dims, kind):
                found = keys(_units(raw), MOST_BITS, PROBES)
                part = batch.take(pa.array(at)).select(["label", "dim"])
                for t in range(PROBES):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), t)), pa.array(found[:, t])], names=["label", "dim", "t", "key"])

    shape = T.StructType([*some.select("label", "dim").schema.fields, T.StructField("t", T.LongType()), T.StructField("key", T.LongType())])
    full = some.mapInArrow(probe, shape).groupBy("label", "dim", "t", "key").agg(F.count("*").alias("c"))
    each = full.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(0, MOST_BITS + 1, 2)])))
    each = each.groupBy("label", "dim", "k", "t", F.expr("pmod(key, shiftleft(1L, k))").alias("key")).agg(F.sum("c").alias("c"))
    met = each.groupBy("label", "dim", "k").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("met"), (F.sum("c") / PROBES).alias("s"))
    met = met.join(sizes, ["label", "dim"])
    pairs = F.greatest(F.when(F.col("s") > 1, F.col("met") / (F.lit(float(PROBES)) * F.col("s") * (F.col("s") - 1))), F.lit(0.5) / F.pow(F.lit(2.0), F.col("k")))
    tables = F.element_at(F.array(*[F.lit(float(tables_needed(least, k, recall))) for k in range(MOST_BITS + 1)]), F.col("k") + 1)
    crowd = F.col("n") * pairs
    cost = tables * (crowd / 2 + F.lit(RECORD_COST) * F.greatest(F.lit(1.0), crowd / tile))
    best = met.groupBy("label", "dim").agg(F.min(F.struct(cost.alias("cost"), "k"))["k"].alias("k"))
    even = F.greatest(F.lit(0), F.round(F.log2(F.col("n") / tile)).cast("int"))
    return sizes.join(best, ["label", "dim"], "left").select("label", "dim", F.coalesce("k", F.least(even, F.lit(MOST_BITS))).alias("k"))


def _few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = 0.93,
    recall: float = 0.999,
    tile: int = TILE,
    bits: int | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows with equal labels link at a cosine of at least `least`. n_links counts the other rows
    linked directly, copies included; component_id is the least id reachable by links. recall is
    the chance, for a pair at the threshold itself, that some table holds it; closer pairs are
    missed more rarely, equal vectors never. bits fixes the keys' bits; else each label has its
    own, chosen on `sample` rows at most.

    Rows whose label is null, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing: 0 links, their own component, kept. Vectors of different
    lengths do not link. A row with a null id counts as a link but names no component; repeated
    rows are copies. kept is vec_id = component_id. Vectors are told apart by 128 bits of hash.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("e")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    infinite = F.lit(float("inf"))
    is_sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & e.isNotNull() & is_sound, F.lit(False)))
    named = rows.where("sound").withColumns({"dim": F.size("e"), "h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(SEED), "e")})
    double = isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32

    chosen = named.select("label", "dim").distinct().withColumn("k", F.lit(bits)) if bits is not None else _bits(named, least, recall, kind, sample, tile)
    chosen = cut(chosen.select(F.col("label").alias("of_label"), F.col("dim").alias("of_dim"), "k"))
    points = named.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    points = points.join(_few(chosen), (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim"))).withColumn("pid", F.monotonically_increasing_id())
    kept = ["label", "dim", "h1", "h2", "rep", "copies", "pid"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.names.index(name))  # noqa: B023, E731
            dims, ks = of("dim").to_numpy(zero_copy_only=False), of("k").to_numpy(zero_copy_only=False)
            for _, at, raw in _vectors(of("e"), dims, kind):
                unit = _units(raw)
                coded = records(unit)
                for k in np.unique(ks[at]).tolist():
                    own = np.flatnonzero(ks[at] == k)
                    found = keys(unit[own], k, tables_needed(least, k, recall))
                    more = (
                        pa.array([r.tobytes() for r in raw[own]], pa.binary()),
                        pa.array([r.tobytes() for r in coded[own]], pa.binary()),
                        pa.array(list(found), pa.list_(pa.int64())),
                    )
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at[own])).select(kept).columns, *more], names=[*kept, "x", "code", "keys"])

    extra = [T.StructField("x", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    coded = cut(points.mapInArrow(encode, T.StructType([*points.select(*kept).schema.fields, *extra])))

    # records meet in buckets; a crowded bucket is cut into blocks, and each pair of blocks is a tile
    narrow = coded.select("label", "dim", "pid", "code", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    crowded = cut(narrow.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > tile))
    narrow = narrow.join(_few(crowded), bucket, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    narrow = narrow.withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).drop("n")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = narrow.withColumn("o", other).select(*bucket, "pid", "code", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    place = [*bucket, "i", "j"]

    def open_points(group: pd.DataFrame) -> pd.DataFrame:
        """Points of a tile with a pair that the bound does not rule out."""
        if len(group) < 2:
            return group[["label", "dim", "t", "key", "i", "j", "pid", "block"]].iloc[:0]
        dim, same = int(group.dim.iloc[0]), int(group.i.iloc[0]) == int(group.j.iloc[0])
        code, block = np.frombuffer(b"".join(group.code), record_type(dim)), group.block.to_numpy()
        left = np.arange(len(group)) if same else np.flatnonzero(block == group.i.iloc[0])
        right = left if same else np.flatnonzero(block == group.j.iloc[0])
        on = np.zeros(len(group), bool)
        for s in range(0, len(left), 256):
            at = left[s : s + 256]
            open_ = estimate_records(code[at], code[right], dim) >= least - reach(code[at], code[right], dim, least)
            if same:
                open_ &= right[None, :] > at[:, None]
            on[at] |= open_.any(axis=1)
            on[right] |= open_.any(axis=0)
        return group.loc[on, ["label", "dim", "t", "key", "i", "j", "pid", "block"]]

    opened = cut(tiles.groupBy(*place).applyInPandas(open_points, tiles.select(*place, "pid", "block").schema))
    spread = coded.select("pid", "x", "keys", "copies").join(_few(opened), "pid")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links of a tile's open points, in double precision."""
        group = group.sort_values("pid")
        t, dim, i, j = (int(group[c].iloc[0]) for c in ("t", "dim", "i", "j"))
        raw = np.frombuffer(b"".join(group.x), kind).reshape(len(group), dim).astype(np.float64)
        unit, held, block = _units(raw), np.stack(group["keys"].to_numpy()), group.block.to_numpy()
        left, right = (np.flatnonzero(block == b) for b in (i, j))
        a_, b_ = [], []
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            exact = unit[part] @ unit[right].T
            p, q = np.nonzero(exact >= least - 1e-9)
            exact = exact[p, q]
            p, q = part[p], right[q]
            if i == j:
                once = q > p
                p, q, exact = p[once], q[once], exact[once]
            near = np.abs(exact - least) < 1e-9  # decided by the plain quotient
            if near.any():
                u, v = raw[p[near]], raw[q[near]]
                exact[near] = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
            hit = exact >= least
            p, q = p[hit], q[hit]
            new = np.ones(len(p), bool)  # an earlier table counts a pair that meets there too
            for earlier in range(t):
                new &= held[p, earlier] != held[q, earlier]
            a_.append(p[new])
            b_.append(q[new])
        a, b = np.concatenate(a_ or [np.zeros(0, int)]), np.concatenate(b_ or [np.zeros(0, int)])
        copies, pid = group.copies.to_numpy(), group.pid.to_numpy()
        links = np.bincount(a, copies[b], len(group)) + np.bincount(b, copies[a], len(group))
        root = _forest(len(group), a, b)
        on = np.flatnonzero(links)
        return pd.DataFrame({"pid": pid[on], "links": links[on].astype(np.int64), "root": pid[root[on]]})

    found = cut(spread.groupBy(*place).applyInPandas(compare, "pid long, links long, root long"))
    links = found.groupBy("pid").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "pid", "root")
    joined = coded.select("label", "h1", "h2", "copies", "pid", "rep").join(parts, F.col("pid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "pid"))
    least_id = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = joined.join(least_id, "root").join(links, "pid", "left").select("label", "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = named.select("vec_id", "label", "h1", "h2").join(told, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
