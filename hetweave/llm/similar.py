"""Documents whose sets of five-word shingles are alike, decided by the sets themselves.

Candidates share a key: bands of MinHash registers, and the covering masks of SimHash. Not all
pairs of a key are drawn up. First each point is held against the likeliest of its keys' least
points; where that links, a crowd of near copies is one component after as many comparisons as it
has members. Then
keys whose points are still apart are looked at in tiles, where sketches are compared in numpy:
twice each point is held against the likeliest one outside its component, which joins what
belongs together at the cost of a pair for each point. Pairs that are apart even then are decided
in their tiles, each in that of the first key it shares; what a task returns are its points with
such pairs, and then the links that join components, no more than it has points. All is decided
exactly, by the Jaccard similarity of the two sets.

Equal texts are one point, known by a 64-bit hash. With 21 bands of 6 registers a pair at a
similarity of 0.8 is a candidate with a chance of 0.998, at 0.85 of 0.99998; that its estimate
lies SLACK below it has one of 0.0004.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hetweave.llm import simhash
from hetweave.llm.common import connected_components, cut, small_batches, text_buffer
from hetweave.llm.fingerprints import PIECE, Texts, least_hashes, permutations, registers_of

BANDS, ROWS = 21, 6
#: Keys of more points are compared in blocks of about so many.
BLOCK = 1024
#: How far below the similarity an estimate may lie to be decided by the sets: over three deviations.
SLACK = 0.12
#: Points that one task compares, in keys of up to a block; and how many where their sets are there.
DEALT, DEALT_SETS = 20_000, 2_000


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, p, simhash, sketch, marks) of (doc_id, text).

    p names the text, sketch holds BANDS * ROWS registers of two bytes, marks the second of each.
    """
    small_batches(docs.sparkSession)
    functions = permutations(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            view = data.tobytes()
            prints = np.array([simhash.fingerprint(view[s:e], 5) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            rows: list[bytes] = []
            marks: list[bytes] = []
            at = 0
            while at < len(prints):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
                texts = Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                registers = registers_of(least_hashes(*texts.runs(), end - at, functions))
                rows += [r.tobytes() for r in registers]
                marks += [r.tobytes() for r in (registers & 255).astype(np.uint8)]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64)), pa.array(rows, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "p", "simhash", "sketch", "marks"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, p long, simhash long, sketch binary, marks binary")


def keys_of(radius: int = 2) -> Column:
    """The keys of a point's sketch and simhash, in an order that all points share."""
    bands = [F.xxhash64(F.lit(b), F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    masks = [F.xxhash64(F.lit(BANDS + k), F.col("simhash").bitwiseAND(F.lit(simhash._signed(m)))) for k, m in enumerate(simhash.covering_masks(radius))]
    return F.array(*bands, *masks)


def keyed(points: DataFrame, radius: int = 2) -> DataFrame:
    """(key, p, n) of the keys that several points share, and their number."""
    rows = points.select("p", F.explode(keys_of(radius)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return cut(rows.join(sizes, "key"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(p, shingles) of (p, text): the distinct shingles in order, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = [s.tobytes() for s in Texts(data, offsets).sets()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["p", "shingles"])

    return texts.mapInArrow(run, "p long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets of shingles; two empty ones are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return common / (len(x) + len(y) - common)


def _in_tiles(pairs: DataFrame, values: DataFrame, measure: Callable[[bytes, bytes], float], least: float) -> DataFrame:
    """(tile, a, b, measured) of the pairs (tile, a, b) with a measure of at least `least`.

    values is (p, value), one row a point. A value is sent once to each tile that needs it, however
    many pairs it is in there; a tile's values are read before its pairs, and a task holds those of
    one tile at a time. Tiles are made of two blocks at most, so neither side has a hot key.
    """
    ends = pairs.select("tile", F.col("a").alias("p")).unionAll(pairs.select("tile", F.col("b").alias("p"))).distinct()
    sent = ends.join(values, "p").select("tile", F.lit(0).alias("late"), F.col("p").alias("a"), F.lit(None).cast("long").alias("b"), "value")
    asked = pairs.select("tile", F.lit(1).alias("late"), "a", "b", F.lit(None).cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            found: list[tuple[int, int, int, float]] = []
            for t, a, b, value in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if t != tile:
                    tile, held = t, {}
                if b is None:
                    held[a] = value
                elif (got := measure(held[a], held[b])) >= least:
                    found.append((t, a, b, got))
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["tile", "a", "b", "measured"])

    rows = sent.unionAll(asked).repartition("tile").sortWithinPartitions("tile", "late")
    return rows.mapInArrow(run, "tile long, a long, b long, measured double")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the pairs of points (tile, a, b) that are alike. Only texts of points in pairs move.

    pairs are read three times, so they come written.
    """
    needed = pairs.select(F.col("a").alias("p")).unionAll(pairs.select(F.col("b").alias("p"))).distinct()
    sets = shingle_sets(texts.join(needed, "p", "left_semi").dropDuplicates(["p"]))
    return cut(_in_tiles(pairs, sets.toDF("p", "value"), jaccard, similarity).select("a", "b", F.col("measured").alias("jaccard")))


def _agreeing(a: bytes, b: bytes) -> float:
    """Share of equal bytes of two sketches of the same length."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def _dealt(open_: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of keys (key, p, n, c) with all columns of points, dealt to tiles.

    A key of more points than a block is cut into blocks, and each two of them meet in a task;
    smaller keys share tasks.
    """
    deals = max(1, open_.count() // DEALT)
    # sketches join before a row is sent to each block of its key, so the join grows with the rows of keys
    rows = open_.join(points, "p").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("p", "key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(deals))).otherwise(tile)
    return rows.select(deal.alias("deal"), (F.col("blocks") == 1).alias("shared"), tile.alias("tile"), "key", (F.col("own") <= F.col("other")).alias("first"), (F.col("own") >= F.col("other")).alias("second"), "c", *points.columns)


def _candidates(open_: DataFrame, points: DataFrame, similarity: float, best: bool) -> DataFrame:
    """(tile, a, b, near) of pairs within keys (key, p, n, c) whose components c differ and whose sketches may be alike.

    With best, of each point and task only the likeliest pair.
    """
    rows = _dealt(open_, points.select("p", "marks")).drop("key")
    least = similarity - SLACK

    def compare(dealt: pd.DataFrame) -> pd.DataFrame:
        found, tiles = [np.zeros((0, 3))], [np.zeros(0, np.int64)]
        for name, tile in dealt.groupby("tile", sort=False):
            a, b = (tile[tile[side].to_numpy()] for side in ("first", "second"))
            if not len(a) or not len(b):
                continue
            x, y = (np.frombuffer(b"".join(t.marks), np.uint8).reshape(len(t), -1) for t in (a, b))
            ia, ib = a.index.to_numpy(), b.index.to_numpy()
            pb, cb = b.p.to_numpy(), b.c.to_numpy()
            for k, (p, c) in enumerate(zip(a.p.to_numpy(), a.c.to_numpy(), strict=True)):
                other = np.flatnonzero(cb != c)
                near = (x[k] == y[other]).mean(axis=1) if len(other) else np.zeros(0)
                keep = near >= least
                if best and keep.any():
                    keep = np.arange(len(near)) == near.argmax()
                found.append(np.column_stack([np.full(keep.sum(), ia[k]), ib[other[keep]], near[keep]]))
                tiles.append(np.full(keep.sum(), name, np.int64))
        every = np.concatenate(found)
        p = dealt.p
        left, right = (p.loc[every[:, k].astype(np.int64)].to_numpy() if len(every) else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"tile": np.concatenate(tiles), "a": np.minimum(left, right), "b": np.maximum(left, right), "near": every[:, 2]})

    return rows.groupBy("deal", "shared").applyInPandas(compare, "tile long, a long, b long, near double")


def _meetings(tile: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each point of a tile's first side, by place, those of the second that it is to be held against.

    Their components differ, their sketches may be alike, and the tile's key is the first that
    they share: a pair meets in one tile only.
    """
    first, second, p, c = (tile[x].to_numpy() for x in ("first", "second", "p", "c"))
    marks = np.frombuffer(b"".join(tile.marks), np.uint8).reshape(len(tile), -1)
    keys, key = np.stack(tile["keys"].to_numpy()), tile.key.iloc[0]
    right = np.flatnonzero(second)
    for i in np.flatnonzero(first):
        j = right[c[right] != c[i]]
        if second[i]:  # both sides are the same block
            j = j[p[j] > p[i]]
        j = j[(marks[i] == marks[j]).mean(axis=1) >= least] if len(j) else j
        if len(j):
            j = j[keys[i][(keys[j] == keys[i]).argmax(axis=1)] == key]
        yield i, j


def _decided(open_: DataFrame, points: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of links within keys (key, p, n, c) that join their components as all links there do.

    points has (p, marks, keys). No pair leaves a task: first each tile names its points that have
    pairs to decide, then their sets are sent there, once a tile, and the links found that join
    what is still apart there are returned.
    """
    least = similarity - SLACK

    def name(dealt: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, tile in dealt.groupby("tile", sort=False):
            asked = np.zeros(len(tile), bool)
            for i, j in _meetings(tile, least):
                asked[i] |= len(j) > 0
                asked[j] = True
            kept.append(tile[asked])
        return pd.concat(kept)[["shared", "tile", "key", "first", "second", "p", "c"]]

    def decide(dealt: pd.DataFrame) -> pd.DataFrame:
        over: dict[int, int] = {}

        def root(c: int) -> int:
            while c in over:
                if over[c] in over:
                    over[c] = over[over[c]]
                c = over[c]
            return c

        found = []
        for _, tile in dealt.groupby("tile", sort=False):
            p, c, sets = tile.p.tolist(), tile.c.tolist(), tile.shingles.tolist()
            for i, js in _meetings(tile, least):
                for j in js.tolist():
                    x, y = root(c[i]), root(c[j])
                    if x != y and jaccard(sets[i], sets[j]) >= similarity:
                        over[x] = y
                        found.append((min(p[i], p[j]), max(p[i], p[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    named = _dealt(open_, points).groupBy("deal", "shared").applyInPandas(name, "shared boolean, tile long, key long, first boolean, second boolean, p long, c long")
    named = cut(named)
    deals = max(1, named.count() // DEALT_SETS)
    sets = shingle_sets(texts.join(named.select("p").distinct(), "p", "left_semi").dropDuplicates(["p"]))
    deal = F.when(F.col("shared"), F.pmod(F.xxhash64("key"), F.lit(deals))).otherwise(F.col("tile"))
    rows = named.join(points, "p").join(sets, "p").withColumn("deal", deal)
    return cut(rows.groupBy("deal", "shared").applyInPandas(decide, "a long, b long"))


def similar_links(docs: DataFrame, prints: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b) of points whose components are those of all links found among the distinct texts.

    docs has (doc_id, text), prints is sketches(docs), written.
    """
    whole = prints.dropDuplicates(["p"])
    points = cut(whole.select("p", "marks", keys_of().alias("keys")))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("p"), F.coalesce("text", F.lit("")).alias("text"))
    keys = keyed(whole)
    first = keys.groupBy("key").agg(F.min("p").alias("a"))
    # a star's points are dealt into blocks like any key's; a pair that several keys have is asked once
    block = F.pmod(F.xxhash64("p"), F.ceil(F.col("n") / BLOCK))
    stars = keys.join(first, "key").where("p <> a").select(F.xxhash64("a", block).alias("tile"), "a", F.col("p").alias("b"))
    stars = _in_tiles(stars.groupBy("a", "b").agg(F.min("tile").alias("tile")), points.select("p", F.col("marks").alias("value")), _agreeing, similarity - SLACK)
    tried = cut(stars.groupBy("b").agg(F.max(F.struct("measured", "a", "tile")).alias("m")).select("m.tile", "m.a", "b"))
    links = verified(tried, texts, similarity).select("a", "b")

    def still_apart() -> DataFrame:
        """Rows of keys whose points are of several components, with those."""
        named = keys.join(connected_components(links).toDF("p", "c"), "p", "left").select("key", "p", "n", F.coalesce("c", "p").alias("c"))
        mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        return cut(named.join(mixed, "key", "left_semi"))

    for _ in range(2):
        # of each point the likeliest of what its tasks found
        ends = _candidates(still_apart(), points, similarity, best=True).withColumn("p", F.explode(F.array("a", "b")))
        pairs = ends.groupBy("p").agg(F.max(F.struct("near", "a", "b", "tile")).alias("m")).select("m.tile", "m.a", "m.b")
        new = pairs.groupBy("a", "b").agg(F.min("tile").alias("tile")).join(tried, ["a", "b"], "left_anti")
        new = cut(new.select("tile", "a", "b"))
        tried = tried.unionAll(new)
        links = links.unionAll(verified(new, texts, similarity).select("a", "b"))
    return links.unionAll(_decided(still_apart(), points, texts, similarity))


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_hash, root, component_id) of each row; component_id is the least id reachable by links.

    Two texts link if the Jaccard similarity of their sets of five-word shingles is at least
    `similarity`; a text of fewer words is one shingle, and all texts without words are alike.
    root names the component in any case, row_hash the text. Rows with a null id have a
    component but never name one; a component of null ids only is null.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(sketches(own))
    found = connected_components(similar_links(own, prints, similarity))
    rep = prints.groupBy("p").agg(F.min("doc_id").alias("rep"))
    named = rep.join(found, F.col("p") == F.col("node"), "left").select("p", "rep", F.coalesce("component", "p").alias("root"))
    of_point = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select(F.col("p").alias("row_hash"), "root", "component_id")
    return prints.select("doc_id", F.col("p").alias("row_hash")).join(of_point, "row_hash").select("doc_id", "row_hash", "root", "component_id")


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar documents, that of its least id, with the columns of docs."""
    return simhash.keep_one(docs, similar_documents(docs, doc_id=doc_id, text=text, similarity=similarity), doc_id, text)
