"""All pairs of an evaluation set, by tiles of a matrix product.

Points are dealt to blocks of a bounded size, and each pair of blocks is a task that returns what
its rows need of it: the nearest few, or sums by cluster. No pair is ever a row. A point is sent to
all blocks, so these are as large as a task can hold, and a tile is worked off in strips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a block: up to MOST, since each point is sent to every block; down to BLOCK where tasks would be few.
BLOCK, MOST, TASKS = 1024, 16_384, 64
#: Scores that a tile holds at once, by strips of its rows: as many as stay in a cache.
STRIP = 1 << 18


def blocks_of(n: int, block: int | None = None) -> int:
    """How many blocks n points are dealt to; their square is the number of tiles."""
    if block:
        return max(1, -(-n // block))
    return max(1, -(-n // MOST), min(-(-n // BLOCK), int(TASKS**0.5)))


def strips(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, STRIP // max(1, columns))
    return (slice(s, s + step) for s in range(0, rows, step))


def over_tiles(points: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType, block: int | None = None) -> DataFrame:
    """work(left, right) for each pair of blocks of points (nid, ...)."""
    n = blocks_of(points.count(), block)
    own = points.withColumn("block", F.pmod(F.xxhash64("nid"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("o", every).withColumns({"bi": F.col("block"), "bj": F.col("o"), "side": F.lit(0)})
    right = own.withColumn("o", every).withColumns({"bi": F.col("o"), "bj": F.col("block"), "side": F.lit(1)})

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group.side == s].sort_values("nid").reset_index(drop=True) for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return work(a, b)

    return left.unionByName(right).drop("block", "o").groupBy("bi", "bj").applyInPandas(tile, schema)


def nearest_cosines(points: DataFrame, k: int, digits: int = 9, block: int | None = None) -> DataFrame:
    """(i, j, score): of each point (nid, vec) its k others of greatest cosine in each tile, ties to the least id.

    The k best of them all are among them. Scores are rounded; a zero vector scores 0.
    """
    nid = points.schema["nid"].dataType
    schema = T.StructType([T.StructField("i", nid), T.StructField("j", nid), T.StructField("score", T.DoubleType())])

    def unit(side: pd.DataFrame) -> np.ndarray:
        x = np.stack(side.vec.to_numpy())
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(size > 0, size, 1.0)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, left, right = unit(a), unit(b).T, a.nid.to_numpy(), b.nid.to_numpy()
        same, known = np.array_equal(left, right), np.isfinite(x).all() and np.isfinite(y).all()
        found = []
        for s in strips(len(a), len(b)):
            score = x[s] @ y
            if same:  # a point is in one block only
                score[left[s, None] == right[None, :]] = -np.inf
            if not known:
                score[np.isnan(score)] = -np.inf
            # what rounds to the k-th or more lies less than a unit of the last digit below it
            low = np.partition(score, len(right) - k, axis=1)[:, len(right) - k] if k < len(right) else np.full(len(score), -np.inf)
            row, column = np.nonzero(score >= low[:, None] - 10.0**-digits)
            best = np.round(score[row, column], digits) + 0.0
            order = np.lexsort((column, -best, row))
            row, column, best = row[order], column[order], best[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            on = (rank < k) & np.isfinite(best)
            found.append(pd.DataFrame({"i": left[s][row[on]], "j": right[column[on]], "score": best[on]}))
        return pd.concat(found)

    return over_tiles(points.select("nid", "vec"), work, schema, block)


def distance_sums(assigned: DataFrame, block: int | None = None) -> DataFrame:
    """(i, ci, cj, s, n): summed euclidean distances of each point (nid, cluster, vec) to the others of each cluster."""
    nid, kind = assigned.schema["nid"].dataType, assigned.schema["cluster"].dataType
    schema = T.StructType([T.StructField("i", nid), T.StructField("ci", kind), T.StructField("cj", kind), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(a.vec.to_numpy()), np.stack(b.vec.to_numpy())
        codes, names = pd.factorize(b.cluster)
        member = np.eye(len(names))[codes]
        left, right = a.nid.to_numpy(), b.nid.to_numpy()
        sums, counts = np.empty((len(a), len(names))), np.tile(member.sum(axis=0).astype(np.int64), (len(a), 1))
        xx, yy, same = (x * x).sum(axis=1), (y * y).sum(axis=1), np.array_equal(left, right)
        for s in strips(len(a), len(b)):
            size = xx[s, None] + yy[None, :]
            squared = size - 2 * (x[s] @ y.T)
            # the difference of near points loses digits, so theirs are taken anew
            row, column = np.nonzero(squared <= 1e-3 * size)
            for t in strips(len(row), x.shape[1]):
                gap = x[s][row[t]] - y[column[t]]
                squared[row[t], column[t]] = (gap * gap).sum(axis=1)
            sums[s] = np.sqrt(squared) @ member
            if same:
                row, column = np.nonzero(left[s, None] == right[None, :])
                np.subtract.at(counts[s], (row, codes[column]), 1)
        row, column = np.nonzero(counts)
        return pd.DataFrame({"i": a.nid.to_numpy()[row], "ci": a.cluster.to_numpy()[row], "cj": np.asarray(names)[column], "s": sums[row, column], "n": counts[row, column]})

    parts = over_tiles(assigned.select("nid", "cluster", "vec"), work, schema, block)
    return parts.groupBy("i", "ci", "cj").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
