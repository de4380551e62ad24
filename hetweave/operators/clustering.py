"""Clustering of vectors and the measures of a clustering.

Points are (nid, vec) with double arrays of one length. Centres are few and travel with the task;
points stay distributed: each round is one pass in Arrow batches that sums by cluster.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.lineage import cut
from hetweave.operators.tiles import distance_sums


def standardize(fit: DataFrame, *apply: DataFrame) -> list[DataFrame]:
    """apply's vectors by fit's means and population deviations; a constant dimension is only centred.

    Vectors are (nid, vec). The figures are one row for each dimension, joined by position in
    long form, so vectors may be wide.
    """
    long = fit.select(F.posexplode("vec").alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    out = []
    for df in apply or (fit,):
        rows = df.select("nid", F.posexplode("vec").alias("dim", "x")).join(stats, "dim")
        rows = rows.select("nid", "dim", ((F.col("x") - F.col("m")) / scale).alias("z"))
        out.append(rows.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda s: s["z"]).alias("vec")))
    return out


def _literal(centre: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in centre])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, one centre at a time."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """points with cluster, the index of the nearest centre (ties to the lower), and its d2; both null for a null vec."""
    of = np.array(centres, float)

    @F.pandas_udf("cluster int, d2 double")
    def place(vec: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": pd.array([None] * len(vec), "Int32"), "d2": np.nan})
        known = vec.notna().to_numpy()
        if known.any():
            d = _gaps(np.stack(vec[known].to_numpy()), of)
            out.loc[known, "cluster"] = d.argmin(axis=1)
            out.loc[known, "d2"] = d.min(axis=1)
        return out

    return points.withColumn("best_", place("vec")).withColumn("cluster", F.col("best_")["cluster"]).withColumn("d2", F.col("best_")["d2"]).drop("best_")


def _sums(points: DataFrame, parts: Callable[[np.ndarray], np.ndarray], runs: int, k: int, width: int) -> np.ndarray:
    """The sum over all points of parts(x), a (runs, k, width) array of a batch x: a row a task for each cell, then an aggregation."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((runs, k, width))
        for batch in batches:
            if len(batch):
                total += parts(np.stack(batch.vec.to_numpy()))
        yield pd.DataFrame({"cell": np.arange(runs * k), "x": list(total.reshape(runs * k, width))})

    cells = points.select("vec").mapInPandas(work, "cell int, x array<double>").select("cell", F.posexplode("x").alias("dim", "x"))
    out = np.zeros((runs * k, width))
    for r in cells.groupBy("cell", "dim").agg(F.sum("x").alias("x")).collect():  # runs * k * width numbers
        out[r.cell, r.dim] = r.x
    return out.reshape(runs, k, width)


def _means(assigned: DataFrame, k: int, weight: Column | None = None) -> dict[int, list[float]]:
    w = F.lit(1.0) if weight is None else weight
    long = assigned.select("cluster", w.alias("w"), F.posexplode("vec").alias("dim", "x"))
    rows = long.groupBy("cluster", "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")).collect()  # k centres
    out: dict[int, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r.cluster, {})[r.dim] = r.m
    return {c: [v[d] for d in sorted(v)] for c, v in out.items() if c < k}


def _spread_out(points: DataFrame, k: int, seeds: list[int]) -> list[list[list[float]]]:
    """k starting centres for each seed: a seeded point, then each time the one most far by hash-weighted distance.

    All seeds draw in the same pass over the points, so there are k passes.
    """
    draw = lambda seed, s: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}.{s}"), F.col("nid").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)
    firsts = points.agg(*[F.min(F.struct(draw(seed, 0).alias("u"), "nid", "vec")).alias(f"f{n}") for n, seed in enumerate(seeds)]).first()
    starts = [[list(f.vec)] if f else [] for f in firsts]
    shape = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("far", T.DoubleType()), points.schema["nid"], points.schema["vec"]])
    for s in range(1, k):
        held = [np.array(c, float) if len(c) == s else None for c in starts]

        def work(batches: Iterator[pd.DataFrame], held: list = held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x, u = np.stack(batch.vec.to_numpy()), np.stack(batch.u.to_numpy())
                for run, centres in enumerate(held):
                    if centres is None:
                        continue
                    d2 = _gaps(x, centres).min(axis=1)
                    # the exponential race: the point of least -log(u) / d2 is drawn with chance d2 / sum
                    far = np.where(d2 > 0, -np.log(u[:, run]) / np.where(d2 > 0, d2, 1.0), np.inf)
                    best = np.lexsort((batch.nid.to_numpy(), far))[0]
                    if np.isfinite(far[best]):
                        yield pd.DataFrame({"run": [run], "far": [far[best]], "nid": [batch.nid.iloc[best]], "vec": [batch.vec.iloc[best]]})

        drawn = points.select("nid", "vec", F.array(*[draw(seed, s) for seed in seeds]).alias("u")).mapInPandas(work, shape)
        for r in drawn.groupBy("run").agg(F.min(F.struct("far", "nid", "vec")).alias("best")).collect():  # a row a seed
            starts[r.run].append(list(r.best.vec))
    return starts


def kmeans(points: DataFrame, k: int, *, seeds: int = 10, rounds: int = 300, seed: int = 42) -> tuple[DataFrame, list[list[float]], float]:
    """(nid, cluster), centres and cost of the best of several starts, by Lloyd's steps.

    A round takes all starts that still move one step, in one pass over the points. A start that
    still lowers its cost after the last round is warned of.
    """
    points = cut(points.select("nid", "vec").where("vec is not null"))
    if points.isEmpty():
        return points.select("nid", F.lit(0).alias("cluster")), [], 0.0
    centres = [np.array(c, float) for c in _spread_out(points, k, [seed + s for s in range(seeds)])]
    most, dim = max(len(c) for c in centres), centres[0].shape[1]
    last, moving = [math.inf] * seeds, list(range(seeds))
    for _ in range(rounds):
        now = [centres[s] for s in moving]

        def parts(x: np.ndarray, now: list[np.ndarray] = now) -> np.ndarray:
            out = np.zeros((len(now), most, dim + 2))
            for run, of in enumerate(now):
                d = _gaps(x, of)
                member = np.eye(most)[d.argmin(axis=1)]
                out[run, :, :dim], out[run, :, dim], out[run, :, dim + 1] = member.T @ x, member.sum(axis=0), member.T @ d.min(axis=1)
            return out

        found, left = _sums(points, parts, len(now), most, dim + 2), []
        for run, s in enumerate(moving):
            cost = float(found[run, :, dim + 1].sum())
            if last[s] - cost <= 1e-9 * max(last[s], 1.0) and last[s] < math.inf:
                continue
            last[s] = cost
            n = found[run, : len(centres[s]), dim]
            centres[s] = np.where(n[:, None] > 0, found[run, : len(centres[s]), :dim] / np.maximum(n, 1)[:, None], centres[s])
            left.append(s)
        moving = left
        if not moving:
            break
    for s in moving:
        warnings.warn(f"k-means: start {s} has not converged in {rounds} rounds", RuntimeWarning, stacklevel=2)
    best = min(range(seeds), key=lambda s: (last[s], s))
    chosen = centres[best].tolist()
    return nearest(points, chosen).select("nid", "cluster"), chosen, last[best]


def fuzzy_cmeans(points: DataFrame, k: int, *, m: float = 2.0, rounds: int = 150, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """(nid, cluster): hard labels of fuzzy memberships u = d^(-2/(m-1)) normalised, and centres.

    Ends when the centres move less than the tolerance; warns if they still move after the last round.
    """
    points = cut(points.select("nid", "vec").where("vec is not null"))
    if points.isEmpty():
        return points.select("nid", F.lit(0).alias("cluster")), []
    centres = np.array(_spread_out(points, k, [seed])[0], float)
    n, dim = centres.shape
    for _ in range(rounds):

        def parts(x: np.ndarray, of: np.ndarray = centres) -> np.ndarray:
            u = (_gaps(x, of) + 1e-16) ** (-1 / (m - 1))
            w = (u / u.sum(axis=1, keepdims=True)) ** m
            return np.concatenate([w.T @ x, w.sum(axis=0)[:, None]], axis=1)[None]

        found = _sums(points, parts, 1, n, dim + 1)[0]
        new = found[:, :dim] / found[:, dim:]
        moved, centres = math.sqrt(((new - centres) ** 2).sum()), new
        if moved < tolerance:
            break
    else:
        warnings.warn(f"fuzzy c-means has not converged in {rounds} rounds", RuntimeWarning, stacklevel=2)
    return nearest(points, centres.tolist()).select("nid", "cluster"), centres.tolist()


def lloyd_step(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(cluster, n, cost, vec): the step of k-means from given centres; centres without points are left out."""
    found = nearest(points, centres)
    rows = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("cost"))
    mean = found.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("vec"))
    return rows.join(mean, "cluster")


def sequential_scheme(points: DataFrame, k: int, *, theta: float | None = None, sample: int = 800, seed: int = 42) -> DataFrame:
    """(nid, cluster) by basic sequential clustering, in parallel.

    Each partition scans its points in order of a seeded hash: a point farther than theta from
    all centres opens a new one while there are fewer than k, else moves the nearest by a running
    mean. The partitions' weighted centres are scanned likewise, and every point goes to the
    nearest of the k left. One partition gives the sequential algorithm itself. theta is, if not
    given, the median distance to the nearest neighbour within a sample of bounded size.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("nid").cast("string")).cast("binary"))
    points = cut(points.select("nid", "vec"))
    if theta is None:
        some = np.array([r.vec for r in points.orderBy(order, "nid").limit(sample).collect()])
        if len(some) < 2:
            theta = 0.0
        else:
            d = ((some[:, None] - some[None]) ** 2).sum(axis=2)
            np.fill_diagonal(d, np.inf)
            theta = float(np.median(np.sqrt(d.min(axis=1))))

    class Scan:
        """Centres so far and the weight each has taken in; memory is k centres."""

        def __init__(self) -> None:
            self.centres: list[np.ndarray] = []
            self.mass: list[float] = []

        def add(self, v: np.ndarray, w: float) -> None:
            d = [float(((v - c) ** 2).sum()) ** 0.5 for c in self.centres]
            near = int(np.argmin(d)) if d else -1
            if near < 0 or (d[near] > theta and len(self.centres) < k):
                self.centres.append(np.array(v, float))
                self.mass.append(w)
            else:
                self.mass[near] += w
                self.centres[near] = self.centres[near] + (v - self.centres[near]) * w / self.mass[near]

    def partition(batches):
        scan = Scan()
        for batch in batches:
            for v in batch.vec:
                scan.add(v, 1.0)
        if scan.centres:
            yield pd.DataFrame({"vec": scan.centres, "w": scan.mass})

    local = points.repartition("nid").withColumn("o", order).sortWithinPartitions("o", "nid").select("vec").mapInPandas(partition, "vec array<double>, w double").collect()  # k rows a partition
    local.sort(key=lambda r: (-r.w, list(r.vec)))
    whole = Scan()
    for r in local:
        whole.add(np.array(r.vec), r.w)
    if not whole.centres:
        return points.select("nid", F.lit(0).alias("cluster"))
    return nearest(points, [c.tolist() for c in whole.centres]).select("nid", "cluster")


def bic(n: int, d: int, parts: list[tuple[int, float]]) -> float:
    """Bayes information of spherical clusters, given each one's size and sum of squares."""
    free = max(n - len(parts), 1)
    variance = max(sum(s for _, s in parts) / (free * d), 1e-12)
    fit = sum(c * math.log(max(c, 1)) - c * math.log(n) - c * d / 2 * math.log(2 * math.pi * variance) for c, _ in parts) - d * free / 2
    return fit - len(parts) * (d + 1) / 2 * math.log(max(n, 2))


def xmeans(points: DataFrame, k: int, *, seed: int = 42) -> DataFrame:
    """(nid, cluster): clusters are halved by 2-means while that raises the information, up to k."""
    points = cut(points.select("nid", "vec"))
    dim = len((points.first() or {"vec": []})["vec"])
    mean = _means(points.withColumn("cluster", F.lit(0)), 1).get(0)
    if mean is None:
        return points.select("nid", F.lit(0).alias("cluster"))
    done, front = [], [mean]
    while front and len(done) + len(front) < k:
        centre = front.pop(0)
        every = done + front + [centre]
        own = nearest(points, every).where(F.col("cluster") == len(every) - 1).select("nid", "vec", "d2")
        n, cost = own.agg(F.count("*"), F.sum("d2")).first()
        if n < 4:
            done.append(centre)
            continue
        _, halves, _ = kmeans(own.select("nid", "vec"), 2, seeds=5, rounds=300, seed=seed)
        sizes = [(r[1], r[2]) for r in nearest(own.select("nid", "vec"), halves).groupBy("cluster").agg(F.count("*"), F.sum("d2")).collect()]
        if len(sizes) == 2 and bic(n, dim, sizes) > bic(n, dim, [(n, cost)]):
            front += halves
        else:
            done.append(centre)
    return nearest(points, done + front).select("nid", "cluster")


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": lambda p, k, **o: kmeans(p, k, **o)[0],
    "fcm": lambda p, k, **o: fuzzy_cmeans(p, k, **o)[0],
    "bsas": sequential_scheme,
    "xmeans": xmeans,
}


def cluster(algorithm: str, points: DataFrame, k: int, **options) -> DataFrame:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}: {sorted(ALGORITHMS)}")
    return ALGORITHMS[algorithm](points, k, **options)


def contingency(assigned: DataFrame) -> DataFrame:
    """(cluster, y, n) of (nid, cluster, y)."""
    return assigned.groupBy("cluster", "y").agg(F.count("*").alias("n"))


def nmi(cells: DataFrame) -> DataFrame:
    """One row: mutual information over the mean of both entropies; 1 if both are constant."""
    total = cells.agg(F.sum("n").alias("t"))
    c = cells.groupBy("cluster").agg(F.sum("n").alias("nc"))
    y = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    joined = cells.join(c, "cluster").join(y, "y").join(total)  # a table of one row
    mi = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nc") * F.col("ny")))).alias("mi"))

    def entropy(side: DataFrame, column: str, name: str) -> DataFrame:
        p = F.col(column) / F.col("t")
        return side.join(total).agg((-F.sum(p * F.log(p))).alias(name))

    row = mi.join(entropy(c, "nc", "hc")).join(entropy(y, "ny", "hy"))  # single rows
    return row.select(F.when(F.col("hc") + F.col("hy") > 0, 2 * F.col("mi") / (F.col("hc") + F.col("hy"))).otherwise(1.0).alias("nmi"))


def hungarian(gain: np.ndarray) -> list[int]:
    """Row of each column in the assignment of greatest gain, by shortest augmenting paths."""
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(n + 1, np.inf), [0] * (n + 1), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = slack < least[1:]
            least[1:][better] = slack[better]
            for x in np.flatnonzero(better):
                way[x + 1] = j
            step = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[step]
            for x in range(n + 1):
                if used[x]:
                    u[match[x]] += delta
                    v[x] -= delta
                else:
                    least[x] -= delta
            j = step
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return [match[x] - 1 for x in range(1, n + 1)]


def accuracy(cells: DataFrame) -> float:
    """Share of points right under the best one-to-one naming of clusters; clusters and labels are few."""
    rows = cells.collect()
    if not rows:
        return 0.0
    cs, ys = sorted({r.cluster for r in rows}), sorted({r.y for r in rows})
    table = np.zeros((len(cs), len(ys)))
    for r in rows:
        table[cs.index(r.cluster), ys.index(r.y)] += r.n
    match = hungarian(table)
    return float(sum(table[match[j], j] for j in range(len(ys)) if match[j] < len(cs)) / table.sum())


def majority_labels(cells: DataFrame) -> DataFrame:
    """(cluster, label): the most frequent true label, ties to the least."""
    k = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "y"))
    return cells.withColumn("k", k).where("k = 1").select("cluster", F.col("y").alias("label"))


def macro_precision(cells: DataFrame) -> DataFrame:
    """One row: precision averaged over all labels after naming clusters by majority; unnamed labels 0."""
    named = cells.join(majority_labels(cells), "cluster")
    each = named.groupBy("label").agg((F.sum(F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    every = cells.select(F.col("y").alias("label")).union(named.select("label")).distinct()
    return every.join(each, "label", "left").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("macro_precision"))


def calinski_harabasz(assigned: DataFrame) -> DataFrame:
    """One row: between- over within-cluster spread per degree of freedom, of (nid, cluster, vec)."""
    long = assigned.select("cluster", F.posexplode("vec").alias("dim", "x"))
    cells = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    total = cells.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    spread = cells.join(total, "dim").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("b"), F.sum(F.col("ss") - F.col("n") * F.col("m") * F.col("m")).alias("w"))
    sizes = assigned.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"))
    ok = (F.col("k") > 1) & (F.col("k") < F.col("n"))
    return spread.join(sizes).select(F.when(ok & (F.col("w") > 0), F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def silhouette(assigned: DataFrame) -> DataFrame:
    """One row: the mean silhouette by euclidean distance, of (nid, cluster, vec).

    A measure over all pairs of points, so it is for evaluation sets; pairs are met in tiles and
    summed by point and cluster. Alone in a cluster scores 0.
    """
    mean = distance_sums(assigned).withColumn("d", F.col("s") / F.col("n"))
    each = mean.groupBy("i").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("own"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return each.agg(F.avg(s).alias("silhouette"))


def soft_assignment(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(nid, cluster, q, p): Student-t closeness to each centre, and its sharpened target.

    q is 1 / (1 + d2) normalised over centres; p is q^2 over the centre's total, normalised.
    """
    d = F.array(*[1 / (1 + squared_distance(F.col("vec"), _literal(c))) for c in centres])
    long = points.select("nid", F.posexplode(d).alias("cluster", "s"))
    q = F.col("s") / F.sum("s").over(Window.partitionBy("nid"))
    long = long.withColumn("q", q)
    total = long.groupBy("cluster").agg(F.sum("q").alias("f"))
    sharp = long.join(F.broadcast(total), "cluster").withColumn("t", F.col("q") * F.col("q") / F.col("f"))  # a row for each centre
    return sharp.select("nid", "cluster", "q", (F.col("t") / F.sum("t").over(Window.partitionBy("nid"))).alias("p"))


def preservation_summary(raw: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...], setting: str = "setting", baseline: str = "original") -> DataFrame:
    """Means and sample deviations over seeds, and deltas to the baseline setting of the same keys."""
    stats = raw.groupBy(setting, *keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in measures], *[F.stddev_samp(m).alias(f"{m}_std") for m in measures])
    base = stats.where(F.col(setting) == baseline).select(*keys, *[F.col(f"{m}_mean").alias(f"{m}_base") for m in measures])
    out = stats.join(base, list(keys), "left")
    return out.withColumns({f"{m}_delta": F.col(f"{m}_mean") - F.col(f"{m}_base") for m in measures} | {f"{m}_abs_delta": F.abs(F.col(f"{m}_mean") - F.col(f"{m}_base")) for m in measures})
