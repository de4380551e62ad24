"""Blocks of query kinds measured against all kinds, which pass by in batches.

A task takes the kinds of a block, then reads all kinds of the same path and reduction, a batch at a
time and in order of ids. It keeps of each query what measures need: how many targets have which two
scores, and the first few of both rankings. Scores tie often, so that is far less than the pairs,
and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hetweave.lineage import cut

#: Query kinds of a block: all kinds are sent to each block, so more of them where blocks would be many.
BLOCK, MOST, BLOCKS = 1024, 4096, 20
#: Pairs that are scored at once, and counted scores kept before equal ones are put together.
STRIP, KEPT, FEW = 1 << 21, 1 << 22, 128
METHODS = ("pathsim", "hetesim")
#: Scores are whole numbers of the 9th digit; OFF makes two of them one key.
UNIT, OFF = 10**9, 1 << 30
#: Name of the profile or cluster of targets without a row.
NOBODY = -(1 << 62)
OUT = "cell int, path string, method string, u long, asked long, mae double, p95 double, p99 double, maxe double, s double, ss double, tie_overlap double, ndcg double, overlap double"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _rows_once(names: pa.Array, ends: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct names, each row's place among them, and the links (name's place, end, weight) of each name."""
    ids, first, place = np.unique(pc.fill_null(names, NOBODY).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    (row, dst), (_, w) = _lists(ends.take(pa.array(first))), _lists(weights.take(pa.array(first)))
    return ids, place, (row, dst, w)


class _Links:
    """Links of the block's rows by their other end, for products with the rows that pass by."""

    def __init__(self, row: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> None:
        self.n, self.norm = n, np.bincount(row, w * w, minlength=n)
        self.ends, code = np.unique(dst, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.row, self.w = row[order], w[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.ends) + 1))

    def scores(self, column: np.ndarray, dst: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of all rows with `width` others, flat, and the others' norms."""
        norm, out = np.bincount(column, w * w, minlength=width), np.zeros(self.n * width)
        if not len(self.ends) or not len(dst):
            return out, norm
        at = np.minimum(np.searchsorted(self.ends, dst), len(self.ends) - 1)
        met = self.ends[at] == dst
        column, at, w = column[met], at[met], w[met]
        sizes = self.starts[at + 1] - self.starts[at]
        upto = np.cumsum(sizes)
        step = 0
        while step < len(at):  # as many products as there are pairs in a strip
            last = max(step + 1, int(np.searchsorted(upto, (upto[step - 1] if step else 0) + STRIP, side="right")))
            some = sizes[step:last]
            each = np.repeat(np.arange(step, last), some)
            own = np.arange(len(each)) - np.repeat(np.cumsum(some) - some, some) + self.starts[at[each]]
            out += np.bincount(self.row[own] * width + column[each], self.w[own] * w[each], minlength=len(out))
            step = last
        return out, norm


def _whole(d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """d / below at 9 digits, as whole numbers; 0 where nothing is shared."""
    return np.floor(d / np.where(below > 0, below, 1.0) * UNIT + 0.5).astype(np.int64)


class _Counts:
    """How many targets of each row have which two scores."""

    def __init__(self, rows: int) -> None:
        self.rows, self.parts, self.size = rows, [], 0

    def put(self, row: np.ndarray, key: np.ndarray, m: np.ndarray) -> None:
        """Entries of which no two of a row have the same key."""
        self.parts.append((row, key, m))
        self.size += len(row)
        if self.size > KEPT:
            self.parts = [self.all()]
            self.size = len(self.parts[0][0])

    def _together(self, row: np.ndarray, key: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal keys of a row counted together; a row at a time, as short sorts stay in a cache."""
        if (row[1:] < row[:-1]).any():
            order = np.argsort(row, kind="stable")
            row, key, m = row[order], key[order], m[order]
        ends, out = np.searchsorted(row, np.arange(self.rows + 1)), []
        for r in np.unique(row):
            own, n = key[ends[r] : ends[r + 1]], m[ends[r] : ends[r + 1]]
            order = np.argsort(own)
            own = own[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out.append((np.full(len(first), r), own[first], np.add.reduceat(n[order], first)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (row, key, m)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, m), by row."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return self._together(*[np.concatenate(c) for c in zip(*self.parts, strict=True)])


def _best(row: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by score, descending, and then by item."""
    order = np.lexsort((item, -score, row))
    row, score, item = row[order], score[order], item[order]
    on = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[on], score[on], item[on]


class _Firsts:
    """The first few targets of each row so far."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.found = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.low, self.last = np.full(rows, -(1 << 62)), np.full(rows, 1 << 62)

    def open(self, score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of scores (rows x kinds) that can be among the first; least is the least member of each kind."""
        low = self.low[:, None]
        return np.nonzero((score != 0) & ((score > low) | ((score == low) & (least[None, :] < self.last[:, None]))))

    def add(self, row: np.ndarray, score: np.ndarray, column: np.ndarray, first: tuple[np.ndarray, np.ndarray]) -> None:
        """Scores with kinds, in order of ids; first has their first members (column, id) by column."""
        row, score, column = _best(row, score, column, self.k)  # a kind's least member stands for it
        if not len(row):
            return
        start, end = (np.searchsorted(first[0], column, side=s) for s in ("left", "right"))
        sizes = end - start
        each = np.repeat(np.arange(len(row)), sizes)
        member = first[1][np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[each]]
        self.found = _best(*[np.concatenate(c) for c in zip(self.found, (row[each], score[each], member), strict=True)], self.k)
        row, count = np.unique(self.found[0], return_counts=True)
        full = count == self.k
        self.low[row[full]], self.last[row[full]] = (self.found[x][np.cumsum(count) - 1][full] for x in (1, 2))

    def table(self, short: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x k) ids, and which are there; targets of least id fill up the rows that are short."""
        row, score, item = self.found
        r, j = np.repeat(np.flatnonzero(short), len(least)), np.tile(least, int(short.sum()))
        known = np.zeros((len(short), len(least)), bool)
        at = np.minimum(np.searchsorted(least, item), max(len(least) - 1, 0))
        hit = least[at] == item if len(least) else np.zeros(len(item), bool)
        known[row[hit], at[hit]] = True
        on = ~known[short].reshape(-1)
        row, score, item = _best(np.concatenate([row, r[on]]), np.concatenate([score, np.zeros(int(on.sum()), np.int64)]), np.concatenate([item, j[on]]), self.k)
        ids, there = np.zeros((len(short), self.k), np.int64), np.zeros((len(short), self.k), bool)
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ids[row, rank], there[row, rank] = item, True
        return ids, there


def counted(row: np.ndarray, key: np.ndarray, m: np.ndarray, rows: int, k: int, n_targets: int, keep_self: bool) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The measures of preserve.kind_measures() by row, and how many targets score in each ranking; entries come by row."""
    others, n = n_targets - 1, n_targets - (0 if keep_self else 1)
    whole_a, whole_b = key // (2 * OFF) - OFF, key % (2 * OFF) - OFF
    a, b = whole_a / UNIT, whole_b / UNIT
    by = lambda x: np.argsort(row * (4 * OFF) + x)
    total = lambda x: np.bincount(row, x, minlength=rows)
    count, d = total(m), np.abs(a - b)
    maxe = np.zeros(rows)
    np.maximum.at(maxe, row, d)

    order = by(np.abs(whole_a - whole_b))
    before_row = np.concatenate([[0.0], np.cumsum(count)])[row]  # rows come in order
    last = np.empty(len(row))
    last[order] = n - count[row[order]] + np.cumsum(m[order]) - before_row[order] - 1
    here = lambda x: (last >= x) & (last - m < x)

    def quantile(share: float) -> np.ndarray:
        at = share * (n - 1)
        low, high = int(at), min(int(at) + 1, n - 1)
        return total(np.where(here(low), d * (1 - (at - low)), 0.0) + np.where(here(high), d * (at - low), 0.0))

    prefix = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, max(k, 0) + 2)))])
    until = lambda x: prefix[np.minimum(x, max(k, 0)).astype(np.int64)]
    share, none, dcg, scored = [], [], [], []
    for c, whole in ((a, whole_a), (b, whole_b)):
        order = by(2 * OFF - whole)
        r, s = row[order], c[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])[: len(r)]
        group = np.cumsum(new) - 1
        ties = np.bincount(group, m[order])
        gain = np.bincount(group, (m * a)[order])
        first = np.flatnonzero(new)
        before = np.cumsum(ties) - ties - before_row[order][first]
        of = np.empty(len(row), np.int64)
        of[order] = group
        scored.append(total(np.where(c != 0, m, 0.0)))
        left = others - scored[-1]
        none.append(np.where(left > 0, np.maximum(0, k - scored[-1]) / np.where(left > 0, left, 1), 0.0))
        inside = np.maximum(0, np.minimum(k - before, ties)) / ties
        share.append(np.where(c != 0, inside[of], none[-1][row]))
        part = m / ties[of] * gain[of] / ties[of] * (until(before + ties) - until(before))[of]
        ranked = total(np.where((c != 0) & (before[of] < k), part, 0.0))
        zeros = total(np.where(c == 0, m * a, 0.0)) / np.maximum(left, 1)
        dcg.append(ranked + zeros * np.where(scored[-1] < k, prefix[-1] - until(scored[-1]), 0.0))
    tie = (total(m * np.minimum(*share)) + (others - count) * np.minimum(*none)) / k if k > 0 else np.ones(rows)
    ndcg = np.where(dcg[0] > 1e-12, dcg[1] / np.where(dcg[0] > 1e-12, dcg[0], 1.0), 1.0) if k > 0 else np.ones(rows)
    found = {"mae": total(m * d) / max(n, 1), "p95": quantile(0.95), "p99": quantile(0.99), "maxe": maxe, "s": total(m * (a - b)), "ss": total(m * (a - b) ** 2)}
    return found | {"tie_overlap": np.where(count > 0, tie, 1.0), "ndcg": np.where(count > 0, ndcg, 1.0)}, scored


class _Block:
    """The query kinds of a block, and what is known of them so far."""

    def __init__(self, n_targets: int, k: int, keep_self: bool, least: np.ndarray) -> None:
        self.n_targets, self.k, self.keep_self, self.least = n_targets, min(k, n_targets - 1), keep_self, least
        self.own: list[pa.RecordBatch] = []
        self.ready = self.seen = False

    def _start(self) -> None:
        own = pa.Table.from_batches(self.own).combine_chunks()
        one = {c: own[c].combine_chunks() if own.num_rows else pa.array([], own[c].type) for c in own.column_names}
        self.kind, self.asked = one["kind"].to_numpy(), one["asked"].to_numpy()
        self.cell, self.path, n = one["cell"][0].as_py(), one["path"][0].as_py(), own.num_rows
        self.profile, self.own_profile, links = _rows_once(one["profile"], one["pd"], one["pw"])
        self.original = _Links(*links, len(self.profile))
        self.cluster, self.own_cluster, links = _rows_once(one["cluster_id"], one["cd"], one["cw"])
        self.reduced = _Links(*links, len(self.cluster))
        self.by_cluster = np.split(np.argsort(self.own_cluster, kind="stable"), np.cumsum(np.bincount(self.own_cluster, minlength=len(self.cluster)))[:-1]) if n else []
        self.first, self.first_asked = _lists(one["ids"]), _lists(one["asks"])[1]
        self.counts = [_Counts(n) for _ in METHODS]
        self.tops = [[_Firsts(len(x), self.k + 1) for x in (self.profile, self.cluster)] for _ in METHODS]
        self.ready = True

    def take(self, batch: pa.RecordBatch, queries: bool) -> None:
        if queries:
            self.own.append(batch)
            return
        if not self.ready:
            self._start()
        step = max(1, STRIP // len(self.kind))
        start = 0
        while start < batch.num_rows:
            width = step if self.seen else min(step, FEW)  # a few first, so that most of the rest can't be among the nearest
            self._strip(batch.slice(start, width))
            self.seen, start = True, start + width

    def _strip(self, part: pa.RecordBatch) -> None:
        """Kinds that pass by, in order of ids. Scores are those of their profiles and of their clusters, which are fewer."""
        width, m = part.num_rows, part.column("size").to_numpy().astype(float)
        (profile, pv, rows), (cluster, cv, small) = (_rows_once(part.column(c), part.column(d), part.column(w)) for c, d, w in (("profile", "pd", "pw"), ("cluster_id", "cd", "cw")))
        (a, na), (b, nb) = self.original.scores(*rows, len(profile)), self.reduced.scores(*small, len(cluster))
        kinds, first = part.column("kind").to_numpy(), _lists(part.column("ids"))
        at = np.minimum(np.searchsorted(kinds, self.kind), width - 1)
        own = np.where(kinds[at] == self.kind, at, -1)
        for i, method in enumerate(METHODS):
            sa, sb = (
                (_whole(2 * d, norm[:, None] + n[None, :]) if method == "pathsim" else _whole(d, np.sqrt(norm[:, None] * n[None, :])))
                for d, norm, n in ((a.reshape(-1, len(profile)), self.original.norm, na), (b.reshape(-1, len(cluster)), self.reduced.norm, nb))
            )
            if self.k > 0:
                for top, score, of in zip(self.tops[i], (sa, sb), (pv, cv), strict=True):
                    each = score[:, of]
                    row, column = top.open(each, kinds)
                    top.add(row, each[row, column], column, first)
            self._count(self.counts[i], sa, sb, pv, cv, m, own)

    def _count(self, counts: _Counts, sa: np.ndarray, sb: np.ndarray, pv: np.ndarray, cv: np.ndarray, m: np.ndarray, own: np.ndarray) -> None:
        """How many targets of the kinds that pass have which two scores: kinds of a query's cluster share what they have by profile and score."""
        rows, keys, sums = [], [], []
        groups = [np.unique(x, return_inverse=True) for x in sa]  # scores of each profile, and those that have them
        for c, kinds in enumerate(self.by_cluster):
            values, place = np.unique(sb[c], return_inverse=True)
            n = len(values)
            shared = None
            if sa.shape[1] * n <= 4 * len(m):
                shared = np.bincount(pv * n + place[cv], m, minlength=sa.shape[1] * n).reshape(-1, n)
            for u in kinds:
                found, group = groups[self.own_profile[u]]
                if shared is not None:
                    held = np.zeros((len(found), n))
                    if len(found) == 1:
                        held[0] = shared.sum(axis=0)
                    elif len(found) <= 8:
                        held = (group == np.arange(len(found))[:, None]).astype(float) @ shared
                    else:
                        np.add.at(held, group, shared)
                    held = held.reshape(-1)
                else:
                    pair = group[pv] * n + place[cv]
                    held = np.bincount(pair, m, minlength=len(found) * n) if len(found) * n <= 8 * len(m) else None
                if held is None:  # far more possible pairs of scores than targets
                    at, which = np.unique(pair, return_inverse=True)
                    held = np.bincount(which, m)
                    if own[u] >= 0:
                        held[which[own[u]]] -= 1
                else:
                    if own[u] >= 0:
                        held[group[pv[own[u]]] * n + place[cv[own[u]]]] -= 1
                    at = np.flatnonzero(held > 0)
                    held = held[at]
                x, y = found[at // n], values[at % n]
                on = ((x != 0) | (y != 0)) & (held > 0)
                rows.append(np.full(int(on.sum()), u))
                keys.append((x[on] + OFF) * (2 * OFF) + y[on] + OFF)
                sums.append(held[on])
        if rows:
            counts.put(np.concatenate(rows), np.concatenate(keys), np.concatenate(sums))

    def measures(self) -> pa.RecordBatch:
        if not self.ready:
            self._start()
        n, out = len(self.kind), []
        for i, method in enumerate(METHODS):
            found, scored = self._counted(*self.counts[i].all())
            overlap = self._overlap(self.tops[i], scored) if self.k > 0 else self.asked.astype(float)
            columns = {"cell": pa.array([self.cell] * n, pa.int32()), "path": pa.array([self.path] * n, pa.string()), "method": pa.array([method] * n), "u": self.kind, "asked": self.asked}
            out.append(pa.table(columns | found | {"overlap": overlap}))
        return pa.concat_tables(out).combine_chunks().to_batches()[0]

    def _counted(self, row: np.ndarray, key: np.ndarray, m: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        return counted(row, key, m, len(self.kind), self.k, self.n_targets, self.keep_self)

    def _overlap(self, tops: list[_Firsts], scored: list[np.ndarray]) -> np.ndarray:
        """Shares of the first k others that both rankings name, summed over a kind's queries."""
        k = self.k
        lists = []
        for t, s, names, own in zip(tops, scored, (self.profile, self.cluster), (self.own_profile, self.own_cluster), strict=True):
            short = np.zeros(len(names), bool)
            short[own[s <= k]] = True  # as many score with all kinds of a profile, or of a cluster
            lists.append([x[own] for x in t.table(short, self.least)])
        (a, in_a), (b, in_b) = lists
        both = (a[:, :, None] == b[:, None, :]) & in_a[:, :, None] & in_b[:, None, :]
        row, member = self.first[0][self.first_asked > 0], self.first[1][self.first_asked > 0]
        plain = both[:, :k, :k].sum(axis=(1, 2)) / k  # of queries that neither list names
        out = plain * (self.asked - np.bincount(row, minlength=len(self.kind)))
        rank = np.arange(k + 1)
        for s in range(0, len(row), 4096):
            r, i = row[s : s + 4096], member[s : s + 4096, None]
            own = [(ids[r] == i) & there[r] for ids, there in ((a, in_a), (b, in_b))]
            near = [rank - (np.cumsum(x, axis=1) - x) < k for x in own]  # the query itself takes no place
            hits = both[r] & (near[0] & ~own[0])[:, :, None] & near[1][:, None, :]
            out += np.bincount(r, hits.sum(axis=(1, 2)) / k, minlength=len(self.kind))
        return out


def kind_rows(kinds: DataFrame, members: DataFrame, half: DataFrame, small: DataFrame, k: int) -> DataFrame:
    """(cell, path, kind, profile, cluster_id, size, asked, pd, pw, cd, cw, ids, asks): kinds with both their rows and first members.

    half has the rows (path, src, dst, w) of profiles, small (cell, path, src, dst, w) of clusters.
    """

    def row(links: DataFrame, by: list[str], name: str, ends: str, weights: str) -> DataFrame:
        lists = links.groupBy(*by, F.col("src").alias(name)).agg(F.collect_list(F.struct("dst", F.col("w").cast("double").alias("w"))).alias("row"))
        return lists.select(*by, name, F.col("row.dst").alias(ends), F.col("row.w").alias(weights))

    w = Window.partitionBy("cell", "path", "kind").orderBy("nid")
    few = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    few = few.groupBy("cell", "path", "kind").agg(F.array_sort(F.collect_list(F.struct("nid", F.col("asked").cast("long").alias("asked")))).alias("few"))
    few = few.select("cell", "path", "kind", F.col("few.nid").alias("ids"), F.col("few.asked").alias("asks"))
    found = kinds.join(row(half, ["path"], "profile", "pd", "pw"), ["path", "profile"], "left").join(row(small, ["cell", "path"], "cluster_id", "cd", "cw"), ["cell", "path", "cluster_id"], "left").join(few, ["cell", "path", "kind"])
    none = {c: F.coalesce(c, F.array().cast("array<long>" if c[1] == "d" else "array<double>")) for c in ("pd", "pw", "cd", "cw")}
    return found.withColumns(none).select("cell", "path", "kind", F.col("profile").cast("long").alias("profile"), F.col("cluster_id").cast("long").alias("cluster_id"), F.col("size").cast("long").alias("size"), F.col("asked").cast("long").alias("asked"), *none, "ids", "asks")


def block_measures(rows: DataFrame, least: list[int], n_targets: int, k: int, keep_self: bool, block: int | None = None) -> DataFrame:
    """(cell, path, method, u, asked, measures) of each kind that holds queries, of kind_rows().

    s and ss are the sum of differences and of their squares, overlap is summed over the kind's
    queries; least has the 2k + 3 least targets. Each block of query kinds reads all kinds, so
    what is sent grows with kinds times blocks.
    """
    rows = cut(rows)
    size = F.lit(block) if block else F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / BLOCKS)))
    groups = rows.where("asked > 0").groupBy("cell", "path").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / size))
    before = F.sum("blocks").over(Window.orderBy("cell", "path")) - F.col("blocks")  # a row for each reduction and path
    groups = cut(groups.select("cell", "path", "n", "blocks", before.alias("before")))
    total = groups.agg(F.sum("blocks")).first()[0] or 1
    dealt = rows.join(F.broadcast(groups), ["cell", "path"])
    # kinds of a cluster share work, so they go to one block, up to half of one together
    parts = F.ceil(F.count("*").over(Window.partitionBy("cell", "path", "cluster_id")) / (size / 2))
    place = F.xxhash64("cluster_id", F.pmod(F.xxhash64("kind"), parts))
    own = dealt.where("asked > 0").withColumn("deal", F.col("before") + F.pmod(place, F.col("blocks"))).withColumn("side", F.lit(0)).drop("n")
    every = dealt.withColumn("deal", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("blocks") - 1))).withColumn("side", F.lit(1)).drop("n")
    ordered = own.unionByName(every).drop("before", "blocks").repartition(int(min(total, 1000)), "deal").sortWithinPartitions("deal", "side", "kind")
    ids = np.array(sorted(least), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            deal, side = batch.column("deal").to_numpy(), batch.column("side").to_numpy()
            ends = [0, *(np.flatnonzero((deal[1:] != deal[:-1]) | (side[1:] != side[:-1])) + 1), len(deal)]
            for start, end in zip(ends, ends[1:], strict=False):
                if deal[start] != at:
                    if block is not None and block.own:
                        yield block.measures()
                    at, block = deal[start], _Block(n_targets, k, keep_self, ids)
                if side[start] == 0 or block.own:  # a deal without queries has nothing to do
                    block.take(batch.slice(start, end - start), side[start] == 0)
        if block is not None and block.own:
            yield block.measures()

    return ordered.mapInArrow(work, OUT)
