"""Benchmark decontamination with suffix arrays over the training words.

Each run of training rows inside a task is a shard with a suffix array of its own over all its
word suffixes, sorted by their first words. Every benchmark suffix that begins a window is looked
up in it by binary search, a word at a time: the range of suffixes that agree with it so far is
narrowed by the next word until the window is through or nothing is left. The range holds all
places where the window occurs. Words are compared by 64-bit hashes and, where a window is found,
by their bytes. At each place the longest match is as far as both sides go on alike; it counts
where the words before it differ, so each verbatim stretch is told once.

An array serves all blocks of the benchmark that are at hand and is not kept: writing it would
take more room than the text, and it is read only once. A row longer than a shard gets several
arrays over parts of its suffixes, which read on beyond their part.

The benchmark travels to the executors in blocks of a checked size, a few at a time; what these
have found is written before the next few are taken up. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import add_column, cut, free_name, pieces, small_batches, text_buffer
from hetweave.llm.words import find_words, hash_words

SHARD_BYTES = 4 << 20
SHARD_WORDS = 1 << 20
#: Blocks of the benchmark that are on the executors at a time.
LIVE_BLOCKS = 8
_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
CONTAMINATION = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("matches", T.ArrayType(_MATCH)),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
    ]
)


class Suffixes:
    """The words of one block of items and the suffixes that begin its windows."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.ids = [i for i, _ in items]
        texts = [(text or "").encode() for _, text in items]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.data, self.starts, self.ends, before = find_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.words = hash_words(self.data, self.starts, self.ends)
        counts = np.diff(before)
        self.item = np.repeat(np.arange(len(items)), counts)
        self.first = before[:-1]
        self.left = before[1:][self.item] - np.arange(len(self.words))
        n = counts[self.item]
        #: Where windows begin, and their words: an item shorter than a window is one itself.
        self.at = np.flatnonzero((self.left >= window) | ((n < window) & (self.left == n)))
        self.need = np.minimum(n[self.at], window)


def suffix_array(words: np.ndarray, left: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The first n suffixes in order of their first words, at least `depth` of them, by doubling.

    left counts a suffix's words; one that ends comes before those that go on.
    """
    _, rank = np.unique(words, return_inverse=True)
    rank, order, h = rank.astype(np.int64), None, 1
    # a pair of ranks and a place fit one number, and numbers sort faster than places by number
    room = max(1, int(len(words) - 1).bit_length())
    place = np.arange(len(words))
    while h < depth:
        top = int(rank.max()) + 2
        then = np.zeros(len(words), np.int64)
        then[: max(0, len(words) - h)] = rank[h:] + 1
        then[left <= h] = 0
        if (top * top).bit_length() + room > 63:
            raise ValueError("too many words for one array")
        both = np.sort((rank * top + then) << room | place)
        order, sorted_ = both & ((1 << room) - 1), both >> room
        rank = np.empty(len(words), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        h *= 2
    if order is None:
        order = np.argsort(rank, kind="stable")
    return order if n == len(words) else order[order < n]


def _narrow(array: np.ndarray, words: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, d: int, right: bool) -> np.ndarray:
    """Binary search in all ranges at once, by the word at distance d, for the place of what is wanted."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        p = array[np.minimum(mid, len(array) - 1)]
        there = np.where(left[p] > d, words[np.minimum(p + d, len(words) - 1)], 0)
        less = there <= want if right else there < want
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def _search(array: np.ndarray, words: np.ndarray, left: np.ndarray, block: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, low, high): the windows of the block that occur, with their ranges in the array."""
    heads = words[array]
    first = block.words[block.at]
    low, high = np.searchsorted(heads, first, "left"), np.searchsorted(heads, first, "right")
    which = np.flatnonzero(low < high)
    done, low, high = [], low[which], high[which]
    for d in range(1, block.window + 1):
        through = block.need[which] <= d
        done.append((which[through], low[through], high[through]))
        which, low, high = which[~through], low[~through], high[~through]
        if not len(which):
            break
        want = block.words[block.at[which] + d]
        low, high = (_narrow(array, words, left, low, high, want, d, right) for right in (False, True))
        on = low < high
        which, low, high = which[on], low[on], high[on]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


class Shard:
    """The words of some training rows, looked up in block after block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int) -> None:
        self.data, self.starts, self.ends, self.before = find_words(data, offsets)
        self.counts = np.diff(self.before)
        self.words = hash_words(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = self.before[self.row + 1] - np.arange(len(self.words))
        self.arrays = []
        for a in range(0, len(self.words), SHARD_WORDS):
            part = slice(a, min(len(self.words), a + SHARD_WORDS + depth))
            self.arrays.append(a + suffix_array(self.words[part], self.left[part], min(SHARD_WORDS, len(self.words) - a), depth))

    def same(self, p: int, block: Suffixes, q: int, n: int) -> bool:
        """Whether n words here and there are the same bytes."""
        sizes = self.ends[p : p + n] - self.starts[p : p + n]
        if (sizes != block.ends[q : q + n] - block.starts[q : q + n]).any():
            return False
        return all((self.data[self.starts[p + k] : self.ends[p + k]] == block.data[block.starts[q + k] : block.ends[q + k]]).all() for k in range(n))

    def look_up(self, block: Suffixes, longest: bool) -> dict[int, tuple[list[tuple[int, int]], list[str], list[dict]]]:
        """For rows with hits their runs of hit words, items and longest matches."""
        runs: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        matches: dict[int, list[dict]] = {}
        for array in self.arrays if len(block.at) else []:
            which, low, high = _search(array, self.words, self.left, block)
            # equal windows have equal ranges, so their places are looked at once
            groups: dict[tuple[int, int, int], list[int]] = {}
            for q, *span in zip(block.at[which].tolist(), low.tolist(), high.tolist(), block.need[which].tolist(), strict=True):
                groups.setdefault(tuple(span), []).append(q)
            for (a, b, n), places in groups.items():
                of = sorted({int(block.item[q]) for q in places})
                for p in array[a:b].tolist():
                    if not self.same(p, block, places[0], n):
                        continue
                    r = int(self.row[p])
                    here = p - int(self.before[r])
                    runs.setdefault(r, []).append((here, here + n))
                    items.setdefault(r, set()).update(of)
                    if longest:
                        matches.setdefault(r, []).extend(m for q in places for m in self._match(p, here, block, q))
        out = {}
        for r, found in runs.items():
            told = sorted(matches.get(r, []), key=lambda m: (m["item_id"], m["item_word"] - m["doc_word"], m["doc_word"]))
            out[r] = (_merge(found), sorted({block.ids[i] for i in items[r]}), told)
        return out

    def _match(self, p: int, here: int, block: Suffixes, q: int) -> list[dict]:
        """The match that begins here, unless the words before agree too."""
        k = q - int(block.first[block.item[q]])
        if here and k and self.words[p - 1] == block.words[q - 1]:
            return []
        n = int(min(self.left[p], block.left[q]))
        differ = np.flatnonzero(self.words[p : p + n] != block.words[q : q + n])
        return [{"item_id": block.ids[block.item[q]], "item_word": k, "doc_word": here, "n_words": int(differ[0]) if len(differ) else n}]


def _look_up(data: np.ndarray, offsets: np.ndarray, suffixes: Suffixes, longest: bool) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list[str], list[dict]]]]:
    """Words of each row, and what its hits are, against one block."""
    shard = Shard(data, offsets, suffixes.window)
    return shard.counts, shard.look_up(suffixes, longest)


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(blocks: list, window: int, text: str, name: str, again: bool, longest: bool):
    """A mapInArrow function that adds the struct, or joins what these blocks find to what is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, sizes = text_buffer(whole.column(whole.schema.names.index(text)))
            for a, b in pieces(sizes, SHARD_BYTES):
                batch = whole.slice(a, b - a)
                shard = Shard(*text_buffer(batch.column(batch.schema.names.index(text))), window)
                found = [shard.look_up(block.value, longest) for block in blocks]
                had = batch.column(batch.schema.names.index(name)).to_pylist() if again else None
                out = []
                for r, n in enumerate(shard.counts.tolist()):
                    parts = [f[r] for f in found if r in f]
                    if had:
                        parts.append(([(x["start"], x["end"]) for x in had[r]["runs"]], had[r]["item_ids"], had[r]["matches"]))
                    runs = _merge([x for p in parts for x in p[0]])
                    items = sorted({i for p in parts for i in p[1]})
                    out.append({"n_words": n, "n_hit": sum(e - s for s, e in runs), "item_ids": items, "runs": [{"start": s, "end": e} for s, e in runs], "matches": [m for p in parts for m in p[2]]})
                kept = batch.drop_columns([name]) if again else batch
                yield add_column(kept, name, pa.array(out, _ARROW))

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 4 << 20,
    longest: bool = True,
    live: int = LIVE_BLOCKS,
) -> tuple[DataFrame, str]:
    """Add a struct column to docs with what each text shares with the benchmark; also its name.

    Fields: n_words; n_hit, the words inside any occurrence of a window; item_ids, sorted as
    strings, the items with an occurring window; runs, the hit words as [start, end) word
    positions; matches, the longest verbatim matches with their place in item and text (left
    empty with longest=False). Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z.
    A window is `window` consecutive words of an item; a shorter item is one window.

    Null and empty texts have no words and no hits; items without words never occur; items
    with a null id are ignored; items with the same id count as one; repeated rows each keep
    their own result; an empty benchmark leaves every text clean. Other columns pass through.
    If docs already has the column name, an underscore is added to the new one.

    benchmark is split by id into blocks of about block_bytes each, found by its measured size. A
    block is what the driver holds, and `live` blocks what an executor's worker holds; with more
    of them the rows found so far are written to the checkpoint folder in between.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = free_name(docs, "contamination")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(0, n, live):
        sent = []
        for one in range(k, min(k + live, n)):
            block = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == one).collect()
            sent.append(spark.sparkContext.broadcast(Suffixes([(r.i, r.t) for r in sorted(block)], window)))
        kept = docs.drop(name) if k else docs
        docs = docs.mapInArrow(_pass(sent, window, text, name, k > 0, longest), T.StructType([*kept.schema.fields, T.StructField(name, CONTAMINATION)]))
        if k + live < n:
            docs = cut(docs)
    return docs, name


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that share no window with the benchmark, with the columns of docs.

    Takes the options of find_contamination and has its rules: null texts are clean and stay.
    """
    found, name = find_contamination(docs, benchmark, longest=False, **options)
    return found.where(F.col(name)["n_hit"] == 0).drop(name)
