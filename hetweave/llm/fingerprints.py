"""MinHash fingerprints: which texts share their shingles, from a few hundred bytes of each.

A text is the set of its runs of five words. Universal hash functions, all at once in numpy over
the words of a whole batch, each keep the least hash of the set; two texts agree in a register
with the chance of their Jaccard similarity, so the share of equal registers estimates it.
Bands of registers that agree name candidates in a join, and the sets themselves decide
(hetweave.llm.similar).

The fingerprint of an edited text costs only what the edit brought: shingles before it are those
of the text, and the least of two parts' registers is the whole's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import add_column, free_name, pieces, small_batches, text_buffer
from hetweave.llm.words import NOT_SPACE, find_words, hash_shingles, hash_words

WORDS = 5
#: Registers of a fingerprint, 16 bits of each least hash.
REGISTERS = 128
PIECE = 4 << 20
_BLOCK = 1 << 15
_EMPTY = np.iinfo(np.uint64).max


def permutations(registers: int = REGISTERS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the universal hash functions modulo 2 ** 64."""
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, registers), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def least_hashes(shingles: np.ndarray, firsts: np.ndarray, of: np.ndarray, n: int, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of each function over each run of shingles; (n, registers), all ones where there is none.

    Runs start at firsts and end where the next one starts; run k goes to row of[k], each to its own.
    """
    factors, addends = functions
    out = np.full((n, len(factors)), _EMPTY, np.uint64)
    if not len(shingles):
        return out
    scratch = np.empty(min(len(shingles), _BLOCK), np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        a, b = np.searchsorted(firsts, at, side="right") - 1, np.searchsorted(firsts, at + len(part))
        cuts = np.maximum(firsts[a:b] - at, 0)
        rows, space = of[a:b], scratch[: len(part)]
        with np.errstate(over="ignore"):
            for k in range(len(factors)):
                np.multiply(part, factors[k], out=space)
                space += addends[k]
                out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(space, cuts))
    return out


def registers_of(least: np.ndarray) -> np.ndarray:
    """16 well-mixed bits of each least hash, which by itself tends to 0 as a text grows."""
    with np.errstate(over="ignore"):
        x = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(48)).astype(">u2")


class Texts:
    """Words and shingles of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data, starts, ends, before = find_words(data, offsets, NOT_SPACE)
        self.starts, self.ends, self.before = starts, ends, before
        self.words = hash_words(data, starts, ends)
        self.shingles = hash_shingles(self.words, WORDS)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of all texts end to end, where each text's begin, and the text of each run.

        A text of fewer words than a shingle is one shingle.
        """
        counts = np.diff(self.before)
        whole = np.maximum(counts - WORDS + 1, 0)
        inside = np.repeat(self.before[:-1], whole) + np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        found, of = self.shingles[inside], np.repeat(np.arange(len(counts)), whole)
        few = np.flatnonzero((counts > 0) & (counts < WORDS))
        extra = [hash_shingles(self.words[self.before[k] : self.before[k + 1]], int(counts[k]))[0] for k in few]
        found, of = np.concatenate([found, np.array(extra, np.uint64)]), np.concatenate([of, few])
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        return found, firsts, of[firsts]

    def sets(self) -> list[np.ndarray]:
        """The distinct shingles of each text, in order of their hashes."""
        found, firsts, of = self.runs()
        out = [np.zeros(0, np.uint64)] * (len(self.before) - 1)
        for k, part in zip(of, np.split(found, firsts[1:]), strict=False):
            out[k] = np.unique(part)
        return out


def minhash(data: np.ndarray, offsets: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least hashes of each text; all ones for a text without words."""
    return least_hashes(*Texts(data, offsets).runs(), len(offsets) - 1, functions)


def with_fingerprints(docs: DataFrame, text: str = "text", registers: int = REGISTERS, seed: int = 42) -> tuple[DataFrame, str]:
    """docs with a column of fingerprints, binary, two bytes a register, and that column's name.

    Words stand between ASCII white space, A-Z lower-cased. A text of fewer than five words is
    one shingle; null, empty and blank texts have no shingle and agree with each other only.
    """
    small_batches(docs.sparkSession)
    name, functions = free_name(docs, "fingerprint"), permutations(registers, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.names.index(text)))
            out: list[bytes] = []
            for a, b in pieces(offsets, PIECE):
                part = data[offsets[a] : offsets[b]]
                out += [r.tobytes() for r in registers_of(minhash(part, offsets[a : b + 1] - offsets[a], functions))]
            yield add_column(batch, name, pa.array(out, pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])), name


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal registers of each row."""
    return (a == b).mean(axis=1)


def _below(x: Column, cuts: list[int], or_equal: bool) -> Column:
    """How many of the sorted cuts are below x (or equal), in steps of the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    literal = lambda v: F.from_json(F.lit(str([int(c) for c in v])), "array<bigint>")  # noqa: E731  folded to a literal
    less = (lambda c: c <= x) if or_equal else (lambda c: c < x)
    blocks = F.size(F.filter(literal(cuts[step - 1 :: step]), less))
    return (blocks * step + F.size(F.filter(F.slice(literal(cuts), blocks * step + 1, step), less))).cast("int")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(bucket, ahead, doc_id, text_hash, text): rows dealt by ascending id, and the number of buckets.

    Rows go by id, nulls last, and rows of one id by a hash of the text. Each bucket holds a run
    of that order, and beyond it, marked ahead, the row that follows (after the last, the first).
    Borders are quantiles of the ids; an id that takes several of them, and rows without an id,
    are cut further by the hash. What is sent along is a row for each bucket, and there are as
    many buckets as spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    want = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / want for k in range(1, want)]
    n, ids, cuts = rows.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", shares, 100 * want)).first()
    cuts, loose = list(cuts or []), -(-(n - ids) * want // max(n, 1))
    place = F.col("text_hash").cast("double") / 2.0**64 + 0.5  # from 0 to 1
    low, high = _below(F.col("doc_id"), cuts, False), _below(F.col("doc_id"), cuts, True)
    slice_ = lambda k: F.least(F.floor(place * k), F.greatest(k - 1, F.lit(0))).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + slice_(F.lit(loose))).otherwise(low + slice_(high - low))
    rows = rows.withColumn("bucket", bucket)
    key = F.struct(F.col("doc_id").isNull().alias("loose"), "doc_id", "text_hash")
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.min(key).alias("head")).collect())  # a row for each bucket
    to = [(h.doc_id, h.text_hash, heads[k - 1][0]) for k, (_, h) in enumerate(heads)]
    seen = F.broadcast(spark.createDataFrame(to, "of_id long, of_hash long, before int"))
    rows = rows.join(seen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    own, other = F.struct(F.col("bucket"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ahead"))
    rows = rows.select("doc_id", "text_hash", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("s"))
    buckets = len(cuts) + 1 + loose
    dealt = rows.select("s.bucket", "s.ahead", "doc_id", "text_hash", "text").repartitionById(buckets, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), "text_hash"), buckets


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by the first ones of the next, and how many stay."""
    n = len(text)
    stay = n - n // 4
    return text[:stay] + following[: n // 4], stay


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", registers: int = REGISTERS, seed: int = 42) -> DataFrame:
    """Each row's fingerprint against those of its edited text and of the next row's text.

    The edited text ends in the beginning of the next document, by ascending id; see in_order()
    for ties. near_edited and near_next are shares of equal registers. Null texts are empty;
    fingerprints are hexadecimal. Texts move once, rows of a task are taken in order, a batch at
    a time with one row held back. The only row of a table follows itself; an empty one has none.
    """
    small_batches(docs.sparkSession)
    functions = permutations(registers, seed)

    def block(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of one bucket but for the last, which only follows."""
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        own = Texts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        found, firsts, of = own.runs()
        n = len(texts)
        shas, tails, shared = [], [], np.zeros(n, np.int64)
        for k in range(n - 1):
            now, stay = edited(texts[k], texts[k + 1])
            coded = now.encode()
            shas.append(hashlib.sha256(coded).hexdigest())
            kept = stay if len(raw[k]) == len(texts[k]) else len(texts[k][:stay].encode())
            # words that end before the edit, so that nothing can join them
            first = own.before[k]
            m = int(np.searchsorted(own.ends[first : own.before[k + 1]], offsets[k] + kept))
            shared[k] = max(0, m - WORDS + 1)
            tails.append(coded[own.starts[first + shared[k]] - offsets[k] :] if shared[k] else coded)
        # two runs of each text: 2k of shingles that the edit leaves, 2k + 1 of the others
        rows = 2 * of + (shared[of] == 0)
        both = np.flatnonzero(np.diff(np.append(firsts, len(found))) > shared[of])
        both = both[shared[of[both]] > 0]
        cuts = np.concatenate([firsts, firsts[both] + shared[of[both]]])
        rows = np.concatenate([rows, 2 * of[both] + 1])
        order = np.argsort(cuts, kind="stable")
        parts = least_hashes(found, cuts[order], rows[order], 2 * n, functions).reshape(n, 2, -1)
        tail_offsets = np.cumsum([0, *map(len, tails)])
        new = Texts(np.frombuffer(b"".join(tails), np.uint8), tail_offsets)
        tail = least_hashes(*new.runs(), n - 1, functions)
        tail[(shared[: n - 1] > 0) & (np.diff(new.before) < WORDS)] = _EMPTY  # all its shingles are shared
        mine = registers_of(parts.min(axis=1))
        theirs = registers_of(np.minimum(parts[: n - 1, 0], tail))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[: n - 1], pa.int64()),
                pa.array([len(t) for t in texts[: n - 1]], pa.int64()),
                pa.array(shas, pa.string()),
                pa.array([r.tobytes().hex() for r in mine[: n - 1]], pa.string()),
                pa.array([r.tobytes().hex() for r in theirs], pa.string()),
                pa.array(likeness(mine[: n - 1], theirs)),
                pa.array(likeness(mine[:-1], mine[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, now = 0, None  # a bucket's rows follow each other; what is left of one ends with its row ahead
        done = False
        for batch in batches:
            for b, ahead, i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if b != now:
                    if len(texts) > 1:
                        yield block(ids, texts)
                    ids, texts, size, now, done = [], [], 0, b, False
                if done:
                    continue  # copies of the row ahead
                ids.append(i)
                texts.append(t)
                size += len(t)
                done = bool(ahead)
                if size > PIECE and len(texts) > 1:
                    yield block(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(texts) > 1:
            yield block(ids, texts)

    dealt, _ = in_order(docs, doc_id, text)
    return dealt.mapInArrow(run, EDITED)
