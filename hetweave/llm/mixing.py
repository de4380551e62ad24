"""Mixing sources by a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time 0 to 1: straight lines between knots. Its
integral, scaled to the source's target, is the source's cumulative demand for words. The
source's documents lie end to end in an order fixed by a hash, once for each pass over the
source; the training position of a document is the time at which the demand reaches its first
word, the inverse of that integral. Words that the demand never reaches are not taken. Sorting
by position, in ranges, gives the order of training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hetweave.llm.common import cut, free_name, numbered_copies

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
Schedule = Sequence[tuple[float, float]]
#: Knots (time, weight) of the sources' schedules, in turn: even, rising, falling.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with rank, weight, cap and target: share of all words dealt by weight.

    Sources by code point, null last, weigh `weights` in turn. A target stops at `most` times
    its source; the excess goes to the others by weight until none is above. In order of
    cap / weight the sources that stop come first, so one running sum finds the level at which
    the others stand. The table has a row for each source, and is the only one put in order.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = sizes.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left / rest
    leveled = sizes.withColumn("level", level)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    found = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("found"), F.col("cap").cast("double")))
    return leveled.withColumn("found", found).select("source", "source_size", "rank", "weight", target.alias("target"))


def _pieces(schedule: Schedule) -> tuple[list[tuple[float, float, float, float]], float]:
    """(start, weight there, slope, integral up to the end) of each piece with a part in the integral, and the whole."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("a schedule's knots go from time 0 to 1, each later than the one before")
    if any(w < 0 for _, w in schedule) or not any(w > 0 for _, w in schedule):
        raise ValueError("a schedule's weights are at least 0, and some are more")
    out, total = [], 0.0
    for (t, w), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t) * (w + w1) / 2
        total += area
        if area > 0:
            out.append((t, w, (w1 - w) / (t1 - t), total))
    return out, total


def training_time(offset: Column, target: Column, which: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """The time at which a source's demand reaches offset words, null where it never does.

    The demand at time t is the target times the schedule's integral to t over that to 1, so
    the time is the root of a quadratic in the piece in which the integral falls. which counts
    from 0 and goes through the schedules in turn.
    """
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        pieces, total = _pieces(schedule)
        area, below, roots = offset / target * F.lit(total), 0.0, []
        for t, w, slope, upto in pieces:
            part = area - F.lit(below)
            # w x + slope x^2 / 2 = part, in the form that stays exact for small slopes
            root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * part, F.lit(0.0)))
            roots.append((upto, F.lit(t) + F.when(part > 0, F.lit(2.0) * part / (F.lit(w) + root)).otherwise(F.lit(0.0))))
            below = upto
        time = roots[-1][1]
        for upto, x in reversed(roots[:-1]):
            time = F.when(area < F.lit(upto), x).otherwise(time)
        out = F.when(F.pmod(which, F.lit(len(schedules))) == k, time).otherwise(out)
    return F.when((target > 0) & (offset < target), F.least(out, F.lit(1.0)))


def _key(doc_id: Column, text: Column) -> Column:
    """The place of a row in its source: rows with equal keys repeat each other in id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _share_of_hash(key: Column) -> Column:
    """The first 28 bits of a key as a number from 0 to 1."""
    return F.conv(F.concat(F.lit("0"), F.substring(key, 1, 7)), 16, 10).cast("long") / F.lit(float(1 << 28))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str, buckets: int) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(source), F.lit("")).alias("s"),
        F.col(source).isNull().alias("no_s"),
        word_count(F.col(text)).alias("size"),
        _key(F.col(doc_id), F.col(text)).alias("key"),
    )
    return rows.withColumn("bucket", F.floor(_share_of_hash(F.col("key")) * buckets).cast("int"))


def _spans(rows: DataFrame) -> DataFrame:
    """(s, no_s, bucket) with its words and the words ahead of it, and the source's figures."""
    each = cut(rows.groupBy("s", "no_s", "bucket").agg(F.sum("size").alias("in_bucket")))
    sizes = each.groupBy("s", "no_s").agg(F.sum("in_bucket").alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("no_s"), F.col("s")).alias("source"), "source_size"))
    targets = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), "source_size", "rank", "target")
    ahead = F.sum("in_bucket").over(Window.partitionBy("s", "no_s").orderBy("bucket")) - F.col("in_bucket")
    return cut(each.withColumn("ahead", ahead).join(targets, ["s", "no_s"]))


def plan_mixture(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedules: Sequence[Schedule] = SCHEDULES, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, position, passes), in training order.

    A row's words are asked for in each pass over its source, from the time at which the demand
    reaches its first word to the time at which it reaches its end. taken counts the words so
    reached by time 1: all of them in a pass that ends by then, those up to the demand's last
    whole word in the pass that it breaks off. So the taken words of a source sum to its target,
    rounded down, and no row gives more than `MOST` times its size. position is the training
    time, 0 to 1, of the first pass, and 1 where the demand never comes to the row; passes counts
    the times at which words of the row are asked for. Rows are range-sorted by position.

    The order in a source is by a hash of id and text, so reruns agree; rows that repeat each
    other in full are alike, counted once and told apart by number. A source's running sum goes
    over buckets of the hash first and then inside each bucket, so one task has a 1/buckets part
    of a source, whatever the ids. Schedules go to the sources in order of their names, in turn.
    Null texts have size 0 and are taken 0 times; a null source is a source; an empty table
    gives no rows.
    """
    rows = _narrow(docs, doc_id, text, source, buckets)
    same = ["s", "no_s", "bucket", "key", "doc_id", "size"]
    rows = cut(rows.groupBy(*same).agg(F.count("*").alias("copies")))
    words = F.col("size") * F.col("copies")
    ahead = F.sum(words).over(Window.partitionBy("s", "no_s", "bucket").orderBy("key", "doc_id", "size")) - words
    spans = _spans(rows.withColumn("size", words))
    rows = numbered_copies(rows.withColumn("inside", ahead), "copies", "copy").join(spans, ["s", "no_s", "bucket"])
    rows = rows.withColumn("first", F.col("ahead") + F.col("inside") + F.col("copy") * F.col("size"))
    demand, which = F.floor("target").cast("long"), F.col("rank") - 1
    taken, passes = F.lit(0).cast("long"), F.lit(0)
    for p in range(MOST):
        begin = F.col("first") + F.col("source_size") * p
        # whole words only: a word is asked for when the demand has come to its end by time 1
        enter = F.when(begin < demand, training_time(begin.cast("double"), F.col("target"), which, schedules))
        rows = rows.withColumn(f"enter_{p}", enter)
        asked = F.col(f"enter_{p}").isNotNull() & (F.col("size") > 0)
        taken = taken + F.when(asked, F.least(F.col("size"), demand - begin)).otherwise(F.lit(0))
        passes = passes + asked.cast("int")
    position = F.coalesce("enter_0", F.lit(1.0)).alias("position")
    rows = rows.select("doc_id", "size", F.when(~F.col("no_s"), F.col("s")).alias("source"), "source_size", "target", taken.alias("taken"), position, passes.alias("passes"))
    return rows.orderBy("position", "doc_id", "size")


#: Rows of the bucket table up to which it is sent to all executors (a row is under 200 bytes).
BROADCAST_ROWS = 200_000


def _inside() -> Column:
    """Words of a bucket up to a row, itself included."""
    return F.sum("size").over(Window.partitionBy("s", "no_s", "bucket").orderBy("key", "doc_id", "size"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedules: Sequence[Schedule] = SCHEDULES, buckets: int = BUCKETS
) -> DataFrame:
    """docs in training order, with its own columns: a row for each pass that takes words of it.

    A row whose first word lies within its source's demand is given whole in that pass; rows of
    no words are left out. Texts move once, into ranges of position: the hash says how far into
    its bucket's words a row lies, which is its offset up to a part of 1/buckets of its source.
    Of each source only the bucket in which a pass ends is summed row by row, which gives the
    row at which it ends; rows that repeat each other in full are taken or left together there.
    The bucket table is sent to all executors while its counted rows are few, and joined by a
    shuffle beyond.
    """
    spans = _spans(_narrow(docs, doc_id, text, source, buckets))
    stop = F.least(F.greatest(F.floor("target").cast("long") - F.col("source_size") * F.col("pass"), F.lit(0)), F.col("source_size"))
    ends = spans.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(MOST)]))).withColumn("stop", stop)
    # a bucket lies before the end of a pass, beyond it, or has the end inside
    ends = cut(ends.where(F.col("ahead") < F.col("stop")))
    split = ends.where(F.col("stop") < F.col("ahead") + F.col("in_bucket")).select("s", "no_s", "bucket", "pass", "stop", "ahead")
    at_end = _narrow(docs, doc_id, text, source, buckets).join(F.broadcast(split.select("s", "no_s", "bucket").distinct()), ["s", "no_s", "bucket"])  # MOST rows a source
    at_end = at_end.groupBy("s", "no_s", "bucket", "key", "doc_id").agg(F.sum("size").alias("size"))
    at_end = at_end.withColumn("inside", _inside()).join(split, ["s", "no_s", "bucket"])
    beyond = at_end.where(F.col("ahead") + F.col("inside") - F.col("size") >= F.col("stop"))
    limits = beyond.groupBy("s", "no_s", "bucket", "pass").agg(F.min("key").alias("limit"))
    ends = ends.join(limits, ["s", "no_s", "bucket", "pass"], "left").drop("stop")
    many = ends.count() > BROADCAST_ROWS

    names = {x: free_name(docs, f"mix_{x}") for x in ("s", "no_s", "key", "bucket", "at")}
    tag = free_name(docs, "mix")
    ends = ends.select("s", "no_s", "bucket", F.struct("pass", "ahead", "in_bucket", "source_size", "target", "rank", "limit").alias(tag))
    ends = ends.toDF(names["s"], names["no_s"], names["bucket"], tag)
    own = docs.withColumns({names["s"]: F.coalesce(F.col(source), F.lit("")), names["no_s"]: F.col(source).isNull(), names["key"]: _key(F.col(doc_id), F.col(text))})
    own = own.withColumn(names["bucket"], F.floor(_share_of_hash(F.col(names["key"])) * buckets).cast("int"))
    out = own.join(ends if many else F.broadcast(ends), [names["s"], names["no_s"], names["bucket"]])
    limit = F.col(f"{tag}.limit")
    out = out.where(F.col(text).rlike(r"[^\x20\x09-\x0D]") & F.when(limit.isNull(), True).otherwise(F.col(names["key"]) < limit))
    share = _share_of_hash(F.col(names["key"])) * buckets - F.col(names["bucket"])
    offset = F.col(f"{tag}.source_size") * F.col(f"{tag}.pass") + F.col(f"{tag}.ahead") + share * F.col(f"{tag}.in_bucket")
    at = F.coalesce(training_time(offset, F.col(f"{tag}.target"), F.col(f"{tag}.rank") - 1, schedules), F.lit(1.0))
    ordered = out.withColumn(names["at"], at)
    ordered = ordered.repartitionByRange(F.col(names["at"]), F.col(doc_id)).sortWithinPartitions(names["at"], doc_id)
    return ordered.select(*[ordered[c] for c in docs.columns])
