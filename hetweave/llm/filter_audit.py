"""How text filters interact: what each removes alone, in every order, and on average over orders.

Words are rows: a text is exploded into its words, words are counted by (document, word) and
then by document, which gives totals and distinct words. Texts are dealt by document once, so
both groupings run where the words are made and no word is ever sent. The other flags need no
words; they are found in the scan, joined to the word counts, and each document becomes a mask
of the filters that it fails. Per part, 32 conditional counts (one for each mask) hold all that
any order of the filters can do, so the orders are worked out on one row for each part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Copies of one row are spread over so many groups, by the task that read them.
SALTS = 64
SPACE = r" \t\n\u000B\u000C\r"


def _bit(filter_: str) -> int:
    return 1 << FILTERS.index(filter_)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_distinct) of each text that has words, once for each (doc_id, text_hash).

    docs has (doc_id, text_hash, text). Rows that repeat each other are spread by the task that
    read them; each of their groups counts its own rows' words, so the quotient is one text's.
    """
    dealt = docs.withColumn("salt", F.spark_partition_id() % SALTS).repartition("doc_id", "text_hash", "salt")
    bare = F.expr(f"trim(leading '{SPACE}' from text)")
    words = dealt.select("doc_id", "text_hash", "salt", F.posexplode(F.split(bare, f"[{SPACE}]+")).alias("at", "word")).where("word <> ''")
    by_word = words.groupBy("doc_id", "text_hash", "salt", "word").agg(F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("firsts"))
    by_group = by_word.groupBy("doc_id", "text_hash", "salt").agg(F.sum("n").alias("n"), F.sum("firsts").alias("rows"), F.count("*").alias("n_distinct"))
    by_text = by_group.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max("n_distinct").alias("n_distinct"))
    return by_text.select("doc_id", "text_hash", (F.col("n") / F.col("rows")).cast("long").alias("n_words"), "n_distinct")


def failure_masks(docs: DataFrame, labels: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5, signs: str = "[#$%&*|]") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters that they fail.

    Bit k of the mask is the k-th of FILTERS. A: fewer than least_words words. B: distinct words
    below least_distinct % of words. C: capitals A-Z above most_capitals % of code points.
    D: one of the signs occurs. E: a row of lesser id has the same text, in whatever part.

    A null text is an empty one, a null part the part ''. Rows of the least id of a text never
    fail E, be there several; rows without an id don't either, and are no one's lesser row.
    Every row counts, also where all its columns repeat another's. Of labels (doc_id, quality,
    toxic) an id is good or toxic if any of its rows says 1; ids without labels are neither.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    counted = word_counts(rows.select("doc_id", "text_hash", "text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = rows.select(
        "doc_id",
        "text_hash",
        "part",
        F.sha2("text", 256).alias("digest"),
        (100 * capitals.cast("long") > most_capitals * F.length("text").cast("long")).alias("c"),
        F.col("text").rlike(signs).alias("d"),
    )
    flags = flags.groupBy("doc_id", "text_hash", "part", "digest", "c", "d").agg(F.count("*").alias("n"))
    own = counted.withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text"})
    joined = flags.join(own, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    total, distinct = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_words", "n_distinct"))
    a, b = total < least_words, 100 * distinct < least_distinct * total
    mask = sum((F.when(x, _bit(f)).otherwise(0) for f, x in zip(FILTERS, (a, b, F.col("c"), F.col("d")), strict=False)), F.lit(0))
    joined = joined.select("doc_id", "part", "digest", "n", mask.alias("mask"))
    if labels is None:
        joined = joined.withColumns({"q": F.lit(0), "t": F.lit(0)})
    else:
        one = lambda c: F.max((F.col(c) == 1).cast("int"))
        by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(one("quality").alias("q"), one("toxic").alias("t"))
        joined = joined.join(by_id, F.col("doc_id") == F.col("label_id"), "left").na.fill(0, ["q", "t"])
    # copies of a text meet as sums: rows of each kind, their least id and how many rows have it
    of_id = joined.groupBy("digest", "part", "mask", "q", "t", "doc_id").agg(F.sum("n").alias("n"))
    kinds = of_id.groupBy("digest", "part", "mask", "q", "t").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = kinds.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("kinds"))
    kinds = kinds.join(least, "digest")
    stay = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = _bit("E")
    both = F.explode(F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - stay).alias("n"))))
    split = kinds.select("part", "q", "t", both.alias("m")).select("part", "q", "t", "m.mask", "m.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))


def conditional_counts(masks: DataFrame) -> DataFrame:
    """One row for each part: n_0 to n_31, good_0 to good_31 and toxic_0 to toxic_31."""
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}")
    return masks.groupBy("part").agg(*[at(c, m) for c in ("n", "good", "toxic") for m in range(MASKS)])


def audit_orders(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row for each part, order of the filters and step, worked out from the part's 32 counts.
    What stands before a step counts as a set: the same filters in another order leave the same
    rows, so 80 pairs of set and filter serve the 600 steps. shapley is what the step's filter
    removes, summed over all orders; a row that fails s filters is removed first by each of them
    in 1 of s orders.
    """
    spark, orders = counts.sparkSession, factorial(len(FILTERS))
    places = [("".join(order), k + 1, sum(map(_bit, order[:k])), _bit(f)) for order in permutations(FILTERS) for k, f in enumerate(order)]
    cases = sorted({(before, bit) for _, _, before, bit in places})
    meets = [(before, bit, m, int(m & (before | bit) == 0), int(bool(m & bit and not m & before)), int(bool(m & bit and m & before)), int(m == bit), orders // m.bit_count() if m & bit else 0) for before, bit in cases for m in range(MASKS)]
    table = spark.createDataFrame(meets, "before int, bit int, mask int, stays int, first int, late int, alone int, share int")
    every = F.array(*[F.struct(F.lit(m).alias("mask"), *[F.col(f"{c}_{m}").alias(c) for c in ("n", "good", "toxic")]) for m in range(MASKS)])
    rows = counts.select("part", F.explode(every).alias("m")).select("part", "m.*").join(F.broadcast(table), "mask")  # 2,560 rows sent
    total = lambda c, by: F.sum(F.col(c) * F.col(by))
    of_case = rows.groupBy("part", "before", "bit").agg(
        total("n", "stays").alias("kept"),
        total("n", "first").alias("removed"),
        total("n", "late").alias("redundant"),
        total("n", "alone").alias("unique_fails"),
        total("good", "first").alias("good_lost"),
        total("toxic", "first").alias("toxic_lost"),
        total("n", "share").alias("shapley"),
    )
    steps = spark.createDataFrame(places, "filter_order string, step int, before int, bit int")
    found = of_case.join(F.broadcast(steps), ["before", "bit"])  # 600 rows sent
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The audit of all orders of the five filters over docs, by part; see failure_masks() for options.

    Of an empty table there are no parts and so no rows. Columns of docs beyond the three that
    are named in the options are not read, whatever their names.
    """
    return audit_orders(conditional_counts(failure_masks(docs, labels, **options)))

