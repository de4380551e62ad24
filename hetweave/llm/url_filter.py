"""URL filters by a temporal list join, in DataFrame operations only.

A filter list is a history of dated entries: a key (a host or a host with a path) is added or
removed on a date. Each entry becomes a validity interval that ends at the key's next entry. A
capture is looked up under every suffix of its host and prefix of its path, and an as-of join
keeps the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hetweave.llm.common import cut, free_name

#: The default list. (key, action, day, category)
DEFAULT_LIST = (
    ("casino-win.example.com", "add", "2024-01-01", "gambling"),
    ("free-bets.example.com", "add", "2024-03-01", "gambling"),
    ("free-bets.example.com", "remove", "2024-06-01", "gambling"),
    ("free-bets.example.com", "add", "2024-09-01", "gambling"),
    ("cheap-pills.example.com", "add", "2024-02-15", "pharmacy"),
    ("ads-track.example.com", "add", "2024-01-01", "tracker"),
    ("ads-track.example.com", "remove", "2024-11-01", "tracker"),
    ("m.ads-track.example.com", "add", "2024-10-01", "tracker"),
    ("blog.tionsh.example.com/en", "add", "2024-05-01", "spam"),
    ("blog.tionsh.example.com/en", "remove", "2024-08-01", "spam"),
)
#: A list up to this many bytes, of keys up to this deep, is sent to all executors; beyond that
#: both sides are shuffled.
BROADCAST_BYTES = 8 << 20
BROADCAST_DEPTH = 16


def default_list(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DEFAULT_LIST), "key string, action string, day string, category string")
    return rows.select("key", "action", F.to_date("day").alias("at"), "category")


def fetch_date(page_id: Column) -> Column:
    """For tables without a fetch time: a day of 2024 from the id, 366 days in turn."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of each stretch of time in which an entry is active.

    entries has (key, action, at, category). An entry ends at the next of the same key and
    category; repeated entries, and those with a null key or time, change nothing; at one time
    a removal comes after an addition. valid_to is null while nothing ends it.
    """
    w = Window.partitionBy("key", "category").orderBy("at", F.col("action") == "remove")
    rows = entries.where("key is not null and at is not null").select(F.lower("key").alias("key"), "action", "at", "category").distinct()
    rows = rows.withColumn("until", F.lead("at").over(w)).where("action = 'add'")
    return rows.select("key", "category", F.col("at").alias("valid_from"), F.col("until").alias("valid_to")).where("valid_to is null or valid_to > valid_from")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _labels(url: Column) -> Column:
    return F.split(url_host(url), r"\.")


def _steps(url: Column) -> Column:
    return F.filter(F.split(F.lower(url_path(url)), "/"), lambda x: x != "")


def _suffix(url: Column, k: Column) -> Column:
    """The last k labels of the host, or null if it has fewer."""
    return F.when(F.size(_labels(url)) >= k, F.array_join(F.slice(_labels(url), -k, k), "."))


def _prefix(url: Column, k: Column) -> Column:
    """The host and the first k steps of the path, or null if it has fewer."""
    return F.when((F.size(_steps(url)) >= k) & url_host(url).isNotNull(), F.concat_ws("/", url_host(url), F.array_join(F.slice(_steps(url), 1, k), "/")))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched_at", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """captures with a column of the list entries active at fetch time; also that column's name.

    A key without a slash covers the host and all below it; a key with one covers that host's
    paths from these steps on. The column is an array of structs (key, category, valid_from,
    valid_to), sorted, empty for URLs that no active entry covers. Null or malformed URLs and
    null fetch times match nothing and stay. An entry holds from valid_from, itself included,
    until valid_to. Repeated rows each stay; extra columns pass through.

    Only host suffixes and path prefixes as deep as the list's deepest keys are looked up: a
    deeper one could match nothing. A list of checked size and depth is sent to the executors,
    one lookup for each depth, so captures are not shuffled whatever their hosts. A longer list
    meets the distinct (URL, time) pairs in a shuffle by key.
    """
    name = free_name(captures, "active")
    spans = cut(validity(entries))
    deep = F.max(F.when(~F.col("key").contains("/"), F.size(F.split("key", r"\.")))), F.max(F.when(F.col("key").contains("/"), F.size(F.split("key", "/")) - 1))
    size, labels, steps = spans.agg(F.sum(F.octet_length("key") + F.octet_length(F.coalesce("category", F.lit(""))) + 32), *deep).first()
    labels, steps = labels or 0, steps or 0
    entry = F.struct("key", "category", "valid_from", "valid_to")
    kind = spans.select(F.array(entry).alias("h")).schema["h"].dataType
    empty = F.array().cast(kind)

    def active(time: Column):
        return lambda e: (time >= e["valid_from"]) & (e["valid_to"].isNull() | (time < e["valid_to"]))

    if (size or 0) <= broadcast_bytes and labels + steps <= BROADCAST_DEPTH:
        histories = cut(spans.groupBy("key").agg(F.collect_list(entry).alias("h")))
        out, found = captures, []
        lookups = [_suffix(F.col(url), F.lit(k)) for k in range(1, labels + 1)] + [_prefix(F.col(url), F.lit(k)) for k in range(1, steps + 1)]
        for n, key in enumerate(lookups):
            found.append(free_name(out, f"list_{n}"))
            k = free_name(out, f"list_key_{n}")
            out = out.withColumn(k, key)
            out = out.join(F.broadcast(histories.toDF(f"{k}_", found[-1])), F.col(k) == F.col(f"{k}_"), "left").drop(k, f"{k}_")
        all_ = F.concat(*[F.coalesce(F.col(c), empty) for c in found]) if found else empty
        out = out.withColumn(name, F.array_sort(F.filter(all_, active(F.col(fetched)))))
        return out.drop(*found), name
    u, t = free_name(captures, "u"), free_name(captures, "t")
    pairs = captures.select(F.col(url).alias(u), F.col(fetched).alias(t)).where(F.col(u).isNotNull() & F.col(t).isNotNull()).distinct()
    keys = F.array(*[_suffix(F.col(u), F.lit(k)) for k in range(1, labels + 1)], *[_prefix(F.col(u), F.lit(k)) for k in range(1, steps + 1)])
    keyed = pairs.withColumn("key", F.explode(F.array_distinct(keys))).where("key is not null")
    met = keyed.join(spans, "key").where(active(F.col(t))(F.struct("valid_from", "valid_to")))
    met = met.groupBy(u, t).agg(F.array_sort(F.collect_set(entry)).alias(name)).toDF(f"{u}_of", f"{t}_of", name)
    out = captures.join(met, (captures[url] == met[f"{u}_of"]) & (captures[fetched] == met[f"{t}_of"]), "left").drop(f"{u}_of", f"{t}_of")
    return out.withColumn(name, F.coalesce(F.col(name), empty)), name


def drop_listed(captures: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """The captures that no entry active at their fetch time covers, with their own columns."""
    found, name = filter_urls(captures, entries, **options)
    return found.where(F.size(name) == 0).drop(name)
