"""Helpers of result tables: run folders, isclose, paired tests by configuration, timings."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hetweave.operators.ranking import student_two_sided


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def fresh_dir(spark: SparkSession, base: str, name: str, *, overwrite: bool = False) -> str:
    """A folder of results that doesn't exist yet: named by time, numbered if that is taken."""
    stamp = f"{base}/{name}" if overwrite else f"{base}/{name}_{datetime.now():%Y%m%d_%H%M%S}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    out, n = stamp, 0
    while not overwrite and fs.exists(path(out)):
        n += 1
        out = f"{stamp}_{n:02d}"
    fs.mkdirs(path(out))
    return out


def paired_by(raw: DataFrame, keys: tuple[str, ...], measure: str, a: str, b: str, setting: str = "setting", unit: str = "seed") -> DataFrame:
    """(keys, n, t, p): paired t-tests of two settings over shared units; p is null under two units."""
    left = raw.where(F.col(setting) == a).select(*keys, unit, F.col(measure).alias("a"))
    right = raw.where(F.col(setting) == b).select(*keys, unit, F.col(measure).alias("b"))
    d = left.join(right, [*keys, unit]).withColumn("d", F.col("a") - F.col("b"))
    stats = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when((F.col("n") > 1) & (F.col("s") > 1e-12), F.col("m") / (F.col("s") / F.sqrt("n")))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        out = np.where(n.to_numpy() > 1, 1.0, np.nan)
        known = t.notna().to_numpy()
        if known.any():
            out[known] = student_two_sided(t.to_numpy()[known], n.to_numpy()[known].astype(float) - 1)
        return pd.Series(out).where(~np.isnan(out), None)

    return stats.withColumn("t", t).select(*keys, "n", "t", p_value("t", "n").alias("p"))


def timed(frames: dict[str, Callable[[], DataFrame]], repeats: int = 5, warm_up: int = 1) -> list[dict]:
    """Seconds to compute each table whole, first and second alternating; rows (name, repeat, seconds)."""
    out = []
    for n in range(-warm_up, repeats):
        order = sorted(frames) if n % 2 == 0 else sorted(frames, reverse=True)
        for name in order:
            began = time.perf_counter()
            frames[name]().write.format("noop").mode("overwrite").save()
            if n >= 0:
                out.append({"name": name, "repeat": n, "seconds": time.perf_counter() - began})
    return out


def speedups(spark: SparkSession, rows: list[dict], baseline: str) -> DataFrame:
    """(name, mean_s, std_s, speedup): ratios of mean times to the baseline's."""
    t = spark.createDataFrame([(r["name"], r["seconds"]) for r in rows], "name string, s double")
    stats = t.groupBy("name").agg(F.avg("s").alias("mean_s"), F.stddev_samp("s").alias("std_s"))
    base = stats.where(F.col("name") == baseline).select(F.col("mean_s").alias("base"))
    return stats.join(base).select("name", "mean_s", "std_s", (F.col("base") / F.col("mean_s")).alias("speedup"))  # base is one row


def runtime_rollup(raw: DataFrame, baseline: str, *by: str) -> DataFrame:
    """(by, name, repeats, mean_s, std_s, median_s, p95_s, median_speedup, mean_speedup) of timings (by, name, repeat, seconds).

    Speed-ups are the baseline's time over the variant's within `by`; null where no baseline was
    timed. One repeat has deviation 0.
    """
    at = lambda p: F.percentile("seconds", F.lit(p))
    stats = raw.groupBy(*by, "name").agg(F.count("*").alias("repeats"), F.avg("seconds").alias("mean_s"), F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("std_s"), at(0.5).alias("median_s"), at(0.95).alias("p95_s"))
    base = stats.where(F.col("name") == baseline).select(*by, F.col("median_s").alias("base_median"), F.col("mean_s").alias("base_mean"))
    both = stats.join(base, list(by), "left") if by else stats.join(base, F.lit(True), "left")  # without groups base is one row
    return both.select(*by, "name", "repeats", "mean_s", "std_s", "median_s", "p95_s", (F.col("base_median") / F.col("median_s")).alias("median_speedup"), (F.col("base_mean") / F.col("mean_s")).alias("mean_speedup"))


def construction_cost(raw: DataFrame) -> DataFrame:
    """(stage, repeats, mean_s, share, peak_mb) of stage timings (stage, repeat, seconds, peak_mb).

    share is the mean over repeats of the stage's part in all seconds of its repeat; peak_mb,
    what the caller sampled, is the greatest of all repeats.
    """
    whole = raw.groupBy("repeat").agg(F.sum("seconds").alias("total"))
    return raw.join(whole, "repeat").groupBy("stage").agg(F.count("*").alias("repeats"), F.avg("seconds").alias("mean_s"), F.avg(F.col("seconds") / F.col("total")).alias("share"), F.max("peak_mb").alias("peak_mb"))
