"""Choosing n-grams: top-K thresholds, and pruning of n-grams that a longer one implies.

A threshold is the K-th largest count, ties kept. It comes from the histogram of counts, which is small, so no group's n-grams are
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import suffix

STRICT = 0.995


def thresholds(df: DataFrame, by: str, k: int, value: str = "cnt", floor: int = 0) -> DataFrame:
    """(by, thr, n): the k-th largest value of each group, ``floor`` where there are fewer; n: rows of the group."""
    hist = df.groupBy(by, value).agg(F.count("*").alias("m"))
    down = hist.withColumn("above", F.sum("m").over(Window.partitionBy(by).orderBy(F.desc(value))))
    return down.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col(value))), F.lit(floor)).alias("thr"), F.sum("m").alias("n"))


def top_trigrams(trigrams: DataFrame, k: int, by: str = "grp") -> DataFrame:
    """Trigrams that occur at least max(2, k-th largest count) times; 000000 and FFFFFF never stay."""
    some = trigrams.where((F.col("cnt") >= 2) & ~F.col("key").isin(0, 0xFFFFFF))
    thr = thresholds(some, by, k).select(F.col(by).alias("_by"), "thr")
    return some.join(thr, F.col(by).eqNullSafe(F.col("_by"))).where("cnt >= thr").drop("_by", "thr")


def without_suffixes(ngrams: DataFrame, low: int, high: int, ratio: float, alignment: int = 1) -> DataFrame:
    """Sets to 0 the count of an n-gram that is a suffix of a longer one with nearly its count (lengths low+2..high drop theirs)."""
    long = ngrams.where((F.col("len") >= max(low + 2, alignment + low)) & (F.col("len") <= high))
    best = long.select("grp", (F.col("len") - alignment).alias("len"), suffix(F.col("key"), F.col("len"), alignment).alias("key"), "cnt").groupBy("grp", "len", "key").agg(F.max("cnt").alias("longer"))
    joined = ngrams.join(best, ["grp", "len", "key"], "left")
    return joined.withColumn("cnt", F.when(F.col("longer") >= F.lit(ratio) * F.col("cnt"), F.lit(0)).otherwise(F.col("cnt")).cast("bigint")).drop("longer")


def with_max_child(ngrams: DataFrame) -> DataFrame:
    """Adds ``child``: the largest count among the n-grams that are one byte longer, 0 without any."""
    child = ngrams.select("grp", (F.col("len") - 1).alias("len"), F.call_function("shiftrightunsigned", F.col("key"), F.lit(8)).alias("key"), "cnt").groupBy("grp", "len", "key").agg(F.max("cnt").alias("child"))
    return ngrams.join(child, ["grp", "len", "key"], "left").withColumn("child", F.coalesce("child", F.lit(0).cast("bigint")))


def survives(min_length: int, ratio: float) -> Column:
    """Whether an n-gram isn't implied by a longer one; at the smallest length a stricter ratio may save it."""
    ok = F.col("child") < F.lit(ratio) * F.col("cnt")
    if ratio < STRICT:
        ok = ok | ((F.col("len") == min_length) & (F.col("child") < F.lit(STRICT) * F.col("cnt")))
    return ok & (F.col("cnt") > 0)


def unimplied(ngrams: DataFrame, low: int, high: int, min_length: int, ratio: float, alignment: int = 1) -> DataFrame:
    """One pass's n-grams without those that a longer one implies."""
    return with_max_child(without_suffixes(ngrams, low, high, ratio, alignment)).where(F.col("len") >= min(min_length, high)).where(survives(min_length, ratio)).select("grp", "len", "key", "cnt")


def most(kept: DataFrame, k: int) -> DataFrame:
    """The n-grams that reach the k-th largest count (all, when there are fewer than k)."""
    thr = thresholds(kept, "grp", k).select(F.col("grp").alias("_by"), F.when(F.col("n") < k, F.lit(1)).otherwise(F.greatest(F.lit(2), F.col("thr"))).alias("thr"))
    return kept.join(thr, F.col("grp").eqNullSafe(F.col("_by"))).where("cnt >= thr").select("grp", "len", "key", "cnt")


def pruned(ngrams: DataFrame, low: int, high: int, min_length: int, k: int, ratio: float, alignment: int = 1) -> DataFrame:
    """One pass's selection: drop implied n-grams, then keep those that reach the k-th largest count (all, when there are fewer than k)."""
    return most(unimplied(ngrams, low, high, min_length, ratio, alignment), k)
