"""Arithmetic on score vectors: rows (ids..., lang_id, score); a language without a row has score 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 0.01


def _added(a: DataFrame, b: DataFrame, ids: list[str], of: Column) -> DataFrame:
    both = a.select(*ids, "lang_id", F.col("score").alias("_a"), F.lit(None).cast("double").alias("_b")).unionByName(b.select(*ids, "lang_id", F.lit(None).cast("double").alias("_a"), F.col("score").alias("_b")))
    sums = both.groupBy(*ids, "lang_id").agg(F.coalesce(F.max("_a"), F.lit(0.0)).alias("_a"), F.coalesce(F.max("_b"), F.lit(0.0)).alias("_b"))
    return sums.select(*ids, "lang_id", of.alias("score"))


def add(a: DataFrame, b: DataFrame, ids: list[str], weight: float = 1.0) -> DataFrame:
    """a + weight * b; each has one row at most for (ids, lang_id)."""
    return _added(a, b, ids, F.col("_a") + F.lit(weight) * F.col("_b"))


def add_thresholded(a: DataFrame, b: DataFrame, ids: list[str], threshold: float, weight: float = 1.0) -> DataFrame:
    """a + weight * b, where b reaches the threshold."""
    return _added(a, b, ids, F.col("_a") + F.when(F.col("_b") >= threshold, F.lit(weight) * F.col("_b")).otherwise(0.0))


def subtract(a: DataFrame, b: DataFrame, ids: list[str], weight: float = 1.0) -> DataFrame:
    """a - weight * b."""
    return _added(a, b, ids, F.col("_a") - F.lit(weight) * F.col("_b"))


def scaled(a: DataFrame, factor: float, lang_id: int | None = None) -> DataFrame:
    """All scores, or those of one language, times a factor."""
    some = F.lit(True) if lang_id is None else F.col("lang_id") == lang_id
    return a.withColumn("score", F.when(some, F.col("score") * F.lit(factor)).otherwise(F.col("score")))


def rooted(a: DataFrame) -> DataFrame:
    """Square roots; a negative score, as stop-grams give, has none: NaN."""
    return a.withColumn("score", F.sqrt("score"))


def nonzero(a: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., n): languages with a score above ``ZERO``; strings without a row have none here either."""
    return a.groupBy(*ids).agg(F.count_if(F.col("score") > ZERO).alias("n"))
