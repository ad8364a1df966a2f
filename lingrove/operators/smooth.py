"""Smoothing of scores over an ordered sequence of strings (a conversation, the lines of a text).

Each string's scores are mixed with a prior: score = L * c + (1 - L) * P, where P decays by 1/4 from string to string and takes in the scores of those before,
and L grows with the string's length and best score. Unrolled, P at step t is the sum over k < t of 4^-(t-k) * w_k * c_k over the scores that reach the threshold, so
a frame of 30 strings is exact to double precision.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECAY, UNSURE, ZERO = 0.25, 1.2, 0.01
FRAME = 30


def smoothed(scored: DataFrame, seq: list[str], order: str, frame: int = FRAME, numbered: bool = False) -> DataFrame:
    """Adds ``smoothed``; scored: (seq..., order, lang_id, n_bytes, score), ``order`` a whole number.

    The first string of a sequence keeps its scores. A language without a row for a string has score 0 there, and gets none. ``numbered``: ``order`` numbers the strings
    from 1, so that those without any row count as a step too, in which the prior decays.
    """
    by = Window.partitionBy(*seq)
    at = scored.withColumn("_t", F.col(order).cast("int") if numbered else F.dense_rank().over(by.orderBy(order)))
    at = at.withColumn("_best", F.max("score").over(Window.partitionBy(*seq, order)))
    size = F.col("n_bytes").cast("double")
    w = F.when(F.col("_t") == 1, F.log(size)).otherwise(2.0 + 0.25 * F.log(size))
    at = at.withColumn("_c", F.when(F.col("score") >= ZERO, w * F.col("score")).otherwise(0.0))
    past = F.collect_list(F.struct("_t", "_c")).over(Window.partitionBy(*seq, "lang_id").orderBy("_t").rangeBetween(-frame, -1))
    prior = F.aggregate(past, F.lit(0.0), lambda s, x: s + x["_c"] * F.pow(F.lit(DECAY), F.col("_t") - x["_t"]))
    weight = F.greatest(F.lit(0.0), 0.5 * F.cbrt(size) + 0.3 * F.pow(F.greatest(F.lit(0.0), F.col("_best")) / UNSURE, F.lit(1.33)))
    lam = weight / (1.0 + weight)
    mixed = F.when(F.col("_t") == 1, F.col("score")).otherwise(lam * F.col("score") + (1.0 - lam) * prior)
    return at.withColumn("smoothed", F.round(mixed, 6)).drop("_t", "_best", "_c")


class Prior:
    """The same as a running state: one per sequence, for streams."""

    def __init__(self, values: dict[int, float] | None = None, strings: int = 0):
        self.values, self.strings = dict(values or {}), strings

    def step(self, scores: dict[int, float], n_bytes: int) -> dict[int, float]:
        """Smoothed scores of the next string; the state moves on."""
        if not self.strings:
            out, w = dict(scores), math.log(n_bytes)
            self.values = {}
        else:
            self.values = {k: v * DECAY for k, v in self.values.items()}
            best = max(0.0, max(scores.values(), default=0.0))
            weight = max(0.0, 0.5 * float(np.cbrt(n_bytes)) + 0.3 * (best / UNSURE) ** 1.33)
            lam = weight / (1 + weight)
            out = {k: lam * v + (1 - lam) * self.values.get(k, 0.0) for k, v in scores.items()}
            w = 2.0 + 0.25 * math.log(n_bytes)
        for k, v in scores.items():
            if v >= ZERO:
                self.values[k] = self.values.get(k, 0.0) + w * v
        self.strings += 1
        return out
