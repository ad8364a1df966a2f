"""Scalar functions of the models: scaling, smoothing, quantising, weighting. Each takes and gives Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POWER = 0.14
BIGRAM_WEIGHT = 0.15
STOP_PENALTY = -9.0
SURE, RATIO, TOP_N = 0.01, 0.8, 3
U32 = 4294967295


def length_factor(n: int, bigram_weight: float = BIGRAM_WEIGHT) -> float:
    """Weight of a matched n-gram by its length: 270 n^0.75; bigrams count only ``bigram_weight`` of that."""
    return 270.0 * n**0.75 * (bigram_weight if n == 2 else 1.0)


def scaled(count: Column, total: Column, power: float = POWER) -> Column:
    """Smoothed relative frequency as an unsigned 32-bit number; a positive count never becomes 0."""
    share = count.cast("double") / total
    if power > 0:
        s = F.pow(F.lit(100.0) * share, F.lit(power))
    elif power < 0:
        s = F.lit(4.0) * F.log1p(share * -power) / F.log1p(F.lit(float(-power)))
    else:
        s = F.lit(100.0) * share
    whole = F.least(F.lit(float(U32)), F.floor(F.lit(1e9) * s + 0.5)).cast("bigint")
    return F.when(count <= 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), whole))


def unscaled(value: Column, power: float = POWER) -> Column:
    """Percentage that a scaled frequency stands for."""
    s = value / F.lit(1e9)
    if power > 0:
        return F.pow(s, F.lit(1.0 / power))
    if power < 0:
        return F.lit(100.0 / -power) * F.expm1(s * F.log1p(F.lit(float(-power))) / 4.0)
    return s


def quantised(f: Column) -> Column:
    """Truncation to 15 bits of mantissa at one of four exponents; nonzero never becomes 0."""
    return (
        F.when(f <= 0, F.lit(0))
        .when(f >= 1 << 30, f - f % 131072)
        .when(f >= 1 << 28, f - f % 32768)
        .when(f >= 1 << 26, f - f % 8192)
        .otherwise(F.greatest(f - f % 2048, F.lit(2048)))
        .cast("bigint")
    )


def probability(quant: Column) -> Column:
    return quant / F.lit(1e11)


def percentage(quant: Column) -> Column:
    return quant / F.lit(1e9)


def mapped(quant: Column, is_stop: Column, penalty: float = STOP_PENALTY) -> Column:
    """Score of a model entry: a stop-gram counts against its language."""
    return F.when(is_stop, F.lit(penalty)).otherwise(F.lit(1.0)) * quant / F.lit(1e11)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def parse_weights(spec: str) -> dict[str, float]:
    """``b0.1,s1.5``: bigram weight, and stop-gram weight (its penalty is -10 times it); a part that can't be read is left out."""
    out = {}
    for part in spec.split(","):
        try:
            value = float(part.strip()[1:])
        except ValueError:
            continue
        if part.strip()[:1] == "b":
            out["bigram_weight"] = value
        elif part.strip()[:1] == "s":
            out["stop_penalty"] = -10.0 * value
    return out
