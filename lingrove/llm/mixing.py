"""Mixing sources to target weights by weighted fair queueing (operator 6).

Each source's documents queue in a shuffled (hash) order; a document's virtual finish time is the tokens of its
source up to and including it, divided by the source's weight. All documents are ordered by finish time
and those within the token budget stay, so every source that still has documents gets its share at every point.

Neither running sum gathers a source, or the table, in one task: rows are range-sorted (by source and shuffle key, then by
finish time) into ranges of about ``RANGE_ROWS`` rows, whatever the weights and the shares of the sources; ranges are summed, their sums run up, and rows run up within
their range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, fresh, tokens, written

BUDGET_SHARE = 0.6
RANGE_ROWS, MAX_RANGES = 50_000, 10_000  # beyond 500 million rows ranges grow
SEED = 11
BROADCAST_SOURCES = 100_000


def weight_of(weights: Mapping[str, float] | None, default: float = 1.0) -> Column:
    """Target weight by source; a source that isn't named (null too) has ``default``."""
    if any(w <= 0 for w in (weights or {}).values()) or default <= 0:
        raise ValueError("weights must be positive")
    out = F.lit(float(default))
    for name, w in (weights or {}).items():
        out = F.when(F.col("source") == name, F.lit(float(w))).otherwise(out)
    return out


def shuffle_key(seed: int = SEED) -> Column:
    """Position of a document in its source's queue: 32 bits of a hash of its id that SQL can say as well."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _ranges(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """``rows`` range-sorted, with ``r``, the number of the range; written, as ranges must not change."""
    return written(rows.repartitionByRange(max(1, min(MAX_RANGES, -(-n // RANGE_ROWS))), *order).withColumn("r", F.spark_partition_id()))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, finish, cum_tokens, k, h) of the documents that fit into the budget.

    Order: finish, source (null first), shuffle key, doc_id (null first), hash of the text. Budget: ``budget_tokens``, or
    ``budget_share`` of all tokens, rounded down. A document stays while the tokens up to and including it are within the
    budget; one without tokens costs nothing. Rows that repeat doc_id, source and text are one entry of the queue, with the tokens of them all.
    """
    rows = docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("h")).withColumn("k", shuffle_key(seed))
    rows = written(rows.groupBy("doc_id", "source", "k", "h").agg(F.sum("n_tokens").alias("n_tokens")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    budget = budget_tokens if budget_tokens is not None else math.floor(budget_share * total)
    source = F.col("source").asc_nulls_first()
    order = ("k", F.col("doc_id").asc_nulls_first(), "h")

    # tokens of the source up to each document
    queued = _ranges(rows, n, source, *order)
    before = queued.groupBy("source", "r").agg(F.sum("n_tokens").alias("s"))
    before = before.select(F.col("source").alias("bs"), F.col("r").alias("br"), (F.sum("s").over(Window.partitionBy("source").orderBy("r")) - F.col("s")).alias("before"))
    w = Window.partitionBy("source", "r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    timed = queued.join(before, queued.source.eqNullSafe(before.bs) & (queued.r == before.br)).withColumn("finish", (F.col("before") + F.sum("n_tokens").over(w)).cast("double") / weight_of(weights))

    # tokens of all sources up to each document, in order of finish
    sorted_ = _ranges(timed.select("doc_id", "source", "n_tokens", "k", "h", "finish"), n, "finish", source, *order)
    drop_written(rows, queued)
    sums = sorted_.groupBy("r").agg(F.sum("n_tokens").alias("s"))
    sums = sums.select(F.col("r").alias("br"), (F.sum("s").over(Window.orderBy("r")) - F.col("s")).alias("before"))
    w = Window.partitionBy("r").orderBy("finish", source, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = sorted_.join(sums.where(F.col("before") <= budget), sorted_.r == sums.br).withColumn("cum_tokens", F.col("before") + F.sum("n_tokens").over(w))
    return out.where(F.col("cum_tokens") <= budget).select("doc_id", "source", "n_tokens", "finish", "cum_tokens", "k", "h")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, finish, cum_tokens), sorted globally by finish; see ``schedule``.

    Null text: 0 tokens; texts are counted whole. A null source is a source of its own. A null id counts as 0 and comes first among equal keys. Empty table: no
    rows. Columns beyond doc_id, source and text aren't read, so their names can't clash.
    """
    s = schedule(docs, weights, budget_tokens, budget_share, seed)
    return s.orderBy("finish", F.col("source").asc_nulls_first(), "k", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "source", "n_tokens", "finish", "cum_tokens")


def keep_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` within the budget, with all their columns, whatever their names. Null text: 0 tokens. A null source is a source of its own. Rows that repeat
    id, source and text stay or go together. Ties of the shuffle key go by id, then by a hash of the text. Empty table: no rows.

    Within a source the schedule keeps a first part of the queue, so the last kept entry of each source decides and
    texts aren't shuffled. That table has a row for each source; beyond ``BROADCAST_SOURCES`` it is joined by shuffle.
    """
    source, end = fresh(docs, "source", "last")
    last = written(schedule(docs, weights, budget_tokens, budget_share, seed).groupBy(F.col("source").alias(source)).agg(F.max(F.struct("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), "h")).alias(end)))
    last = F.broadcast(last) if last.count() <= BROADCAST_SOURCES else last
    own = F.struct(shuffle_key(seed).alias("k"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"))
    return docs.join(last, docs["source"].eqNullSafe(last[source])).where(own <= F.col(end)).select(*docs.columns)


ORACLE = f"""
with t as (
  select doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) as q,
         cast('0x' || substr(md5(coalesce(doc_id, 0) || ':{SEED}'), 1, 8) as bigint) as k
  from documents
), n as (
  select doc_id, source, k, cast(case when q = '' then 0 else length(q) - length(replace(q, ' ', '')) + 1 end as bigint) as n_tokens from t
), f as (
  select *, cast(sum(n_tokens) over (partition by source order by k, doc_id nulls first rows unbounded preceding) as double) / 1.0 as finish from n
), c as (
  select *, cast(sum(n_tokens) over (order by finish, source nulls first, k, doc_id nulls first rows unbounded preceding) as bigint) as cum_tokens from f
)
select doc_id, source, n_tokens, finish, cum_tokens from c
where cum_tokens <= (select cast(floor({BUDGET_SHARE} * sum(n_tokens)) as bigint) from n)
"""
