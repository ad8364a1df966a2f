"""Samples of text lines: (…, line_no, line). Each gives a boolean ``selected``; the rest is the reject stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import utf8

RANGE = 4096  # lines whose lengths are one row of the greedy choice


def every(n: int) -> Column:
    """Lines 0, n, 2n, ..."""
    return F.col("line_no") % n == 0


def length_between(low: int, high: int) -> Column:
    """Lines of low..high bytes."""
    return F.octet_length("line").between(low, high)


def uniform(lines: DataFrame, n: int) -> DataFrame:
    """n of all N lines, evenly spread: line k is taken when floor(i (k + 1.5)) > floor(i (k + 0.5)), i = n / N; all of them when n >= N."""
    total = lines.agg(F.count("*").alias("_n"))
    i = F.lit(float(n)) / F.col("_n")
    step = lambda x: F.floor(i * (F.col("line_no") + F.lit(x)))
    return lines.crossJoin(F.broadcast(total)).withColumn("selected", (step(1.5) > step(0.5)) | (F.lit(n) >= F.col("_n"))).drop("_n")


def running(lines: DataFrame, rate: float, order: str = "line_no", parts: str | None = None) -> DataFrame:
    """About ``rate`` of the bytes, evenly spread: a line is taken when the running sum of rate * bytes, from rate / 2 on, passes a multiple of the
    mean length. Sums run within ``parts`` where given; else over ranges of ``order`` (see ``running_sum``)."""
    size = F.octet_length("line").cast("bigint")
    mean = lines.agg((F.sum(size) / F.count("*")).alias("_mean"))
    summed = running_sum(lines.withColumn("_size", size), "_size", order, "_sum")
    here = F.lit(rate / 2) + F.lit(rate) * F.col("_sum") / F.col("_mean")
    before = F.lit(rate / 2) + F.lit(rate) * (F.col("_sum") - F.col("_size")) / F.col("_mean")
    return summed.crossJoin(F.broadcast(mean)).withColumn("selected", F.floor(here) > F.floor(before)).drop("_size", "_sum", "_mean")


def running_sum(rows: DataFrame, value: str, order: str, name: str, width: int = 65536) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in ``order`` (a whole number, unique). Ranges of ``order`` are summed first, so no task
    sees the whole table."""
    r = F.floor(F.col(order) / width)
    cut = rows.withColumn("_r", r)
    sums = cut.groupBy("_r").agg(F.sum(value).alias("_s"))
    sums = sums.select(F.col("_r").alias("_br"), (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(sums, F.col("_r") == F.col("_br")).withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_r", "_br", "_before")


def first_bytes(lines: DataFrame, limit: int, order: str = "line_no") -> DataFrame:
    """Lines that begin within the first ``limit`` bytes, the last one cut (in bytes, then read as UTF-8 with broken ends replaced)."""
    b = utf8(F.col("line"))
    summed = running_sum(lines.withColumn("_size", F.octet_length("line").cast("bigint")), "_size", order, "_sum")
    room = F.lit(limit) - (F.col("_sum") - F.col("_size"))
    return summed.where(room > 0).withColumn("bytes", F.when(room < F.col("_size"), F.substring(b, F.lit(1), room.cast("int"))).otherwise(b)).drop("_size", "_sum")


def greedy_bytes(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """(order, selected): takes a line whenever the bytes taken so far are no more than rate * bytes seen so far, rate = (n + 1) / all bytes; about n bytes in all.

    lines: (order, line), or (order, size) with the lines' bytes. Each choice depends on all before it, so the lengths (not the texts) pass through one task in order,
    ``RANGE`` of them as one row of 4 bytes each; numbers and choices are put together again in all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = seen = 0
        for batch in batches:
            totals, picks = batch.column(2).to_pylist(), []
            for sizes, total in zip(batch.column(1), totals, strict=True):
                rate, flags = (n + 1.0) / total if total > 0 else 0.0, bytearray(len(sizes))
                for i, size in enumerate(sizes.values.to_pylist()):
                    if total > 0 and got <= seen * rate:
                        flags[i] = 1
                        got += size
                    seen += size
                picks.append(bytes(flags))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picks, pa.binary())], names=["_r", "picks"])

    size = F.col("size") if "size" in lines.columns else F.octet_length("line")
    sized = lines.select(F.col(order).cast("bigint").alias(order), size.cast("int").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    r = F.floor(F.col(order) / RANGE).cast("bigint")
    rows = sized.groupBy(r.alias("_r")).agg(F.array_sort(F.collect_list(F.struct(order, "size"))).alias("_l"))
    # the numbers of a range come out in their order, so each side puts them there; the texts' task sees the sizes alone
    folded = rows.select("_r", F.col("_l.size").alias("sizes")).crossJoin(F.broadcast(total)).repartition(1).sortWithinPartitions("_r").mapInArrow(run, "_r bigint, picks binary")
    both = rows.select(F.col("_r"), F.col(f"_l.{order}").alias("_at")).join(folded, "_r")
    return both.select(F.posexplode("_at").alias("_i", order), "picks").select(order, (F.substring("picks", F.col("_i") + 1, F.lit(1)) == F.lit(b"\x01")).alias("selected"))


def random_lines(lines: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n lines without replacement, by a hash of their number and the seed (the same for the same seed); all when n is larger. In line order."""
    key = F.md5(F.concat_ws(":", F.col("line_no").cast("string"), F.lit(str(seed))).cast("binary"))
    return lines.orderBy(key, "line_no").limit(n).orderBy("line_no")


def write_both(lines: DataFrame, chosen: str, rejected: str) -> None:
    """The lines that are ``selected`` as text in one folder, the others in another."""
    lines.where("selected").select("line").write.mode("overwrite").text(chosen)
    lines.where("not coalesce(selected, false)").select("line").write.mode("overwrite").text(rejected)


def training_rate(n: float, total: int) -> float:
    """Share of the bytes to take so that n of them come out: raised a little beyond a half, everything from 0.98 on."""
    if total <= 0:
        return 1.0
    i = n / total
    i = i + (i - 0.5) / 6 if i > 0.5 else i
    return 1.0 if i >= 0.98 else i


def training_sample(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """``lines`` that are ``selected`` for training: whole lines, evenly spread, ``n`` bytes at least; all where there are no more.

    Longer lines are likelier to be taken, so that lines of very different lengths give more than n bytes. A sample that comes out short is drawn again for
    more bytes, in proportion to what lacked.
    """
    size = F.octet_length("line").cast("bigint")
    total = lines.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    want = float(n)
    while True:
        rate = training_rate(want, total)
        if rate >= 1.0 or total < want:
            return lines
        got = running(lines, rate, order).where("selected").drop("selected")
        sampled = got.agg(F.coalesce(F.sum(F.octet_length("line").cast("bigint")), F.lit(0))).first()[0]
        if sampled >= n:
            return got
        want *= want / max(1, sampled) * 1.01
