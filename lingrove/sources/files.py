"""Byte strings from files and tables: whole files, blocks, lines. Every reader gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FULL_FILE = 262_144


def read_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes) of raw files, one row each."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("content").alias("bytes"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, line) of text files; lines are numbered from 0 within a file."""
    b = spark.read.format("binaryFile").load(list(paths)).select("path", F.col("content").cast("string").alias("t"))
    return b.select("path", F.posexplode(split_lines(F.col("t"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a line feed at the end doesn't begin another line."""
    return F.when(F.octet_length(text) > 0, F.split(F.regexp_replace(text, "\\n\\z", ""), "\\n", -1))


def lines_of(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., line_no, line, bytes): ``bytes`` keeps the line feed, as it is scored."""
    cut = docs.select(*ids, F.endswith(text, F.lit("\n")).alias("_end"), split_lines(F.col(text)).alias("_lines"))
    out = cut.select(*ids, "_end", F.posexplode("_lines").alias("line_no", "line"), F.size("_lines").alias("_n"))
    whole = F.concat("line", F.when((F.col("line_no") + 1 < F.col("_n")) | F.col("_end"), F.lit("\n")).otherwise(""))
    return out.select(*ids, F.col("line_no").cast("bigint").alias("line_no"), "line", whole.alias("bytes"))


def block_starts(n: Column, block: int, stride: int | None = None) -> Column:
    """Starts of overlapping blocks: every quarter block, up to the last full block's share; a short string still has shrinking ones."""
    step = stride or block // 4
    limit = F.least(n.cast("bigint"), F.greatest(F.lit(1), F.ceil(n / F.lit(float(block))) - 1).cast("bigint") * block)
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), limit - 1, F.lit(step).cast("bigint")))


def blocks_of(docs: DataFrame, ids: list[str], block: int = 4096, text: str = "text", stride: int | None = None) -> DataFrame:
    """(ids..., start, len, bytes) of the overlapping blocks of each string's UTF-8."""
    b = docs.select(*ids, F.encode(text, "UTF-8").alias("_b")) if dict(docs.dtypes)[text] == "string" else docs.select(*ids, F.col(text).alias("_b"))
    at = b.withColumn("start", F.explode(block_starts(F.octet_length("_b"), block, stride)))
    size = F.least(F.lit(block).cast("bigint"), F.octet_length("_b") - F.col("start"))
    return at.select(*ids, "start", size.alias("len"), F.substring("_b", (F.col("start") + 1).cast("int"), size.cast("int")).alias("bytes"))


def full_file(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., bytes): the first 256 KiB of each string as one block, as the whole-file mode of identification defines."""
    return docs.select(*ids, F.substring(F.encode(text, "UTF-8"), 1, FULL_FILE).alias("bytes"))


def global_line_numbers(lines: DataFrame, order: list[str], width: int = 65536) -> DataFrame:
    """Adds ``line_no`` over the whole table, from 0, in ``order``, whose first column is a whole number (a document's): lines are counted by document, counts are
    added up over ranges of ``width`` numbers, the ranges' sums run up, then the documents' within their range, and lines number within their document."""
    head = order[0]
    n = lines.groupBy(head).agg(F.count("*").alias("_n")).withColumn("_r", F.floor(F.col(head) / width))
    ranges = n.groupBy("_r").agg(F.sum("_n").alias("_s")).select(F.col("_r").alias("_rr"), (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_start"))
    within = F.sum("_n").over(Window.partitionBy("_r").orderBy(head).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    n = n.withColumn("_within", within).join(ranges, F.col("_r").eqNullSafe(F.col("_rr"))).select(F.col(head).alias("_h"), (F.col("_start") + F.col("_within")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(head).orderBy(*order)) - 1
    return lines.join(n, F.col(head).eqNullSafe(F.col("_h"))).withColumn("line_no", (F.col("_before") + own).cast("bigint")).drop("_h", "_before")
