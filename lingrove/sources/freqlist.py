"""Frequency lists: reading the native, tab-separated and word-edge formats, and writing vocabularies.

A list is a DataFrame of lines (line_no, value); reading gives (key BINARY, len, cnt, is_stop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import code_point_ranges, code_point_utf8, quoted, unquoted

DIRECTIVES = ("TotalCount", "Lang", "Region", "Encoding", "Source", "Script", "Scaled", "IgnoreBlanks", "Alignment", "BigramCounts", "Discount", "Coverage", "WeightedCoverage", "FreqCoverage", "MatchFactor", "UTF8")
_ENTRY = r"^(-?)(0[xX][0-9a-fA-F]+|[0-9]+)([a-z]?)[ \t]+(.+)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one list file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def header(lines: DataFrame) -> dict[str, str]:
    """The directives of a list (a few lines)."""
    rows = lines.where(F.col("value").rlike(f"^({'|'.join(DIRECTIVES)}):")).orderBy("line_no").limit(len(DIRECTIVES) * 4).collect()
    return {r.value.partition(":")[0]: r.value.partition(":")[2].strip() for r in rows}


def native(lines: DataFrame) -> DataFrame:
    """``[-]count[letter] key``: a minus, or count 0, marks a stop-gram (count 1); a letter shifts the count left (a: 1). Blanks in keys are quoted."""
    up_to = F.min(F.when(F.col("value").startswith("BigramCounts:"), F.col("line_no")))
    end = lines.agg(up_to.alias("_end"))
    body = lines.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))).where(~F.col("value").rlike(r"^[;#]"))
    part = lambda i: F.regexp_extract("value", _ENTRY, i)
    rows = body.where(F.col("value").rlike(_ENTRY)).select(part(1).alias("minus"), part(2).alias("num"), part(3).alias("letter"), part(4).alias("quoted"))
    base = F.when(F.lower("num").startswith("0x"), F.conv(F.substring("num", 3, 20), 16, 10)).when(F.col("num").rlike("^0[0-7]+$"), F.conv("num", 8, 10)).otherwise(F.col("num")).cast("bigint")
    shift = F.when(F.col("letter") == "", 0).otherwise(F.ascii("letter") - 96)
    rows = rows.withColumn("base", base).select(unquoted(F.col("quoted")).alias("key"), ((F.col("minus") == "-") | (F.col("base") == 0)).alias("is_stop"), (F.greatest(F.lit(1), F.col("base")) * F.pow(F.lit(2.0), shift).cast("bigint")).alias("cnt"))
    return rows.groupBy("key").agg(F.octet_length("key").alias("len"), F.sum("cnt").alias("cnt"), F.bool_or("is_stop").alias("is_stop")).select("key", "len", "cnt", "is_stop")


def total_of(entries: DataFrame, head: dict[str, str]) -> int:
    """Training bytes that counts refer to: TotalCount, or a quarter of the summed lengths; times the discount."""
    total = int(head["TotalCount"]) if "TotalCount" in head else (entries.agg(F.coalesce(F.sum(F.floor(F.col("len") * F.col("cnt") / 4)), F.lit(0))).first()[0])
    return int(total * max(1.0, float(head.get("Discount", 1.0))))


def textcat(lines: DataFrame) -> DataFrame:
    """(key, len, cnt, is_stop) of ``key<TAB>count`` lines."""
    p = F.split("value", "\t")
    rows = lines.where(F.col("value").rlike("^[^\t]+\t[0-9]+")).select(F.encode(p[0], "UTF-8").alias("key"), F.regexp_extract(p[1], "^[0-9]+", 0).cast("bigint").alias("cnt"))
    return rows.groupBy("key").agg(F.octet_length("key").alias("len"), F.sum("cnt").alias("cnt")).select("key", "len", "cnt", F.lit(False).alias("is_stop"))


def textcat_total(entries: DataFrame) -> int:
    return entries.agg(F.coalesce(F.sum(F.col("len") * F.col("cnt") * 8), F.lit(0))).first()[0]


def edged(lines: DataFrame) -> DataFrame:
    """``count key`` lines with ``<`` and ``>`` for word edges, which become blanks. Counts of 1 are skipped; a key of over 3 bytes also
    counts without its trailing blank, and then without its leading one, each variant once."""
    rows = lines.where(F.col("value").rlike("^[0-9]+[ \t]+.+$")).select(F.regexp_extract("value", "^([0-9]+)", 1).cast("bigint").alias("cnt"), F.translate(F.regexp_extract("value", "^[0-9]+[ \t]+(.+)$", 1), "<>", "  ").alias("k")).where("cnt > 1")
    no_end = F.when((F.octet_length("k") > 3) & F.col("k").endswith(" "), F.regexp_replace("k", " $", "")).otherwise(F.col("k"))
    no_edges = F.when((F.octet_length("k") > 3) & (F.octet_length(no_end) > 3) & no_end.startswith(" "), F.regexp_replace(no_end, "^ ", "")).otherwise(no_end)
    each = rows.select("cnt", F.explode(F.array_distinct(F.array(F.col("k"), no_end, no_edges))).alias("k"))
    return each.groupBy(F.encode("k", "UTF-8").alias("key")).agg(F.sum("cnt").alias("cnt")).select("key", F.octet_length("key").alias("len"), "cnt", F.lit(False).alias("is_stop"))


def code_points(spark: SparkSession, spec: str) -> DataFrame:
    """(key, len, cnt, is_stop): one n-gram of count 1 for each code point of ranges like ``0x410-0x412, 0x416``; its share of the total is 10 * len."""
    rows = spark.createDataFrame(code_point_ranges(spec) or [(1, 0)], "a bigint, b bigint").where("a <= b").select(F.explode(F.sequence("a", "b")).alias("cp"))
    return rows.select(code_point_utf8(F.col("cp")).alias("key")).where("key is not null").distinct().select("key", F.octet_length("key").alias("len"), F.lit(1).cast("bigint").alias("cnt"), F.lit(False).alias("is_stop"))


def bigram_table(lines: DataFrame) -> DataFrame:
    """(key, cnt) of the 65,536 counts after ``BigramCounts:``, in order of the first byte, then the second."""
    start = lines.where(F.col("value").startswith("BigramCounts:")).agg(F.min("line_no").alias("_s"))
    rows = lines.crossJoin(F.broadcast(start)).where((F.col("line_no") > F.col("_s")) & F.col("value").rlike("^[0-9]+"))
    return rows.select((F.col("line_no") - F.col("_s") - 1).cast("bigint").alias("key"), F.regexp_extract("value", "^[0-9]+", 0).cast("bigint").alias("cnt")).where("key < 65536")


def vocabulary(entries: DataFrame, head: dict[str, str]) -> DataFrame:
    """(value): lines of a native list, the directives first, then the entries by falling count; entries: (key BINARY, cnt, is_stop)."""
    spark = entries.sparkSession
    top = spark.createDataFrame([(f"{k}: {v}",) for k, v in head.items()] or [("",)], "value string").where("value <> ''")
    body = entries.orderBy(F.desc("cnt"), "key").select(F.concat(F.when(F.col("is_stop"), "-").otherwise(""), F.col("cnt").cast("string"), F.lit("\t"), quoted(F.col("key"))).alias("value"))
    return top.unionByName(body)
