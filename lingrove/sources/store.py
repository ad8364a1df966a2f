"""Models on disk: two Parquet tables, ``languages`` and ``ngrams``, and a version file."""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Language
from ..functions.texts import escaped_key

VERSION = 1
LANGUAGES = "lang_id int, language string, friendly string, region string, encoding string, source string, script string, alignment int, coverage double, counted_cover double, freq_cover double, match_factor double, train_bytes bigint"
NGRAMS = "lang_id int, lang string, len int, key bigint, cnt bigint, scaled bigint, quant bigint, is_stop boolean"


def languages(spark: SparkSession, rows: list[Language]) -> DataFrame:
    names = [c.split()[0] for c in LANGUAGES.split(", ")][1:]
    return spark.createDataFrame([(i, *(asdict(r)[n] for n in names)) for i, r in enumerate(rows)], LANGUAGES)


def save(langs: DataFrame, ngrams: DataFrame, path: str) -> None:
    """Writes beside the old model, moves that aside, the new one into its place, and deletes the old one last: a failure leaves one of them whole (``path`` or ``path``.old)."""
    spark = langs.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    langs.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{new}/languages")
    ngrams.write.mode("overwrite").parquet(f"{new}/ngrams")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.delete(p(old), True)
        if not fs.rename(p(path), p(old)):
            raise OSError(f"{path} can't be renamed to {old}")
    if not fs.rename(p(new), p(path)):
        raise OSError(f"{new} can't be renamed to {path}")
    fs.delete(p(old), True)


def dump(langs: DataFrame, ngrams: DataFrame | None = None) -> DataFrame:
    """(part, place, value): the lines of a database's dump, in order of part and place: its languages, and where ``ngrams`` are given its n-grams by key."""
    name = F.format_string("  Lang %2d: %s_%s-%s / %s", F.col("lang_id"), *(F.coalesce(c, F.lit("(null)")) for c in ("language", "region", "encoding", "source")))
    spark = langs.sparkSession
    edge = spark.createDataFrame([(0, "", "LanguageIdentifier Begin"), (9, "", "LanguageIdentifier End")], "part int, place string, value string")
    out = edge.unionByName(langs.select(F.lit(1).alias("part"), F.lpad(F.col("lang_id").cast("string"), 6, "0").alias("place"), name.alias("value")))
    if ngrams is None:
        return out
    hexed = F.lpad(F.hex("key"), (F.col("len") * 2).cast("int"), "0")
    one = F.struct("lang_id", F.concat(F.col("lang_id").cast("string"), F.when(F.col("is_stop"), "*").otherwise(""), F.lit(":"), F.col("quant").cast("string")).alias("shown"))
    rows = ngrams.groupBy(hexed.alias("place")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    rows = rows.select(F.lit(3).alias("part"), "place", F.concat(F.lit("   "), escaped_key(F.col("place")), F.lit("  ::"), F.array_join(F.transform("all", lambda x: F.concat(F.lit(" "), x["shown"])), "")).alias("value"))
    return out.unionByName(spark.createDataFrame([(2, "", "LanguageIdentifier Trie")], "part int, place string, value string")).unionByName(rows)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/languages")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_model(spark: SparkSession, path: str | None = None, name: str = "models", create: bool = False) -> tuple[DataFrame, DataFrame]:
    """(languages, ngrams) from ``path``, else ``./name``, ``~/.lingrove/name``, ``/usr/share/lingrove/name``; ``create``: empty tables where none is found."""
    places = [path] if path else [f"./{name}", os.path.expanduser(f"~/.lingrove/{name}"), f"/usr/share/lingrove/{name}"]
    for place in places:
        if exists(spark, place):
            langs = spark.read.parquet(f"{place}/languages")
            found = {r.version for r in langs.select("version").distinct().limit(2).collect()}
            if found - {VERSION}:
                raise ValueError(f"{place}: version {found}, not {VERSION}")
            return langs.drop("version"), spark.read.schema(NGRAMS).parquet(f"{place}/ngrams")
    if create:
        return spark.createDataFrame([], LANGUAGES), spark.createDataFrame([], NGRAMS)
    raise FileNotFoundError(f"no model at {', '.join(places)}")


def add(langs: DataFrame, ngrams: DataFrame, new: Language, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model with one language more; one of the same identity (language, region, encoding, source) is refused."""
    same = langs.where(F.col("language").eqNullSafe(new.language) & F.col("region").eqNullSafe(new.region) & F.col("encoding").eqNullSafe(new.encoding) & F.col("source").eqNullSafe(new.source))
    if not same.isEmpty():
        raise ValueError(f"{new.describe()} is there already")
    at = langs.agg(F.coalesce(F.max("lang_id") + 1, F.lit(0))).first()[0]
    row = languages(langs.sparkSession, [new]).withColumn("lang_id", F.lit(at))
    return langs.unionByName(row), ngrams.unionByName(entries.withColumns({"lang_id": F.lit(at), "lang": F.lit(new.language)}).select(*ngrams.columns))
