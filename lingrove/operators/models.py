"""Operators on models: similarity, stop-grams, coverage, clustering, summaries.

A model is (lang_id, lang, len, key, cnt, scaled, quant, is_stop). Everything is a join or an aggregation by n-gram key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scaling import POWER, U32, quantised
from ..functions.texts import unique_model
from . import grams
from .select import survives, with_max_child

MIN_CONFUSIBLE = 134_213_632
MAX_WANTED = 4_000_000  # n-grams that are sent to be counted; beyond it all are counted and joined
FULL_TRAINING, LEAST_TRAINING = 2_000_000.0, 15_000.0


def similarity(model: DataFrame) -> DataFrame:
    """(lang_a, lang_b, similarity): cosine of the models' weights for all ordered pairs that share an n-gram; stop-grams don't count."""
    m = model.where("not is_stop").select("lang_id", "len", "key", (F.col("quant") / F.lit(1e9)).alias("w"))
    norm = m.groupBy("lang_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    b = m.select(F.col("lang_id").alias("lang_b"), "len", "key", F.col("w").alias("w_b"))
    dot = m.join(b, ["len", "key"]).groupBy(F.col("lang_id").alias("lang_a"), "lang_b").agg(F.sum(F.col("w") * F.col("w_b")).alias("dot"))
    na, nb = norm.select(F.col("lang_id").alias("lang_a"), F.col("norm").alias("na")), norm.select(F.col("lang_id").alias("lang_b"), F.col("norm").alias("nb"))
    return dot.join(na, "lang_a").join(nb, "lang_b").select("lang_a", "lang_b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


def related(similar: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of different models with at least this similarity (an invalid threshold is 0.5)."""
    threshold = threshold if 0 < threshold <= 1 else 0.5
    return similar.where((F.col("lang_a") != F.col("lang_b")) & (F.col("similarity") >= threshold))


def training_weight(train_bytes: Column) -> Column:
    """Discount of a model with little training data: ((bytes - 15000) / 1985000)^0.7 below 2 MB, 0 below 15 kB."""
    share = F.greatest(F.lit(0.0), (train_bytes - LEAST_TRAINING) / (FULL_TRAINING - LEAST_TRAINING))
    return F.when(train_bytes < FULL_TRAINING, F.pow(share, F.lit(0.7))).otherwise(F.lit(1.0))


def confusible(model: DataFrame, pairs: DataFrame, train_bytes: DataFrame, power: float = POWER, least: int = MIN_CONFUSIBLE) -> DataFrame:
    """(lang_a, len, key, weight): n-grams of the models related to lang_a with the largest of their weights, where it isn't negligible.

    weight: (similarity * training_weight)^power * quant, rounded. train_bytes: (lang_id, total).
    """
    w = pairs.join(train_bytes, pairs.lang_b == train_bytes.lang_id).select("lang_a", "lang_b", F.pow(F.col("similarity") * training_weight(F.col("total")), F.lit(power)).alias("w"))
    m = model.where("not is_stop and quant > 0").select(F.col("lang_id").alias("lang_b"), "len", "key", "quant")
    weight = F.floor(F.col("w") * F.col("quant") + 0.5).cast("bigint")
    return m.join(F.broadcast(w), "lang_b").groupBy("lang_a", "len", "key").agg(F.max(weight).alias("weight")).where(F.col("weight") >= least)


def observed(texts: DataFrame, wanted: DataFrame, low: int = 3, high: int = 8) -> DataFrame:
    """(lang_a, len, key, cnt): occurrences of the wanted (lang_a, len, key) in that language's training texts (grp, bytes), grp being lang_a as text."""
    if wanted.count() <= MAX_WANTED:
        sent = {}
        for (lang, n), t in wanted.where(F.col("len").between(low, high)).select("lang_a", "len", "key").toPandas().groupby(["lang_a", "len"]):
            sent.setdefault(str(lang), {})[int(n)] = t["key"].sort_values().to_numpy()
        found = grams.occurrences(texts, sent)
        return found.select(F.col("grp").cast("int").alias("lang_a"), "len", "key", "cnt")
    found = grams.counts(texts, low, high).withColumn("lang_a", F.col("grp").cast("int"))
    return found.join(wanted.select("lang_a", "len", "key"), ["lang_a", "len", "key"], "left_semi").select("lang_a", "len", "key", "cnt")


LEAST_CONFUSIBLE = 100


def stop_grams(confus: DataFrame, seen: DataFrame) -> DataFrame:
    """(lang_a, len, key, weight): confusible n-grams of three bytes and more that the language's own training text never has.

    A language with ``LEAST_CONFUSIBLE`` confusible n-grams or fewer gets none.
    """
    enough = confus.groupBy("lang_a").agg(F.count("*").alias("_n")).where(F.col("_n") > LEAST_CONFUSIBLE).select("lang_a")
    return confus.where("len > 2").join(enough, "lang_a", "left_semi").join(seen, ["lang_a", "len", "key"], "left_anti")


def named_pairs(languages: DataFrame, wanted: str) -> DataFrame:
    """(lang_b, wanted): the models that a list of descriptors (``en_US-utf-8,de/Source``) names; a descriptor that fits several models, or none, names nothing."""
    out = None
    for w in dict.fromkeys(x.strip() for x in wanted.split(",") if x.strip()):
        one = unique_model(languages, w).select(F.col("lang_id").alias("lang_b"), F.lit(w).alias("wanted"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else languages.select(F.col("lang_id").alias("lang_b"), F.lit("").alias("wanted")).where("false")


def selected(similar: DataFrame, languages: DataFrame, by: str | float, lang_a: int | None = None) -> DataFrame:
    """(lang_a, lang_b, similarity): the models that give another one its stop-grams.

    by: a list of descriptors, or a threshold of similarity (a number, or text like ``@0.5``). By similarity, models of one
    language, region and encoding don't serve each other; a model without one of the three is no such twin.
    """
    if lang_a is not None:
        similar = similar.where(F.col("lang_a") == lang_a)
    if isinstance(by, str) and not by.startswith("@"):
        return similar.join(F.broadcast(named_pairs(languages, by).select("lang_b").distinct()), "lang_b", "left_semi")
    try:
        threshold = float(by[1:]) if isinstance(by, str) else float(by)
    except ValueError:
        threshold = 0.5
    a, b = (languages.select(F.col("lang_id").alias(f"lang_{x}"), F.struct("language", "region", "encoding").alias(f"_{x}")) for x in "ab")
    twins = (F.col("_a.language") == F.col("_b.language")) & (F.col("_a.region") == F.col("_b.region")) & (F.col("_a.encoding") == F.col("_b.encoding"))
    found = related(similar, threshold).join(F.broadcast(a), "lang_a").join(F.broadcast(b), "lang_b")
    return found.where(~F.coalesce(twins, F.lit(False))).select("lang_a", "lang_b", "similarity")


def raw_weight(weight: Column, total: Column) -> Column:
    """A stop-gram's weight as a count of its language's training bytes, as vocabularies of unscaled counts write it."""
    return F.floor(weight / F.lit(1e9) / 100.0 * total + 0.5).cast("bigint")


def with_stop_grams(model: DataFrame, stops: DataFrame) -> DataFrame:
    """The models with their stop-grams as entries that count against them."""
    names = model.select("lang_id", "lang").distinct()
    rows = stops.withColumnRenamed("lang_a", "lang_id").join(F.broadcast(names), "lang_id").select("lang_id", "lang", "len", "key", F.lit(0).cast("bigint").alias("cnt"), F.col("weight").alias("scaled"), quantised(F.col("weight")).alias("quant"), F.lit(True).alias("is_stop"))
    return model.unionByName(rows)


def boosted(model: DataFrame, confus: DataFrame, boost: float = 2.0, power: float = POWER) -> DataFrame:
    """Raises the weights of a model's n-grams that no related model has, when boost > 1."""
    c = confus.select(F.col("lang_a").alias("lang_id"), "len", "key", F.lit(1).alias("_known"))
    more = F.least(F.lit(float(U32)), F.floor(F.col("scaled") * F.pow(F.lit(100.0 * boost), F.lit(power)) + 0.9)).cast("bigint")
    unique = F.col("_known").isNull() & F.lit(boost > 1)
    out = model.join(c, ["lang_id", "len", "key"], "left").withColumn("scaled", F.when(unique, more).otherwise(F.col("scaled"))).drop("_known")
    return out.withColumn("quant", quantised(F.col("scaled"))).select(*model.columns)


def coverage(strings: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, total, coverage, counted_cover, freq_cover, match_factor) of each model over its own texts (doc, lang, bytes).

    coverage: share of bytes in some n-gram of the model; counted_cover: n-grams over a byte, on average; freq_cover: root of the summed
    length * count / 1e9 of all matches; match_factor: matches per byte.
    """
    from .score_positions import covered

    out = covered(strings, model.where("not is_stop"))
    total = out.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("total", "covered", "matched", "matches", "freq")])
    share = lambda c: F.round(F.col(c) / F.col("total"), 6)
    return total.select("lang", "total", share("covered").alias("coverage"), share("matched").alias("counted_cover"), F.round(F.sqrt(F.col("freq") / F.lit(1e9)), 6).alias("freq_cover"), share("matches").alias("match_factor"))


def adjustment(match_factor: Column, alignment: Column) -> Column:
    """Factor on a model's scores: alignment / match_factor^0.25; 1 for a model without matches."""
    return F.when(match_factor > 0, alignment / F.pow(match_factor, F.lit(0.25))).otherwise(F.lit(1.0))


def clustered(model: DataFrame, encodings: DataFrame, min_length: int = 3, ratio: float = 0.90) -> DataFrame:
    """(encoding, len, key, quant): one merged model per encoding: the largest weight of each n-gram, cut to twice the size of the largest member.

    encodings: (lang_id, encoding). Stop-grams, n-grams below the smallest length and those that a longer one implies are left out.
    """
    m = model.where("not is_stop").join(F.broadcast(encodings), "lang_id")
    size = m.groupBy("encoding", "lang_id").agg(F.count("*").alias("n")).groupBy("encoding").agg((2 * F.max("n")).alias("k"))
    merged = m.groupBy(F.col("encoding").alias("grp"), "len", "key").agg(F.max("quant").alias("cnt"))
    fit = with_max_child(merged).where((F.col("len") >= min_length) & survives(min_length, ratio))
    hist = fit.groupBy("grp", "cnt").agg(F.count("*").alias("m")).withColumn("above", F.sum("m").over(Window.partitionBy("grp").orderBy(F.desc("cnt"))))
    thr = hist.join(F.broadcast(size), F.col("grp") == F.col("encoding")).groupBy("grp").agg(F.coalesce(F.max(F.when(F.col("above") >= F.col("k"), F.col("cnt"))), F.lit(0)).alias("thr"))
    return fit.join(F.broadcast(thr), "grp").where("cnt >= thr").select(F.col("grp").alias("encoding"), "len", "key", F.col("cnt").alias("quant"))


def cluster_models(model: DataFrame, languages: DataFrame, min_length: int = 3, ratio: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """(languages, model) with one merged model for each encoding, called ``CLUS``; a second set of models to tell encodings by."""
    merged = clustered(model, languages.select("lang_id", "encoding"), min_length, ratio)
    names = languages.where("encoding is not null").select("encoding").distinct()
    langs = names.select((F.row_number().over(Window.orderBy("encoding")) - 1).alias("lang_id"), F.lit("CLUS").alias("language"), F.lit("Clustered").alias("friendly"), F.lit("XX").alias("region"), "encoding", F.lit("merged").alias("source"))
    at = langs.select("lang_id", F.col("encoding").alias("_e"))
    rows = merged.join(F.broadcast(at), F.col("encoding") == F.col("_e"))
    return langs, rows.select("lang_id", F.lit("CLUS").alias("lang"), "len", "key", F.lit(0).cast("bigint").alias("cnt"), F.col("quant").alias("scaled"), "quant", F.lit(False).alias("is_stop"))


def by_name(scored: DataFrame, languages: DataFrame, ids: list[str]) -> DataFrame:
    """Adds ``language`` and ``place``: scores other than 0 in the order of the languages' names (nameless ones last), ties by language id."""
    at = scored.where("score <> 0").join(F.broadcast(languages.select("lang_id", "language")), "lang_id")
    return at.withColumn("place", F.row_number().over(Window.partitionBy(*ids).orderBy(F.col("language").asc_nulls_last(), "lang_id")))


def summary(languages: DataFrame) -> DataFrame:
    """(models, languages, pairs): counts of models, distinct languages, distinct (language, encoding); null is a value."""
    lang, enc = F.coalesce("language", F.lit("")), F.coalesce("encoding", F.lit(""))
    return languages.agg(F.count("*").alias("models"), F.countDistinct(lang).alias("languages"), F.countDistinct(lang, enc).alias("pairs"))


def merged_by_name(scored: DataFrame, languages: DataFrame, ids: list[str]) -> DataFrame:
    """Scores of models with one language name, added up."""
    return scored.join(F.broadcast(languages.select("lang_id", "language")), "lang_id").groupBy(*ids, "language").agg(F.round(F.sum("score"), 6).alias("score"))


def string_counts(best: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, n): strings by the name of their best language."""
    return best.join(F.broadcast(languages.select("lang_id", "language")), "lang_id").groupBy("language").agg(F.count("*").alias("n"))


def sizes(model: DataFrame) -> DataFrame:
    """(lang, n, n_stop, longest): entries of each model."""
    return model.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("is_stop").alias("n_stop"), F.max("len").alias("longest"))


def bigram_average(strings: DataFrame, bigrams: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., average): mean probability of a string's bigrams under a table (key, cnt); null for a string of one byte or none."""
    total = bigrams.agg(F.sum("cnt").alias("t"))
    b = strings.withColumn("b", F.encode("bytes", "UTF-8")).drop("bytes")
    found = grams.exploded(b, 2, 2).withColumn("key", grams.packed(F.col("key_hex"))).join(bigrams.select("key", "cnt"), "key", "left")
    return found.groupBy(*ids).agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(*ids, F.round(F.col("s") / F.col("t") / F.col("n"), 9).alias("average"))


