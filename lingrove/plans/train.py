"""Training: a model of byte n-grams for each group (language) of texts.

Trigrams are counted and the most frequent kept; passes of growing length count only what begins with a kept n-gram, drop what a longer
one implies, and keep the most frequent; bigrams are merged in; counts are smoothed and quantised. The kept n-grams of all groups are k per
group, so between passes the prefixes are sent to the counting tasks while they are few (``MAX_PREFIXES``); beyond
that the counts are joined with them.

A pass counts one length after the other. An n-gram occurs no more often than what it begins with, so only those go on that are frequent enough to be kept,
or to drop one that is: see ``_selected``.
"""

from __future__ import annotations

import uuid

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Language, TrainOptions
from ..functions.scaling import quantised, scaled
from ..operators import grams, models, sample, select
from ..sources import files, freqlist, store

MAX_PREFIXES = 4_000_000
START = 2  # the first bound of a pass is the k-th largest count over this


def kept(df: DataFrame) -> DataFrame:
    """A result that several steps read: written to the shared folder of the session (spark.checkpoint.dir) until it ends, or, where none is set, cached: then a lost executor's part is made again."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.cache()
    path = f"{base.rstrip('/')}/lingrove-model-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, group: str = "lang", text: str = "text") -> DataFrame:
    """(grp, bytes) for training."""
    return docs.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("bytes")).where("bytes is not null")


def totals(texts: DataFrame) -> DataFrame:
    """(grp, total): bytes of each group."""
    return texts.groupBy("grp").agg(F.sum(F.octet_length("bytes")).cast("bigint").alias("total"))


def bigrams(trigrams: DataFrame) -> DataFrame:
    """Bigram counts as sums over the third byte of unfiltered trigrams (so a text's last bigram isn't counted)."""
    return trigrams.groupBy("grp", F.lit(2).alias("len"), F.call_function("shiftrightunsigned", F.col("key"), F.lit(8)).alias("key")).agg(F.sum("cnt").alias("cnt"))


def filtered(trigrams: DataFrame, o: TrainOptions) -> DataFrame:
    key = grams.hex_key(F.col("key"), F.col("len"))
    if o.skip_newlines:
        trigrams = trigrams.where(~grams.skips_newlines(key, o.alignment))
    if o.skip_numbers:
        trigrams = trigrams.where(~grams.skips_numbers(key))
    return trigrams


def _extended(texts: DataFrame, model: DataFrame, low: int, high: int, o: TrainOptions) -> DataFrame:
    """Counts of the n-grams of low..high bytes that begin with a kept n-gram of low-1 bytes."""
    heads = model.where(F.col("len") == low - 1).select("grp", "key")
    if heads.count() <= MAX_PREFIXES:
        out = grams.counts(texts, low, high, o.alignment, _sent(heads), low - 1)
    else:
        heads = heads.select(F.col("grp").alias("_g"), F.col("key").alias("_k"))
        out = grams.counts(texts, low, high, o.alignment)
        out = out.join(heads, F.col("grp").eqNullSafe(F.col("_g")) & (grams.prefix(F.col("key"), F.col("len"), low - 1) == F.col("_k")), "left_semi")
    return _unbroken(out, low, o)


def _sent(heads: DataFrame) -> dict[object, np.ndarray]:
    """By group the sorted keys of (grp, key)."""
    return {g if isinstance(g, str) else None: np.sort(k.to_numpy(np.int64)) for g, k in heads.toPandas().groupby("grp", dropna=False)["key"]}


def _unbroken(ngrams: DataFrame, low: int, o: TrainOptions) -> DataFrame:
    if o.skip_newlines:
        ends = "0A|0D|00" if o.alignment == 1 else "0A|0D"
        ngrams = ngrams.where(~grams.hex_key(F.col("key"), F.col("len")).rlike(f"^(..){{{low - 1},}}({ends})"))
    return ngrams


def _longer(texts: DataFrame, heads: DataFrame, n: int, o: TrainOptions) -> DataFrame:
    """Counts of the n-grams of n bytes that begin with one of the ``heads`` (grp, key), which are sent."""
    return _unbroken(grams.extensions(texts, _sent(heads), n, o.alignment), n, o)


def _of(values: dict[str | None, int]) -> Column:
    """A row's group's value; null for other groups."""
    known = [x for g, v in values.items() if g is not None for x in (F.lit(g), F.lit(v).cast("bigint"))]
    of = F.create_map(*known)[F.col("grp")] if known else F.lit(None).cast("bigint")
    return F.when(F.col("grp").isNull(), F.lit(values[None])).otherwise(of) if None in values else of


def _counted(texts: DataFrame, first: DataFrame, low: int, high: int, o: TrainOptions, least: dict[str | None, int]) -> DataFrame:
    """The counts of low..high bytes that reach their group's ``least``; first: those of ``low`` bytes."""
    enough = F.col("cnt") >= _of(least)
    out = level = first.where(enough)
    for n in range(low + 1, high + 1):
        heads = level.where(F.col("len") == n - 1).select("grp", "key")
        if heads.count() > MAX_PREFIXES:
            return out.unionByName(_extended(texts, level, n, high, o).where(enough))
        level = kept(_longer(texts, heads, n, o).where(enough))
        out = out.unionByName(level)
    return out


def _selected(texts: DataFrame, model: DataFrame, low: int, high: int, o: TrainOptions) -> DataFrame:
    """One pass: ``select.pruned`` of the model with the counts of low..high bytes, without counting what can't matter.

    With a bound t on the k-th largest count that is left, what is kept has counts of t at least. It is dropped by longer ones of ratio * t at least, and these
    by others of ratio^2 * t: nothing rarer is counted. The bound is half the k-th largest count of the model and ``low`` bytes; where fewer than k n-grams reach it in the
    end it wasn't one, and those groups are counted again with an eighth of it, down to 1, which is all there is.
    """
    k, ratio = o.pass_k(low), min(1.0, o.affix_ratio)
    heads = model.where(F.col("len") == low - 1).select("grp", "key")
    first = kept(_longer(texts, heads, low, o) if heads.count() <= MAX_PREFIXES else _extended(texts, model, low, low, o))
    bound = {r.grp: max(1, int(r.thr / START)) for r in select.thresholds(model.unionByName(first), "grp", k).collect()}
    found = None
    while bound:
        mine = _of(bound).isNotNull()
        every = _counted(texts if found is None else texts.where(mine), first, low, high, o, {g: int(t * ratio * ratio) for g, t in bound.items()})
        left = select.unimplied(model.where(mine).unionByName(every), low, high, o.min_length, o.affix_ratio, o.alignment)
        left = kept(left.where(F.col("cnt") >= _of(bound)))
        many = {r.grp: r["count"] for r in left.groupBy("grp").count().collect()}
        short = {g: t // 8 or 1 for g, t in bound.items() if t > 1 and many.get(g, 0) < k}
        left = left.where(_of(dict.fromkeys(short, 1)).isNull()) if short else left
        found = left if found is None else found.unionByName(left)
        bound = short
    return select.most(found, k) if found is not None else model.where("false")


def select_ngrams(texts: DataFrame, o: TrainOptions = TrainOptions()) -> tuple[DataFrame, DataFrame]:
    """(n-grams (grp, len, key, cnt) without bigrams, bigrams)."""
    tri = kept(grams.counts(texts, 3, 3, o.alignment))
    model = kept(select.top_trigrams(filtered(tri, o), o.pass_k(3)))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0] if o.max_length > 3 else 0
    for low, high in o.passes(size) if o.max_length > 3 else []:
        new = kept(_selected(texts, model, low, high, o))
        if new.isEmpty():
            break
        model = new
        if high < o.max_length and new.where(F.col("len") == high).isEmpty():
            break
    return model.where(F.col("len") >= o.min_length), bigrams(tri)


def finish(ngrams: DataFrame, total: DataFrame, o: TrainOptions = TrainOptions()) -> DataFrame:
    """(lang_id, lang, len, key, cnt, scaled, quant, is_stop): smoothed and quantised; lang_id: place of the name in order, from 0."""
    ids = total.withColumn("lang_id", F.dense_rank().over(Window.orderBy("grp")) - 1).select(F.col("grp").alias("lang"), "lang_id", (F.col("total") * F.lit(max(1.0, o.discount))).alias("total"))
    out = ngrams.join(F.broadcast(ids), ngrams.grp == ids.lang).withColumn("scaled", scaled(F.col("cnt"), F.col("total"), o.power)).withColumn("quant", quantised(F.col("scaled")))
    return out.select("lang_id", "lang", "len", "key", "cnt", "scaled", "quant", F.lit(False).alias("is_stop"))


def train(docs: DataFrame, o: TrainOptions = TrainOptions(), group: str = "lang", text: str = "text") -> DataFrame:
    """One model for every value of ``group``: see ``finish``. Null texts and groups are left out; an empty table gives no rows."""
    texts = texts_of(docs, group, text).where("grp is not null")
    longer, pairs = select_ngrams(texts, o)
    if o.bigrams:
        longer = longer.unionByName(pairs.where("cnt >= 2").select("grp", "len", "key", "cnt"))
    return kept(finish(longer, totals(texts), o))


def limited(docs: DataFrame, o: TrainOptions, order: str, text: str = "text") -> DataFrame:
    """(line_no, bytes) of the training text under ``limit_bytes``: the first bytes of the lines in ``order``, or whole lines spread over all of them."""
    lines = files.global_line_numbers(files.lines_of(docs, [order], text), [order, "line_no"]).select("line_no", F.col("bytes").alias("line"))
    if o.limit_bytes is None:
        return lines.select("line_no", F.col("line").cast("binary").alias("bytes"))
    if o.sampled and o.alignment == 1:
        return sample.training_sample(lines, o.limit_bytes).select("line_no", F.col("line").cast("binary").alias("bytes"))
    return sample.first_bytes(lines, o.limit_bytes).select("line_no", "bytes")


def add_group(langs: DataFrame, ngrams: DataFrame, texts: DataFrame, new: Language, o: TrainOptions = TrainOptions(), related: str | float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One training group, from texts (bytes) to the database with its model: (languages, n-grams, vocabulary lines).

    The model is trained, or, with ``related`` and a model of the same identity in the database, taken from there and replaced. Its coverage of the texts goes with its row.
    ``related`` (descriptors, or a threshold like ``@0.5``) names the models whose n-grams, where these texts never have them, become its stop-grams;
    ``o.boost`` raises what none of them has. Vocabulary lines are those of the frequency-list format.
    """
    texts = texts.where("bytes is not null").select(F.lit(new.language).alias("grp"), "bytes")
    total = totals(texts)
    size = total.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    same = langs.where(F.col("language").eqNullSafe(new.language) & F.col("region").eqNullSafe(new.region) & F.col("encoding").eqNullSafe(new.encoding) & F.col("source").eqNullSafe(new.source)).select("lang_id", "train_bytes").first()
    if same and related is None:
        raise ValueError(f"{new.describe()} is there already")
    if same:
        at, trained = same.lang_id, same.train_bytes
        model = ngrams.where((F.col("lang_id") == at) & ~F.col("is_stop"))
        langs, ngrams = langs.where(F.col("lang_id") != at), ngrams.where(F.col("lang_id") != at)
    else:
        at, trained = langs.agg(F.coalesce(F.max("lang_id") + 1, F.lit(0))).first()[0], size
        longer, pairs = select_ngrams(texts, o)
        if o.bigrams:
            longer = longer.unionByName(pairs.where("cnt >= 2").select("grp", "len", "key", "cnt"))
        model = kept(finish(longer, total, o).withColumn("lang_id", F.lit(at)))
    cover = models.coverage(texts.withColumnRenamed("grp", "lang"), model.withColumn("lang", F.lit(new.language))).first()
    row = replace(new, coverage=cover.coverage or 0.0, counted_cover=cover.counted_cover or 0.0, freq_cover=cover.freq_cover or 0.0, match_factor=cover.match_factor or 0.0, train_bytes=trained) if cover else replace(new, train_bytes=trained)
    langs = langs.unionByName(store.languages(langs.sparkSession, [row]).withColumn("lang_id", F.lit(at)))
    if related is not None:
        every = kept(ngrams.unionByName(model.select(*ngrams.columns)))
        langs = langs.sparkSession.createDataFrame(langs.collect(), store.LANGUAGES)  # a row for each model
        pairs = kept(models.selected(kept(models.similarity(every)), langs, related, at))
        confus = kept(models.confusible(every, pairs, langs.select("lang_id", F.col("train_bytes").alias("total")), o.power))
        longest = confus.agg(F.coalesce(F.max("len"), F.lit(3))).first()[0]
        seen = models.observed(texts.withColumn("grp", F.lit(str(at))), confus, 2, longest)
        if confus.count() > models.LEAST_CONFUSIBLE:
            model = kept(models.with_stop_grams(models.boosted(model, confus, o.boost, o.power), models.stop_grams(confus, seen)))
    entries = model.select(F.unhex(grams.hex_key(F.col("key"), F.col("len"))).alias("key"), F.when(F.col("is_stop"), models.raw_weight(F.col("scaled"), F.lit(trained))).otherwise(F.col("cnt")).alias("cnt"), "is_stop")
    head = {"TotalCount": str(size), "Lang": f"{new.language}={new.friendly}"} | {k: v for k, v in (("Region", new.region), ("Encoding", new.encoding), ("Source", new.source)) if v}
    return langs, ngrams.unionByName(model.select(*ngrams.columns)), freqlist.vocabulary(entries, head)
