"""Identification as one plan: strings of documents, their scores, and the report of each.

Scoring, ranking, dropping duplicates and cutting off are one pass over each batch (numpy on strings x languages), so nothing is shuffled: a string
comes out with the list of what is shown for it, and strings without a language with an empty list. Smoothing needs the strings of a document in order, and
models too large to be sent are joined; both go through rows (string, language) and gather a string's rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import IdentifyOptions
from ..functions import texts
from ..sources import files
from . import grams, score, smooth
from .models import adjustment

SHOWN = "array<struct<lang_id: int, label: string, score: double>>"


class Ranking:
    """What is shown of a matrix of scores: labels, classes of models that are the same to the reader, and limits."""

    def __init__(self, languages: list[Row], o: IdentifyOptions):
        self.o, self.by_name = o, o.terse and o.block in (1, 2)
        n = max((r.lang_id for r in languages), default=-1) + 1
        self.labels, self.factor = [""] * n, np.ones(n)
        kinds: dict[tuple, int] = {}
        self.kind = np.arange(n)
        for r in languages:
            name = (r.friendly or r.language) if o.friendly else r.language
            label = name if o.terse else name + (f"_{r.region}" if r.region else "") + (f"-{r.encoding}" if r.encoding else "")
            if o.separate_sources and r.source and not self.by_name:
                label += f"/{r.source}"
            if o.show_script:
                label += f"@{r.script or 'UNKNOWN'}"
            self.labels[r.lang_id], self.factor[r.lang_id] = label, r.factor
            key = (r.language,) if self.by_name else (r.lang_id,) if o.separate_sources else (r.language, r.region, r.encoding)
            self.kind[r.lang_id] = kinds.setdefault(key, len(kinds))

    def top(self, scores: np.ndarray, langs: np.ndarray | None = None) -> pa.Array:
        """List of the shown (lang_id, label, score) for each row; scores: -inf for none; langs: the columns' languages, row by row, where they differ."""
        o, n = self.o, scores.shape[1]
        if o.adjust_coverage and n:
            f = self.factor[:n] if langs is None else self.factor[langs]
            scores = np.where(np.isinf(scores), scores, score.rounded(np.where(np.isinf(scores), 0.0, scores) * f))
        best = np.argsort(-scores, axis=1, kind="stable")[:, : n if self.by_name else 2 * o.top_n]
        scores = np.take_along_axis(scores, best, axis=1)
        lang = best if langs is None else np.take_along_axis(langs, best, axis=1)
        show = (scores > o.sure) & (scores >= o.ratio * np.where(scores[:, :1] > 0, scores[:, :1], 0)) if n else np.zeros(scores.shape, bool)
        if not o.separate_sources or self.by_name:
            kind = self.kind[lang] if n else lang
            for j in range(1, lang.shape[1]):
                show[:, j] &= ~(kind[:, :j] == kind[:, j : j + 1]).any(axis=1)
        show &= np.cumsum(show, axis=1) <= o.top_n
        ids = lang[show]
        items = pa.StructArray.from_arrays([pa.array(ids.astype(np.int32)), pa.array(self.labels, pa.string()).take(pa.array(ids.astype(np.int64))), pa.array(scores[show])], ["lang_id", "label", "score"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(show.sum(axis=1))].astype(np.int32)), items)


def strings_of(docs: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), text: str = "text") -> DataFrame:
    """(ids..., start, bytes): blocks, lines (``start``: the line's number) or the first 256 KiB, as ``o.block`` says; null texts have none."""
    docs = docs.where(F.col(text).isNotNull())
    if o.block == 0:
        out = files.full_file(docs, ids, text).withColumn("start", F.lit(0).cast("bigint"))
    elif o.block <= 2:
        out = files.lines_of(docs, ids, text).withColumnRenamed("line_no", "start")
    else:
        out = files.blocks_of(docs, ids, o.block, text)
    return out.select(*ids, F.col("start").cast("bigint").alias("start"), "bytes")


def _ranking(languages: DataFrame, o: IdentifyOptions) -> tuple[Ranking, dict[int, int]]:
    """What is shown of the models, and the alignments other than 1."""
    names = [c for c in ("friendly", "region", "encoding", "source", "script") if c not in languages.columns]
    rows = languages.withColumns({c: F.lit(None).cast("string") for c in names})
    factor = adjustment(F.col("match_factor"), F.col("alignment")) if "match_factor" in languages.columns else F.lit(1.0)
    rows = rows.select("lang_id", "language", "friendly", "region", "encoding", "source", "script", factor.cast("double").alias("factor"), (F.col("alignment") if "alignment" in languages.columns else F.lit(1)).alias("alignment")).collect()
    return Ranking(rows, o), {r.lang_id: r.alignment for r in rows if r.alignment > 1}


def shown(strings: DataFrame, model: DataFrame, languages: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), order: str | None = None) -> DataFrame:
    """``strings`` (ids..., bytes and others) with n_bytes and ``shown``: the languages reported, best first; empty where there is none.

    languages: a row for each model (see ``sources.store``). order: with ``o.smooth``, the one of ``ids`` that numbers the strings of a sequence.
    """
    rank, align = _ranking(languages, o)
    b = F.encode("bytes", "UTF-8") if dict(strings.dtypes)["bytes"] == "string" else F.col("bytes")
    sized = strings.withColumn("n_bytes", F.octet_length(b).cast("bigint"))
    scored_bytes = texts.without_blank_bytes(b) if o.ignore_blanks else b
    if not o.smooth and score.sendable(score.used_by(model, o)):
        tables = score.tables_of(model, o, align)

        def run(col: pa.Array) -> pa.Array:
            data, offs = grams.buffers(col)
            parts = [rank.top(tables.scores(data[offs[a] : offs[c]], offs[a : c + 1] - offs[a], o)) for a, c in grams.pieces(offs, score.PIECE, tables.rows())]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("lang_id", pa.int32()), ("label", pa.string()), ("score", pa.float64())])))

        return sized.withColumn("shown", F.arrow_udf(run, SHOWN)(scored_bytes))
    found = score.sums(strings.withColumn("bytes", scored_bytes), model, ids, o, align).withColumn("score", score.score(o))
    if o.smooth:
        seq = [c for c in ids if c != order]
        place = strings.select(*ids).withColumn("_pos", F.row_number().over(Window.partitionBy(*seq).orderBy(order)))
        found = smooth.smoothed(found.join(place, ids), seq, "_pos", numbered=True).select(*ids, "lang_id", F.col("smoothed").alias("score"))
    lists = found.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("lang_id", "score"))).alias("all"))

    def cut(col: pa.Array) -> pa.Array:
        size = np.asarray(pa.compute.list_value_length(col)).astype(np.int64)
        flat, width = col.flatten(), int(size.max()) if len(size) else 0
        at = np.arange(width)[None, :] < size[:, None]
        scores, langs = np.full(at.shape, -np.inf), np.zeros(at.shape, np.int64)
        scores[at], langs[at] = np.asarray(flat.field(1)), np.asarray(flat.field(0))
        return rank.top(scores, langs)

    lists = lists.select(*ids, F.arrow_udf(cut, SHOWN)(F.col("all")).alias("shown"))
    return sized.join(lists, ids, "left").withColumn("shown", F.coalesce("shown", F.array().cast(SHOWN)))


def _overlapping(tables: score._Tables, rank: Ranking, o: IdentifyOptions, col: pa.Array) -> pa.Array:
    """For each text the list of its blocks, (start, n_bytes, shown): a text is gone through once, whatever share of them overlaps."""
    data, offs = grams.buffers(col)
    size, step = np.diff(offs), o.block // 4
    limit = np.minimum(size, np.maximum(1, -(-size // o.block) - 1) * o.block)
    many = -(-limit // step)
    text = np.repeat(np.arange(len(size)), many)
    start = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * step
    low = offs[text] + start
    high = np.minimum(low + o.block, offs[text + 1])
    parts, a = [], 0
    while a < len(low):
        b = min(len(low), a + tables.rows(), max(a + 1, int(np.searchsorted(low, low[a] + max(score.PIECE, 2 * o.block)))))
        at = low[a]
        parts.append(rank.top(tables.scores_of(data[at : high[a:b].max()], low[a:b] - at, high[a:b] - at, o)))
        a = b
    found = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("lang_id", pa.int32()), ("label", pa.string()), ("score", pa.float64())])))
    items = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array((high - low).astype(np.int64)), found], ["start", "n_bytes", "shown"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), items)


def blocks_shown(docs: DataFrame, model: DataFrame, languages: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), text: str = "text") -> DataFrame:
    """(ids..., start, n_bytes, shown) of the overlapping blocks of each text: as ``shown`` over ``strings_of``, without making the blocks."""
    rank, align = _ranking(languages, o)
    if o.smooth or o.ignore_blanks or align or not score.sendable(score.used_by(model, o)):
        return shown(strings_of(docs, ids, o, text), model, languages, [*ids, "start"], o, "start").select(*ids, "start", "n_bytes", "shown")
    tables = score.tables_of(model, o, align)

    def run(col: pa.Array) -> pa.Array:
        return _overlapping(tables, rank, o, col)

    kind = f"array<struct<start: bigint, n_bytes: bigint, shown: {SHOWN}>>"
    b = F.encode(text, "UTF-8") if dict(docs.dtypes)[text] == "string" else F.col(text)
    found = docs.where(F.col(text).isNotNull()).select(*ids, F.arrow_udf(run, kind)(b).alias("_blocks"))
    return found.select(*ids, F.explode("_blocks").alias("_b")).select(*ids, "_b.start", "_b.n_bytes", "_b.shown")


def best(strings: DataFrame, model: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), alignments: dict[int, int] | None = None) -> DataFrame:
    """``strings`` (ids..., bytes and others) with (lang_id, score) of the highest score, ties by language id; both null where nothing matches."""
    if not score.sendable(score.used_by(model, o)):
        top = score.ranked(score.scores(strings, model, ids, o, alignments), ids, o).where("rank = 1").drop("rank")
        return strings.join(top, ids, "left")
    tables = score.tables_of(model, o, alignments)

    def run(col: pa.Array) -> pa.Array:
        data, offs = grams.buffers(col)
        lang, top = np.zeros(len(offs) - 1, np.int32), np.full(len(offs) - 1, -np.inf)
        for a, b in grams.pieces(offs, score.PIECE, tables.rows()):
            s = tables.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], o)
            if s.shape[1]:
                lang[a:b] = s.argmax(axis=1)
                top[a:b] = s[np.arange(b - a), lang[a:b]]
        none = np.isinf(top)
        return pa.StructArray.from_arrays([pa.array(lang, mask=none), pa.array(top, mask=none)], ["lang_id", "score"])

    out = strings.withColumn("_best", F.arrow_udf(run, "lang_id int, score double")(F.col("bytes")))
    return out.withColumns({"lang_id": F.col("_best.lang_id"), "score": F.col("_best.score")}).drop("_best")


def reported(found: DataFrame, o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """Adds ``report``, the line printed for a string; null where nothing is. found: (start, bytes, n_bytes, shown)."""
    lines = o.block in (1, 2)
    one = F.transform("shown", lambda x: x["label"] if o.terse and lines else F.format_string("%s:%.6f", x["label"], x["score"]))
    some = F.when(F.size("shown") > 0, F.array_join(one, "," if o.terse and lines else " "))
    extent = F.format_string("@ %08X-%08X", F.col("start"), F.col("start") + F.col("n_bytes") - 1)
    if lines:
        text = F.col("bytes") if dict(found.dtypes)["bytes"] == "string" else F.decode("bytes", "UTF-8")
        return found.withColumn("report", F.concat(F.coalesce(some, F.lit("??")), F.lit("\t"), text))
    line = some if o.block == 0 else F.concat(extent, F.lit(" "), some)
    return found.withColumn("report", F.coalesce(line, F.concat(extent, F.lit(": no languages detected"))) if o.verbose else line)


def identify(docs: DataFrame, model: DataFrame, languages: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), text: str = "text") -> DataFrame:
    """(ids..., start, n_bytes, shown, report) of every string of the documents. Null and empty texts have no string; an empty table gives no rows."""
    if o.block > 2:
        return reported(blocks_shown(docs, model, languages, ids, o, text), o).select(*ids, "start", "n_bytes", "shown", "report")
    found = shown(strings_of(docs, ids, o, text), model, languages, [*ids, "start"], o, "start")
    return reported(found, o).select(*ids, "start", "n_bytes", "shown", "report")
