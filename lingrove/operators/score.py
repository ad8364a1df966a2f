"""Scoring byte strings against models.

``sums`` is the join of a text's n-grams with the models and the sum over it. The models are sent to the tasks while they are within
``MAX_MODEL_ROWS`` (k n-grams for each language); beyond that, or where asked, the n-grams are exploded and joined by key. Both give the
same integers, so scores don't depend on the way or on the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IdentifyOptions
from ..functions.scaling import length_factor
from . import grams
from .trie import Trie

MAX_MODEL_ROWS = 4_000_000
MAX_COLUMNS = 32  # languages, with and without stop-grams, whose weights by n-gram are kept as columns; of more, entries are gone through one by one
PIECE = 1 << 18
_MAX_ALIGN = np.array([4, 1, 2, 1])


class _Tables:
    """The models by n-gram length: a trie of the keys, and for each key the entries (language, stop flag, weight) from ``first`` on."""

    def __init__(self, rows, lengths: range, alignments: dict[int, int]):
        self.by_length = {}
        self.langs = int(rows["lang_id"].max()) + 1 if len(rows) else 0
        self.align = np.array([alignments.get(i, 1) for i in range(self.langs)])
        keys = {}
        for n in lengths:
            t = rows[rows["len"] == n].sort_values("key")
            if len(t):
                keys[n], first, many = np.unique(t["key"].to_numpy(np.int64), return_index=True, return_counts=True)
                self.by_length[n] = (first, many, t["lang_id"].to_numpy(np.int64), t["is_stop"].to_numpy(bool), t["quant"].to_numpy(np.float64))
        self.trie = Trie(keys)
        self.columns = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"columns": None}

    def _column(self, n: int) -> dict[tuple[int, int], np.ndarray] | None:
        """By (language, stop flag) the weight of each node of n bytes; None where they are many, or starts count by language."""
        if self.columns is None:
            self.columns = {}
            self.trie.make()
        if n not in self.columns:
            first, many, lang, stop, quant = self.by_length[n]
            kinds = np.unique(lang * 2 + stop)
            if len(kinds) > MAX_COLUMNS or (self.align > 1).any():
                self.columns[n] = None
            else:
                key, kind = np.repeat(self.trie.own[n], many), lang * 2 + stop
                self.columns[n] = {}
                for c in kinds.tolist():
                    w = np.zeros(len(self.trie.nodes[n]), np.int64)
                    np.add.at(w, key[kind == c], quant[kind == c].astype(np.int64))
                    self.columns[n][c // 2, c % 2] = w
        return self.columns[n]

    def sums(self, data: np.ndarray, offs: np.ndarray) -> dict[int, np.ndarray]:
        """By length: rows x languages x (ordinary, stop-gram) sums of weights; exact, as they stay below 2^53."""
        return self.sums_of(data, offs[:-1], offs[1:])

    def sums_of(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """The same for the strings data[low:high], which may overlap: the data is gone through once."""
        out = {}
        for size, start, node in self.trie.walk(data):
            if size not in self.by_length:
                continue
            a = np.searchsorted(start, low)
            b = np.maximum(a, np.searchsorted(start, high - size, "right"))
            columns = self._column(size)
            if columns is not None:
                out[size] = np.zeros((len(low), self.langs, 2))
                run = np.zeros(len(start) + 1, np.int64)
                for (lang, stop), w in columns.items():
                    np.cumsum(w[node], out=run[1:])
                    out[size][:, lang, stop] = run[b] - run[a]
                continue
            first, many, lang, stop, quant = self.by_length[size]
            m = b - a
            hit = np.arange(int(m.sum())) + np.repeat(a - (np.cumsum(m) - m), m)
            row, at = np.repeat(np.arange(len(low)), m), self.trie.place[size][node[hit]]
            own = np.flatnonzero(at >= 0)
            row, at, rel = row[own], at[own], start[hit[own]]
            rel = rel - low[row]
            m = many[at]
            entry = np.arange(int(m.sum())) + np.repeat(first[at] - (np.cumsum(m) - m), m)
            row, most = np.repeat(row, m), np.repeat(_MAX_ALIGN[rel % 4], m)
            ok = self.align[lang[entry]] <= most
            if not ok.all():
                entry, row = entry[ok], row[ok]
            cell = (row * self.langs + lang[entry]) * 2 + stop[entry]
            out[size] = np.bincount(cell, quant[entry], minlength=len(low) * self.langs * 2).reshape(len(low), self.langs, 2)
        return out

    def rows(self) -> int:
        """Rows that are scored at once, so that their cells stay within some 32 MB for each length, whatever the number of languages."""
        return max(1, (2 << 20) // max(1, self.langs))

    def scores(self, data: np.ndarray, offs: np.ndarray, o: IdentifyOptions) -> np.ndarray:
        """rows x languages: the scores, -inf where nothing matches; the same arithmetic, in the same order, as ``score``."""
        return self.scores_of(data, offs[:-1], offs[1:], o)

    def scores_of(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, o: IdentifyOptions) -> np.ndarray:
        """The same for the strings data[low:high], which may overlap."""
        got = self.sums_of(data, low, high)
        shape = (len(low), self.langs)
        total, some = np.zeros(shape), np.zeros(shape, bool)
        for n in o.lengths():
            if n in got:
                f = length_factor(n, o.bigram_weight)
                total += got[n][:, :, 0] * f + got[n][:, :, 1] * (f * o.stop_penalty)
                some |= (got[n] != 0).any(axis=2)
        total /= (1e11 * np.maximum(1, high - low))[:, None]
        return np.where(some, rounded(total), -np.inf)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def _scorer(tables: _Tables, n_ids: int, lengths: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = grams.buffers(batch.column(n_ids))
            for a, b in grams.pieces(offs, PIECE, tables.rows()):
                got = tables.sums(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if not got:
                    continue
                some = sum(np.abs(m).sum(axis=2) for m in got.values()) > 0
                row, lang = np.nonzero(some)
                ids = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in range(n_ids)]
                cols = [pa.array((offs[a + 1 : b + 1] - offs[a:b])[row]), pa.array(lang.astype(np.int32))]
                for size in lengths:
                    for k in range(2):
                        cols.append(pa.array(got[size][row, lang, k].astype(np.int64)) if size in got else pa.array(np.zeros(len(row), np.int64)))
                names = [batch.schema.names[k] for k in range(n_ids)] + ["n_bytes", "lang_id"] + [f"{c}{size}" for size in lengths for c in "sp"]
                yield pa.RecordBatch.from_arrays(ids + cols, names=names)

    return run


def _string_grams(n_ids: int, lengths: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = grams.buffers(batch.column(n_ids))
            names = [batch.schema.names[k] for k in range(n_ids)] + ["n_bytes", "len", "key", "most", "n"]
            for a, b in grams.pieces(offs, 1 << 20):
                o = offs[a : b + 1] - offs[a]
                for size in lengths:
                    key, start = grams.keys(data[offs[a] : offs[b]], o, size)
                    if not len(key):
                        continue
                    row = np.searchsorted(o, start, "right") - 1
                    most = _MAX_ALIGN[(start - o[row]) % 4]
                    order = np.lexsort((most, key, row))
                    row, key, most = row[order], key[order], most[order]
                    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (most[1:] != most[:-1])])
                    n = np.diff(np.r_[at, len(row)])
                    row = row[at]
                    ids = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in range(n_ids)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(o)[row]), pa.array(np.full(len(row), size, np.int32)), pa.array(key[at]), pa.array(most[at].astype(np.int32)), pa.array(n)], names=names)

    return run


def sendable(model: DataFrame) -> bool:
    """Whether a model's entries may be sent to the tasks: at most ``MAX_MODEL_ROWS``, some 40 bytes each in the driver."""
    return model.count() <= MAX_MODEL_ROWS


def tables_of(model: DataFrame, o: IdentifyOptions, alignments: dict[int, int] | None = None) -> _Tables:
    return _Tables(used_by(model, o).select("lang_id", "len", "key", "is_stop", "quant").toPandas(), range(2, 9), alignments or {})


def used_by(model: DataFrame, o: IdentifyOptions) -> DataFrame:
    """The entries of a model that count under the options."""
    used = model.where(F.col("len").isin(list(o.lengths())))
    return used if o.stop_grams else used.where("not is_stop")


def sums(strings: DataFrame, model: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), alignments: dict[int, int] | None = None, by_join: bool = False, tables: _Tables | None = None) -> DataFrame:
    """(ids..., n_bytes, lang_id, s2, p2, ..., s8, p8): sums of quantised weights of ordinary and of stop-grams, by length.

    strings: the id columns and ``bytes`` (STRING or BINARY). Only languages with a match have a row.
    """
    lengths = range(2, 9)
    used = used_by(model, o)
    strings = strings.select(*ids, "bytes")
    if tables is not None or (not by_join and sendable(used)):
        tables = tables or tables_of(model, o, alignments)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strings.select(*ids).schema)
        cols = ", ".join(f"s{n} bigint, p{n} bigint" for n in lengths)
        return strings.mapInArrow(_scorer(tables, len(ids), lengths), f"{kinds}, n_bytes bigint, lang_id int, {cols}")
    # the n-grams of each string, counted, by key; those of one alignment class together
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strings.select(*ids).schema)
    found = strings.mapInArrow(_string_grams(len(ids), range(o.lengths().start, 9)), f"{kinds}, n_bytes bigint, len int, key bigint, most int, n bigint")
    align = F.create_map(*[x for i, a in (alignments or {}).items() for x in (F.lit(i), F.lit(a))]) if alignments else None
    hit = found.join(used.select("len", "key", "lang_id", "is_stop", "quant"), ["len", "key"])
    if align is not None:
        hit = hit.where(F.coalesce(align[F.col("lang_id")], F.lit(1)) <= F.col("most"))
    hit = hit.withColumn("quant", F.col("quant") * F.col("n"))
    cells = [F.coalesce(F.sum(F.when((F.col("len") == n) & (F.col("is_stop") == F.lit(c == "p")), F.col("quant"))), F.lit(0)).cast("bigint").alias(f"{c}{n}") for n in lengths for c in "sp"]
    return hit.groupBy(*ids, "n_bytes", "lang_id").agg(*cells)


def score(o: IdentifyOptions = IdentifyOptions()) -> Column:
    """Score from the sums: by length in fixed order, normalised by the string's bytes, rounded to 6 places."""
    total = None
    for n in o.lengths():
        f = length_factor(n, o.bigram_weight)
        term = F.col(f"s{n}") * F.lit(f) + F.col(f"p{n}") * F.lit(f * o.stop_penalty)
        total = term if total is None else total + term
    return F.round(total / (F.lit(1e11) * F.col("n_bytes")), 6)


def scores(strings: DataFrame, model: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions(), alignments: dict[int, int] | None = None, by_join: bool = False, tables: _Tables | None = None) -> DataFrame:
    """(ids..., lang_id, score)."""
    return sums(strings, model, ids, o, alignments, by_join, tables).select(*ids, "lang_id", score(o).alias("score"))


def ranked(scored: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """Adds ``rank``: by score, ties by language id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("score"), "lang_id")))


def cut(scored: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """Keeps scores of at least max(sure, ratio * best); where none reaches that, the best alone."""
    best = F.max("score").over(Window.partitionBy(*ids))
    return ranked(scored, ids, o).withColumn("_best", best).where((F.col("score") >= F.greatest(F.lit(o.sure), F.lit(o.ratio) * F.col("_best"))) | ((F.col("_best") < o.sure) & (F.col("rank") == 1))).drop("_best")


def report(scored: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """What is shown: at most top_n languages with score > sure and >= ratio * best."""
    best = F.max("score").over(Window.partitionBy(*ids))
    return ranked(scored, ids, o).withColumn("_best", best).where((F.col("score") > o.sure) & (F.col("score") >= F.lit(o.ratio) * F.col("_best")) & (F.col("rank") <= o.top_n)).drop("_best")


def deduped(scored: DataFrame, languages: DataFrame, ids: list[str], by: tuple[str, ...] = ("language", "region", "encoding")) -> DataFrame:
    """Of models with the same language, region and encoding (nulls are equal) the best-scoring one of each string."""
    at = scored.join(F.broadcast(languages), "lang_id")
    turn = F.row_number().over(Window.partitionBy(*ids, *by).orderBy(F.desc("score"), "lang_id"))
    return at.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
