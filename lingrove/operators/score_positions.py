"""Which bytes of a text a model's n-grams cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .score import MAX_MODEL_ROWS, PIECE
from .trie import Trie


def covered(strings: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, total, covered, matched, matches, freq), one row per batch and language; strings: (lang, bytes); model: (lang, len, key, cnt).

    A language's model goes to the tasks with those of others, as many as make up ``MAX_MODEL_ROWS`` entries; each language needs its own alone.
    """
    groups, room = [[]], MAX_MODEL_ROWS
    for r in model.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect():  # a row for each model
        if groups[-1] and r.n > room:
            groups.append([])
            room = MAX_MODEL_ROWS
        groups[-1].append(r.lang)
        room -= r.n
    out = None
    for langs in groups:
        one = _covered(strings.where(F.col("lang").isin(langs)) if len(groups) > 1 else strings, model.where(F.col("lang").isin(langs)) if len(groups) > 1 else model)
        out = one if out is None else out.unionByName(one)
    return out


def _covered(strings: DataFrame, model: DataFrame) -> DataFrame:
    rows = model.select("lang", "len", "key", "cnt").toPandas()
    tables = {}
    for lang, t in rows.sort_values("key").groupby("lang"):
        at = {int(n): (x["key"].to_numpy(np.int64), x["cnt"].to_numpy(np.int64)) for n, x in t.groupby("len")}
        tables[lang] = Trie({n: k for n, (k, _) in at.items()}), {n: c for n, (_, c) in at.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows_of in grams.by_group(batch.column(0)):
                data, offs = grams.buffers(batch.column(1).filter(rows_of))
                sums = np.zeros(5, np.int64)
                trie, counts = tables.get(lang, (None, None))
                for a, b in grams.pieces(offs, PIECE):
                    part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    depth = np.zeros(len(part) + 1, np.int64)
                    for n, start, node in trie.walk(part) if trie else ():
                        if n not in counts:
                            continue
                        at = trie.place[n][node]
                        low = np.searchsorted(start, o[:-1])
                        m = np.maximum(low, np.searchsorted(start, o[1:] - n, "right")) - low
                        hit = np.arange(int(m.sum())) + np.repeat(low - (np.cumsum(m) - m), m)
                        hit = hit[at[hit] >= 0]
                        s = start[hit]
                        depth += np.bincount(s, minlength=len(depth)) - np.bincount(s + n, minlength=len(depth))
                        sums[2:] += (n * len(s), len(s), n * int(counts[n][at[hit]].sum()))
                    sums[:2] += (len(part), int((np.cumsum(depth[:-1]) > 0).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *(pa.array([int(x)]) for x in sums)], names=["lang", "total", "covered", "matched", "matches", "freq"])

    return strings.select("lang", "bytes").where("lang is not null and bytes is not null").mapInArrow(run, "lang string, total bigint, covered bigint, matched bigint, matches bigint, freq bigint")
