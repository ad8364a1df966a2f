"""Identification of streams: per micro-batch scores, scores smoothed over each sequence, running counts by language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import IdentifyOptions
from ..operators import identify, score
from ..operators.smooth import Prior
from ..plans.train import kept

STATE = "langs array<int>, values array<double>, strings bigint"


def scored(strings: DataFrame, model: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """(ids..., n_bytes, lang_id, score) of a stream of strings; stateless, so append mode goes."""
    return score.sums(strings, model, ids, o).select(*ids, "n_bytes", "lang_id", score.score(o).alias("score"))


def report_to(strings: DataFrame, model: DataFrame, ids: list[str], sink: Callable[[DataFrame, int], None], o: IdentifyOptions = IdentifyOptions()):
    """A stream writer that hands each micro-batch's report to ``sink(batch, batch_id)``; start it with the checkpoint of your choice."""

    model = kept(model)  # of all micro-batches
    tables = score.tables_of(model, o) if score.sendable(score.used_by(model, o)) else None

    def each(batch: DataFrame, number: int) -> None:
        sink(score.report(score.scores(batch, model, ids, o, tables=tables), ids, o), number)

    return strings.writeStream.foreachBatch(each)


def _step(seq: str, order: str):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        langs, values, n = state.get if state.exists else ([], [], 0)
        prior = Prior(dict(zip(langs, values, strict=True)), n)
        rows = pd.concat(list(frames), ignore_index=True).sort_values([order, "lang_id"])
        out = []
        for at, one in rows.groupby(order, sort=True):
            got = prior.step(dict(zip(one["lang_id"].tolist(), one["score"].tolist(), strict=True)), int(one["n_bytes"].iloc[0]))
            out += [(key[0], at, g, round(v, 6)) for g, v in got.items()]
        state.update(([int(g) for g in prior.values], [float(v) for v in prior.values.values()], prior.strings))
        yield pd.DataFrame(out, columns=[seq, order, "lang_id", "smoothed"])

    return run


def smoothed(strings: DataFrame, model: DataFrame, seq: str, order: str, o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """(seq, order, lang_id, smoothed): scores mixed with those of the earlier strings of the same sequence.

    strings: (seq, order, bytes). The state of a sequence is its prior, a number for each language. Strings of one micro-batch are taken in
    their order; one that comes in a later batch than its successor is taken when it comes.
    """
    found = scored(strings, model, [seq, order], o)
    kinds = dict(found.dtypes)
    out = f"{seq} {kinds[seq]}, {order} {kinds[order]}, lang_id int, smoothed double"
    return found.groupBy(seq).applyInPandasWithState(_step(seq, order), out, STATE, "append", GroupStateTimeout.NoTimeout)


def best(strings: DataFrame, model: DataFrame, ids: list[str], o: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """(ids..., lang_id, score) of the best language of each string of a stream; null where nothing matches. Without state: each string is scored and ranked by itself."""
    return identify.best(strings, model, ids, o).select(*ids, "lang_id", "score")


def language_counts(stream_of_best: DataFrame) -> DataFrame:
    """(lang_id, n): running counts, for complete or update mode."""
    return stream_of_best.groupBy("lang_id").agg(F.count("*").alias("n"))
