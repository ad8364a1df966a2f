"""Identification as a SQL function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IdentifyOptions
from ..operators import grams
from ..operators.score import MAX_MODEL_ROWS, _Tables
from .scaling import length_factor


def register(spark: SparkSession, model: DataFrame, name: str = "identify", o: IdentifyOptions = IdentifyOptions()) -> None:
    """Makes ``name(text)`` known to SQL: a struct (lang, score) of the best language, null where none has a positive score.

    The model is sent with the function; one of more than ``MAX_MODEL_ROWS`` entries is refused: score it by join instead.
    """
    used = model.where(F.col("len").isin(list(o.lengths())))
    if used.count() > MAX_MODEL_ROWS:
        raise ValueError(f"{name}: the model has more than {MAX_MODEL_ROWS} entries")
    rows = used.select("lang_id", "lang", "len", "key", "is_stop", "quant").toPandas()
    tables = _Tables(rows, o.lengths(), {})
    names = dict(zip(rows["lang_id"].tolist(), rows["lang"].tolist(), strict=True))
    stop = o.stop_penalty if o.stop_grams else 0.0

    def run(col: pa.Array) -> pa.Array:
        if pa.types.is_null(col.type):
            return pa.nulls(len(col), pa.struct([("lang", pa.string()), ("score", pa.float64())]))
        data, offs = grams.buffers(col)
        n = len(col)
        total = np.zeros((n, max(1, tables.langs)))
        for a, b in grams.pieces(offs, 1 << 20):
            for size, m in tables.sums(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).items():
                total[a:b] += (m[:, :, 0] + m[:, :, 1] * stop) * length_factor(size, o.bigram_weight)
        total /= 1e11 * np.maximum(1, np.diff(offs))[:, None]
        at = total.argmax(axis=1) if n else np.zeros(0, np.int64)
        top = np.round(total[np.arange(n), at], 6)
        none = pa.array(top <= 0)
        lang = pa.array([names.get(i) for i in at.tolist()], pa.string())
        return pa.StructArray.from_arrays([lang, pa.array(top)], ["lang", "score"], mask=none)

    spark.udf.register(name, F.arrow_udf(run, "lang string, score double"))
