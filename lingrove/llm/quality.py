"""Quality classifier: supervised subword embeddings (operator 3).

A document is the average of learned vectors of its words plus the average of learned vectors of its
character n-grams (``NGRAMS`` characters of case-folded text), all hashed into fixed tables; a softmax over the
classes clean, low and toxic follows. One word bucket stands for the bigrams of a word and itself, so that repetition
is learned whatever the word. Trained by stochastic gradient descent in numpy (steps scaled for each row
of the tables by its past gradients); buckets that few training documents have are left at zero.
The average is linear, so scoring needs no vectors: each bucket's contribution to each logit is worked out
once and a document is a sum of looked-up numbers.

The only sample is the training set: at most ``max_rows`` labelled documents, in fixed shares of the classes,
chosen by a hash of the id. The executors turn them into features and one task trains on these; the driver gets the table of
logits alone, whose size is fixed. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, chunks, fold, fresh, text_buffers, words

CLASSES = ("clean", "low", "toxic")
SHARES = (0.5, 0.15, 0.35)  # of the training rows
NGRAMS = (4,)
BUCKET_BITS = 18
MAX_ROWS = 9000
MIN_SHARE = 0.002  # a bucket is learned when this share of the training documents has it, two at least
DIM, EPOCHS, RATE, BATCH, EPS = 8, 8, 1.0, 32, 1e-3
KEEP = 0.5


@dataclass(frozen=True)
class Model:
    """``table``: logits of low and toxic over clean for each bucket (words first, then n-grams); ``bias`` likewise."""

    table: np.ndarray
    bias: np.ndarray
    bucket_bits: int = BUCKET_BITS


def _word_buckets(folded: np.ndarray, rolling: Rolling, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words, then bucket 0 for every word that repeats the one before it."""
    start, end, row = words(folded, offs)
    h = rolling.spans(start, end)
    again = row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]
    return np.concatenate([row, again]), np.concatenate([(h >> U(64 - bits)).astype(np.int64), np.zeros(len(again), np.int64)])


def _char_edges(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each character begins, and the end; characters before each row). A row's first byte begins one, whatever it is."""
    begins = (data & 0xC0) != 0x80
    begins[offs[:-1][np.diff(offs) > 0]] = True
    edge = np.flatnonzero(begins)
    return np.r_[edge, len(data)], np.searchsorted(edge, offs)


def _gram_buckets(rolling: Rolling, edge: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n characters from each one; those that run into the next row are there too."""
    m = max(0, len(edge) - n)
    return (rolling.spans(edge[:m], edge[n:]) >> U(64 - bits)).astype(np.int32)


def logits(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x 2 logits over clean for the rows of a byte buffer."""
    n, size = len(offs) - 1, 1 << model.bucket_bits
    out = np.tile(model.bias, (n, 1))
    if not len(data):
        return out
    folded = fold(data)
    rolling = Rolling(folded)
    row, bucket = _word_buckets(folded, rolling, offs, model.bucket_bits)
    n_words = np.maximum(1, np.bincount(row, minlength=n))
    for k in range(2):
        out[:, k] += np.bincount(row, model.table[:size, k][bucket], minlength=n) / n_words
    edge, at = _char_edges(folded, offs)
    n_grams, sums = np.zeros(n, np.int64), np.zeros((n, 2))
    for g in NGRAMS:
        bucket = _gram_buckets(rolling, edge, g, model.bucket_bits)
        first = np.minimum(at[:-1], len(bucket))
        last = np.maximum(np.minimum(at[1:] - g + 1, len(bucket)), first)
        n_grams += last - first
        for k in range(2):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(model.table[size:, k][bucket], out=total[1:])
            sums[:, k] += total[last] - total[first]
    return out + sums / np.maximum(1, n_grams)[:, None]


def probabilities(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x 3 softmax."""
    z = np.hstack([np.zeros((len(offs) - 1, 1)), logits(model, data, offs)])
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _features(text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of one document; the weights of words add up to 1, those of n-grams too."""
    offs, size = np.array([0, len(text)]), 1 << bits
    folded = fold(text)
    rolling = Rolling(folded)
    w = _word_buckets(folded, rolling, offs, bits)[1]
    edge, _ = _char_edges(folded, offs)
    g = np.concatenate([_gram_buckets(rolling, edge, n, bits) for n in NGRAMS]).astype(np.int64) + size
    b1, c1 = np.unique(w, return_counts=True)
    b2, c2 = np.unique(g, return_counts=True)
    return np.concatenate([b1, b2]).astype(np.int32), np.concatenate([c1 / max(1, len(w)), c2 / max(1, len(g))]).astype(np.float32)


def train(texts: list[bytes], classes: list[int], bucket_bits: int = BUCKET_BITS, **how) -> Model:
    """Fit on labelled texts; classes: indices into CLASSES."""
    return train_on([_features(np.frombuffer(t, np.uint8), bucket_bits) for t in texts], classes, bucket_bits, **how)


def train_on(made: list[tuple[np.ndarray, np.ndarray]], classes: list[int], bucket_bits: int = BUCKET_BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Fit on the features (bucket, weight) of labelled texts. Without texts of two classes the model keeps everything."""
    size = 2 << bucket_bits
    y = np.asarray(classes, np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((size, 2), np.float32), np.array([-20.0, -20.0]), bucket_bits)
    rng = np.random.default_rng(seed)
    docs_with = np.zeros(size, np.int32)
    for bucket, _ in made:
        docs_with[bucket] += 1
    used = np.flatnonzero(docs_with >= max(2, round(MIN_SHARE * len(y))))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    made = [(place[b[place[b] >= 0]], w[place[b] >= 0]) for b, w in made]
    e = ((rng.random((len(used), dim)) - 0.5) / dim).astype(np.float32)
    w, bias = (rng.random((dim, len(CLASSES))) - 0.5).astype(np.float32), np.zeros(len(CLASSES), np.float32)
    past_e, past_w = np.full(len(used), EPS, np.float32), np.full(w.shape, 1e-8, np.float32)
    steps, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            docs = order[s : s + BATCH]
            idx = np.concatenate([made[d][0] for d in docs])
            wt = np.concatenate([made[d][1] for d in docs])
            lens = np.array([len(made[d][0]) for d in docs])
            h, full = np.zeros((len(docs), dim), np.float32), np.flatnonzero(lens)
            if len(full):
                h[full] = np.add.reduceat(e[idx] * wt[:, None], (np.cumsum(lens) - lens)[full], axis=0)
            z = h @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            if len(idx):
                per_doc = (p @ w.T)[np.repeat(np.arange(len(docs)), lens)]
                g_e = np.stack([np.bincount(idx, per_doc[:, k] * wt, minlength=len(used)) for k in range(dim)], axis=1).astype(np.float32)
                past_e += (g_e * g_e).mean(axis=1)
                e -= lr * g_e / np.sqrt(past_e)[:, None]
            g_w = h.T @ p / len(docs)
            past_w += g_w * g_w
            w -= lr * g_w / np.sqrt(past_w)
            bias -= lr * 0.1 * p.mean(axis=0)
    table = np.zeros((size, len(CLASSES) - 1), np.float32)
    table[used] = e @ (w[:, 1:] - w[:, :1])
    return Model(table, (bias[1:] - bias[0]).astype(np.float64), bucket_bits)


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = text_buffers(batch.column(3))
            for a, b in chunks(offs):
                made = [_features(data[offs[i] : offs[i + 1]], bits) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), *(pa.array([m[k].tobytes() for m in made], pa.binary()) for k in range(2))], names=["id", "tag", "c", "buckets", "weights"])

    return run


def _trainer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for batch in batches:
            for doc, tag, c, bucket, weight in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if doc not in rows or tag < rows[doc][0]:
                    rows[doc] = (tag, c, np.frombuffer(bucket, np.int32), np.frombuffer(weight, np.float32))
        some = [rows[doc] for doc in sorted(rows)]
        m = train_on([(x[2], x[3]) for x in some], [x[1] for x in some], bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.table.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary())], names=["table", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 3, bucket_bits: int = BUCKET_BITS) -> Model:
    """Train on at most ``max_rows`` labelled documents.

    Several labels of one id: the worse counts. Labels with a null, or whose document is missing or null, are left
    out; a document that repeats under one id is used once, and of several texts under one id the one with the least hash. The rows that
    train are broadcast by id and shuffled to one task as features: both are bounded by ``max_rows``.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    known = known.select(F.col("doc_id").cast("bigint").alias("_lr_id"), F.when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).otherwise(1).alias("c"))
    picked = None
    for c, share in enumerate(SHARES):
        some = known.where(F.col("c") == c).orderBy(F.xxhash64("_lr_id", F.lit(seed)), "_lr_id").limit(int(max_rows * share))
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("tag"), "text")
    found = texts.join(F.broadcast(picked), F.col("id") == F.col("_lr_id")).select("id", "tag", "c", "text")
    rows = found.mapInArrow(_feature_rows(bucket_bits), "id bigint, tag bigint, c int, buckets binary, weights binary")
    got = rows.repartition(1).mapInArrow(_trainer(bucket_bits), "table binary, bias binary").first()
    if got is None:
        return train_on([], [], bucket_bits)
    return Model(np.frombuffer(got.table, np.float32).reshape(-1, 2), np.frombuffer(got.bias, np.float64), bucket_bits)


def _scorer(model: Model):
    def run(col: pa.Array) -> pa.Array:
        data, offs, _ = text_buffers(col)
        parts = [probabilities(model, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in chunks(offs)]
        p = np.concatenate(parts) if parts else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], [f"p_{c}" for c in CLASSES])

    return run


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a struct column (p_clean, p_low, p_toxic); null text scores like an empty one."""
    f = F.arrow_udf(_scorer(model), ", ".join(f"p_{c} double" for c in CLASSES))
    return docs.withColumn(name, f(F.col("text")))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: float = KEEP) -> DataFrame:
    """(doc_id, p_clean, p_low, p_toxic, is_kept) for every row of ``docs``.

    Kept: p_clean >= ``keep``. A null text, or one without words or n-grams, is judged by the bias alone. Repeated rows, equal texts and null ids are scored like any
    row. Texts are scored whole, whatever their length. Further columns aren't read, so their names can't clash. Empty table: no rows. Without labels of two classes all are kept.
    """
    s = with_scores(docs.select("doc_id", "text"), fit(docs, labels, max_rows), "s")
    return s.select("doc_id", "s.*").withColumn("is_kept", F.col("p_clean") >= keep)


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names; which are kept: as in ``scores``. Empty table: no rows."""
    (name,) = fresh(docs, "scores")
    return with_scores(docs, fit(docs, labels, max_rows), name).where(F.col(f"{name}.p_clean") >= keep).drop(name)
