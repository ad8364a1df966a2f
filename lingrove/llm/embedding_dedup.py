"""Embedding near-dedup by iterative quantisation (operator 4).

Vectors are brought to length 1, centred and turned onto their principal directions; rotations of these are learned by iterative
quantisation (alternately: codes are the signs of the rotated vectors; the rotation is the best orthogonal match to the codes). Each
rotation gives up to 64 balanced bits; the codes of several, from different starts, are one long code.

Retrieval is by multi-index Hamming tables: the code is cut into substrings of ``width`` bits, each the key of a table, and vectors
that share a key in any table meet. ``width`` follows the logarithm of the number of vectors, so the company that a vector has by chance stays the
same at every size. The number of tables is measured: sample vectors are turned by the largest angle allowed, in random directions, and
tables are added until ``RECALL`` of them share a key with where they came from. What meets is compared by the original vectors' cosine, exactly.

The mean, the directions and the rotations are fitted on a sample of about ``FIT_ROWS`` vectors (all, where there are no more), in one task; every vector is
indexed. Near-duplicate groups are the components of the pairs found with cosine >= ``min_cosine``. Equal vectors are one entry from the start. A vector alone
under its key goes no further; only the others are joined with their vectors, and a list gives edges to the smallest members of its components, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_list, components, drop_written, links, local_stars, written

MIN_COSINE = 0.95
RECALL = 0.97
STEPS = 15
FIT_ROWS = 10_000
SPARE_BITS = 3  # a table has 2^3 keys for each vector


@dataclass(frozen=True)
class Index:
    """mean; dim x bits projection of all rotations; tables of ``width`` bits each, from the first bit on."""

    mean: np.ndarray
    projection: np.ndarray
    width: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """n x tables int64."""
        bits = (unit - self.mean) @ self.projection[:, : self.width * self.tables] >= 0
        return (bits.reshape(len(unit), self.tables, self.width) << np.arange(self.width, dtype=np.int64)).sum(axis=2)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def width_of(n: int) -> int:
    return min(62, max(6, math.ceil(math.log2(max(2, n))) + SPARE_BITS))


def fit(x: np.ndarray, width: int, min_cosine: float = MIN_COSINE, recall: float = RECALL, steps: int = STEPS, seed: int = 5) -> Index:
    """From a sample of unit vectors: rotations are learned until their tables find ``recall`` of the turned vectors."""
    rng, n, dim = np.random.default_rng(seed), len(x), x.shape[1]
    mean = x.mean(axis=0)
    value, axis = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    bits = min(64, dim)
    axis = axis[:, np.argsort(-value)[:bits]]
    z = (x - mean) @ axis
    aside = rng.standard_normal((min(n, 4000), dim))
    aside -= (aside * x[: len(aside)]).sum(axis=1, keepdims=True) * x[: len(aside)]
    turned = _unit(min_cosine * x[: len(aside)] + math.sqrt(max(0.0, 1 - min_cosine**2)) * _unit(aside)) if dim > 1 else x[: len(aside)]
    projection, found, tables = np.zeros((dim, 0)), np.zeros(len(aside), bool), 0
    while True:
        rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
            rotation = (u @ vt).T
        projection = np.hstack([projection, axis @ rotation])
        while (tables + 1) * width <= projection.shape[1]:
            at = slice(tables * width, (tables + 1) * width)
            found |= (((x[: len(aside)] - mean) @ projection[:, at] >= 0) == ((turned - mean) @ projection[:, at] >= 0)).all(axis=1)
            tables += 1
            if found.mean() >= recall:
                return Index(mean, projection[:, : tables * width], width, tables)


def learn(vectors: DataFrame, dim: int, n: int, min_cosine: float = MIN_COSINE, steps: int = STEPS, fit_rows: int = FIT_ROWS) -> Index:
    """The index of all vectors (id, v), fitted on about ``fit_rows`` of them, by a hash of the id; one task, from which only the index comes back."""
    width = width_of(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), _unit(_matrix(b.column(1), dim))) for b in batches if b.num_rows]
        if parts:
            ids = np.concatenate([p[0] for p in parts])
            i = fit(np.concatenate([p[1] for p in parts])[np.argsort(ids, kind="stable")], width, min_cosine, steps=steps)
            yield pa.RecordBatch.from_arrays([pa.array([i.mean.tobytes()]), pa.array([i.projection.tobytes()]), pa.array([i.tables])], names=["mean", "projection", "tables"])

    one_in = max(1, n // fit_rows)
    for share in (one_in, 1):  # a hash may, of few, choose none
        sample = vectors.select("id", "v").where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
        got = sample.repartition(1).mapInArrow(run, "mean binary, projection binary, tables bigint").first()
        if got:
            return Index(np.frombuffer(got.mean), np.frombuffer(got.projection).reshape(dim, -1), width, got.tables)
    raise ValueError("no vectors")


def compare(min_cosine: float):
    """Edges of lists (list, id, v)."""

    def edges(table: pa.Table) -> pa.Table:
        ids, v = np.asarray(table.column("id").combine_chunks()), table.column("v").combine_chunks()
        order = np.argsort(ids, kind="stable")
        ids, unit = ids[order], _unit(_matrix(v, len(v.flatten()) // len(ids)))[order]
        a, b = links(len(ids), lambda x, y: unit[x] @ unit[y].T >= min_cosine)
        label = local_stars(len(ids), a, b)
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[label[far]], "b": ids[far]})

    def pairs(batch: pa.RecordBatch):
        unit = _unit(_matrix(batch.column(2), len(batch.column(2).flatten()) // batch.num_rows))
        return lambda i, j: np.einsum("ij,ij->i", unit[i], unit[j]) >= min_cosine

    return by_list(edges, pairs)


def near_edges(entries: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b): edges that connect the entries (id, v, keys) that share a key and reach the cosine."""
    keyed = entries.select("id", F.posexplode("keys").alias("t", "key")).select("id", F.xxhash64("t", "key").alias("list"))
    shared = keyed.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list")
    met = keyed.join(shared, "list").join(entries.select("id", "v"), "id").select("list", "id", "v")
    return met.repartition("list").sortWithinPartitions("list").mapInArrow(compare(min_cosine), "a bigint, b bigint")


def groups(table: DataFrame, min_cosine: float = MIN_COSINE, steps: int = STEPS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, group_id, is_kept) for every distinct non-null id (a whole number): the group's smallest id is kept.

    Vectors that can't be compared are their own groups: null, empty, with a null or non-finite element, of zero length, or of another than the
    commonest dimension (of equally common ones the larger). Rows that share an id are one entry, whose vector is the least of theirs. Equal
    vectors are one group. Null ids have no row. Further columns aren't read, so their names can't clash. Empty table: no rows.
    """
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    ids = rows.select("id").distinct()
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = written(rows.where(F.col("v").isNotNull() & fine).groupBy("id").agg(F.min("v").alias("v")))
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not dims:
        return ids.select(F.col("id").alias("vec_id"), F.col("id").alias("group_id"), F.lit(True).alias("is_kept"))
    dim, n = dims[0].d, dims[0].n
    same_size = good.where(F.size("v") == dim)
    index = learn(same_size, dim, n, min_cosine, steps)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = index.keys(_unit(_matrix(b.column(1), dim)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, index.tables, dtype=np.int32)), pa.array(k.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "v", "keys"])

    once = same_size.groupBy("v").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    same = same_size.join(once.where("id <> other").select("v", F.col("id").alias("a")), "v").select("a", F.col("id").alias("b")).where("a <> b")
    entries = written(once.select("id", "v").mapInArrow(encode, "id bigint, v array<float>, keys array<bigint>"))
    roots = components(near_edges(entries, min_cosine).unionByName(same))
    drop_written(good, entries)
    return ids.join(roots, ids.id == roots.node, "left").select(F.col("id").alias("vec_id"), F.coalesce("root", "id").alias("group_id")).withColumn("is_kept", F.col("vec_id") == F.col("group_id"))
