"""What the operators of this subpackage share: shared-folder writes, Arrow buffers, hashing, components.

Text is handled as the UTF-8 bytes of Arrow's own buffers; no Python string is made per row.
Batches are cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), so a
worker's memory follows the longest text, not the size of its partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POW = np.ones(1, U)
_INV = np.ones(1, U)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or the one the session was given with setCheckpointDir. Without either it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors.

    The table goes with ``drop_written``, or else when the session that made it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lingrove-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._lingrove_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no later step reads."""
    for t in tables:
        path = getattr(t, "_lingrove_path", None)
        if path:
            folder = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has a column called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_lr_{n}"
        while n in taken:
            n += "_"
        out.append(n)
        taken.add(n)
    return out


# ---- Arrow buffers ---------------------------------------------------------


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1, is_null); a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    offs = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], null


def strings(kind: pa.DataType, data: np.ndarray, offs: np.ndarray, null: np.ndarray) -> pa.Array:
    """Strings from their bytes end to end; of the type of the column that they come from, so large ones stay large."""
    out = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out).cast(kind)


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes, one row at least."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def give_back() -> None:
    """Return what numpy and Arrow have freed to the system: Spark keeps workers between tasks, more of them than run at once."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``run`` for arrow_udf as one call for all batches of a task, which gives memory back after each batch and at the end."""

    def each(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            made = run(col)
            del col
            yield made
            del made
            give_back()
        give_back()

    return each


# ---- hashing ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, CHUNK + 4096)
        pw, iv = np.full(m, U(_BASE)), np.full(m, U(pow(_BASE, -1, 1 << 64)))
        pw[0] = iv[0] = 1
        _POW, _INV = np.multiply.accumulate(pw), np.multiply.accumulate(iv)
    return _POW, _INV


_LUT = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Rolling:
    """Polynomial prefix hashes of a byte buffer: the hash of any span in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        pw, self.inv = _powers(n + 1)
        self.p = np.zeros(n + 1, U)
        np.cumsum(_LUT[data] * pw[:n], out=self.p[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.p[end] - self.p[start]) * self.inv[start])

    def grams(self, n: int) -> np.ndarray:
        """Unmixed hashes of all spans of n bytes, by start."""
        m = len(self.p) - 1
        return (self.p[n:] - self.p[: m + 1 - n]) * self.inv[: m + 1 - n] if m >= n else np.zeros(0, U)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 13, 32]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8."""
    out = _FOLD[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of letters, digits and bytes beyond ASCII; none crosses a row."""
    is_word = np.zeros(len(data) + 2, np.int8)
    is_word[1:-1] = _IS_WORD[data]
    edge = np.diff(is_word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        inner = offs[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = inner[(is_word[inner] == 1) & (is_word[inner + 1] == 1)]  # a word on both sides of a row's edge
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row


def word_counts(data: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens between blanks, tabs and line ends in each span; spans don't begin within a token, but for the rows' first bytes."""
    full = ~_IS_SPACE[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    edge = offs[:-1][np.diff(offs) > 0]
    begins[edge] = full[edge]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=total[1:])
    return total[end] - total[start]


# ---- connected components --------------------------------------------------


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, for nodes 0..n-1 and edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        lo = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, lo)
        np.minimum.at(new, lb, lo)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def links(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], hub: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, among 0..n-1, exactly what is connected by ``near``; near(x, y): boolean matrix for two arrays of indices.

    Blocks are compared with all that is left. What a block links to in large numbers is one component already, so its members are
    compared with the rest alone, never with each other: a crowd of near copies costs a few comparisons each.
    """
    left, a, b = np.arange(n), [], []

    def step() -> int:
        return max(1, min(256, (1 << 18) // max(1, len(left))))

    while len(left):
        k = step()
        block, left = left[:k], left[k:]
        x, y = np.nonzero(np.triu(near(block, block), 1))
        u, v = np.nonzero(near(block, left)) if len(left) else (x[:0], y[:0])
        if len(u) <= hub:
            a += [block[x], block[u]]
            b += [block[y], left[v]]
            continue
        both = np.r_[block, left]
        label = local_stars(len(both), np.r_[x, u], np.r_[y, k + v])
        moved = np.flatnonzero(label != np.arange(len(both)))
        a.append(both[label[moved]])
        b.append(both[moved])
        label = label[k:]
        hit = np.flatnonzero(label < k)
        root, many = np.unique(label[hit], return_counts=True)
        mine = label == root[many.argmax()]
        front, left = left[mine], left[~mine]
        while len(front) and len(left):
            k = step()
            block, front = front[:k], front[k:]
            m = near(block, left)
            got = m.any(axis=0)
            if got.any():
                a.append(block[m.argmax(axis=0)[got]])
                b.append(left[got])
                front, left = np.r_[front, left[got]], left[~got]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def by_list(edges: Callable[[pa.Table], pa.Table], pairs: Callable[[pa.RecordBatch], Callable[[np.ndarray, np.ndarray], np.ndarray]], small: int = 64):
    """For mapInArrow on rows (list, id, ...) sorted by list; gives edges (a, b).

    ``edges``: of one list, which may go on in the next batch. Lists of up to ``small`` rows within a batch are compared together, without a
    call for each: ``pairs(batch)`` says of two arrays of rows which pairs are near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, out = np.asarray(batch.column(0)), np.asarray(batch.column(1)), []
            cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            if held and held[0].column(0)[0].as_py() != key[0]:
                out.append(edges(pa.Table.from_batches(held)))
                held = []
            size = np.diff(cut)
            if len(size) > 1 and held:
                out.append(edges(pa.Table.from_batches([*held, batch.slice(0, size[0])])))
                held = []
                cut, size = cut[1:], size[1:]
            # but for the last list, which may go on
            for k in np.flatnonzero(size[:-1] > small):
                out.append(edges(pa.Table.from_batches([batch.slice(cut[k], size[k])])))
            left = np.repeat(np.where(size[:-1] <= small, cut[1:-1], 0), size[:-1]) - 1 - np.arange(cut[0], cut[-2])  # rows after it in its list
            i, near, d = np.arange(cut[0], cut[-2]), None, 1
            while True:
                ok = left >= d
                i, left = i[ok], left[ok]
                if not len(i):
                    break
                near = near or pairs(batch)
                hit = i[near(i, i + d)]
                if len(hit):
                    out.append(pa.table({"a": np.minimum(ids[hit], ids[hit + d]), "b": np.maximum(ids[hit], ids[hit + d])}))
                d += 1
            held.append(batch.slice(cut[-2], size[-1]))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held:
            yield from edges(pa.Table.from_batches(held)).to_batches()

    return run


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``edges`` (integers).

    Alternating large-star and small-star rounds; each is two aggregations that combine on the map side,
    and no node's neighbour list is ever gathered. Every round is written to the shared folder; it ends
    when a round changes nothing. Nodes without an edge to another node don't appear.
    """
    e = written(edges.select(F.greatest(u, v).cast("bigint").alias("u"), F.least(u, v).cast("bigint").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        # large star: each neighbour larger than the node goes to the smallest of node and neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = e.join(low, e.v == low.k).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: node and smaller neighbours go to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        j = large.join(least, large.u == least.k)
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct())
        state = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        drop_written(e)
        e = new
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _count_tokens(col: pa.Array) -> pa.Array:
    data, offs, _ = text_buffers(col)
    n = np.zeros(len(offs) - 1, np.int64)
    for a, b in chunks(offs):
        o = offs[a : b + 1] - offs[a]
        n[a:b] = word_counts(data[offs[a] : offs[b]], o, o[:-1], o[1:])
    return pa.array(n)


def tokens(text: Column) -> Column:
    """Number of tokens between blanks, tabs and line ends; 0 for null."""
    return F.arrow_udf(_count_tokens, "bigint")(text)
