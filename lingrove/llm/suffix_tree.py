"""LM scoring: probabilistic suffix tree (operator 8).

Symbols are UTF-8 bytes. Counts of every context of up to ``DEPTH`` bytes and the byte after it are gathered from all
documents (the start of a text counts as context too, as byte 0). A context is retained when its next-byte distribution diverges from its
parent's (the context without its first byte): count * KL(context || parent) >= ``divergence``; a ``min_share`` above 0 asks besides
that it makes up that share of all positions. The ancestors of a retained context are retained with it. A retained context's
distribution is its counts smoothed toward its parent's: (count(c, x) + a * p_parent(x)) / (count(c) + a); the root's is smoothed toward the
uniform one over 256 bytes. A position is scored by the longest retained suffix of what precedes it.

By default the divergence test alone decides, so the tree grows with the corpus. Up to ``MAX_NODES`` rows it is sent to the executors; a larger
one stays a table: the distinct runs of the corpus get their probabilities from it, class by class of contexts, and each block of about ``BLOCK`` bytes of text is sent those of its runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, chunks, drop_written, text_buffers, written

DEPTH = 5
MIN_SHARE = 0.0
MAX_NODES = 3_000_000
BLOCK = 32 << 20
DIVERGENCE = 8.0
SMOOTH = 2.0


@dataclass(frozen=True)
class Model:
    """By depth: sorted keys of (context, byte) and their log2 probabilities; sorted contexts, the share of the next-shorter
    context's distribution that an unseen byte gets, as log2."""

    pairs: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    backoff: tuple[np.ndarray, ...]


def _keys(data: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """For each byte the depth+1 bytes that end with it, packed; bytes before the text are 0."""
    key = data.astype(np.int64)
    pos = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, min(depth, len(data) - 1) + 1):
        key[k:] |= np.where(pos[k:] >= k, data[: len(data) - k], 0).astype(np.int64) << (8 * k)
    return key


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            codes, keys = pd.factorize(np.concatenate([k for k, _ in held]))
            return keys, np.bincount(codes, np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            data, offs, _ = text_buffers(batch.column(0))
            for a, b in chunks(offs):
                codes, keys = pd.factorize(_keys(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], depth))
                held.append((keys, np.bincount(codes, minlength=len(keys))))
                rows += len(keys)
                if rows > 2_000_000:
                    held = [merge()]
                    rows = len(held[0][0])
                    if rows > 1_000_000:  # hand on what has piled up; the aggregation adds it up
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["key", "n"])
                        held, rows = [], 0
        if held:
            keys, n = merge()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return run


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(c, x, n, cn): occurrences of every byte x after every context c of ``depth`` bytes in the whole corpus, and of c; partitioned by context."""
    found = docs.select("text").where("text is not null").mapInArrow(_count(depth), "key bigint, n bigint")
    # each task has added up its own counts already, so they are shuffled as they are
    return found.select(F.shiftright("key", 8).alias("c"), F.col("key").bitwiseAND(F.lit(255)).alias("x"), "n").repartition("c").groupBy("c", "x").agg(F.sum("n").alias("n")).withColumn("cn", _total_of())


def _total_of() -> Column:
    return F.sum("n").over(Window.partitionBy("c"))


def tree(grams: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, divergence: float = DIVERGENCE) -> DataFrame:
    """(depth, c, x, n) of the retained contexts, from the written counts of the longest ones."""
    level = grams
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels, made = [], []
    # a shorter context's counts are sums over the longer ones; partitioned by context, its counts and their sum take one shuffle
    for k in range(depth, -1, -1):
        if k < depth:
            shorter = level.select(F.col("c").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("c"), "x", "n")
            shorter = shorter.groupBy("c", "x").agg(F.sum("n").alias("n")) if k == 0 else shorter.repartition("c").groupBy("c", "x").agg(F.sum("n").alias("n"))
            level = written(shorter.withColumn("cn", _total_of()))
            made.append(level)
        levels.append(level.where(F.col("cn") >= (max(1.0, min_share * total) if k else 0)).select(F.lit(k).alias("depth"), "c", "x", "n", "cn"))
    every = levels[0]
    for at in levels[1:]:
        every = every.unionByName(at)
    every = written(every)
    drop_written(*made)
    # divergence of each context from its parent
    parent = every.select((F.col("depth") + 1).alias("pd"), F.col("c").alias("pc"), F.col("x").alias("px"), F.col("n").alias("pn"), F.col("cn").alias("pcn"))
    # the context's earliest byte is the highest of the packed ones
    up = F.expr("c & (shiftleft(cast(1 as bigint), 8 * (depth - 1)) - 1)")
    child = every.where("depth > 0").withColumn("up", up)
    kl = child.join(parent, (child.depth == parent.pd) & (child.up == parent.pc) & (child.x == parent.px)).groupBy("depth", "c", "up").agg(F.sum(F.expr("n * ln((n / cn) / (pn / pcn))")).alias("gain"))
    chosen = written(kl.where(F.col("gain") >= divergence).select("depth", "c"))  # read once for each depth
    keep = chosen
    for _ in range(depth - 1):
        chosen = chosen.where("depth > 1").select((F.col("depth") - 1).alias("depth"), F.expr("c & (shiftleft(cast(1 as bigint), 8 * (depth - 1)) - 1)").alias("c"))
        keep = keep.unionByName(chosen)
    keep = keep.distinct()
    return every.where("depth = 0").select("depth", "c", "x", "n").unionByName(every.join(keep, ["depth", "c"]).select("depth", "c", "x", "n"))


def model_of(nodes: pd.DataFrame, depth: int = DEPTH, smooth: float = SMOOTH) -> Model:
    """The smoothed distributions of the retained contexts."""
    pairs, logs, contexts, backoff = [], [], [], []
    for k in range(depth + 1):
        t = nodes[nodes["depth"] == k].sort_values(["c", "x"])
        c, x, n = (t[v].to_numpy(np.int64) for v in ("c", "x", "n"))
        ctx, at = np.unique(c, return_inverse=True)
        total = np.bincount(at, n, minlength=len(ctx)) if len(ctx) else np.zeros(0)
        if k == 0 and not len(ctx):
            ctx, total = np.zeros(1, np.int64), np.zeros(1)
        key = (c << 8) | x
        if k == 0:
            below = np.full(len(key), 1 / 256)
        else:
            below = np.exp2(_score(Model(tuple(pairs), tuple(logs), tuple(contexts), tuple(backoff)), key & ((1 << 8 * k) - 1), k - 1))
        logs.append(np.log2((n + smooth * below) / (total[at] + smooth)) if len(key) else np.zeros(0))
        pairs.append(key)
        contexts.append(ctx)
        backoff.append(np.log2(smooth / (total + smooth)))
    return Model(tuple(pairs), tuple(logs), tuple(contexts), tuple(backoff))


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def _score(model: Model, key: np.ndarray, depth: int) -> np.ndarray:
    """log2 probability of the last byte of each packed run by the longest retained suffix of the bytes before it."""
    out = np.zeros(len(key))
    todo = np.arange(len(key))
    for k in range(depth, -1, -1):
        if not len(todo):
            break
        run = key[todo] & ((1 << 8 * (k + 1)) - 1)
        c, known = _find(model.contexts[k], run >> 8)
        todo_k, run, c = todo[known], run[known], c[known]
        p, seen = _find(model.pairs[k], run)
        out[todo_k[seen]] += model.logs[k][p[seen]] if len(model.logs[k]) else 0
        lost = todo_k[~seen]  # an unseen byte: the context's share for its parent's distribution, and on with the parent
        out[lost] += model.backoff[k][c[~seen]]
        if k == 0:
            out[lost] += -8.0
        todo = np.concatenate([todo[~known], lost])
    return out


def _scorer(log_of: Callable[[np.ndarray], np.ndarray], depth: int):
    """``log_of``: log2 probability of each of some distinct packed runs."""

    def run(col: pa.Array) -> pa.Array:
        data, offs, null = text_buffers(col)
        n = len(offs) - 1
        total = np.zeros(n)
        for a, b in chunks(offs):
            o = offs[a : b + 1] - offs[a]
            codes, keys = pd.factorize(_keys(data[offs[a] : offs[b]], o, depth))
            sums = np.zeros(len(codes) + 1)
            np.cumsum(log_of(keys)[codes], out=sums[1:])
            total[a:b] = sums[o[1:]] - sums[o[:-1]]
        size = np.diff(offs)
        none = null | (size == 0)
        return pa.StructArray.from_arrays([pa.array(size, mask=null), pa.array(total, mask=null), pa.array(-total / np.maximum(1, size), mask=none)], ["n_bytes", "log2_prob", "bits_per_byte"])

    return run


def _pack(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each, all lowest bytes first: sorted keys compress to half of what whole ones do."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.int64).ravel()


def _logs(short: pd.DataFrame, depth: int, smooth: float, lists: int):
    """For the runs whose contexts end alike: their log2 probabilities, and the lists that they are in."""

    def run(counted: pa.Table, long: pa.Table) -> pa.Table:
        model = model_of(pd.concat([short, long.select(short.columns.tolist()).to_pandas()]), depth, smooth)
        key = np.asarray(counted["run"])
        return pa.table({"list": key % lists, "run": key, "log": _score(model, key, depth)})

    return run


def _wanted(depth: int, lists: int, most: int = 2_000_000):
    """For rows (doc_id, text, block): the distinct runs of each block, by the list that they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        rows = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for block, found in held.items():
                keys = np.sort(found[0])
                at = keys % lists
                keys = keys[np.argsort(at, kind="stable")]
                have, n = np.unique(at, return_counts=True)
                cut = np.r_[0, np.cumsum(n)]
                raw = [_pack(keys[a:b], depth + 1) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(np.full(len(have), block)), pa.array(raw, pa.binary())], names=["list", "block", "keys"])

        for batch in batches:
            block = np.asarray(batch.column(2))
            for of in np.unique(block).tolist():
                data, offs, _ = text_buffers(batch.column(1).filter(pa.array(block == of)))
                for a, b in chunks(offs):
                    keys = pd.unique(_keys(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], depth))
                    if not len(keys):
                        continue
                    held.setdefault(of, []).append(keys)
                    rows += len(keys)
                    if rows > most:
                        held = {k: [pd.unique(np.concatenate(v))] for k, v in held.items()}
                        rows = sum(len(v[0]) for v in held.values())
                        if rows > most // 2:  # a block may ask for a run again
                            yield from packed()
                            held, rows = {}, 0
        held = {k: [pd.unique(np.concatenate(v))] for k, v in held.items()}
        yield from packed()

    return run


def _answer(width: int):
    """For a list: what blocks want of it with the log2 probabilities."""

    def run(wanted: pa.Table, runs: pa.Table) -> pa.Table:
        key, log = np.asarray(runs["run"]), np.asarray(runs["log"])
        order = np.argsort(key)
        find = _lookup(key[order], log[order])
        logs = [find(_unpack(raw.as_py(), width)).tobytes() for raw in wanted["keys"]]
        return pa.table({"block": wanted["block"], "keys": wanted["keys"], "logs": pa.array(logs, pa.binary())})

    return run


def _lookup(key: np.ndarray, log: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def find(keys: np.ndarray) -> np.ndarray:
        at, known = _find(key, keys)
        if not known.all():
            raise ValueError("a run of a text isn't among those counted: the table of texts changed while it was read")
        return log[at]

    return find


def _score_block(depth: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        key = np.concatenate([np.zeros(0, np.int64), *(_unpack(raw.as_py(), depth + 1) for raw in answers["keys"])])
        log = np.concatenate([np.zeros(0), *(np.frombuffer(raw.as_py()) for raw in answers["logs"])])
        order = np.argsort(key)
        score = _scorer(_lookup(key[order], log[order]), depth)
        names = ["doc_id", "n_bytes", "log2_prob", "bits_per_byte"]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(0), *score(b.column(1)).flatten()], names=names) for b in rows.to_batches()])

    return run


def _by_join(docs: DataFrame, grams: DataFrame, nodes: DataFrame, depth: int, smooth: float, block_bytes: int) -> DataFrame:
    """``scores`` with the tree as a table. Every run of a text is among ``grams``, so no byte is unseen after a retained context.

    Texts are put into blocks of about ``block_bytes``; a block asks once for each of its runs, so what is shuffled follows the bytes of text,
    not the runs of each text. Runs and their probabilities are spread over lists, and lists answer blocks.
    """
    spark = docs.sparkSession
    blocks = nodes.where("depth = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // block_bytes + 1
    lists = max(blocks, 63) | 1  # odd, so that all bytes decide
    # contexts that end alike are together; the few short ones go to all
    end = F.col("c").bitwiseAND(F.lit(0xFFFF)) % lists
    short = nodes.where("depth < 2").toArrow().to_pandas()
    long = nodes.where("depth > 1").select(end.alias("end"), "depth", "c", "x", "n")
    counted = grams.select(end.alias("end"), F.shiftleft("c", 8).bitwiseOR(F.col("x")).alias("run"))
    runs = counted.groupBy("end").cogroup(long.groupBy("end")).applyInArrow(_logs(short, depth, smooth, lists), "list bigint, run bigint, log double")
    # the same exchange of texts serves twice: the runs are taken from all of its columns, and it has as many partitions as others at least,
    # or the cogroup would shuffle the texts anew
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(parts, "block")
    wanted = rows.mapInArrow(_wanted(depth, lists), "list bigint, block bigint, keys binary")
    answers = wanted.groupBy("list").cogroup(runs.groupBy("list")).applyInArrow(_answer(depth + 1), "block bigint, keys binary, logs binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(depth), f"doc_id {kind}, n_bytes bigint, log2_prob double, bits_per_byte double")


def scores(docs: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, divergence: float = DIVERGENCE, smooth: float = SMOOTH, max_nodes: int = MAX_NODES, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, log2_prob, bits_per_byte) for every row of ``docs`` under the tree of all rows.

    Null text: all null. Empty text: 0 bytes, 0, null. Repeated rows count, and are scored, each time; null ids too. Further columns aren't
    read. Empty table: no rows.
    """
    grams = written(counts(docs, depth))
    nodes = written(tree(grams, depth, min_share, divergence))
    if nodes.count() > max_nodes:
        return _by_join(docs, grams, nodes, depth, smooth, block_bytes)
    model = model_of(nodes.toArrow().to_pandas(), depth, smooth)
    f = F.arrow_udf(_scorer(lambda keys: _score(model, keys, depth), depth), "n_bytes bigint, log2_prob double, bits_per_byte double")
    return docs.select("doc_id", f(F.col("text")).alias("s")).select("doc_id", "s.*")
