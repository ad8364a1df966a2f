"""SimHash near-dedup by the May-Ozerov recursion (operator 7).

Fingerprint: 256 bits, the signs of the summed bit votes of a text's distinct words and word pairs
(case folded). Two documents are near copies when their fingerprints differ in at most ``max_bits``.

Search: a *filter* is a strip of random coordinates with a random centre; it lets through the
fingerprints whose weight (after the centre is XORed in) on the strip is at most ``STRIP_WEIGHT``.
One round draws a strip and a random set of centres such that a fingerprint passes one filter on average;
each filter's list is then split again in the same way, on strips of its own, until a list is small, and small
lists are compared by brute force. Rounds are repeated so often, on every level, that a pair at the largest distance is found in its list with
probability ``recall`` or more (closer pairs more often). The first level is the shuffle: a list is a
key. Further levels run inside the task that holds the list. A list that splitting would make dearer to search (its filters let most of it through, as in a crowd of
near copies) is compared as it is; within a crowd that is a few comparisons for each member.

Equal fingerprints are one entry from the start, so thousands of exact copies cost one. A list reports its
components as edges to their smallest members, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, by_list, chunks, components, drop_written, fold, fresh, links, local_stars, mix, text_buffers, words, written

BITS = 256
MAX_BITS = 56
RECALL = 0.9
STRIP, STRIP_WEIGHT = 16, 1  # the first level: a filter passes 17 of 65,536
NEXT, NEXT_WEIGHT = 8, 1  # below it: 9 of 256
SMALL = 2048
ROW_BITS = 22  # a chunk has fewer rows than 2^22, as it has about CHUNK bytes

# ---- fingerprints ----------------------------------------------------------

_LANES = (np.arange(256, dtype=U)[:, None] >> np.arange(7, -1, -1, dtype=U)[None, :] & U(1)) << (np.arange(8, dtype=U) * U(8))
_LANES = _LANES.sum(axis=1, dtype=U)  # a byte's bits as eight counters of eight bits, first bit lowest


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words and pairs of neighbouring words of each row, by row."""
    folded = fold(data)
    start, end, row = words(folded, offs)
    w = Rolling(folded).spans(start, end)
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = np.concatenate([w, mix(w[pair] * U(0x9FB21C651E98DF25) + w[pair + 1])])
    rows = np.concatenate([row, row[pair]])
    # the same bits of a hash whatever the number of rows, so that equal texts get equal features in any batch
    key = np.sort((rows.astype(U) << U(64 - ROW_BITS)) | (both >> U(ROW_BITS)))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> U(64 - ROW_BITS)).astype(np.int64), mix(key << U(ROW_BITS))


def simhash(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features per row, n x 32 bytes). A bit is set when more than half of the features have it."""
    n = len(offs) - 1
    out, total = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, np.int64)
    row, h = features(data, offs)
    if not len(row):
        return total, out
    total = np.bincount(row, minlength=n)
    first = np.searchsorted(row, np.flatnonzero(total))
    size = total[total > 0]
    # sums of at most 255 features fit into the byte counters: cut rows into such pieces
    pieces = -(-size // 255)
    at = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * 255
    of = np.repeat(np.flatnonzero(total), pieces)
    votes = np.zeros((n, BITS), np.int32)
    for word in range(BITS // 64):
        v = mix(h + U(0x632BE59BD9B4E019 * (word + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            sums = np.add.reduceat(_LANES[v[:, byte]], at).view(np.uint8).reshape(-1, 8)
            np.add.at(votes[:, word * 64 + byte * 8 : word * 64 + byte * 8 + 8], of, sums)
    out[:] = np.packbits(votes * 2 > total[:, None], axis=1)
    return total, out


def _simhash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offs, _ = text_buffers(batch.column(1))
        for a, b in chunks(offs):
            n, fp = simhash(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            keep = np.flatnonzero(n > 0)
            q = np.ascontiguousarray(fp[keep]).view(">u8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(keep)), *(pa.array(q[:, k]) for k in range(4))], names=["id", "f0", "f1", "f2", "f3"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0..f3): one row for every row that has a non-null id and at least one word."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").mapInArrow(_simhash_batches, "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


# ---- filters ---------------------------------------------------------------


def hit(strip: int, weight: int, max_bits: int) -> float:
    """P(a round puts a pair at ``max_bits`` into one list).

    All coordinates of a round come from one strip, so it is the mean over the pair's distance there: a centre within
    reach of both is drawn with probability 1 / ball, and how many there are depends on that distance.
    """
    ball = sum(math.comb(strip, w) for w in range(weight + 1))
    total = 0.0
    for k in range(min(strip, max_bits) + 1):
        at_k = math.comb(max_bits, k) * math.comb(BITS - max_bits, strip - k) / math.comb(BITS, strip)
        shared = sum(math.comb(k, i) * math.comb(strip - k, j) for i in range(k + 1) for j in range(strip - k + 1) if max(i, k - i) + j <= weight)
        total += at_k * (1 - (1 - 1 / ball) ** shared)
    return total


def rounds(strip: int, weight: int, max_bits: int, recall: float, below: float) -> int:
    """Rounds until a pair at ``max_bits`` is found with probability ``recall``, when its list is searched with probability ``below`` of finding it.

    Each round that puts the pair into one list is a try of its own, so a pair is missed with (1 - hit * below) ^ rounds. With
    ``below`` = ``recall`` the bound holds for lists of any depth.
    """
    return math.ceil(math.log(1 - recall) / math.log1p(-hit(strip, weight, max_bits) * below))


def _strip_values(fp: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """Integer value of the chosen bits (0: the first one) of n x 4 uint64."""
    v = np.zeros(len(fp), np.int32)
    for i, c in enumerate(coords.tolist()):
        v |= ((fp[:, c // 64] >> U(63 - c % 64)) & U(1)).astype(np.int32) << np.int32(i)
    return v


def _passes(values: np.ndarray, strip: int, weight: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, centre) for every centre of one round that lets an entry through."""
    ball = [0] + [1 << i for i in range(strip)]
    if weight != 1:
        ball = [x for x in range(1 << strip) if x.bit_count() <= weight]
    centre = rng.random(1 << strip) < 1.0 / len(ball)
    for x in ball:
        c = values ^ x
        hit = np.flatnonzero(centre[c])
        yield hit, c[hit]


def _lists(fp: np.ndarray, strip: int, weight: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(entries, centre) of one round's lists."""
    found = list(_passes(_strip_values(fp, rng.choice(BITS, strip, replace=False)), strip, weight, rng))
    return np.concatenate([x for x, _ in found]), np.concatenate([c for _, c in found])


def _near(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (by index) that connect the near ones among n x 4 uint64."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = fp[x], fp[y]
        d = np.bitwise_count(p[:, None, 0] ^ q[None, :, 0]).astype(np.uint16)
        for k in range(1, 4):
            d += np.bitwise_count(p[:, None, k] ^ q[None, :, k])
        return d <= max_bits

    return links(len(fp), near)


def search_list(fp: np.ndarray, max_bits: int, recall: float, rng: np.random.Generator, small: int = SMALL, depth: list[int] | None = None, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges among one list: brute force when small, or when splitting would cost as much; else split by filters on new strips and recurse.

    ``depth`` (for tests) gets the level and the size of every list that is compared.
    """
    n_rounds = rounds(NEXT, NEXT_WEIGHT, max_bits, recall, recall)
    left, right = [], []
    for r in range(n_rounds if len(fp) > small else 0):
        hit, centre = _lists(fp, NEXT, NEXT_WEIGHT, rng)
        order = np.argsort(centre, kind="stable")
        hit, centre = hit[order], centre[order]
        parts = np.split(hit, np.flatnonzero(np.diff(centre)) + 1) if len(hit) else []
        if r == 0 and n_rounds * sum(len(m) ** 2 for m in parts) >= len(fp) ** 2:
            break
        for members in parts:
            x, y = search_list(fp[members], max_bits, recall, rng, small, depth, level + 1)
            left.append(members[x])
            right.append(members[y])
    else:
        if len(fp) > small:
            a, b = (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))
            return _stars(len(fp), a, b)
    if depth is not None:
        depth.append((level, len(fp)))
    return _near(fp, max_bits)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = local_stars(n, a, b)
    x = np.flatnonzero(label != np.arange(n))
    return x, label[x]


# ---- the distributed search ------------------------------------------------


def _emit(n_rounds: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(5)]
            for s in range(0, len(cols[0]), 20_000):
                part = [c[s : s + 20_000] for c in cols]
                fp = np.stack(part[1:], axis=1).view(U)
                for r in range(n_rounds):
                    rng = np.random.default_rng([seed, r])
                    hit, centre = _lists(fp, STRIP, STRIP_WEIGHT, rng)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array((r << STRIP) + centre.astype(np.int64)), pa.array(part[0][hit]), *(pa.array(part[k][hit]) for k in range(1, 5))], names=["list", "id", "f0", "f1", "f2", "f3"])

    return run


def _search(max_bits: int, recall: float, seed: int):
    def edges(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id").combine_chunks())
        fp = np.stack([np.asarray(table.column(f"f{k}").combine_chunks()) for k in range(4)], axis=1).view(U)
        order = np.argsort(ids, kind="stable")
        ids, fp = ids[order], fp[order]
        a, b = _stars(len(ids), *search_list(fp, max_bits, recall, np.random.default_rng([seed, int(table.column("list")[0].as_py())])))
        return pa.table({"a": ids[a], "b": ids[b]})

    def pairs(batch: pa.RecordBatch):
        fp = np.stack([np.asarray(batch.column(k)) for k in range(2, 6)], axis=1).view(U)
        return lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= max_bits

    return by_list(edges, pairs)


def near_edges(fps: DataFrame, max_bits: int = MAX_BITS, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(a, b): edges that connect near fingerprints; fps: (id, f0..f3), each fingerprint once."""
    # the recursion misses some pairs too, so a shared list counts as found with probability ``recall``
    n = rounds(STRIP, STRIP_WEIGHT, max_bits, recall, recall)
    lists = fps.mapInArrow(_emit(n, seed), "list bigint, id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(_search(max_bits, recall, seed), "a bigint, b bigint")


def groups(docs: DataFrame, max_bits: int = MAX_BITS, recall: float = RECALL, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, is_kept) for every distinct non-null id (a whole number).

    ``group_id`` is the smallest id of the near copies that are connected; that one is kept. A document
    without a word (null, empty, only punctuation) has no fingerprint and is its own group. Rows that share
    an id are one document: its group holds the near copies of each. Null ids have no row. Long texts are read whole. Equal fingerprints
    (ties) are near. Further columns aren't read, so their names can't clash. Empty table: no rows.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    roots = copies(docs, max_bits, recall, seed, id_col, text_col)
    return ids.join(roots, ids.doc_id == roots.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id")).withColumn("is_kept", F.col("doc_id") == F.col("group_id"))


def copies(docs: DataFrame, max_bits: int = MAX_BITS, recall: float = RECALL, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of the ids that have a near copy; root: the smallest of the group, itself included."""
    fps = written(fingerprints(docs, id_col, text_col))
    key = ["f0", "f1", "f2", "f3"]
    once = fps.groupBy(*key).agg(F.min("id").alias("id"), F.max("id").alias("other"))
    near = near_edges(once.select("id", *key), max_bits, recall, seed)
    many = once.where("id <> other").select(*key, F.col("id").alias("a"))
    same = fps.join(many, key).select("a", F.col("id").alias("b")).where("a <> b")
    out = components(near.unionByName(same))
    drop_written(fps)
    return out


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, recall: float = RECALL, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies of a document with a smaller id; all columns stay, whatever their names.

    Rows with a null id and rows without a word (null, empty, only punctuation) stay. Of rows that repeat an id all stay or all go. Equal
    fingerprints are near, however long the texts. Empty table: no rows.
    """
    (name,) = fresh(docs, "gone")
    gone = copies(docs, max_bits, recall, seed, id_col, text_col).where("node <> root").select(F.col("node").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone[name], "left_anti")
