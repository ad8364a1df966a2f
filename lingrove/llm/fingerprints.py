"""Document fingerprints: one-permutation MinHash (operator 9).

Each shingle (``width`` consecutive words, case folded) is hashed once; the top of the hash picks one of
``bins`` bins and the rest is the value, of which a bin keeps the least. Empty bins are filled by optimal
densification: bin i tries bins g(i, 1), g(i, 2), ... of a fixed 2-universal sequence until one is full
and copies it, so two documents copy from the same places. Of each bin the low ``bits`` bits are
packed. ``estimate`` corrects the matches that b bits share by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, chunks, fold, mix, text_buffers, words

BINS, BITS, WIDTH = 128, 8, 3
_SCHEMA = "struct<n_shingles: bigint, signature: binary>"


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a text with fewer words, but one at least, has one shingle."""
    folded = fold(data)
    start, end, row = words(folded, offs)
    if not len(start):
        return row, np.zeros(0, U)
    w = Rolling(folded).spans(start, end)
    h = w.copy()
    n = len(w)
    last = np.r_[row[1:] != row[:-1], True]
    first = np.flatnonzero(np.r_[True, last[:-1]])
    left = np.repeat(np.r_[first[1:], n] - first, np.diff(np.r_[first, n])) - (np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])))
    for k in range(1, width):  # words of the next rows are not taken in
        ok = left > k
        at = np.flatnonzero(ok)
        h[at] = mix(h[at] * U(0x9FB21C651E98DF25) + w[at + k])
    keep = (left >= width) | np.isin(np.arange(n), first)
    return row[keep], h[keep]


def _donors(bins: int, tries: int) -> np.ndarray:
    i = np.arange(bins, dtype=U)[:, None] * U(0x9E3779B97F4A7C15)
    return (mix(i + np.arange(1, tries + 1, dtype=U)[None, :] * U(0xC2B2AE3D27D4EB4F)) % U(bins)).astype(np.int64)


def signatures(data: np.ndarray, offs: np.ndarray, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingles per row, packed uint8 matrix) for the rows of a byte buffer."""
    n = len(offs) - 1
    row, h = shingles(data, offs, width)
    h = mix(h)
    count = np.bincount(row, minlength=n)
    slot = row * bins + ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    table = np.full(n * bins, 1 << 32, np.int64)
    np.minimum.at(table, slot, (h & U(0xFFFFFFFF)).astype(np.int64))
    table = table.reshape(n, bins)
    empty = (table == 1 << 32) & (count > 0)[:, None]
    full, (r, c), k = ~(table == 1 << 32), np.nonzero(empty), 0
    donors = _donors(bins, 64)
    while len(r):
        if k == donors.shape[1]:
            donors = _donors(bins, 2 * k)
        d = donors[c, k]
        ok = full[r, d]
        table[r[ok], c[ok]] = table[r[ok], d[ok]]
        r, c, k = r[~ok], c[~ok], k + 1
    low = (mix(table.astype(U).ravel()) & U((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16).reshape(n, bins)
    if bits == 8:
        packed = low
    else:
        packed = np.packbits(((low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=low.dtype)) & 1).reshape(n, -1).astype(np.uint8), axis=1)
    packed[count == 0] = 0
    return count, packed


def _fingerprint(bins: int, bits: int, width: int):
    size = (bins * bits + 7) // 8

    def run(col: pa.Array) -> pa.Array:
        data, offs, null = text_buffers(col)
        counts, parts = [], []
        for a, b in chunks(offs):
            c, p = signatures(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bins, bits, width)
            counts.append(c)
            parts.append(p)
        n = len(offs) - 1
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(parts).tobytes() if parts else b""
        mask = pa.array(count == 0)
        sig = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32).tobytes()), pa.py_buffer(flat)])
        sig = pa.compute.if_else(mask, pa.scalar(None, pa.binary()), sig)
        return pa.StructArray.from_arrays([pa.array(count.astype(np.int64), mask=null), sig], ["n_shingles", "signature"])

    return run


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, signature) for every row of ``docs``; one pass, no shuffle.

    ``n_shingles`` counts a repeated shingle each time. Null text: both null. Text without a letter or
    digit: 0 and a null signature. Repeated rows, null ids and ties of hashes: each row has its own
    signature. Columns beyond id and text are not read, so their names can't clash. Empty table: no rows.
    """
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits: 1, 2, 4 or 8")
    f = F.arrow_udf(_fingerprint(bins, bits, width), _SCHEMA)
    return docs.select(F.col(id_col).alias("doc_id"), f(F.col(text_col)).alias("s")).select("doc_id", "s.n_shingles", "s.signature")


def unpack(signature: bytes, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    v = np.unpackbits(np.frombuffer(signature, np.uint8))[: bins * bits].reshape(bins, bits)
    return v.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1))


def estimate(a: bytes | None, b: bytes | None, bins: int = BINS, bits: int = BITS) -> float | None:
    """Jaccard similarity from two signatures: (matches/bins - 2^-b) / (1 - 2^-b), 0 at least; null for a null one."""
    if a is None or b is None:
        return None
    same = float((unpack(a, bins, bits) == unpack(b, bins, bits)).mean())
    chance = 2.0**-bits
    return max(0.0, (same - chance) / (1 - chance))


def estimate_column(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """``estimate`` inside the JVM, for 8 or 4 bits: compares hex digits of the packed bins."""
    if bits not in (4, 8):
        raise ValueError("estimate_column: 4 or 8 bits")
    step = bits // 4
    x, y = F.hex(a), F.hex(b)
    at = F.sequence(F.lit(1), F.lit(bins * step), F.lit(step))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substring(x, i, F.lit(step)) == F.substring(y, i, F.lit(step)), 1).otherwise(0))
    return F.greatest(F.lit(0.0), (same / bins - 2.0**-bits) / (1 - 2.0**-bits))
