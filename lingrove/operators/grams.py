"""Byte n-grams: generation and counting.

A key of up to 8 bytes is one BIGINT (its bytes, first one highest), so joins and aggregates compare machine words. Counting is done twice
over: each task adds up its own batches in numpy (a map-side combine before anything is exploded into rows) and an aggregation adds up the
tasks. ``exploded`` is the same as rows inside the JVM, for lengths beyond 8 bytes and for positions.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trie import MAX_CELLS, Trie, within_rows

CHUNK = 1 << 20


def give_back() -> None:
    """Gives freed memory back to the system, where it can: a worker waits for its next task with what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def hex_key(key: Column, size: Column) -> Column:
    """Upper-case hexadecimal form of a packed key."""
    return F.lpad(F.hex(key), (size * 2).cast("int"), "0") if not isinstance(size, int) else F.lpad(F.hex(key), 2 * size, "0")


def packed(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, -10).cast("bigint")


def prefix(key: Column, size: Column, keep: int) -> Column:
    """First ``keep`` bytes of a packed key of ``size`` bytes."""
    return F.call_function("shiftrightunsigned", key, (size - keep) * 8)


def suffix(key: Column, size: Column, drop: int = 1) -> Column:
    """A packed key without its first ``drop`` bytes."""
    return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (size - drop) * 8) - 1)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null has no bytes."""
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    if col.null_count:
        col = pa.compute.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, size: int = CHUNK, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes and at most ``rows`` rows, one row at least."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1))
        yield a, b
        a = b


def by_group(col: pa.Array) -> Iterator[tuple[object, pa.Array]]:
    """(value, mask) of each distinct value of a column."""
    d = col.dictionary_encode()
    code = np.asarray(pa.compute.fill_null(d.indices, -1))
    for k in np.unique(code):
        yield (d.dictionary[int(k)].as_py() if k >= 0 else None), pa.array(code == k)


def keys(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed key, start) of all n-grams of n bytes that lie within one row."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(m, np.uint64)
    for k in range(n):
        key = (key << np.uint64(8)) | data[k : k + m]
    ok = np.ones(m, bool)
    for k in range(1, n):
        inner = offs[1:-1] - k
        ok[inner[(inner >= 0) & (inner < m)]] = False
    start = np.flatnonzero(ok)
    return key[start].view(np.int64), start


def _starts(offs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Position of each start in its own row."""
    return start - offs[np.searchsorted(offs, start, "right") - 1]


def _counter(low: int, high: int, alignment: int, allowed: Mapping[object, np.ndarray] | None, prefix_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[object, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            codes, found = pd.factorize(np.concatenate([k for k, _ in parts]))
            return found, np.bincount(codes, np.concatenate([c for _, c in parts]), minlength=len(found)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for (group, n), parts in held.items():
                key, count = merged(parts)
                yield from _rows(group, n, key, count)

        for batch in batches:
            for group, rows_of in by_group(batch.column(0)):
                data, offs = buffers(batch.column(1).filter(rows_of))
                for a, b in pieces(offs):
                    part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    for n in range(low, high + 1):
                        key, start = keys(part, o, n)
                        if alignment > 1:
                            key = key[_starts(o, start) % alignment == 0]
                        if allowed is not None:
                            table = allowed.get(group)
                            if table is None or not len(table):
                                continue
                            head = (key.view(np.uint64) >> np.uint64(8 * (n - prefix_size))).view(np.int64)
                            key = key[table[np.minimum(np.searchsorted(table, head), len(table) - 1)] == head]
                        if not len(key):
                            continue
                        codes, found = pd.factorize(key)
                        held.setdefault((group, n), []).append((found, np.bincount(codes, minlength=len(found)).astype(np.int64)))
                        rows += len(found)
                    if rows > 2_000_000:
                        held = {k: [merged(v)] for k, v in held.items()}
                        rows = sum(len(v[0][0]) for v in held.values())
                        if rows > 1_000_000:
                            yield from flush()
                            held, rows = {}, 0
            give_back()
        yield from flush()
        held = {}
        give_back()

    return run


def counts(texts: DataFrame, low: int, high: int, alignment: int = 1, allowed: Mapping[object, np.ndarray] | None = None, prefix_size: int = 0) -> DataFrame:
    """(grp, len, key, cnt) of all n-grams of low..high bytes; texts: (grp STRING, bytes BINARY or STRING).

    ``alignment``: only starts that are multiples of it within their row. ``allowed``: by group the sorted keys of ``prefix_size`` bytes, one of which an n-gram
    must begin with. Null texts have none.
    """
    if not 1 <= low <= high <= 8:
        raise ValueError("counts: lengths of 1 to 8 bytes")
    return texts.mapInArrow(_counter(low, high, alignment, allowed, prefix_size), "grp string, len int, key bigint, cnt bigint").groupBy("grp", "len", "key").agg(F.sum("cnt").alias("cnt"))


class _Held:
    """Counts of (node, next byte): in one array, a column for each byte that has come up, while that is small; else as pairs."""

    def __init__(self, nodes: int):
        self.nodes, self.parts, self.room = nodes, [], 0
        self.column, self.bytes = np.full(256, -1, np.int64), np.zeros(0, np.int64)
        self.total = np.zeros((nodes, 0), np.int64)
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, node: np.ndarray, byte: np.ndarray) -> None:
        self.parts.append((node.astype(np.int32), byte))
        self.room += len(node)
        if self.room > 1_000_000:
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        node, byte = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.room = [], 0
        some = np.flatnonzero(np.bincount(byte, minlength=256))
        new = some[self.column[some] < 0]
        if self.total is not None and len(new):
            self.column[new] = np.arange(len(self.bytes), len(self.bytes) + len(new))
            self.bytes = np.concatenate([self.bytes, new])
            if self.nodes * len(self.bytes) > MAX_CELLS // 2:
                self.pairs, self.total = self.found(), None
            else:
                self.total = np.pad(self.total, ((0, 0), (0, len(new))))
        if self.total is not None:
            self.total += np.bincount(node.astype(np.int64) * len(self.bytes) + self.column[byte], minlength=self.total.size).reshape(self.total.shape)
        else:
            known = len(self.pairs[0])
            codes, found = pd.factorize(np.concatenate([self.pairs[0], (node.astype(np.int64) << 8) | byte]))
            many = np.bincount(codes[known:], minlength=len(found))
            many[:known] += self.pairs[1]
            self.pairs = found, many

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(node << 8 | byte, count)."""
        self.settle()
        if self.total is None:
            return self.pairs
        node, column = np.nonzero(self.total)
        return (node << 8) | self.bytes[column], self.total[node, column]


def _rows(group: object, size: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 1 << 17):
        k, c = pa.array(key[a : a + (1 << 17)].astype(np.int64)), pa.array(count[a : a + (1 << 17)].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(group, pa.string()), len(k)), pa.repeat(pa.scalar(size, pa.int32()), len(k)), k, c], names=["grp", "len", "key", "cnt"])


def extensions(texts: DataFrame, heads: Mapping[object, np.ndarray], size: int, alignment: int = 1) -> DataFrame:
    """(grp, len, key, cnt) of the n-grams of ``size`` bytes whose first size - 1 are one of the group's ``heads`` (sorted, distinct): what ``counts`` with ``allowed`` gives
    for one length, without a search. A task holds a number for each head and byte."""
    tries = {g: Trie({size - 1: h}) for g, h in heads.items() if len(h)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, _Held] = {}
        for batch in batches:
            for group, rows_of in by_group(batch.column(0)):
                trie = tries.get(group)
                if trie is None:
                    continue
                trie.make()
                if group not in held:
                    held[group] = _Held(len(trie.nodes[size - 1]))
                data, offs = buffers(batch.column(1).filter(rows_of))
                for a, b in pieces(offs, CHUNK >> 1):
                    part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    ok = within_rows(o, size)
                    if alignment > 1:
                        at = np.arange(len(part))
                        ok &= _starts(o, at) % alignment == 0
                    for n, start, node in trie.walk(part, ok):
                        if n == size - 1:
                            held[group].add(node, part[start + n])
            give_back()
        while held:
            group, h = held.popitem()
            at, count = h.found()
            yield from _rows(group, size, (tries[group].nodes[size - 1][at >> 8] << 8) | (at & 255), count)
            del h, at, count
        tries.clear()
        give_back()

    return texts.mapInArrow(run, "grp string, len int, key bigint, cnt bigint").groupBy("grp", "len", "key").agg(F.sum("cnt").alias("cnt"))


def occurrences(texts: DataFrame, wanted: Mapping[object, Mapping[int, np.ndarray]]) -> DataFrame:
    """(grp, len, key, cnt): how often each group's texts have its wanted keys (by length, sorted); those that never occur have no row."""
    tries = {g: Trie(k) for g, k in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[object, int], np.ndarray] = {}
        for batch in batches:
            for group, rows_of in by_group(batch.column(0)):
                trie = tries.get(group)
                if trie is None:
                    continue
                trie.make()
                data, offs = buffers(batch.column(1).filter(rows_of))
                for a, b in pieces(offs, CHUNK >> 1):
                    part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    for n, start, node in trie.walk(part):
                        if n in trie.keys:
                            # those that reach beyond their row don't count
                            inside = np.zeros(len(start) + 1, np.int32)
                            low = np.searchsorted(start, o[:-1])
                            np.add.at(inside, low, 1)
                            np.add.at(inside, np.maximum(low, np.searchsorted(start, o[1:] - n, "right")), -1)
                            node = node[np.cumsum(inside[:-1]) > 0]
                            seen = np.bincount(node, minlength=len(trie.nodes[n]))[trie.own[n]]
                            held[group, n] = held.get((group, n), 0) + seen
        for (group, n), count in held.items():
            at = np.flatnonzero(count)
            yield from _rows(group, n, tries[group].keys[n][at], count[at])

    return texts.mapInArrow(run, "grp string, len int, key bigint, cnt bigint").groupBy("grp", "len", "key").agg(F.sum("cnt").alias("cnt"))


def exploded(texts: DataFrame, low: int, high: int, bytes_col: str = "b") -> DataFrame:
    """``texts`` with (start, len, key_hex) of every n-gram, in the JVM: slices of the binary column, so any length goes."""
    out = None
    for n in range(low, high + 1):
        at = F.explode(F.when(F.octet_length(bytes_col) >= n, F.sequence(F.lit(0), F.octet_length(bytes_col) - n)))
        one = texts.withColumn("start", at).withColumn("len", F.lit(n)).withColumn("key_hex", F.hex(F.substring(F.col(bytes_col), F.col("start") + 1, F.lit(n))))
        out = one if out is None else out.unionByName(one)
    return out.drop(bytes_col)


# ---- filters on trigrams and longer keys ------------------------------------


def skips_newlines(key_hex: Column, alignment: int = 1) -> Column:
    """True for a key that the newline filter drops: CR or LF anywhere, a leading tab, two leading blanks; NUL where bytes are unaligned."""
    at_byte = lambda x: key_hex.rlike(f"^(..)*({x})")
    drop = at_byte("0A|0D") | key_hex.startswith("09") | key_hex.startswith("2020")
    return drop | at_byte("00") if alignment == 1 else drop


def skips_numbers(key_hex: Column) -> Column:
    """True for a trigram that the number filter drops: digits with digits or separators, and rows of one punctuation mark."""
    digit, sep = "3[0-9]", "2[CE]"
    return key_hex.rlike(f"^({digit}{digit}|{sep}{digit}{digit}|{digit}{sep}{digit})") | key_hex.isin("2D2D2D", "3D3D3D", "2A2A2A", "2E2E2E", "3F3F3F")


# ---- the same for units of 16 bits --------------------------------------


def skips_wide(key_hex: Column, big: bool, newlines: bool = False, numbers: bool = False, ascii_only: bool = True) -> Column:
    """True for a trigram of 16-bit text that is dropped.

    Little end first: keys that begin with NUL split a character, so none stays; then two blanks, and CR, LF or a tab as a whole character; numbers as in
    ``skips_numbers``. Big end first: keys with NUL in the middle alone split one (where all characters are ASCII); numbers can't be told from three bytes.
    """
    if not big:
        drop = key_hex.startswith("00")
        if newlines:
            drop = drop | (key_hex == "200020") | key_hex.rlike("^(..00(0D|0A)|(0D|0A|09)00..)$")
        if numbers:
            drop = drop | key_hex.rlike("^(2[CE]003[0-9]|3[0-9]002[CE]|3[0-9]003[0-9])$") | key_hex.isin("2D002D", "3D003D", "2A002A", "2E002E", "3F003F")
        return drop
    drop = key_hex.rlike("^(?!00)..00..$") if ascii_only else F.lit(False)
    return drop | key_hex.rlike("^(..00(0D|0A)|00(0D|0A|09)..)$") if newlines else drop


def skips_pairs(key_hex: Column, newlines: bool = False, numbers: bool = False) -> Column:
    """True for a longer n-gram of aligned big-endian text that begins with two characters to be dropped: marks repeated always, blanks and numbers where asked."""
    drop = key_hex.rlike("^(002D002D|003D003D|002A002A|002E002E|003F003F)")
    if newlines:
        drop = drop | key_hex.startswith("00200020")
    if numbers:
        drop = drop | key_hex.rlike("^00(3[0-9]|2[CE])003[0-9]|^003[0-9]002[CE]")
    return drop


def ends_lines_wide(key_hex: Column, first: int, big: bool) -> Column:
    """True for an n-gram with CR, LF or NUL as a 16-bit character from byte ``first`` - 1 on."""
    unit = "00(0A|0D|00)" if big else "(0A|0D|00)00"
    return key_hex.rlike(f"^(....){{{(first - 1) // 2},}}({unit})")


def cleared(grams_: DataFrame, first: int | None = None, second: int | None = None, third: int | None = None) -> DataFrame:
    """Trigrams (key) without those that have these bytes; None stands for any byte."""
    drop = F.lit(True)
    for place, byte in ((16, first), (8, second), (0, third)):
        if byte is not None:
            drop = drop & (F.shiftrightunsigned("key", place).bitwiseAND(F.lit(255)) == byte)
    return grams_.where(~drop)
