"""BPE encoding and decoding with a public byte-level vocabulary (operator 2).

Distinct pretokens lie end to end in one array of symbols with links to the next and the previous one. The
index maps each mergeable pair, by its rank, to all its positions. The ranks in use are applied in ascending order (a heap):
all live positions of the pair merge at once, and only the lists of the pairs to their left and right are
added to; entries that a merge made stale are told by their symbols when their list comes up. A worker goes through its partition in pieces of some
``PIECE`` bytes; the index of a piece has the pretokens that no earlier one had, so each distinct pretoken is encoded once
and its ids are gathered for every occurrence. Beyond ``Known.LIMIT`` pretokens a worker forgets them and begins anew.
A batch's ids are written into one array, and what a batch took is given back to the system before the next.

The vocabulary is read from ``vocab_path`` in each Python worker (once); it is never trained and never copied.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, releasing, text_buffers

PIECE = 1 << 20
COMPARE = 1 << 17  # bytes that are decoded at once
VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merges; a merge's rank is its place in the list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ids = _byte_letters(), model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(ids.values()) + 1
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.left, self.right, self.made = pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), pairs[:, 2].astype(np.int32)
        key = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of_key = key[order], order.astype(np.int32)
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.token_size = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCAB) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def splitter():
    return regex.compile(PATTERN).findall


class _Index:
    """Pair occurrence index: rank -> arrays of positions; the ranks in use in a heap."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        ok = ranks >= 0
        if not ok.all():
            ranks, at = ranks[ok], at[ok]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if (found := self.lists.get(r)) is None:
                self.lists[r] = [part]
                heapq.heappush(self.heap, r)
            else:
                found.append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        parts = self.lists.pop(r)
        return r, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, offsets) by the pair occurrence index."""
    size = np.array([len(w) for w in words], np.int64)
    offs = np.r_[0, np.cumsum(size)]
    n = int(offs[-1])
    sym = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = size > 0
    nxt[offs[1:][full] - 1] = -1
    prv[offs[:-1][full]] = -1
    index = _Index()
    if n:
        table = v.ranks(np.repeat(v.of_byte, 256), np.tile(v.of_byte, 256))
        inverse = np.zeros(v.size, np.int32)
        inverse[v.of_byte] = np.arange(256)
        at = np.flatnonzero(nxt >= 0).astype(np.int32)
        index.add(table[inverse[sym[at]] * 256 + inverse[sym[at + 1]]], at)
    while index.heap:
        r, pos = index.pop()
        a, b, new = v.left[r], v.right[r], v.made[r]
        q = nxt[pos]
        live = (sym[pos] == a) & (q >= 0) & (sym[q] == b)
        if not live.all():
            pos, q = pos[live], q[live]
        if a == b and len(pos) > 1:  # in a row of equal symbols every other position merges, from the left
            runs = np.flatnonzero(np.r_[True, pos[1:] != q[:-1]])
            nth = np.arange(len(pos)) - np.repeat(runs, np.diff(np.r_[runs, len(pos)]))
            pos, q = pos[nth % 2 == 0], q[nth % 2 == 0]
        if not len(pos):
            continue
        after = nxt[q]
        sym[pos], sym[q] = new, -1
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        before = prv[pos]
        left, right = before[before >= 0], pos[has]
        index.add(v.ranks(np.concatenate([sym[left], sym[right]]), np.concatenate([sym[nxt[left]], sym[after[has]]])), np.concatenate([left, right]))
    alive = sym >= 0
    kept = np.r_[0, np.cumsum(alive)]
    return sym[alive], kept[offs]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... of size[i] each, end to end."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - first, size)


class Known:
    """The pretokens seen so far, numbered as they came, with the numbers that belong to each (``flat``, cut by ``offs``)."""

    LIMIT = 50_000

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's pretokens as numbers; the values of new ones are made."""
        if len(self.number) > self.LIMIT:
            self.clear()
        split, get, old, out = splitter(), self.number.__getitem__, len(self.number), []
        for t in texts:
            found = split(t) if t else []
            out.append(np.fromiter(map(get, found), np.int32, len(found)))
        if len(self.number) > old:
            flat, offs = self.make(list(itertools.islice(self.number, old, None)))
            self.flat, self.offs = np.r_[self.flat, flat], np.r_[self.offs, offs[1:] + self.offs[-1]]
        return out


_encoders: dict[str, Known] = {}


def encoder(path: str = VOCAB) -> Known:
    if path not in _encoders:
        v = vocabulary(path)
        _encoders[path] = Known(lambda words: encode_words([w.encode("utf-8", "surrogatepass") for w in words], v))
    return _encoders[path]


def encode_batch(texts: list[str | None], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, offsets)."""
    numbers = known.of(texts)
    size, out, lens = np.diff(known.offs), [], []
    for w in numbers:
        s = size[w]
        out.append(known.flat[_ragged(known.offs[w], s)])
        lens.append(len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.r_[0, np.cumsum(lens, dtype=np.int64)]


def decode_batch(ids: np.ndarray, offs: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lists of ids; an id outside the vocabulary raises."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError("decode: an id outside the vocabulary")
    size = v.token_size[ids]
    ends = np.r_[0, np.cumsum(size)]
    return v.token_bytes[_ragged(v.token_at[ids], size)], ends[offs]


def _encoder(path: str):
    def run(col: pa.Array) -> pa.Array:
        v = vocabulary(path)
        data, offs, null = text_buffers(col)
        # a text has no more tokens than bytes; pages that nothing is written to take no memory
        flat, at, same = np.empty(int(offs[-1]), np.int32), [np.zeros(1, np.int64)], []
        known = encoder(path)
        for a, b in chunks(offs, PIECE):
            got, o = encode_batch(col.slice(a, b - a).to_pylist(), known)
            n = int(at[-1][-1])
            flat[n : n + len(got)] = got
            at.append(o[1:] + n)
            for x, y in chunks(offs[a : b + 1] - offs[a], COMPARE):
                raw, ends = decode_batch(got[o[x] : o[y]], o[x : y + 1] - o[x], v)
                lo, hi = offs[a + x], offs[a + y]
                if np.array_equal(ends, offs[a + x : a + y + 1] - lo) and np.array_equal(raw, data[lo:hi]):
                    same.append(np.ones(y - x, bool))
                else:
                    same.append(np.array([raw[ends[i] : ends[i + 1]].tobytes() == data[offs[a + x + i] : offs[a + x + i + 1]].tobytes() for i in range(y - x)]))
        ends = np.concatenate(at).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[null, False]) if null.any() else pa.array(ends), pa.array(flat[: ends[-1]]))
        return pa.StructArray.from_arrays([pa.array(np.diff(ends).astype(np.int64), mask=null), lists, pa.array(np.concatenate(same) if same else np.zeros(0, bool), mask=null)], ["n_tokens", "token_ids", "round_trip"])

    return run


def encoded(docs: DataFrame, name: str, vocab_path: str = VOCAB) -> DataFrame:
    """``docs`` with a struct column (n_tokens, token_ids, round_trip); null text: all null; empty text: no tokens."""
    return docs.withColumn(name, F.arrow_udf(releasing(_encoder(vocab_path)), "n_tokens bigint, token_ids array<int>, round_trip boolean")(F.col("text")))


def encode(docs: DataFrame, vocab_path: str = VOCAB) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row; ``round_trip``: decoding the ids gives the text's bytes again.

    Null text: all null. Empty text: no tokens. Whole texts, whatever their length; no shuffle. Repeated rows and null ids: each row by itself. Further columns aren't read. Empty table: no rows.
    """
    return encoded(docs.select("doc_id", "text"), "s", vocab_path).select("doc_id", "s.*")


def with_ids(docs: DataFrame, vocab_path: str = VOCAB) -> DataFrame:
    """``docs`` with n_tokens and token_ids; columns of these names are replaced, all others stay, whatever their names.

    Null text: both null. Empty text: 0 and no ids. Texts are encoded whole, whatever their length. Repeated rows and null ids: each row by itself. Empty table: no rows.
    """
    (name,) = fresh(docs, "bpe")
    return encoded(docs, name, vocab_path).withColumns({"n_tokens": F.col(f"{name}.n_tokens"), "token_ids": F.col(f"{name}.token_ids")}).drop(name)


_UNKNOWN = "\ufffd".encode()


def _decoder(path: str):
    def run(col: pa.Array) -> pa.Array:
        v = vocabulary(path)
        null = np.asarray(col.is_null())
        size = np.where(null, 0, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))).astype(np.int64)
        flat = col.flatten()
        # an id that is null or outside the vocabulary is written as U+FFFD
        ids = np.asarray(pa.compute.fill_null(flat, -1)).astype(np.int64)
        known = (ids >= 0) & (ids < v.size)
        lens = np.where(known, v.token_size[np.where(known, ids, 0)], len(_UNKNOWN))
        ends = np.r_[0, np.cumsum(lens)]
        raw = np.empty(ends[-1], np.uint8)
        raw[_ragged(ends[:-1][known], lens[known])] = v.token_bytes[_ragged(v.token_at[ids[known]], lens[known])]
        raw[(ends[:-1][~known][:, None] + np.arange(len(_UNKNOWN))).ravel()] = np.tile(np.frombuffer(_UNKNOWN, np.uint8), int((~known).sum()))
        blob, at = raw.tobytes(), ends[np.r_[0, np.cumsum(size)]]
        return pa.array([None if null[i] else blob[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(col))], pa.string())

    return run


def decode(tokens: DataFrame, vocab_path: str = VOCAB, ids_col: str = "token_ids", name: str = "text") -> DataFrame:
    """``tokens`` with the text of a column of id lists. Null list: null; empty list: empty text. An id that is null or not in the vocabulary, and
    bytes that aren't UTF-8, become U+FFFD. A column called ``name`` is replaced, all others stay. Lists of any length. Empty table: no rows."""
    return tokens.withColumn(name, F.arrow_udf(_decoder(vocab_path), "string")(F.col(ids_col).cast("array<bigint>")))
