"""Token counts: exact BPE token count at every prefix (operator 10).

Prefix dynamic programming: the encoding of a prefix ends with the one vocabulary token t for which the prefix without t is a
prefix whose own last token is *compatible* with t (t may follow it: the two, joined, encode to just themselves); its count is
that prefix's plus one. So every distinct pretoken is walked once, byte by byte, with no encoding of its prefixes, and sorted pretokens
share the states of their common beginnings; a worker keeps the counts of the pretokens it has seen (see ``bpe.Known``). A document's counts are sums over its pretokens.

Where a prefix ends, its last pretoken may differ from the whole text's: a white-space run at the end is one pretoken, and a cut
contraction ('re, 've, 'll) is an apostrophe and a letter. Both are taken into account, so each count equals
``len(encode(text[:i]))``.

Stored for each document: one signed byte for each character, the count's change from the prefix before it; a change beyond -127..127 is the byte -128 and
eight more with the change itself. ``prefix_counts`` sums them up; ``tokens_at`` and ``longest_prefix`` answer from them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PIECE, VOCAB, Known, Vocabulary, _ragged, vocabulary
from .common import chunks, text_buffers

BUDGETS = (512, 2048)
_CUT = ("'re", "'ve", "'ll")


class PrefixCounter:
    """The dynamic program over single pretokens, with its tables of tokens and of compatible pairs."""

    def __init__(self, v: Vocabulary):
        self.id_of = {t: i for i, t in enumerate(v.tokens) if t}
        self.endings = {t[i:] for t in self.id_of for i in range(len(t))}
        self.tokens = v.tokens
        self.merge = {(a, b): (r, n) for r, (a, b, n) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), strict=True))}
        self.of_byte = v.of_byte.tolist()
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def encode(self, word: bytes) -> list[int]:
        """Encoding by repeated lowest-rank merges; for joined pairs of tokens only."""
        ids = [self.of_byte[b] for b in word]
        while len(ids) > 1:
            ranked = [self.merge.get(p, (1 << 30, 0)) for p in zip(ids, ids[1:], strict=False)]
            r, new = min(ranked)
            if r == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ranked[i][0] == r:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def compatible(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def alone(self, a: int) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = self.encode(self.tokens[a]) == [a]
        return found

    def walk(self, word: bytes, counts: list[int], lasts: list[int]) -> None:
        """Extends the states (counts and last tokens of the prefixes known so far; one for the empty prefix) to the whole word."""
        id_of, endings, fits = self.id_of, self.endings, self.fits
        for j in range(len(counts), len(word) + 1):
            i = j - 1
            while True:
                part = word[i:j]
                if part not in endings:
                    raise ValueError("a prefix without an encoding")
                t = id_of.get(part)
                if t is not None:
                    if i == 0:
                        if self.alone(t):
                            break
                    else:
                        ok = fits.get((lasts[i], t))
                        if ok or ok is None and self.compatible(lasts[i], t):
                            break
                i -= 1
                if i < 0:
                    raise ValueError("a prefix without an encoding")
            counts.append(counts[i] + 1)
            lasts.append(t)

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of every character prefix of all words end to end, offsets), words in the order given."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        made: list[list[int]] = [[]] * len(raw)
        counts, lasts, before = [0], [-1], b""
        for k in sorted(range(len(raw)), key=raw.__getitem__):
            w = raw[k]
            same, most = 0, min(len(before), len(w))
            while same < most and before[same] == w[same]:
                same += 1
            del counts[same + 1 :], lasts[same + 1 :]
            self.walk(w, counts, lasts)
            made[k] = counts[1:] if len(w) == len(words[k]) else [c for c, nx in zip(counts[1:], [*w[1:], 0], strict=True) if nx & 0xC0 != 0x80]
            if words[k] in _CUT:
                made[k][1] = 2
            before = w
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((c for m in made for c in m), np.int32, int(size.sum()))
        return flat, np.r_[0, np.cumsum(size)]


class Counts(Known):
    """Counts of every prefix of the pretokens seen, and what the joins of white space need."""

    def __init__(self, c: PrefixCounter):
        self.counter = c
        super().__init__(c.table)

    def clear(self) -> None:
        super().clear()
        self.words: list[str] = []
        self.blank, self.lead, self.runs = np.zeros(0, bool), np.zeros(0, bool), {}

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        out = super().of(texts)
        new = list(itertools.islice(self.number, len(self.words), None))
        self.words += new
        self.blank = np.r_[self.blank, np.fromiter((w.isspace() for w in new), bool, len(new))]
        self.lead = np.r_[self.lead, np.fromiter((w[0].isspace() for w in new), bool, len(new))]
        return out


_counters: dict[str, Counts] = {}


def counter(path: str) -> Counts:
    if path not in _counters:
        _counters[path] = Counts(PrefixCounter(vocabulary(path)))
    return _counters[path]


def batch_counts(texts: list[str | None], known: Counts) -> Iterator[np.ndarray]:
    """For each text the token counts of its prefixes of 1, 2, ... characters."""
    numbers = known.of(texts)
    flat, offs, runs = known.flat, known.offs, known.runs
    size = np.diff(offs)
    total = flat[offs[1:] - 1] if len(flat) else np.zeros(0, np.int32)
    for w in numbers:
        s, t = size[w], total[w]
        base = np.cumsum(t) - t
        counts = flat[_ragged(offs[w], s)] + np.repeat(base, s).astype(np.int32)
        begin = np.cumsum(s) - s
        # a white-space run of two pretokens: a prefix that ends with it has it as one
        for k in np.flatnonzero(known.blank[w[:-1]] & known.lead[w[1:]]).tolist():
            run = known.words[w[k]] + known.words[w[k + 1]][0]
            if run not in runs:
                runs[run] = int(known.counter.table([run])[0][-1])
            counts[begin[k + 1]] = base[k] + runs[run]
        yield counts.astype(np.int32)


WIDE = -128


def packed(d: np.ndarray) -> np.ndarray:
    """Changes as bytes: one each, or ``WIDE`` and eight for one that needs them."""
    far = np.abs(d) > 127
    if not far.any():
        return d.astype(np.int8)
    out, at = np.zeros(len(d) + 8 * int(far.sum()), np.int8), np.arange(len(d)) + 8 * (np.cumsum(far) - far)
    out[at] = np.where(far, WIDE, d)
    out[at[far][:, None] + np.arange(1, 9)] = d[far].astype("<i8").view(np.int8).reshape(-1, 8)
    return out


def unpacked(deltas: bytes) -> np.ndarray:
    raw = np.frombuffer(deltas, np.int8)
    if not (raw == WIDE).any():
        return raw.astype(np.int64)
    out, i = [], 0
    while i < len(raw):
        step = 9 if raw[i] == WIDE else 1
        out.append(int.from_bytes(raw[i + 1 : i + 9].tobytes(), "little", signed=True) if step == 9 else int(raw[i]))
        i += step
    return np.array(out, np.int64)


def _counter(path: str, budgets: tuple[int, ...]):
    def run(col: pa.Array) -> pa.Array:
        c = counter(path)
        _, offs, null = text_buffers(col)
        deltas, ends, chars, tokens, cuts = [], [0], [], [], [[] for _ in budgets]
        for a, b in chunks(offs, PIECE):
            for counts in batch_counts(col.slice(a, b - a).to_pylist(), c):
                d = packed(np.diff(counts, prepend=0))
                deltas.append(d)
                ends.append(ends[-1] + len(d))
                chars.append(len(counts))
                tokens.append(int(counts[-1]) if len(counts) else 0)
                for k, most in enumerate(budgets):
                    cuts[k].append(_longest(counts, most))
        blob = np.concatenate(deltas).tobytes() if deltas else b""
        made = pa.Array.from_buffers(pa.large_binary(), len(chars), [None, pa.py_buffer(np.asarray(ends, np.int64).tobytes()), pa.py_buffer(blob)])
        made = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), made).cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        return pa.StructArray.from_arrays([pa.array(chars, pa.int64(), mask=null), pa.array(tokens, pa.int64(), mask=null), made, *(pa.array(x, pa.int64(), mask=null) for x in cuts)], ["n_chars", "n_tokens", "prefix_deltas", *(f"chars_in_{m}" for m in budgets)])

    return run


def _longest(counts: np.ndarray, most: int) -> int:
    """Characters of the longest prefix with at most so many tokens (counts can fall: the last that fits)."""
    if not len(counts) or counts[-1] <= most:
        return len(counts)
    fit = np.flatnonzero(counts <= most)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_table(docs: DataFrame, vocab_path: str = VOCAB, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_chars, n_tokens, prefix_deltas, chars_in_<budget>...) for every row of ``docs``; no shuffle.

    ``chars_in_<b>``: characters of the longest prefix with at most b tokens. Null text: all null. Empty text: 0 characters, 0
    tokens, no bytes. Texts are counted whole, whatever their length. Repeated rows and null ids: each row by itself. Further columns aren't read, so their names can't clash. Empty table: no rows.
    """
    f = F.arrow_udf(_counter(vocab_path, budgets), "n_chars bigint, n_tokens bigint, prefix_deltas binary" + "".join(f", chars_in_{b} bigint" for b in budgets))
    return docs.select("doc_id", f(F.col("text")).alias("s")).select("doc_id", "s.*")


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(unpacked(deltas))


def tokens_at(deltas: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many characters (the whole text when it has fewer); null for null."""

    def run(d: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None or k is None else int(unpacked(x)[: max(0, k)].sum()) for x, k in zip(d.to_pylist(), n.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(deltas, chars)


def longest_prefix(deltas: Column, tokens: Column) -> Column:
    """Characters of the longest prefix with at most so many tokens; null for null."""

    def run(d: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None or k is None else _longest(prefix_counts(x), k) for x, k in zip(d.to_pylist(), n.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(deltas, tokens)
