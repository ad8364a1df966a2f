"""Counting what can matter alone gives what counting everything gives, and scores by trie those of a search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lingrove.config import IdentifyOptions, TrainOptions
from lingrove.operators import grams, identify, score, select
from lingrove.operators.trie import Trie
from lingrove.plans import train as T
from lingrove.sources import files


def documents(spark, seed=3):
    """Words by rank, some of them only within longer ones, and groups of very different sizes."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß\n") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    words += ["unbreakable", "unbreakably", "xyxyxyxy"]
    rows = [(g, " ".join(words[min(len(words) - 1, int(rnd.paretovariate(0.6)))] for _ in range(n))) for g, size in (("a", 40), ("b", 6), (None, 3), ("c", 1)) for n in range(size)]
    return spark.createDataFrame(rows, "grp string, bytes string")


def plain(df):
    return sorted(tuple(r) for r in df.select("len", "key", "cnt", "grp").fillna("?").collect())


@pytest.mark.parametrize("o", [TrainOptions(k=15, small=True), TrainOptions(k=60, small=False, skip_newlines=True), TrainOptions(k=15, small=True, alignment=2, affix_ratio=0.5), TrainOptions(k=60, small=True, min_length=5, affix_ratio=2.0)])
def test_bounded_pass_is_the_whole_pass(spark, o):
    texts = documents(spark)
    model = want = T.kept(select.top_trigrams(T.filtered(grams.counts(texts, 3, 3, o.alignment), o), o.pass_k(3)))
    for low, high in o.passes(0):
        longer = want.unionByName(T._extended(texts, want, low, high, o))
        want = T.kept(select.pruned(longer, low, high, o.min_length, o.pass_k(low), o.affix_ratio, o.alignment))
        model = T.kept(T._selected(texts, model, low, high, o))
        assert plain(model) == plain(want)


def test_bound_that_is_too_high_is_lowered(spark, monkeypatch):
    """Too little reaches the first bound here, so it is lowered and counted again."""
    texts, o = documents(spark), TrainOptions(k=40)
    model = T.kept(select.top_trigrams(grams.counts(texts, 3, 3), o.k))
    want = plain(select.pruned(model.unionByName(T._extended(texts, model, 4, 6, o)), 4, 6, 3, o.k, 0.9))
    tries = []
    counted = T._counted
    monkeypatch.setattr(T, "_counted", lambda t, f, lo, hi, o, least: tries.append(least) or counted(t, f, lo, hi, o, least))
    monkeypatch.setattr(T, "START", 0.01)  # a hundred times the k-th largest count
    assert plain(T._selected(texts, model, 4, 6, o)) == want
    assert len(tries) > 1


@pytest.mark.parametrize("cells", [1 << 23, 4000])
def test_extensions_and_occurrences_are_counts(spark, cells, monkeypatch):
    monkeypatch.setattr(grams, "MAX_CELLS", cells)
    texts = documents(spark)
    every = {(r.grp, r.len, r.key): r.cnt for r in grams.counts(texts, 3, 8).collect()}
    for n in (4, 6, 8):
        heads = {g: np.unique([k for h, m, k in every if h == g and m == n - 1 and k % 3]) for g in ("a", "b", None)}
        got = {(r.grp, r.key): r.cnt for r in grams.extensions(texts, heads, n).collect()}
        assert got == {(g, k): c for (g, m, k), c in every.items() if m == n and g in heads and (k & (1 << 64) - 1) >> 8 in set(heads[g].tolist())}
    wanted = {g: {n: np.unique([k for h, m, k in every if h == g and m == n and k % 5] + [7]) for n in (3, 5, 8)} for g in ("a", "b")}
    got = {(r.grp, r.len, r.key): r.cnt for r in grams.occurrences(texts, wanted).collect()}
    assert got == {(g, n, k): c for (g, n, k), c in every.items() if g in wanted and n in wanted[g] and k in set(wanted[g][n].tolist())}


@pytest.mark.parametrize("cells", [1 << 23, 0])
def test_walk_finds_every_key(cells, monkeypatch):
    from lingrove.operators import trie

    monkeypatch.setattr(trie, "MAX_CELLS", cells)
    rnd = np.random.default_rng(1)
    data = rnd.choice(np.array([0, 97, 98, 255], np.uint8), 4000)
    keys = {n: np.unique(grams.keys(data, np.array([0, len(data)]), n)[0][::3]) for n in (2, 3, 5, 8)}
    t = Trie(keys)
    for n, start, node in t.walk(data):
        if n in keys:
            key, at = grams.keys(data, np.array([0, len(data)]), n)
            want = np.isin(key, keys[n])
            own = t.place[n][node]
            assert (start[own >= 0] == at[want]).all() and (keys[n][own[own >= 0]] == key[want]).all()


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(lang, key, rnd.randint(1, 1000) * 2048, rnd.random() < 0.1) for lang in range(3) for word in (b"unbreakable", "éß deé".encode(), b" abc") for n in range(2, 9) for key in {word[i : i + n] for i in range(len(word) - n + 1)} if rnd.random() < 0.7]
    return spark.createDataFrame([(lang, f"l{lang}", len(k), int.from_bytes(k, "big", signed=len(k) == 8), 1, q, q, stop) for lang, k, q, stop in rows], "lang_id int, lang string, len int, key bigint, cnt bigint, scaled bigint, quant bigint, is_stop boolean")


@pytest.mark.parametrize("block, columns", [(80, 32), (100, 0), (4096, 32)])
def test_overlapping_blocks_are_scored_as_blocks(spark, model, block, columns, monkeypatch):
    monkeypatch.setattr(score, "MAX_COLUMNS", columns)
    monkeypatch.setattr(score, "PIECE", 300)
    langs = model.select("lang_id", "lang").distinct().withColumnRenamed("lang", "language")
    sizes = [*range(0, 240, 7), 319, 320, 321, 4095, 4096, 4097, 9000]
    text = ("unbreakable abc éß deé\n" * 600).encode()
    docs = spark.createDataFrame([(i, bytearray(text[i : i + n])) for i, n in enumerate(sizes)] + [(99, None)], "id int, text binary").coalesce(1)
    o = IdentifyOptions(block=block, verbose=True)
    want = identify.shown(files.blocks_of(docs, ["id"], block), model, langs, ["id", "start"], o).select("id", "start", "n_bytes", "shown")
    got = identify.identify(docs, model, langs, ["id"], o).select("id", "start", "n_bytes", "shown")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_alignment_counts_from_the_string_start():
    import pandas as pd

    rows = pd.DataFrame({"lang_id": [0, 1], "len": [3, 3], "key": [0x616263, 0x616263], "is_stop": [False, True], "quant": [5, 7]})
    t = score._Tables(rows, range(2, 9), {1: 2})
    data, offs = grams.buffers(pa.array([b"abc", b"xabcabc", b"ab", b"xxabc"], pa.binary()))
    assert t.sums(data, offs)[3].tolist() == [[[5, 0], [0, 7]], [[10, 0], [0, 7]], [[0, 0], [0, 0]], [[5, 0], [0, 7]]]
