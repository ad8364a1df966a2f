import random

import pytest

from lingrove.llm import suffix_tree
from tests.llm import brute


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("max_nodes", [suffix_tree.MAX_NODES, 0])
def test_sent_and_joined_like_brute_force(spark, max_nodes):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abab cé") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[0], "", None]
    got = {r.doc_id: r for r in suffix_tree.scores(table(spark, texts), max_nodes=max_nodes).collect()}
    known = [t.encode() for t in texts if t is not None]
    for i, w in enumerate(brute.suffix_tree_bits(known, suffix_tree.DEPTH, 0.0, suffix_tree.DIVERGENCE, suffix_tree.SMOOTH)):
        assert got[i].n_bytes == len(known[i]) and got[i].log2_prob == pytest.approx(w, abs=1e-6)
        assert got[i].bits_per_byte == (pytest.approx(-w / len(known[i])) if known[i] else None)
    assert got[43].n_bytes is None and got[43].log2_prob is None and got[43].bits_per_byte is None


def test_a_context_stays_when_the_corpus_grows(spark):
    rng = random.Random(9)
    rest = ["".join(rng.choice("abcdef ") for _ in range(5000)) for _ in range(400)]
    kept = suffix_tree.tree(suffix_tree.written(suffix_tree.counts(table(spark, ["qz" * 4] + rest))))
    # "q" occurs 4 times among 2,000,008 bytes, always with z after it
    assert kept.where(f"depth = 1 and c = {ord('q')}").count() > 0


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_the_join_shuffles_texts_not_their_runs(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(2000)]
    before = shuffled(spark)
    assert len(suffix_tree.scores(table(spark, texts), max_nodes=0).collect()) == 2000
    took = shuffled(spark) - before
    assert sum(map(len, texts)) / 4 < took < 2 * sum(map(len, texts))


def test_many_blocks_score_like_the_sent_tree(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abab cé") for _ in range(rng.randrange(1, 200)))) for i in range(300)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None), (7, ""), (8, "日本語"), (9, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sent, joined = (sorted(map(tuple, suffix_tree.scores(docs, max_nodes=m, block_bytes=700).collect()), key=repr) for m in (suffix_tree.MAX_NODES, 0))
    assert len(joined) == len(rows)
    assert [r[:2] for r in joined] == [r[:2] for r in sent]
    assert [r[2:] for r in joined] == [tuple(v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in r[2:]) for r in sent]
