"""The ten operators against SQL, brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingrove.llm import bpe, common, embedding_dedup, fingerprints, line_dedup, mixing, quality, queries, simhash, substring_dedup, suffix_tree, token_counts
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


# 1: line dedup


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_line_dedup_like_a_loop(spark, min_lines):
    rng = random.Random(min_lines)
    long = [" ".join(f"{c}{i}" for i in range(50 + k)) for k, c in enumerate("xyz")]
    texts = ["\n".join(rng.choice([*"abcde", *long]) for _ in range(rng.randrange(1, 14))) for _ in range(25)] + ["", "\n\n\n", "x" * 300_000]
    got = {r.doc_id: (r.text, r.n_removed, r.n_lines) for r in line_dedup.dedup(docs_of(spark, texts), min_lines).collect()}
    assert got == brute.line_dedup(list(enumerate(texts)), min_lines)


def test_maximal_runs(spark):
    passage = [f"line {i} of the passage" for i in range(200)]
    other = [f"another {i}" for i in range(5)]
    texts = ["\n".join(["a0", *passage, "b0"]), "\n".join(["a1", *passage, "b1"]), "\n".join([*other, "c", *passage[50:130], "d"]), "\n".join(["e", *other, *passage[:3]])]
    found = {(r.doc, r.start, r.length) for r in line_dedup.runs(docs_of(spark, texts)).collect()}
    assert found == {(1, 1, 200), (2, 6, 80), (3, 1, 8)}  # two runs that touch are one
    at = dict(line_dedup.levels(docs_of(spark, texts)))
    assert sorted(at) == [1, 2, 4, 8, 16, 32, 64, 128, 256]
    deep = at[128].orderBy("rank").collect()
    assert sorted((r.doc, r.i) for r in deep if r.later) == [(1, 1 + k) for k in range(73)]  # 200 - 128 + 1 suffixes of the run
    assert at[256].isEmpty()


# 2 and 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCAB)
    t.encode_special_tokens = True
    return t


def test_encoding_like_the_library(spark, documents, library):
    odd = [" ", "  \n\n ", "aaaaaaaaaaaaaaaaa", "don't we'll", "日本語テキスト", "á🙂", "<|endoftext|>", "x" * 50_000, "1234567 89"]
    for r in bpe.encode(documents.select("doc_id", "text").unionByName(docs_of(spark, odd).select("doc_id", "text"))).join(documents.select("doc_id", "text"), "doc_id").limit(80).collect():
        assert r.round_trip
    got = bpe.encode(docs_of(spark, odd + [r.text for r in documents.orderBy("doc_id").collect()]))
    texts = odd + [r.text for r in documents.orderBy("doc_id").collect()]
    for r in got.collect():
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) and r.round_trip


def test_decoding(spark, documents):
    back = bpe.decode(bpe.encode(documents), name="back").join(documents.select("doc_id", "text"), "doc_id")
    assert back.where("back <> text").count() == 0
    df = spark.createDataFrame([([],), (None,), ([None, 10**9, -1],), (bpe.encode(docs_of(spark, ["ab cd"])).first().token_ids + [None],)], "token_ids array<bigint>")
    assert [r.text for r in bpe.decode(df.withColumn("text", F.lit("clash"))).collect()] == ["", None, "\ufffd" * 3, "ab cd\ufffd"]
    assert bpe.decode(df.limit(0)).collect() == []


def test_pretokens_are_forgotten_beyond_the_limit(library, monkeypatch):
    monkeypatch.setattr(bpe.Known, "LIMIT", 3)
    for known, of in ((bpe.encoder(), lambda t: library.encode(t, add_special_tokens=False).ids),):
        for text in ("one two three four five", "five six", "one one one", "seven eight nine ten"):
            assert bpe.encode_batch([text, None, ""], known)[0].tolist() == of(text)
    counts = token_counts.counter(bpe.VOCAB)
    for text in ("a  b c d e", "f g  h", "a  b"):
        assert next(token_counts.batch_counts([text], counts)).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_large_changes_are_packed():
    d = np.array([1, -127, 127, 128, 0, -5000, 1 << 40, 3])
    raw = token_counts.packed(d).tobytes()
    assert len(raw) == len(d) + 3 * 8 and token_counts.unpacked(raw).tolist() == d.tolist()
    assert token_counts.prefix_counts(raw).tolist() == np.cumsum(d).tolist()


def test_prefix_counts_like_encoding_each_prefix(spark, library):
    texts = ["Hello world, it's  \n\n  we're 12345 don't", "  leading", "tail   ", "été übergrößen", "'ll 've", "aaaaaaaaaaaaaaaab", "日本 語", "a  b\t\tc\n"]
    for r in token_counts.prefix_table(docs_of(spark, texts), budgets=(3, 5)).collect():
        t = texts[r.doc_id]
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]
        assert token_counts.prefix_counts(r.prefix_deltas).tolist() == want
        for m in (3, 5):
            assert r[f"chars_in_{m}"] == max([i + 1 for i, c in enumerate(want) if c <= m], default=0)


def test_prefix_counts_of_the_whole_table(spark, documents, library):
    both = token_counts.prefix_table(documents).join(documents.select("doc_id", "text"), "doc_id").withColumns({"half": token_counts.tokens_at(F.col("prefix_deltas"), F.lit(100)), "fits": token_counts.longest_prefix(F.col("prefix_deltas"), F.lit(512))})
    for r in both.collect():
        assert r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)
        assert r.half == len(library.encode(r.text[:100], add_special_tokens=False).ids) and r.fits == r.chars_in_512


# 3


def test_classifier_on_held_out_labels(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.scores(docs, labels.where("doc_id % 3 > 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r for r in got if r.quality == 0 or r.toxic == 1]
    right = sum(r.is_kept for r in clean) + sum(not r.is_kept for r in bad)
    assert right >= 0.9 * len(got) and sum(r.is_kept for r in clean) >= 0.9 * len(clean)
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)


def test_classifier_does_not_depend_on_the_batch():
    texts = [b"good words here", b"bad bad bad bad", b"", b"good words there", b"bad bad words"]
    m = quality.train(texts, [0, 1, 0, 0, 1], bucket_bits=10)
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = quality.probabilities(m, np.frombuffer(b"".join(texts), np.uint8), offs)
    for t, p in zip(texts, together, strict=True):
        assert quality.probabilities(m, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == pytest.approx(p)


def plain_features(text, bits):
    """Buckets of a text's words and character n-grams, one by one."""
    def one(piece):
        raw = np.frombuffer(piece, np.uint8)
        return int(common.Rolling(raw).spans(np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - bits))

    words = [w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())]
    found = [one(w) for w in words] + [0] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    low = text.lower()
    return found, [one(low[i : i + n].encode()) for n in quality.NGRAMS for i in range(len(low) - n + 1)]


def test_logits_like_sums_over_words_and_characters():
    texts = ["Good words, good Words here", "été à la plage 日本語テキスト", "a", "", "bad bad bad", "né né! ok"]
    m = quality.train([t.encode() for t in texts] * 3, [0, 1, 2, 0, 1, 2] * 3, bucket_bits=12)
    raw = [t.encode() for t in texts]
    got = quality.logits(m, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for t, z in zip(texts, got, strict=True):
        words, grams = plain_features(t, 12)
        want = m.bias + m.table[words].sum(axis=0) / max(1, len(words)) + m.table[[(1 << 12) + g for g in grams]].sum(axis=0) / max(1, len(grams))
        assert z == pytest.approx(want, abs=1e-5)


# 4


@pytest.mark.parametrize("shift", [0.0, 1.5])
def test_planted_vectors_are_found(spark, shift):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 64)) + shift
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.standard_normal(base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    twin = 0.955 * base + np.sqrt(1 - 0.955**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    crowd = base[:1] + rng.standard_normal((300, 64)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, twin, crowd]))]
    got = {r.vec_id: r.group_id for r in embedding_dedup.groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    x = np.vstack([base, twin, crowd]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = list(zip(*np.nonzero(np.triu(x @ x.T >= embedding_dedup.MIN_COSINE, 1)), strict=True))
    want = brute.components(range(len(x)), near)
    assert len(near) > 1500 and all(want[i] == want[g] for i, g in got.items())
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert sum(got[i] == got[1500 + i] for i in range(1500)) >= 0.9 * 1500
    assert len({got[3000 + i] for i in range(300)}) == 1


def test_company_by_chance_stays_the_same():
    rng, company = np.random.default_rng(3), []
    for n in (2_000, 20_000, 100_000):
        x = embedding_dedup._unit(rng.standard_normal((n, 64)))
        index = embedding_dedup.fit(x[:1500], embedding_dedup.width_of(n), steps=5)
        keys = index.keys(x)
        company.append(sum((np.unique(keys[:, t], return_counts=True)[1] ** 2).sum() - n for t in range(index.tables)) / n)
    assert max(company) < 12 and company[2] < 2 * company[0]


def test_embedding_groups_like_all_pairs(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    near = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= embedding_dedup.MIN_COSINE, 1)), strict=True)]
    want = brute.components(ids, near)
    got = {r.vec_id: r.group_id for r in queries.op4_embedding_near_dedup(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(want[i] == want[g] for i, g in got.items())
    assert not near or sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)


# 5


def test_repeated_passages_go_and_the_rest_stays(spark):
    passage = " ".join(f"Sentence number {i} speaks of rivers and stones." for i in range(10))
    own = [f"Document {i} starts with {'words ' * (i + 3)}here. " for i in range(4)]
    texts = [own[0] + passage, own[1] + passage + " The end.", own[2], passage]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(docs_of(spark, texts)).collect()}
    assert got == {0: texts[0], 1: own[1] + "The end.", 2: texts[2], 3: ""}


def test_spans_of_many_sentences(spark):
    text = " ".join(f"w{i}." for i in range(300)) + " "
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs_of(spark, [text, "Own words here. " + text]), 300, 300, 300).collect()}
    assert got == {0: 0, 1: 300}


# 6


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_mixing_like_a_queue(spark, range_rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rng = random.Random(4)
    texts = [" ".join("w" for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    sources = [rng.choice("abc") for _ in texts]
    weights = {"a": 3.0, "b": 0.5}
    key = lambda i: int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:8], 16)
    want = brute.mix([(i, s, len(t.split())) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], weights, 0.4, key)
    docs = docs_of(spark, texts, sources)
    assert [r.doc_id for r in mixing.mix(docs, weights, budget_share=0.4).collect()] == want
    assert {r.doc_id for r in mixing.keep_mix(docs, weights, budget_share=0.4).collect()} == set(want)


# 7


def prints_of(docs):
    return [(r.id, sum((r[f"f{k}"] & (1 << 64) - 1) << (64 * (3 - k)) for k in range(4))) for r in simhash.fingerprints(docs).collect()]


def test_simhash_groups_like_all_pairs(spark, documents):
    prints = prints_of(documents)
    near = brute.hamming_pairs(prints, simhash.MAX_BITS)
    want = brute.components([i for i, _ in prints], near)
    got = {r.doc_id: r.group_id for r in simhash.groups(documents).collect()}
    assert all(want.get(i, i) == want.get(g, g) for i, g in got.items())
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)


def test_planted_copies_are_found(spark, documents):
    rng = random.Random(8)
    base = [r for r in documents.where("n_chars > 800").orderBy("doc_id").collect()][:40]
    plants = []
    for k, r in enumerate(base):
        words = r.text.split(" ")
        for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
            words[at] = "changed"
        plants += [(1_000_000 + k, r.text), (2_000_000 + k, " ".join(words))]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(plants, "doc_id bigint, text string"))
    got = {r.doc_id: r.group_id for r in simhash.groups(df).collect()}
    assert all(got[1_000_000 + k] == got[r.doc_id] for k, r in enumerate(base))
    assert sum(got[2_000_000 + k] == got[r.doc_id] for k, r in enumerate(base)) >= 0.9 * len(base)


def test_simhash_does_not_depend_on_the_batch():
    texts = [b"the quick brown fox %d jumps over it" % (i % 7) for i in range(300)]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = simhash.simhash(np.frombuffer(b"".join(texts), np.uint8), offs)[1]
    for i in range(7):
        assert (simhash.simhash(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[1][0] == together[i]).all()


def test_recursion_keeps_recall():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, (1500, 4)).astype(np.uint64)
    twin = fp.copy()
    for row in twin:
        for bit in rng.choice(256, simhash.MAX_BITS - 16, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    a, b = simhash.search_list(np.vstack([fp, twin]), simhash.MAX_BITS, 0.9, rng, small=600)
    label = common.local_stars(3000, a, b)
    assert (label[:1500] == label[1500:]).mean() >= 0.9
    assert len(np.unique(label)) >= 1500


# 8


def test_scores_like_a_dictionary(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abab c") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    got = {r.doc_id: r for r in suffix_tree.scores(docs_of(spark, texts), depth=3, min_share=0.002, divergence=2.0).collect()}
    want = brute.suffix_tree_bits([t.encode() for t in texts], 3, 0.002, 2.0, suffix_tree.SMOOTH)
    for i, w in enumerate(want):
        assert got[i].log2_prob == pytest.approx(w, abs=1e-6) and got[i].bits_per_byte == pytest.approx(-w / len(texts[i]))


# 9


def plain_signature(text, bins, bits, width):
    """Bins of the least shingle hash, empty ones filled from their donors, one by one."""
    def span(piece):
        raw = np.frombuffer(piece, np.uint8)
        return common.Rolling(raw).spans(np.array([0]), np.array([len(raw)]))

    words = [span(w.encode()) for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())]
    table = {}
    for i in range(max(1, len(words) - width + 1) if words else 0):
        h = words[i]
        for w in words[i + 1 : i + width]:
            h = common.mix(h * np.uint64(0x9FB21C651E98DF25) + w)
        h = int(common.mix(h)[0])
        b = (h >> 32) * bins >> 32
        table[b] = min(table.get(b, 1 << 32), h & 0xFFFFFFFF)
    donors, out = fingerprints._donors(bins, 4096), []
    for b in range(bins if table else 0):
        at = b if b in table else next(int(d) for d in donors[b] if int(d) in table)
        out.append(int(common.mix(np.array([table[at]], np.uint64))[0]) & ((1 << bits) - 1))
    return out


@pytest.mark.parametrize("bins, bits, width", [(128, 8, 3), (64, 4, 2), (32, 1, 1)])
def test_signatures_bin_by_bin(spark, bins, bits, width):
    rng = random.Random(bins)
    texts = ["", "!!", "one", "one two", "Été à la plage", *(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 200))) for _ in range(30))]
    for r in fingerprints.fingerprints(docs_of(spark, texts), bins, bits, width).collect():
        want = plain_signature(texts[r.doc_id], bins, bits, width)
        assert (r.signature is None) == (not want)
        assert not want or fingerprints.unpack(bytes(r.signature), bins, bits).tolist() == want


def test_fingerprints_estimate_jaccard(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(600)]
    errors = []
    texts = [" ".join(base)]
    for share in (0.0, 0.1, 0.3, 0.6, 1.0):
        texts.append(" ".join(w if rng.random() >= share else rng.choice(words) for w in base))
    sig = {r.doc_id: r.signature for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    for i in range(1, len(texts)):
        exact = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        errors.append(abs(fingerprints.estimate(sig[0], sig[i]) - exact))
    assert errors[0] == 0.0 and max(errors) < 0.15


def test_estimate_in_the_jvm(spark, documents):
    s = fingerprints.fingerprints(documents).where("signature is not null").limit(20)
    pairs = s.crossJoin(s.select(F.col("signature").alias("other")))
    for r in pairs.select("signature", "other", fingerprints.estimate_column(F.col("signature"), F.col("other")).alias("e")).collect():
        assert r.e == pytest.approx(fingerprints.estimate(bytes(r.signature), bytes(r.other)))


# nulls, empty and long texts, ties, repeated rows, clashing columns

HARD = [(1, "one two three. four five six.\nseven", "a"), (1, "one two three. four five six.\nseven", "a"), (1, "another text under the same id", None), (None, "no id here", "a"), (2, None, "b"), (3, "", "b"), (4, " \n\t ", "b"), (5, "word " * 60_000, "c"), (6, "...", None), (7, "日本語 " * 50, "c"), (None, None, None)]
CLASH = ["_lr_doc", "_lr_tag", "_lr_made", "_lr_runs", "_lr_source", "_lr_last", "_lr_scores", "_lr_bpe", "_lr_gone", "_lr_id", "_lr_c", "rank", "k", "h", "id", "doc", "s", "tag", "n_tokens", "root", "node", "list", "v", "code", "finish", "r"]


def hard(spark, empty=False):
    df = spark.createDataFrame([] if empty else HARD, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit(c) for c in CLASH})


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (1, 0, 0), (5, 0, 0), (7, 1, 0), (None, 1, 0), (4, None, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))


PER_ROW = {
    "line_dedup": lambda s, df: line_dedup.dedup(df),
    "bpe": lambda s, df: bpe.encode(df),
    "quality": lambda s, df: quality.scores(df, labels(s)),
    "substring_dedup": lambda s, df: substring_dedup.dedup(df),
    "suffix_tree": lambda s, df: suffix_tree.scores(df),
    "fingerprints": lambda s, df: fingerprints.fingerprints(df),
    "token_counts": lambda s, df: token_counts.prefix_table(df),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_hard_rows(spark, name):
    got = PER_ROW[name](spark, hard(spark)).collect()
    assert len(got) == len(HARD)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in HARD)
    assert PER_ROW[name](spark, hard(spark, empty=True)).collect() == []
    null = [r for r in got if r.doc_id == 2][0].asDict()
    if name != "quality":
        assert all(v is None for c, v in null.items() if c != "doc_id")


KEPT = {  # what a stage keeps of the hard rows, by (id, text)
    "line_dedup": lambda rows: rows,
    "simhash": lambda rows: rows,
    "mixing": None,
    "bpe": lambda rows: rows,
    "quality": None,
}


@pytest.mark.parametrize("name, keep", [("line_dedup", line_dedup.keep_lines), ("simhash", simhash.keep_one), ("mixing", mixing.keep_mix), ("bpe", bpe.with_ids), ("quality", lambda df: quality.keep_clean(df, labels(df.sparkSession)))])
def test_stages_keep_all_columns(spark, name, keep):
    df = hard(spark)
    got = keep(df)
    assert set(df.columns) <= set(got.columns)
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in CLASH if not (name == "bpe" and c == "n_tokens"))
    texts = sorted(((r.doc_id, r.text) for r in rows), key=repr)
    every = sorted(((i, t) for i, t, _ in HARD), key=repr)
    if KEPT[name]:
        assert texts == KEPT[name](every)
    else:
        assert set(texts) <= set(every) and len(texts) <= len(every)
        assert texts.count(HARD[0][:2]) in (0, 2)  # repeated rows go together
    assert keep(hard(spark, empty=True)).count() == 0


def test_mixing_of_hard_rows(spark):
    got = mixing.mix(hard(spark), budget_share=1.0).collect()
    assert len(got) == len(HARD) - 1  # the repeated row is one entry
    assert got[-1].cum_tokens == sum(len((t or "").split(" ")) if t and t.strip() and "\n" not in t else len((t or "").split()) for _, t, _ in HARD) - 60_000 + 60_000 - sum(t.endswith(" ") and bool(t.strip()) for _, t, _ in HARD if t)


def test_groups_of_hard_rows(spark):
    got = {r.doc_id: r.group_id for r in simhash.groups(hard(spark)).collect()}
    assert got == {i: i for i in (1, 2, 3, 4, 5, 6, 7)}
    assert simhash.groups(hard(spark, empty=True)).count() == 0


def test_hard_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [1.0, 2.0]), (9, [-1.0, 3.0, 0.2]), (1, [1.0, 0.0, 0.5]), (None, [1.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(c) for c in CLASH})
    got = {r.vec_id: r.group_id for r in embedding_dedup.groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert embedding_dedup.groups(df.limit(0)).count() == 0
    assert embedding_dedup.groups(df.where("vec_id = 3")).count() == 1
