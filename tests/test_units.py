"""Small cases whose results follow from the definitions."""

import random

import pytest
from pyspark.sql import functions as F

from lingrove.config import IdentifyOptions, Language, TrainOptions, parse_alignment
from lingrove.functions import scaling, texts
from lingrove.operators import grams, identify, sample, score, select, smooth
from lingrove.operators import models as M
from lingrove.plans import train as T
from lingrove.sources import files, freqlist, store


def counts(spark, rows, low=3, high=3, **how):
    df = spark.createDataFrame([("x", r) for r in rows], "grp string, bytes binary")
    return {r.h: r.cnt for r in grams.counts(df, low, high, **how).select(grams.hex_key(F.col("key"), F.col("len")).alias("h"), "cnt").collect()}


def test_scaling_and_quantising(spark):
    assert scaling.length_factor(3) == pytest.approx(615.466905, abs=1e-6)
    assert scaling.length_factor(2) == pytest.approx(68.112610, abs=1e-6)
    want = {1: 275422870, 10: 380189396, 1000: 724435960, 42000: 1222516982}
    rows = spark.createDataFrame([(c,) for c in want], "c bigint").select("c", scaling.scaled(F.col("c"), F.lit(1000000)).alias("s"))
    rows = rows.withColumn("back", scaling.unscaled(F.col("s")) * 10000).collect()
    assert {r.c: r.s for r in rows} == want
    assert all(r.back == pytest.approx(r.c, rel=1e-4) for r in rows)
    q = {0: 0, 1: 2048, 2047: 2048, 2048: 2048, 5000: 4096, 67108863: 67106816, 67108864: 67108864, 67117055: 67108864, 268468223: 268435456, 1073741824: 1073741824, 4294967295: 4294836224}
    got = spark.createDataFrame([(f,) for f in q], "f bigint").select("f", scaling.quantised(F.col("f")).alias("q")).collect()
    assert {r.f: r.q for r in got} == q


def test_logarithmic_power_and_back(spark):
    df = spark.createDataFrame([(c,) for c in (1, 50, 9000)], "c bigint")
    rows = df.select("c", (scaling.unscaled(scaling.scaled(F.col("c"), F.lit(10000), -100.0), -100.0) * 10000).alias("back")).collect()
    assert all(r.back / 100 == pytest.approx(r.c, rel=1e-3) for r in rows)


def test_counting(spark):
    assert counts(spark, [b"aaaa"]) == {"616161": 2}
    assert counts(spark, [b"abcabc"], alignment=2) == {"616263": 1, "636162": 1}
    assert counts(spark, [None, b"", b"ab", b"abc", b"abc"]) == {"616263": 2}
    assert counts(spark, [b"ab", b"cd"]) == {}  # none crosses from text to text
    assert counts(spark, [bytes([255] * 8)], 8, 8) == {"FF" * 8: 1}


def test_exploded_equals_counts(spark):
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(12))) for _ in range(40)]
    df = spark.createDataFrame([(r,) for r in rows], "b binary")
    got = {r.key_hex: r["count"] for r in grams.exploded(df, 2, 8).groupBy("key_hex").count().collect()}
    assert got == counts(spark, rows, 2, 8)


def test_filters(spark):
    rows = [(k.hex().upper(),) for k in (b"12x", b"1.2", b".12", b"---", b"a12", b"ab\n", b"\tab", b"  a", b"a\0b")]
    got = spark.createDataFrame(rows, "k string").select("k", grams.skips_numbers(F.col("k")).alias("n"), grams.skips_newlines(F.col("k")).alias("l")).collect()
    assert [r.n for r in got] == [True, True, True, True, False, False, False, False, False]
    assert [r.l for r in got] == [False] * 5 + [True] * 4


def test_top_k_keeps_ties(spark):
    def kept(values, k):
        df = spark.createDataFrame([("x", 3, i + 1, c) for i, c in enumerate(values)], "grp string, len int, key bigint, cnt bigint")
        return sorted(r.cnt for r in select.top_trigrams(df, k).collect())

    assert kept([5, 4, 4, 3, 1], 2) == [4, 4, 5]
    assert kept([5, 1, 1], 2) == [5]
    assert kept([], 2) == []


def test_pruning(spark):
    def key(b):
        return int.from_bytes(b, "big")

    def df(entries):
        return spark.createDataFrame([("x", len(k), key(k), c) for k, c in entries.items()], "grp string, len int, key bigint, cnt bigint")

    def survivors(entries):
        return {r.key for r in select.with_max_child(df(entries)).where(select.survives(3, 0.9)).collect()}

    assert key(b"abc") in survivors({b"abcd": 90, b"abc": 100})
    assert key(b"abc") not in survivors({b"abcd": 100, b"abc": 100})
    got = {r.key: r.cnt for r in select.without_suffixes(df({b"abcdef": 95, b"bcdef": 100, b"cdef": 100}), 4, 6, 0.9).collect()}
    assert got == {key(b"abcdef"): 95, key(b"bcdef"): 0, key(b"cdef"): 100}


def test_pass_schedule():
    o = TrainOptions()
    assert o.passes(10_000) == [(4, 6), (7, 8)]
    assert o.passes(1 << 40) == [(4, 5), (6, 7), (8, 8)]
    assert TrainOptions(affix_ratio=3).affix_ratio == 2.0 and TrainOptions(affix_ratio=0.1).affix_ratio == 0.4
    with pytest.raises(ValueError):
        TrainOptions(max_length=9)


def brute_scores(text, model, o, align):
    """Score of a byte string by walking over every occurrence."""
    out = {}
    for lang, length, key, quant, stop in model:
        for s in range(len(text) - length + 1):
            if length in o.lengths() and text[s : s + length] == key and align.get(lang, 1) <= (4, 1, 2, 1)[s % 4]:
                w = quant / 1e11 * (o.stop_penalty if stop else 1) * scaling.length_factor(length, o.bigram_weight) / len(text)
                out[lang] = out.get(lang, 0.0) + w
    return out


@pytest.mark.parametrize("by_join", [False, True])
def test_scores_like_a_walk(spark, by_join):
    rng = random.Random(5)
    keys = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 8))) for _ in range(60)})
    model = [(rng.randrange(3), len(k), k, rng.randrange(1, 1 << 20) * 2048, rng.random() < 0.2) for k in keys]
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(40))) for _ in range(30)] + [b""]
    m = spark.createDataFrame([(g, n, int.from_bytes(k, "big"), q, s) for g, n, k, q, s in model], "lang_id int, len int, key bigint, quant bigint, is_stop boolean")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)] + [(99, None)], "id int, bytes binary")
    for o in (IdentifyOptions(), IdentifyOptions(bigram_weight=0.0), IdentifyOptions(stop_grams=False)):
        align = {1: 2, 2: 4}
        got = {(r.id, r.lang_id): r.score for r in score.scores(df, m, ["id"], o, align, by_join).collect()}
        used = model if o.stop_grams else [e for e in model if not e[4]]
        want = {(i, g): v for i, s in enumerate(strings) for g, v in brute_scores(s, used, o, align).items()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_trained_on_itself(spark):
    docs = spark.createDataFrame([("aaaa", "x")], "text string, lang string")
    m = T.train(docs, TrainOptions(max_length=3, bigrams=False))
    assert [(r.cnt, r.scaled, r.quant) for r in m.collect()] == [(2, 1729242101, 1729232896)]
    s = spark.createDataFrame([(1, "aaaa")], "id int, bytes string")
    assert score.scores(s, m, ["id"]).first().score == pytest.approx(5.321428, abs=1e-6)


def test_training_with_nulls_and_without_rows(spark):
    docs = spark.createDataFrame([(None, "x"), ("", "x"), ("abab", None), ("abababab", "y")], "text string, lang string")
    assert {r.lang for r in T.train(docs).collect()} == {"y"}
    assert T.train(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").dropDuplicates(["text"])
    model = T.train(docs.where("doc_id % 2 = 0"), TrainOptions(max_length=3))
    test = docs.where("doc_id % 2 = 1").withColumn("bytes", F.substring("text", 1, 200))
    best = score.ranked(score.scores(test, model, ["doc_id", "lang"]), ["doc_id", "lang"]).where("rank = 1").join(model.select("lang_id", F.col("lang").alias("found")).distinct(), "lang_id")
    right = best.agg(F.avg((F.col("lang") == F.col("found")).cast("int"))).first()[0]
    assert right >= 0.95


def test_cut_and_report(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.1), (2, 0, 0.001), (2, 1, 0.002)], "id int, lang_id int, score double")
    assert {(r.id, r.lang_id) for r in score.cut(df, ["id"]).collect()} == {(1, 0), (1, 1), (2, 1)}
    assert {(r.id, r.lang_id) for r in score.report(df, ["id"]).collect()} == {(1, 0), (1, 1)}
    assert {(r.id, r.lang_id) for r in score.report(df, ["id"], IdentifyOptions(top_n=1)).collect()} == {(1, 0)}


def test_blocks(spark):
    def blocks(n):
        df = spark.createDataFrame([(1, "x" * n)], "id int, text string")
        return [(r.start, r.len) for r in files.blocks_of(df, ["id"], 80).orderBy("start").collect()]

    assert blocks(100) == [(0, 80), (20, 80), (40, 60), (60, 40)]
    assert blocks(170) == [(0, 80), (20, 80), (40, 80), (60, 80), (80, 80), (100, 70), (120, 50), (140, 30)]
    assert blocks(0) == []


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, "c"), (3, ""), (4, None)], "id int, text string")
    got = [(r.id, r.line_no, r.line, r.bytes) for r in files.lines_of(df, ["id"]).orderBy("id", "line_no").collect()]
    assert got == [(1, 0, "a", "a\n"), (1, 1, "", "\n"), (1, 2, "b", "b\n"), (2, 0, "c", "c")]


def test_similarity(spark):
    rows = [(0, "a", 3, 1, 4096, False), (0, "a", 3, 2, 8192, False), (1, "b", 3, 1, 4096, False), (1, "b", 3, 2, 8192, False), (2, "c", 3, 9, 4096, False)]
    m = spark.createDataFrame(rows, "lang_id int, lang string, len int, key bigint, quant bigint, is_stop boolean")
    got = {(r.lang_a, r.lang_b): r.similarity for r in M.similarity(m).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}


def test_samples(spark):
    lines = spark.createDataFrame([(k, "x" * k) for k in range(7)], "line_no bigint, line string")
    assert [r.line_no for r in lines.where(sample.every(3)).orderBy("line_no").collect()] == [0, 3, 6]
    five = lines.where("line_no < 5")
    assert [r.line_no for r in sample.uniform(five, 2).where("selected").orderBy("line_no").collect()] == [1, 4]
    assert sample.uniform(five, 9).where("selected").count() == 5
    assert [r.line_no for r in lines.where(sample.length_between(2, 4)).orderBy("line_no").collect()] == [2, 3, 4]
    assert sample.training_rate(99, 100) == 1.0 and sample.training_rate(10, 100) == 0.1


def test_smoothing_like_a_running_state(spark):
    rng = random.Random(2)
    rows, want = [], {}
    prior = smooth.Prior()
    for t in range(12):
        n, s = rng.randint(1, 300), {g: round(rng.random(), 6) for g in range(3)}
        rows += [("c", t, g, n, v) for g, v in s.items()]
        want |= {(t, g): v for g, v in prior.step(s, n).items()}
    df = spark.createDataFrame(rows, "conv string, t int, lang_id int, n_bytes bigint, score double")
    got = {(r.t, r.lang_id): r.smoothed for r in smooth.smoothed(df, ["conv"], "t").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_descriptors_and_alignment():
    assert [parse_alignment(x) for x in ("0", "3", "4", "9", None, "x")] == [1, 2, 4, 4, 1, 1]
    x = Language("en=English", region="US", coverage=7, match_factor=99)
    assert (x.language, x.friendly, x.coverage, x.match_factor, x.describe()) == ("en", "English", 1.0, 16.0, "en_US-utf-8")
    assert scaling.parse_weights("b0.1,s1.5,zz") == {"bigram_weight": 0.1, "stop_penalty": -15.0}


def test_store(spark, tmp_path):
    langs = store.languages(spark, [Language("en")])
    grams_ = spark.createDataFrame([(0, "en", 3, 7, 2, 2048, 2048, False)], store.NGRAMS)
    with pytest.raises(FileNotFoundError):
        store.open_model(spark, str(tmp_path / "none"))
    assert store.open_model(spark, str(tmp_path / "none"), create=True)[0].count() == 0
    store.save(langs, grams_, str(tmp_path / "m"))
    a, b = store.open_model(spark, str(tmp_path / "m"))
    assert a.count() == 1 and b.collect() == grams_.collect()
    a, b = store.add(a, b, Language("de"), grams_)
    assert {r.lang_id for r in b.collect()} == {0, 1}
    with pytest.raises(ValueError):
        store.add(a, b, Language("de"), grams_)


def test_keys_and_lists(spark, tmp_path):
    for k in (b"a b\n\\\0", "é".encode(), b"\xff\x01"):
        assert texts.unquote_key(texts.quote_key(k)) == k
    entries = spark.createDataFrame([(b"the", 12, False), (b" of ", 7, False), (b"xqz", 3, True)], "key binary, cnt bigint, is_stop boolean")
    lines = [r.value for r in freqlist.vocabulary(entries, {"TotalCount": "99"}).collect()]
    again = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert {(bytes(r.key), r.cnt, r.is_stop) for r in freqlist.native(again).collect()} == {(b"the", 12, False), (b" of ", 7, False), (b"xqz", 3, True)}
    assert freqlist.header(again) == {"TotalCount": "99"}


def test_encodings(spark):
    df = spark.createDataFrame([(b"\xe9", "aé".encode())], "b binary, u binary")
    r = df.select(F.hex(texts.latin1_to_utf8(F.col("b"))), F.hex(texts.widened(F.col("u"), texts.Extension.UTF8_BIG)), F.hex(texts.widened(F.col("u"), texts.Extension.UTF8_LITTLE)), F.hex(texts.transliterated(F.col("u"), "utf-8", "ascii"))).first()
    assert tuple(r) == ("C3A9", "006100E9", "6100E900", "6165")


def options_case(spark):
    """Two models of one language from two sources, and one of another language, told apart by single trigrams."""
    key = lambda b: int.from_bytes(b, "big")
    rows = [(0, "a", 3, key(b"aaa"), 9, 900_000_000, 900_000_000, False), (1, "a", 3, key(b"aaa"), 8, 800_000_000, 800_000_000, False), (2, "b", 3, key(b"aaa"), 7, 760_000_000, 760_000_000, False), (2, "b", 3, key(b"bbb"), 7, 900_000_000, 900_000_000, False)]
    langs = store.languages(spark, [Language("a", region="X", source="s", script="Latin"), Language("a", region="X", source="t"), Language("b=Bee", match_factor=16.0)])
    return langs, spark.createDataFrame(rows, store.NGRAMS)


@pytest.mark.parametrize(
    "o, want",
    [
        (IdentifyOptions(block=0), [("a_X-utf-8", "b-utf-8"), ("b-utf-8",), ()]),
        (IdentifyOptions(block=0, separate_sources=True), [("a_X-utf-8/s", "a_X-utf-8/t", "b-utf-8"), ("b-utf-8",), ()]),
        (IdentifyOptions(block=0, top_n=1, show_script=True), [("a_X-utf-8@Latin",), ("b-utf-8@UNKNOWN",), ()]),
        (IdentifyOptions(block=0, terse=True, friendly=True), [("a", "Bee"), ("Bee",), ()]),
        (IdentifyOptions(block=1, terse=True), [("a", "b"), ("b",), ()]),
        (IdentifyOptions(block=0, ratio=0.95), [("a_X-utf-8",), ("b-utf-8",), ()]),
        (IdentifyOptions(block=0, adjust_coverage=True), [("a_X-utf-8",), ("b-utf-8",), ()]),
    ],
)
@pytest.mark.parametrize("sent", [True, False])
def test_identify_by_options(spark, monkeypatch, o, want, sent):
    if not sent:
        monkeypatch.setattr(score, "MAX_MODEL_ROWS", 0)
    langs, model = options_case(spark)
    docs = spark.createDataFrame([(0, "aaa"), (1, "bbb"), (2, "ccc"), (3, ""), (4, None)], "id int, text string")
    got = identify.identify(docs, model, langs, ["id"], o).orderBy("id").collect()
    assert [tuple(x.label for x in r.shown) for r in got if r.id < 3] == want
    assert all(not r.shown for r in got if r.id == 3)
    if o.block == 1:
        assert [r.report for r in got] == ["a,b\taaa", "b\tbbb", "??\tccc"]
    else:
        assert got[2].report is None


def test_verbose_blocks_blanks_and_smoothing(spark):
    langs, model = options_case(spark)
    docs = spark.createDataFrame([(0, "c" * 100), (1, "a a a")], "id int, text string")
    got = identify.identify(docs, model, langs, ["id"], IdentifyOptions(block=80, verbose=True)).orderBy("id", "start").collect()
    assert [r.report for r in got][:2] == ["@ 00000000-0000004F: no languages detected", "@ 00000014-00000063: no languages detected"]
    blank = identify.identify(docs, model, langs, ["id"], IdentifyOptions(block=0, ignore_blanks=True)).where("id = 1").first()
    assert [x.label for x in blank.shown] == ["a_X-utf-8", "b-utf-8"]
    lines = spark.createDataFrame([(0, "aaa\nccc\nbbb\nbbb\n")], "id int, text string")
    got = identify.identify(lines, model, langs, ["id"], IdentifyOptions(block=1, smooth=True)).orderBy("start").collect()
    prior, want = smooth.Prior(), []
    plain = score.sums(files.lines_of(lines, ["id"]), model, ["line_no"]).withColumn("score", score.score()).collect()
    for t in range(4):
        want.append(prior.step({r.lang_id: r.score for r in plain if r.line_no == t}, 4))
    for r, w in zip(got, want, strict=True):
        assert {x.lang_id: x.score for x in r.shown}.items() <= {g: pytest.approx(v, abs=2e-6) for g, v in w.items()}.items()
        assert r.shown or not w


def test_stop_gram_choices(spark):
    langs = store.languages(spark, [Language("a", region="X"), Language("a", region="X", source="t"), Language("a", region="Y"), Language("b")])
    similar = spark.createDataFrame([(0, k, s) for k, s in enumerate((1.0, 0.9, 0.8, 0.6))], "lang_a int, lang_b int, similarity double")
    chosen = lambda by: sorted(r.lang_b for r in M.selected(similar, langs, by, 0).collect())
    assert chosen("@0.7") == [2] and chosen(0.5) == [2, 3] and chosen("@x") == [2, 3]
    assert chosen("a_Y,b,zz") == [2, 3] and chosen("a") == []  # one name for several models names none
    few = spark.createDataFrame([(0, 3, k, 5) for k in range(100)] + [(1, 3, k, 5) for k in range(101)] + [(1, 2, 7, 5)], "lang_a int, len int, key bigint, weight bigint")
    seen = spark.createDataFrame([(1, 3, 4, 1)], "lang_a int, len int, key bigint, cnt bigint")
    assert {(r.lang_a, r.len, r.key) for r in M.stop_grams(few, seen).collect()} == {(1, 3, k) for k in range(101) if k != 4}


def test_training_group_from_the_database(spark):
    rng = random.Random(4)
    text = lambda words, n=900: " ".join(rng.choice(words) for _ in range(n))
    base = [f"{a}{b}{c}" for a in "kst" for b in "aeo" for c in "lmnr"]
    mine = spark.createDataFrame([(text(base),)], "bytes string")
    other = T.train(spark.createDataFrame([(text([*base, *(f"{a}u{c}" for a in "bdg" for c in "lmnr")], 9000), "b")], "text string, lang string"))
    langs = store.languages(spark, [Language("b", train_bytes=3_000_000)])
    langs, ngrams, lines = T.add_group(langs, other, mine, Language("a"))
    row = langs.where("language = 'a'").first()
    assert row.lang_id == 1 and 0.9 < row.coverage <= 1 and row.match_factor > 1 and row.train_bytes == len(mine.first().bytes)
    with pytest.raises(ValueError):
        T.add_group(langs, ngrams, mine, Language("a"))
    langs, ngrams, lines = T.add_group(langs, ngrams, mine, Language("a"), TrainOptions(boost=2.0), "@0.01")
    assert langs.count() == 2 and ngrams.where("lang_id = 1 and is_stop").count() > 0
    stops = {bytes(r.key) for r in freqlist.native(spark.createDataFrame([(i, r.value) for i, r in enumerate(lines.collect())], "line_no int, value string")).where("is_stop").collect()}
    own = mine.first().bytes.encode()
    assert stops and not any(k in own for k in stops) and all(len(k) > 2 for k in stops)


def test_sampled_training(spark):
    rng = random.Random(9)
    lines = spark.createDataFrame([(k, "x" * rng.choice((1, 5, 400))) for k in range(2000)], "line_no bigint, line string")
    rows = sorted((r.line_no, len(r.line)) for r in lines.collect())
    total = sum(size for _, size in rows)

    def plain(n):
        """The rule line by line: long lines are the likelier, so more bytes than n may come."""
        want = float(n)
        while True:
            rate = want / total
            rate += (rate - 0.5) / 6 if rate > 0.5 else 0
            count, got = rate / 2, []
            for no, size in rows:
                step = rate * size / (total / len(rows))
                if rate >= 0.98 or int(count + step) > int(count):
                    got.append(no)
                count += step
            sampled = sum(size for no, size in rows if no in set(got))
            if sampled >= n or total < want or rate >= 0.98:
                return got
            want *= want / sampled * 1.01

    for n in (total // 10, total * 2):
        got = sorted(r.line_no for r in sample.training_sample(lines, n).collect())
        want = plain(n)
        assert len(set(got) ^ set(want)) <= 2  # sums are added in another order
    docs = spark.createDataFrame([(1, "ab\ncd\n"), (2, "ef")], "doc_id bigint, text string")
    assert [bytes(r.bytes) for r in T.limited(docs, TrainOptions(limit_bytes=4), "doc_id").orderBy("line_no").collect()] == [b"ab\n", b"c"]
    assert T.limited(docs, TrainOptions(), "doc_id").count() == 3


def test_malformed_utf8_and_large_types(spark):
    df = spark.createDataFrame([(b"a\xffb",), ("é🙂".encode(),), (b"",), (None,)], "b binary")
    got = [None if r[0] is None else bytes(r[0]) for r in df.select(texts.widened(F.col("b"), texts.Extension.UTF8_BIG)).collect()]
    assert got == [b"\0a\0b", "é🙂".encode("utf-16-be"), b"", None]
    back = [r[0] for r in df.select(texts.from_utf16(texts.widened(F.col("b"), texts.Extension.UTF8_LITTLE), False)).collect()]
    assert back == ["ab", "é🙂", "", None]
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert counts(spark, [b"abcabc", b"abd"]) == {"616263": 2, "626361": 1, "636162": 1, "616264": 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_wide_filters(spark):
    keys = [b"\0ab", b" \0 ", b"a\0\n", b"\t\0a", b"1\0.", b"1\x002", b"-\0-", b"a\0b", b"\n\0a"]
    df = spark.createDataFrame([(k.hex().upper(),) for k in keys], "k string")
    assert [r[0] for r in df.select(grams.skips_wide(F.col("k"), False, True, True)).collect()] == [True] * 7 + [False, True]
    big = spark.createDataFrame([(k.hex().upper(),) for k in (b"\0\na", b"\0a\0", b"a\0b", b"a\0\r", b"\0\ta")], "k string")
    assert [r[0] for r in big.select(grams.skips_wide(F.col("k"), True, True)).collect()] == [True, False, True, True, True]
    pairs = spark.createDataFrame([(k.hex().upper(),) for k in (b"\0-\0-", b"\0 \0 \0a", b"\x001\x002", b"\x001\0,", b"\0,\x003", b"\0a\0b")], "k string")
    assert [r[0] for r in pairs.select(grams.skips_pairs(F.col("k"), True, True)).collect()] == [True] * 5 + [False]
    assert [r[0] for r in pairs.select(grams.skips_pairs(F.col("k"))).collect()] == [True] + [False] * 5
    three = spark.createDataFrame([(0x616263,), (0x616200,), (0x006162,)], "key bigint")
    assert [r.key for r in grams.cleared(three, third=0).collect()] == [0x616263, 0x006162] and grams.cleared(three, first=0, second=0x61).count() == 2


def test_romanized(spark):
    df = spark.createDataFrame([("Привет, мир",), ("Αθήνα",), ("plain",), (None,), ("سلام؟",)], "t string")
    assert [r[0] for r in df.select(texts.romanized(F.col("t"))).collect()] == ["Privet, mir", "Athī́na", "plain", None, "slām?"]


def test_database_dump(spark, tmp_path):
    langs = store.languages(spark, [Language("en", region="US", source="w")])
    grams_ = spark.createDataFrame([(0, "en", 3, int.from_bytes(b"a b", "big"), 2, 2048, 2048, False), (0, "en", 3, int.from_bytes(b"x\ny", "big"), 2, 4096, 4096, True)], store.NGRAMS)
    lines = [r.value for r in store.dump(langs, grams_).orderBy("part", "place").collect()]
    assert lines == ["LanguageIdentifier Begin", "  Lang  0: en_US-utf-8 / w", "LanguageIdentifier Trie", "   a\\ b  :: 0:2048", "   x\\0Ay  :: 0*:4096", "LanguageIdentifier End"]
    sample.write_both(spark.createDataFrame([("a", True), ("b", False), ("c", None)], "line string, selected boolean"), f"{tmp_path}/yes", f"{tmp_path}/no")
    assert {r.value for r in spark.read.text(f"{tmp_path}/no").collect()} == {"b", "c"} and spark.read.text(f"{tmp_path}/yes").count() == 1
