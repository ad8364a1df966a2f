"""Each stage of the pipeline against brute force on its own input."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from lingrove.llm import bpe, common, mixing, quality, simhash
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import prints_of


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(common.written(stage(spark, kept[-1], DATA)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == columns
    start, clean, lines, one, mixed, encoded = kept

    scores = quality.scores(start, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores if r.is_kept}

    want = brute.line_dedup([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, (t, gone, n) in want.items() if gone < n}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    prints = prints_of(lines)
    near = brute.hamming_pairs(prints, simhash.MAX_BITS)
    group = brute.components([r.doc_id for r in lines.collect()], near)
    stay = {r.doc_id for r in one.collect()}
    assert {group[i] for i in stay} == set(group.values())
    missed = sum(a in stay and b in stay for a, b in near)
    assert missed <= 0.1 * len(near)

    key = lambda i: int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:8], 16)
    rows = [(r.doc_id, r.source, len(r.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) - r.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ").count("")) for r in one.collect()]
    assert {r.doc_id for r in mixed.collect()} == set(brute.mix(rows, {}, mixing.BUDGET_SHARE, key))

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCAB)
    t.encode_special_tokens = True
    assert encoded.count() == mixed.count()
    for r in encoded.collect():
        assert r.token_ids == t.encode(r.text, add_special_tokens=False).ids


def test_run_is_the_stages_one_after_another(spark):
    got = {(r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, DATA))
    assert got == {(r.doc_id, tuple(r.token_ids)) for r in docs.collect()}


def test_run_on_hard_rows(spark, tmp_path):
    from tests.llm.test_operators import HARD, hard, labels

    for name, empty in (("hard", False), ("empty", True)):
        d = f"{tmp_path}/{name}"
        docs = hard(spark, empty).drop("n_tokens").withColumn("n_chars", F.length("text").cast("bigint"))
        docs.write.parquet(f"{d}/documents.parquet")
        labels(spark, empty).where("doc_id = 7").write.parquet(f"{d}/labels.parquet")  # one class, so the classifier keeps everything
        got = corpus_pipeline.run(spark, d).collect()
        assert (not got) == empty
        # what costs nothing stays; the repeated rows go together; the text of 60,000 words is over the budget
        assert empty or {(2, None), (3, ""), (4, " \n\t "), (6, "..."), (None, None)} <= {(r.doc_id, r.text) for r in got}
        assert sum(r.text == HARD[0][1] for r in got) in (0, 2) and all(r.doc_id != 5 for r in got)
        assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in HARD}
        assert all((r.token_ids is None) == (r.text is None) and (r.text is None or r.n_tokens == len(r.token_ids)) for r in got)
