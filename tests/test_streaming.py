import pytest
from pyspark.sql import functions as F

from lingrove.config import TrainOptions
from lingrove.functions import sql
from lingrove.operators import score, smooth
from lingrove.plans import train as T
from lingrove.streaming import identify
from tests.conftest import DATA


@pytest.fixture(scope="module")
def model(spark):
    return T.train(spark.read.parquet(f"{DATA}/documents.parquet"), TrainOptions(max_length=3))


@pytest.fixture(scope="module")
def strings(spark, tmp_path_factory):
    df = spark.read.parquet(f"{DATA}/conversations.parquet").where("text is not null").dropDuplicates(["conv_id", "turn"])
    rows = df.select("conv_id", "turn", F.col("text").alias("bytes")).orderBy("turn").limit(60)
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for turn in sorted({r.turn for r in rows.collect()}):
        rows.where(F.col("turn") == turn).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def ran(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def stream_of(spark, strings):
    return spark.readStream.schema(strings[0].schema).option("maxFilesPerTrigger", 1).parquet(strings[1])


def test_scores_like_a_batch(spark, model, strings):
    ids = ["conv_id", "turn"]
    got = {tuple(r) for r in ran(spark, identify.scored(stream_of(spark, strings), model, ids).select(*ids, "lang_id", "score"), "s_scores")}
    assert got == {tuple(r) for r in score.scores(strings[0], model, ids).collect()}


def test_smoothing_over_one_batch_like_the_window(spark, model, strings):
    stream = spark.readStream.schema(strings[0].schema).parquet(strings[1])
    got = {(r.conv_id, r.turn, r.lang_id): r.smoothed for r in ran(spark, identify.smoothed(stream, model, "conv_id", "turn"), "s_smooth")}
    found = score.sums(strings[0], model, ["conv_id", "turn"]).withColumn("score", score.score())
    want = {(r.conv_id, r.turn, r.lang_id): r.smoothed for r in smooth.smoothed(found, ["conv_id"], "turn").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_reports_reach_the_sink(spark, model, strings, tmp_path):
    out = []
    q = identify.report_to(stream_of(spark, strings), model, ["conv_id", "turn"], lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert set(out) == {tuple(r) for r in score.report(score.scores(strings[0], model, ["conv_id", "turn"]), ["conv_id", "turn"]).collect()}


def test_sql_function(spark, model, strings):
    sql.register(spark, model, "identify_text")
    strings[0].createOrReplaceTempView("some_turns")
    got = {(r.conv_id, r.turn): r.lang for r in spark.sql("select conv_id, turn, identify_text(bytes).lang as lang from some_turns").collect()}
    best = score.ranked(score.scores(strings[0], model, ["conv_id", "turn"]), ["conv_id", "turn"]).where("rank = 1").join(model.select("lang_id", "lang").distinct(), "lang_id")
    assert got == {(r.conv_id, r.turn): r.lang for r in best.collect()}
    assert spark.sql("select identify_text(null) as x").first().x is None
