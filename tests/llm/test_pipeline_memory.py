"""What the pipeline's Python workers hold."""

import os
import subprocess
import sys

import pyarrow as pa

from lingrove.llm import bpe, common, line_dedup
from tests.conftest import DATA

PEAK = """
import re
import pyarrow as pa
from lingrove.llm import bpe
of = lambda what: int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
run = bpe._encoder(bpe.VOCAB)
run(pa.array(["a b c d " * 1250] * 100))
batch = pa.array(["a b c d " * 1250] * 1200)
open("/proc/self/clear_refs", "w").write("5")
before = of("VmRSS")
run(batch)
print(of("VmHWM") - before, batch.nbytes / 2**20)
"""


def test_lines_are_removed_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = line_dedup.keep_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_batch_is_encoded_within_four_times_its_bytes():
    """Its ids are twice its bytes here: two tokens for each four bytes."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", PEAK], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    grown, text = map(float, got.stdout.split())
    assert grown < 4 * text


def test_batches_of_a_task_in_one_call():
    cols = [pa.array(["a b", None]), pa.array([], pa.string()), pa.array(["", "c"])]
    run = bpe._encoder(bpe.VOCAB)
    assert list(common.releasing(run)(iter(cols))) == [run(c) for c in cols]
