"""What the counter holds and hands on at once stays small, however much there is to count."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lingrove.operators import grams


def test_counter_hands_on_small_batches():
    rnd = np.random.default_rng(2)
    rows = [rnd.integers(0, 256, 50_000, np.uint8).tobytes() for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * len(rows)), pa.array(rows, pa.binary())], names=["grp", "bytes"])
    tracemalloc.start()
    total = 0
    for out in grams._counter(4, 6, 1, None, 0)(iter([batch])):
        total += sum(out.column(3).to_numpy().tolist())
        assert out.num_rows <= 1 << 17
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(r) - n + 1 for r in rows for n in (4, 5, 6))
    assert peak < 250e6
