"""The one task of the greedy sample sees lengths alone, and ranges of them at the edges give what a plain fold gives."""

import random

from lingrove.operators import sample


def test_ranges_are_one_stream(spark, monkeypatch):
    monkeypatch.setattr(sample, "RANGE", 7)
    rnd = random.Random(5)
    sizes = [rnd.choice((0, 1, 5, 90)) for _ in range(200)]
    rows = [(i, s) for i, s in enumerate(sizes)]
    got = sample.greedy_bytes(spark.createDataFrame(rows, "line_no bigint, size bigint").repartition(5), 1000)
    taken = seen = 0
    want = []
    for i, s in rows:
        take = taken <= seen * (1001.0 / sum(sizes))
        want.append((i, take))
        taken, seen = taken + s * take, seen + s
    assert sorted(tuple(r) for r in got.collect()) == want and 0 < sum(t for _, t in want) < len(want)
