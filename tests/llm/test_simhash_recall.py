import math

import numpy as np
import pytest

from lingrove.llm import simhash


def planted(n, seed):
    """n random fingerprints, then their twins at exactly MAX_BITS."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 256), np.uint8)
    twin = bits.copy()
    for row in twin:
        row[rng.choice(256, simhash.MAX_BITS, replace=False)] ^= 1
    return np.packbits(np.vstack([bits, twin]), axis=1).view(">u8").astype(np.uint64)


@pytest.mark.parametrize("strip, weight", [(simhash.STRIP, simhash.STRIP_WEIGHT), (simhash.NEXT, simhash.NEXT_WEIGHT)])
def test_hit_probability_by_counting_centres(strip, weight):
    ball, want = sum(math.comb(strip, w) for w in range(weight + 1)), 0.0
    for k in range(strip + 1):
        shared = sum(c.bit_count() <= weight and (c ^ (1 << k) - 1).bit_count() <= weight for c in range(1 << strip))
        at_k = math.comb(simhash.MAX_BITS, k) * math.comb(256 - simhash.MAX_BITS, strip - k) / math.comb(256, strip)
        want += at_k * (1 - (1 - 1 / ball) ** shared)
    assert simhash.hit(strip, weight, simhash.MAX_BITS) == pytest.approx(want)
    n = simhash.rounds(strip, weight, simhash.MAX_BITS, 0.9, 0.9)
    assert 1 - (1 - want * 0.9) ** n >= 0.9  # also when the list found is searched with the same misses


def test_first_level_recall_at_the_largest_distance(spark):
    fp = planted(3000, 5).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    found = {(min(r), max(r)) for r in simhash.near_edges(df).collect()}
    assert sum((i, i + 3000) in found for i in range(3000)) / 3000 >= 0.9


def test_recall_of_a_split_list_at_the_largest_distance():
    fp, found = planted(1500, 6), 0
    for seed in range(4):
        a, b = simhash.search_list(fp, simhash.MAX_BITS, 0.9, np.random.default_rng(seed), small=600)
        found += len({(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} & {(i, i + 1500) for i in range(1500)})
    assert found / 6000 >= 0.9


def test_lists_that_shrink_are_split_down_to_small_ones():
    fp, depth = planted(15_000, 8), []
    a, b = simhash.search_list(fp, simhash.MAX_BITS, 0.9, np.random.default_rng(2), small=256, depth=depth)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert max(level for level, _ in depth) >= 3 and max(size for _, size in depth) <= 2 * 256
    label = np.arange(30_000)
    from lingrove.llm.common import local_stars

    label = local_stars(30_000, a, b)
    assert (label[:15_000] == label[15_000:]).mean() >= 0.9 and found


def test_a_crowd_is_compared_as_it_is():
    rng = np.random.default_rng(4)
    fp = np.tile(rng.integers(0, 1 << 63, 4).astype(np.uint64), (20_000, 1))
    for _ in range(10):
        bit = rng.integers(0, 256, 20_000)
        fp[np.arange(20_000), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    depth = []
    a, b = simhash.search_list(fp, simhash.MAX_BITS, 0.9, rng, depth=depth)
    assert depth == [(1, 20_000)] and len(a) < 40_000
    from lingrove.llm.common import local_stars

    assert (local_stars(20_000, a, b) == 0).all()
