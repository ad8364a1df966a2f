"""The registered queries keep the passes of their SQL whatever the size of the text."""

import pytest

from lingrove import config
from lingrove.plans import queries as q
from tests.conftest import DATA


def test_small_asked_for_whatever_the_bytes():
    assert config.TrainOptions(small=True).passes(1 << 40) == [(4, 6), (7, 8)]
    assert config.TrainOptions(small=False).passes(1) == [(4, 5), (6, 7), (8, 8)]


@pytest.mark.parametrize("name", ["bigram_merge", "train_model", "train_group"])
def test_same_as_sql_where_the_text_is_large(name, same, monkeypatch):
    monkeypatch.setattr(config, "SMALL_DATA", 0.0, raising=False)
    same(q.QUERIES[name], q.SQL[name])
