"""Stage tables and checkpoints go at the end of a scope."""

import os

import pytest

from emberline.operators import cluster as C
from emberline.sources.stages import shared_folder, staged, stages


def held(spark):
    top = shared_folder(spark)
    return {os.path.join(d, x) for d, names, _ in os.walk(top.removeprefix("file:")) for x in names if x.startswith(("stage-", "rdd-"))}


def test_nothing_is_left_after_a_scope(spark):
    outside = staged(spark.range(3), "outside")
    before = held(spark)
    with stages(spark):
        nodes, pairs = staged(spark.range(5), "nodes"), staged(spark.range(4).selectExpr("id a", "id + 1 b"), "pairs")
        assert {r.component for r in C.components(nodes, pairs).collect()} == {0}
        with stages(spark):
            inner = staged(spark.range(2), "inner")
            assert inner.count() == 2
        assert nodes.count() == 5 and held(spark) > before
        with pytest.raises(Exception):
            inner.count()
    assert held(spark) == before and outside.count() == 3


def test_a_failure_leaves_nothing_either(spark):
    before = held(spark)
    with pytest.raises(ZeroDivisionError):
        with stages(spark):
            staged(spark.range(3), "lost")
            1 / 0
    assert held(spark) == before
