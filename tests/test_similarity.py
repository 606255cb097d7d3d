"""The similarity join, its classes of copies, and what is clustered from them, against plain loops."""

import random

import numpy as np
import pytest

from emberline.operators import cluster as C
from emberline.operators import similarity as S
from emberline.operators import vectors as D


def sparse_vectors(rng, n, dims=60, held=5):
    out = []
    for _ in range(n):
        v = np.zeros(dims)
        v[rng.choice(dims, held, replace=False)] = rng.random(held) + 0.2
        out.append(v)
    return out


def frame(spark, v):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")


def loop(v, threshold, at_least=False):
    u = [None if x is None or not np.linalg.norm(x) else np.asarray(x) / np.linalg.norm(x) for x in v]
    out = set()
    for i in range(len(u)):
        for j in range(i + 1, len(u)):
            if u[i] is not None and u[j] is not None:
                c = float(u[i] @ u[j])
                if c >= threshold - 1e-9 if at_least else c > threshold + 1e-9:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("threshold,at_least", [(0.9, False), (0.6, True), (0.3, False), (0.0, False), (-0.2, True), (1.0, True), (1.0, False)])
def test_pairs_equal_the_loop(spark, monkeypatch, threshold, at_least):
    monkeypatch.setattr(S, "TILE", 9)
    rng = np.random.default_rng(3)
    v = sparse_vectors(rng, 60)
    v += [v[0] + 0.1 * v[1], 2 * v[2], v[2], v[2], -v[3], np.zeros(60), np.zeros(60), None, []]
    v += [x + rng.normal(0, 0.02, 60) * (x > 0) for x in v[:15]]
    got = D.similar_pairs(frame(spark, v).withColumnRenamed("id", "tweet_id"), threshold, at_least).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and all(r.a < r.b for r in got)
    assert {(r.a, r.b) for r in got} == loop(v, threshold, at_least)


def test_prefixes_compare_far_fewer_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 50)
    rng = np.random.default_rng(4)
    n = 1500
    v = sparse_vectors(rng, n, 256, 14)
    for x in v:  # a dimension that all hold
        x[0] = 0.5
    posted, sizes, width = S.plan_postings(S.unit_rows(frame(spark, v)), 0.93)
    compared = sum(k * (k - 1) // 2 for k in sizes.values())
    assert width == 256 and -1 not in sizes and compared < n * (n - 1) // 2 / 10
    # dense vectors have nothing to skip: all are compared once
    assert set(S.plan_postings(S.unit_rows(frame(spark, rng.normal(size=(200, 8)))), 0.3)[1]) == {-1}


def test_twenty_thousand_copies_cost_their_number(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b, c = (x.tolist() for x in sparse_vectors(rng, 3))
    near = (np.array(a) * (1 + 0.01 * rng.random(60))).tolist()
    rows = [(i, a if i % 2 else b) for i in range(20_000)] + [(20_000, near), (20_001, c)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(8)
    s = S.similar_classes(df, 0.95)
    assert s.members.count() == 20_002 and s.members.select("rep").distinct().count() == 4
    assert [(r.a, r.b) for r in s.pairs.collect()] == [(1, 20_000)]
    for found in (S.similar_components(df, 0.95), S.similar_leaders(df, 0.95), S.similar_density(df, 0.95, 5).select("id", "component")):
        got = found.toPandas()
        sizes = got[got.columns[1]].value_counts()
        assert sizes.to_dict() == {0: 10_000, 1: 10_001, 20_001: 1}


def brute_leaders(n, near, least):
    used, leader = set(), {}
    for i in range(n):
        free = [j for j in near[i] if j not in used]
        if i not in used and len(free) >= least:
            used.update(free)
            leader.update((j, i) for j in free)
    return {j: leader.get(j, j) for j in range(n)}


def brute_density(n, near, least):
    core = {i for i in range(n) if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        stack = [i] if i not in label else []
        while stack:
            x = stack.pop()
            label.setdefault(x, i)
            stack += [y for y in near[x] if y in core and y not in label]
    return {i: label.get(i, min([label[j] for j in near[i] if j in core], default=i)) for i in range(n)}


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_leaders_and_density_with_copies_equal_the_loops(spark, least):
    rng = random.Random(least)
    base = [[rng.choice([0.0, 1.0, 1.0, 2.0]) for _ in range(5)] for _ in range(18)]
    v = [rng.choice(base) for _ in range(50)]
    near = {i: [j for j in range(50) if (min(i, j), max(i, j)) in loop(v, 0.93) or i == j and any(v[i])] for i in range(50)}
    assert dict(S.similar_leaders(frame(spark, v), 0.93, least).collect()) == brute_leaders(50, near, least)
    if least > 1:
        assert dict(S.similar_density(frame(spark, v), 0.93, least, at_least=False).collect()) == brute_density(50, near, least)


def test_rejected_leaders_are_free_again(spark):
    # 0 sees only 1; 1 leads 0, 2 and 3
    nodes = spark.createDataFrame([(i, 1) for i in range(6)], "id int, size int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (4, 5)], "a int, b int")
    assert dict(C.counted_leaders(nodes, pairs, 3).collect()) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert dict(C.counted_leaders(nodes, pairs, 2).collect()) == {0: 0, 1: 0, 4: 4, 5: 4}


def test_empty_tables(spark):
    none = frame(spark, [None]).where("false")
    assert D.similar_pairs(none.withColumnRenamed("id", "tweet_id"), 0.5).count() == 0
    assert S.similar_components(none, 0.5).count() == 0 and S.similar_leaders(none, 0.5, 3).count() == 0
    assert S.similar_components(frame(spark, [None, []]), 0.5).count() == 2


def test_sums_over_pairs_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = [*rng.random((6, 4)), *[x for x in rng.random((4, 4)) for _ in range(3)], np.zeros(4)]
    for threshold, at_least in ((0.8, False), (1.0, False), (1.0, True)):
        s = S.similar_classes(frame(spark, v), threshold, at_least)
        pairs = s.expanded().collect()
        want = {}
        for r in pairs:
            want[r.a], want[r.b] = want.get(r.a, 0.0) + r.cos, want.get(r.b, 0.0) + r.cos
        assert {r.id: r.weight for r in s.weights().collect()} == pytest.approx(want)
        assert tuple(s.counted().first()) == (len(pairs), pytest.approx(sum(r.cos for r in pairs)))


def test_communities_by_similarity_make_no_pairs(spark, monkeypatch):
    from emberline.plans import QUERIES

    monkeypatch.setattr(S.Similar, "expanded", lambda self: pytest.fail("all pairs made"))
    assert QUERIES["community_center_v2"](spark, "/root/testdata/sf0.001").count() > 0
