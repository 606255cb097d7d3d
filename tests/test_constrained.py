"""Clusters and coherence from classes, against those from all pairs."""

import random

import pytest

from emberline.operators import cluster as C
from emberline.operators import constrained as Z
from emberline.operators import events as V
from emberline.operators import similarity as S


def given(spark, seed, n=60):
    rng = random.Random(seed)
    turns = [(1.0, 0.0, 0.0), (0.95, 0.31, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0), (0.05, 0.0, 0.99), (0.0, 0.7, 0.72)]
    names = [["p:a"], ["p:b"], ["p:a", "t:c"], [], [], ["t:d"]]
    events = [(f"{i:03d}", 1000 + rng.randrange(80_000), rng.choice(["", "x", "x", "y"] if seed % 2 else ["x"]), rng.choice(names)) for i in range(n)]
    vectors = [(e[0], list(rng.choice(turns))) for e in events] + [("zero", [0.0, 0.0, 0.0])]
    edges = [(rng.choice(events)[0], rng.choice(events)[0]) for _ in range(12)]
    e = spark.createDataFrame([*events, ("zero", 1000, "z", ["p:a"])], "id string, time long, author string, entity array<string>")
    return S.similar_classes(spark.createDataFrame(vectors, "id string, v array<double>"), 0.8, True), e, spark.createDataFrame(edges + edges[:2], "source string, target string")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_and_coherence_equal_those_of_all_pairs(spark, seed):
    similar, events, edges = given(spark, seed)
    assert Z.all_near(events)
    pairs = V.condition_count(similar.expanded(), events, edges).where("satisfied >= 2").checkpoint()
    ids = pairs.selectExpr("a id").union(pairs.selectExpr("b id")).distinct()
    want = C.components(ids, pairs).selectExpr("component cluster_id", "id")
    got = Z.near_clusters(similar, events, edges).checkpoint()
    assert sorted(map(tuple, got.select("cluster_id", "id").collect())) == sorted(map(tuple, want.collect()))
    coherence = {r.cluster_id: pytest.approx(r.coherence, abs=1e-9) for r in V.pair_coherence(want, pairs).collect()}
    assert {r.cluster_id: r.coherence for r in Z.near_coherence(similar, got, edges).collect()} == coherence


def test_times_apart_are_left_to_the_pairs(spark):
    rows = spark.createDataFrame([("a", 0), ("b", V.NEAR + 1)], "id string, time long")
    assert not Z.all_near(rows) and Z.all_near(rows.where("id = 'a'"))
    assert not Z.all_near(spark.createDataFrame([("a", None)], "id string, time long"))


def test_a_text_posted_often_costs_its_posts(spark):
    n = 20_000  # 200 million pairs
    events = spark.range(n).selectExpr("format_string('%05d', id) id", "1000L time", "concat('u', id % 900) author", "if(id % 2 = 0, array('p:a'), array('p:b')) entity")
    similar = S.similar_classes(events.selectExpr("id", "array(1.0D, 0.0D) v"), 0.85, True)
    edges = spark.createDataFrame([], "source string, target string")
    got = Z.near_clusters(similar, events, edges).checkpoint()
    assert [tuple(r) for r in got.groupBy("cluster_id").count().collect()] == [("00000", n)]
    assert Z.near_coherence(similar, got, edges).first().coherence == pytest.approx(1.0)


@pytest.mark.parametrize("seed, met", [(1, 1024), (2, 3)])
def test_conditions_are_counted_where_pairs_are_made(spark, monkeypatch, seed, met):
    similar, events, edges = given(spark, seed)
    want = V.condition_count(similar.expanded(), events, edges).where("satisfied >= 2").select("a", "b", "cos", "satisfied")
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(S, "MET", met)
    similar.expanded = lambda: pytest.fail("all pairs are made before they are tested")
    assert sorted(map(tuple, Z.similar_conditions(similar, events, edges).collect())) == want
