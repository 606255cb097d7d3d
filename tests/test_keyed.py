"""Key and time joins with hot keys, and leader clustering in growing blocks, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberline.operators import events as V
from emberline.operators import keyed as K

SCHEMA = "id string, time long, entity array<string>, author string, action string, anchor_id string"


def given(rng, n, hot=0.5):
    return [
        (f"{i:04d}", rng.choice([None, *range(0, 500, 7)]) if i % 9 == 0 else rng.randrange(500) * 3600, ["hot"] * (rng.random() < hot) + [rng.choice("pqrs|")] * (rng.random() < 0.5), rng.choice(["", "x", "y"]), rng.choice([None, "a", "b"]), rng.choice(["", "", "k1"]))
        for i in range(n)
    ]


def near(x, y):
    return x[1] is not None and y[1] is not None and abs(x[1] - y[1]) <= V.NEAR


def weight(x, y):
    shared, same = bool(set(x[2]) & set(y[2])), x[4] is not None and x[4] == y[4]
    two = x[3] != y[3] and x[3] and y[3]
    return 10.0 if x[5] and x[5] == y[5] else 8.0 if shared and same else 6.0 if shared and near(x, y) else 4.0 if two and near(x, y) and same else 0.0


def conditions(x, y, linked):
    return sum((near(x, y), bool(set(x[2]) & set(y[2])), bool(x[3] and y[3] and x[3] != y[3]), x[4] is not None and x[4] == y[4], (x[0], y[0]) in linked))


@pytest.fixture(params=[(5000, 2048), (3, 4)], ids=["sent", "dealt"])
def sizes(request, monkeypatch):
    """The side that is sent to all tasks, and the blocks of a hot key."""
    monkeypatch.setattr(K, "SMALL", request.param[0])
    monkeypatch.setattr(K, "BLOCK", request.param[1])


def test_pairs_equal_the_loops(spark, sizes):
    events = given(random.Random(1), 60)
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    both = [(x, y) for i, x in enumerate(events) for y in events[i + 1 :]]
    assert sorted(map(tuple, V.near_pairs(df).collect())) == [(x[0], y[0]) for x, y in both if near(x, y)]
    assert sorted(map(tuple, V.weighted_pairs(df).collect())) == [(x[0], y[0], weight(x, y)) for x, y in both if weight(x, y)]
    linked = {(x[0], y[0]) for x, y in both if random.Random(x[0] + y[0]).random() < 0.05}
    edges = spark.createDataFrame([(b, a) for a, b in linked], "source string, target string")
    want = [(x[0], y[0], conditions(x, y, linked)) for x, y in both if conditions(x, y, linked) >= 2]
    assert sorted(map(tuple, V.condition_pairs(df, edges).collect())) == want


def test_a_hot_key_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "SMALL", 10)
    monkeypatch.setattr(K, "BLOCK", 50)
    rows = [(i, "hot" if i % 2 else f"cold{i}") for i in range(2000)]
    left, right = spark.createDataFrame(rows, "a long, k string"), spark.createDataFrame(rows, "b long, k string")
    counts = spark.createDataFrame([("hot", 1000, 1000)], "k string, l long, r long")
    groups = Counter((r.k, r.i, r.j) for r in K._dealt(left, counts, "a", "l", "r", "i", "j").collect())
    hot = {g: n for g, n in groups.items() if g[0] == "hot"}
    assert len(hot) == 400 and max(hot.values()) < 100
    assert K.shared_key_pairs(left, right).count() == 1000 * 999 // 2


@pytest.mark.parametrize("block,most", [(13, 0), (1000, 10**6)])
def test_block_leaders_of_conditions_equal_the_loop(spark, sizes, block, most):
    events = given(random.Random(block + most), 45, hot=0.2)
    df = spark.createDataFrame(events, SCHEMA).repartition(4)
    linked = {(events[2][0], events[40][0])}
    edges = spark.createDataFrame(list(linked), "source string, target string")
    for by_weight, value, pairs in (
        (True, weight, lambda leaders, e: V.weighted_pairs(e, leaders)),
        (False, lambda x, y: float(conditions(x, y, linked) >= 3), lambda leaders, e: V.condition_pairs(e, edges, leaders, 3).select("a", "b", F.lit(1.0).alias("weight"))),
    ):
        lead, want = [], {}
        for y in events:
            fits = [(-value(x, y) if by_weight else 0, x[0]) for x in lead if value(x, y)]
            want[y[0]] = min(fits)[1] if fits else y[0]
            if not fits:
                lead.append(y)
        got = {r.id: r.leader for r in V.block_leaders(df, pairs, block, by_weight, most).collect()}
        assert got == want


def test_many_events_that_never_meet_take_few_rounds(spark):
    rounds = []

    def pairs(leaders, events):
        rounds.append(1)
        return leaders.where("id < 0").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("weight"))

    found = V.block_leaders(spark.range(200_000), pairs)
    assert found.where("id = leader").count() == 200_000 and len(rounds) <= 2 * 20


def test_a_hot_ticker_costs_its_clusters(spark, monkeypatch):
    seen = []
    real = V.shared_key_pairs
    monkeypatch.setattr(V, "shared_key_pairs", lambda a, b: seen.append(a.count() * b.count()) or real(a, b))
    n = 3000
    members = spark.range(n).selectExpr("format_string('%05d', id) cluster_id", "id")
    entities = spark.range(n).selectExpr("format_string('%05d', id) cluster_id", "'tickers' kind", "if(id % 3 = 0, '$OWN', '$HOT') name")
    none = spark.createDataFrame([], "cluster_id string, phrase string")
    got = V.merge_events(members, entities, none)
    assert {(r.cluster_id, r.n) for r in got.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()} == {("00000", 1000), ("00001", 2000)}
    assert V.merge_events(members.where("false"), entities, none).count() == 0


def test_a_chain_within_a_block_takes_no_rounds(spark, monkeypatch):
    from emberline.operators import cluster as C

    monkeypatch.setattr(C, "leaders", lambda *a, **k: pytest.fail("settled by rounds"))
    events = spark.range(300).selectExpr("cast(id as string) id", "id n")

    def pairs(leaders, events):  # each meets the next in order of its name
        names = sorted(str(i) for i in range(300))
        chain = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
        return chain.join(leaders.selectExpr("id a"), "a", "left_semi").join(events.selectExpr("id b"), "b", "left_semi").select("a", "b", F.lit(1.0).alias("weight"))

    names = sorted(str(i) for i in range(300))
    want = {x: names[i - i % 2] for i, x in enumerate(names)}
    assert {r.id: r.leader for r in V.block_leaders(events, pairs, 300).collect()} == want


def test_pairs_are_tested_where_they_are_made(spark, monkeypatch, sizes):
    monkeypatch.setattr(V, "shared_key_pairs", lambda a, b: pytest.fail("pairs made before they are tested"))
    events = given(random.Random(7), 50)
    got = V.weighted_pairs(spark.createDataFrame(events, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(x[0], y[0], weight(x, y)) for i, x in enumerate(events) for y in events[i + 1 :] if weight(x, y)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]  # pairs aren't grouped after they meet
