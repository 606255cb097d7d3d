"""The quality classifier: word vectors against a loop, gradients, calibration, held-out accuracy, odd input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import quality
from emberline.llm.quality import BITS, DIM, REACH, Network, Tokens, classify, context_sums, digest, index_vectors, keep_quality, pooled, word_vectors


def tokens(*texts):
    raw = [t.encode() for t in texts]
    return Tokens(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(t) for t in raw]))


def test_tokens_and_shapes():
    t = tokens("Abc!! dé\t7x", "", "THE %% É the", "..")
    assert t.first.tolist() == [0, 4, 4, 8, 9]
    assert t.shape.tolist() == [3, 0, 4, 1, 2, 0, 5, 4, 0]
    same = tokens("the the The the!").bucket
    assert same[0] == same[1] == same[3] != same[2]
    assert len(tokens("", " \n").bucket) == 0


def test_context_sums_equal_the_loop():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c dd ! é".split()) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    t, index = tokens(*texts), index_vectors()
    assert (np.abs(index).sum(axis=1) == quality.ONES).all()
    want = np.zeros((1 << BITS, DIM))
    for a, b in zip(t.first[:-1], t.first[1:]):
        for i in range(a, b):
            for j in range(max(a, i - REACH), min(b, i + REACH + 1)):
                if i != j:
                    want[t.bucket[i]] += index[t.bucket[j]]
    for chunk in (1 << 18, 7, 1):
        got = np.zeros((1 << BITS, DIM))
        context_sums(t, index, got, chunk)
        assert (got == want).all()


def test_pooling_in_chunks_equals_whole():
    rng = np.random.default_rng(2)
    vectors, index = rng.normal(size=(1 << BITS, DIM)).astype(np.float32), index_vectors()
    texts = ["a b! c", "", "x " * 50, "One TWO 3 é", "  ", "end"]
    whole = pooled(tokens(*texts), vectors, index)
    for chunk in (1, 3, 20):
        assert np.allclose(pooled(tokens(*texts), vectors, index, chunk), whole, atol=5e-3)  # the spread is a difference of sums
    for i, x in enumerate(texts):
        assert np.allclose(pooled(tokens(x), vectors, index)[0], whole[i], atol=5e-3)
    assert (whole[1] == 0).all() and (whole[4] == 0).all()
    assert whole[2, -1] == pytest.approx(49 / 50)


def test_gradient():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 5)), (rng.random(30) < 0.5).astype(float)
    y[:2] = 0, 1
    net = Network(x, y, np.ones(30))
    z, w = net.standard(x), rng.random(30)

    def loss():
        m = np.tanh(z @ net.p["w"] + net.p["b"]) @ net.p["v"] + net.p["c"][0]
        decay = sum((net.p[k] ** 2).sum() for k in "wv") * quality.DECAY / 2
        return (w * (np.logaddexp(0, m) - y * m)).sum() / len(y) + decay

    g = net.gradient(z, y, w)
    for k, v in net.p.items():
        at = tuple(rng.integers(s) for s in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        assert g[k][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-7)
        v[at] += 1e-5


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(4)
    logit = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert Network.calibrated(3 * logit, y, np.ones(20000)) == pytest.approx(3, rel=0.1)


def test_word_vectors_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"w{i % 7} the w{i % 5}, and w{i % 3}!",) for i in range(60)] + [(None,), ("",)], "text string")
    a, b = word_vectors(df.repartition(1)), word_vectors(df.repartition(5))
    assert (a == b).all() and set(np.round(np.linalg.norm(a, axis=1), 5)) == {0.0, 1.0}


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = digest(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.95
    assert np.mean([r.predicted == 0 for r in got if r.quality == 0]) >= 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_odd_input(spark):
    texts = [None, "", " ", "same", "same", "é", "word " * 20000]
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)] + [(None, "x", "clash", 0.5), (3, "other", "clash", 0.5)], "doc_id long, text string, score string, `a.b` double")
    some = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None), (6, 7), (99, 1)], "doc_id long, quality int")
    got = classify(docs, some, F.lit(True))
    assert sorted(got.columns) == ["a.b", "doc_id", "score", "text"]
    rows = got.collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r["a.b"] == 0.5 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "", " ")}) == 1
    assert {r.score for r in classify(docs, some.where("false"), F.lit(True)).collect()} == {0.5}
    assert {r.score for r in classify(docs, some.where("doc_id = 4"), F.lit(True)).collect()} == {0.0}
    assert digest(docs.where("false"), some).count() == 0
    kept = keep_quality(docs.withColumn("quality_score", F.lit(1)), some.where("doc_id = 4"))
    assert kept.count() == 0 and kept.columns == [*docs.columns, "quality_score"]
