"""Blocks of vectors compared from files, against plain loops."""

import numpy as np
import pytest

from emberline.operators import blocks as B
from emberline.operators import similarity as S


def made(spark, n=120, dims=40):
    rng = np.random.default_rng(11)
    v = np.abs(rng.normal(size=(n, dims))) * (rng.random((n, dims)) < 0.5)
    v[: n // 3] = v[n // 3 : n // 3 * 2] + rng.normal(0, 0.05, (n // 3, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v, spark.createDataFrame([(f"d{i}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>")


def near(v, threshold):
    c = v @ v.T
    return {tuple(sorted((f"d{i}", f"d{j}"))) for i in range(len(v)) for j in range(i) if c[i, j] >= threshold}


@pytest.mark.parametrize("threshold,kept", [(0.95, 8), (0.6, 96), (-0.5, 4)])
def test_block_pairs_equal_the_loop(spark, monkeypatch, threshold, kept):
    monkeypatch.setattr(B, "KEPT", kept)
    v, df = made(spark)
    got = B.block_pairs(S.unit_rows(df), threshold, True, len(v), v.shape[1], side=25).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == near(v, threshold)


def test_vectors_are_not_sent_to_every_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 10)
    monkeypatch.setattr(S, "_tiles", lambda *a: pytest.fail("dealt to pairs of blocks"))
    v, df = made(spark)
    assert {(r.a, r.b) for r in S.similar_classes(df, 0.9, True).pairs.collect()} == near(v, 0.9)


def test_vectors_are_not_written_again_with_their_postings(spark, monkeypatch):
    from emberline.sources import stages

    monkeypatch.setattr(S, "TILE", 10)
    names, was = [], stages.staged
    monkeypatch.setattr(stages, "staged", lambda df, name: names.append(name if {"dims", "w"} <= set(df.columns) else "") or was(df, name))
    v, df = made(spark)
    assert {(r.a, r.b) for r in S.similar_classes(df, 0.9, True).pairs.collect()} == near(v, 0.9)
    assert sorted(filter(None, names)) == ["unit-vectors", "vector-classes"]


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_components_come_from_a_forest_of_the_pairs(spark, monkeypatch, threshold):
    from emberline.operators.cluster import components

    v, df = made(spark)
    want = near(v, threshold)
    got = [(r.a, r.b) for r in B.block_pairs(S.unit_rows(df), threshold, True, len(v), v.shape[1], side=25, forest=True).collect()]
    assert set(got) <= want and len(got) < 5 * len(v) and (threshold > 0.8 or len(want) > 20 * len(v))  # a vector is in five pairs of blocks
    label = {f"d{i}": f"d{i}" for i in range(len(v))}
    for _ in label:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(got, "a string, b string")
    assert dict(components(df.select("id"), frame).collect()) == label
    monkeypatch.setattr(S, "TILE", 10)
    monkeypatch.setattr(S, "_tiles", lambda *a: pytest.fail("dealt to pairs of blocks"))
    assert dict(S.similar_components(df, threshold, True).collect()) == label


def test_pairs_that_are_joined_already_are_not_computed_again(spark, monkeypatch):
    v, df = made(spark, 240)
    for rows, columns in ((7, 9), (256, 1024)):
        monkeypatch.setattr(B, "ROWS", rows)
        monkeypatch.setattr(B, "COLUMNS", columns)
        for threshold in (0.9, 0.3):
            assert {(r.a, r.b) for r in B.block_pairs(S.unit_rows(df), threshold, True, len(v), v.shape[1], side=60).collect()} == near(v, threshold)
            got = [(r.a, r.b) for r in B.block_pairs(S.unit_rows(df), threshold, True, len(v), v.shape[1], side=240, forest=True).collect()]
            assert set(got) <= near(v, threshold) and len(got) < len(v)  # one block: a forest of it


def test_sketches_are_as_long_as_the_sample_asks_for(spark):
    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(400, 128)))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = S.unit_rows(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    few, many = (B._basis(rows, len(v), 128, t).shape for t in (0.97, 0.7))
    assert few[0] == many[0] == 128 and few[1] < 96 < many[1]


def test_density_clusters_of_two_make_no_pairs(spark, monkeypatch):
    v, df = made(spark)
    plain, asked = S.block_pairs, []
    monkeypatch.setattr(S, "TILE", 10)
    monkeypatch.setattr(S, "block_pairs", lambda *a, **k: asked.append(k["forest"]) or plain(*a, **k))
    for least in (2, 3):
        S.similar_density(df, 0.9, least).count()
    assert asked == [True, False]
