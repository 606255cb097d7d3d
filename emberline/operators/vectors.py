"""Hashed text embeddings and similarity joins over them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assets
from .text import per_post


def _hashed(least: int, top: int | None):
    """The 256 sums of word weights of each post, a function that tasks get by value.

    A word weighs log(1 + count) times a bonus for length, both rounded once, so that words of equal weight are tied here as in SQL;
    its dimension is the last byte of its md5.
    """

    def sums(row, word, words, n, posts):
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, each = np.unique(n, return_inverse=True)
        log = np.array([math.log(1 + int(k)) for k in counts], np.float64)
        w = log[each] * np.where(length > 3, (length + 7) / 10, 1.0)[word]
        used = np.unique(word)
        dim = np.zeros(len(words), np.int64)
        dim[used] = [hashlib.md5(x.encode()).digest()[-1] for x in words.take(pa.array(used, pa.int64())).to_pylist()]
        if top and len(row) and np.bincount(row).max() > top:
            order = np.empty(len(words), np.int64)
            order[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            by = np.lexsort((order[word], -w, row))
            by = np.sort(by[np.arange(len(by)) - np.searchsorted(row, row) < top])
            row, word, w = row[by], word[by], w[by]
        return np.bincount(row * 256 + dim[word], weights=w, minlength=posts * 256).reshape(posts, 256)

    return sums


def hash_embedding(posts: DataFrame, least: int = 3, stops: tuple[str, ...] = assets.EMBEDDING_STOPS, top: int | None = 256) -> DataFrame:
    """posts(tweet_id, text) -> (tweet_id, dim, w): unit vectors of 256 hashed dimensions, as long rows; see _hashed."""
    sums = _hashed(least, top)

    def long(row, word, words, n, first, posts):
        v = sums(row, word, words, n, posts)
        at, dim = np.nonzero(v)
        return at, [pa.array(dim, pa.int32()), pa.array(v[at, dim] / np.sqrt((v * v).sum(axis=1))[at], pa.float64())]

    return per_post(posts, least, stops, long, "dim int, w double")


def hash_vectors(posts: DataFrame, least: int = 3, stops: tuple[str, ...] = assets.EMBEDDING_STOPS, top: int | None = 256) -> DataFrame:
    """posts(tweet_id, text) -> (tweet_id, v array<double>): the vectors of hash_embedding, a row a post, without a shuffle."""
    sums = _hashed(least, top)

    def vectors(row, word, words, n, first, posts):
        v = sums(row, word, words, n, posts)
        norm = np.sqrt((v * v).sum(axis=1))
        some = np.flatnonzero(norm)
        offsets = pa.array(np.arange(len(some) + 1) * 256, pa.int32())
        return some, [pa.ListArray.from_arrays(offsets, pa.array((v[some] / norm[some, None]).ravel(), pa.float64()))]

    return per_post(posts, least, stops, vectors, "v array<double>")


def rank_embedding(posts: DataFrame, size: int = 128) -> DataFrame:
    """(tweet_id, dim, w): the i-th distinct word in order of appearance fills slot i with log(1 + count), unit norm."""

    def slots(row, word, words, n, first, posts):
        by = np.lexsort((word, first, row))
        dim = np.arange(len(by)) - np.searchsorted(row, row)
        by, dim = by[dim < size], dim[dim < size]
        row, w = row[by], np.log1p(n[by])
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=posts))
        return row, [pa.array(dim, pa.int32()), pa.array(w / norm[row], pa.float64())]

    return per_post(posts, 3, (), slots, "dim int, w double")


def dense(long: DataFrame, size: int = 256) -> DataFrame:
    """(tweet_id, v array<double>) from long rows."""
    filled = long.groupBy("tweet_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "w"))).alias("m"))
    return filled.select("tweet_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


def embed(posts: DataFrame, embedder=None, most: int = 8000, batch: int = 256, strict: bool = False) -> DataFrame:
    """posts(tweet_id, text) -> (tweet_id, v, hashed): vectors by an embedder, a function from a list of texts to a list of vectors.

    Texts are cut to `most` characters and sent in batches from the tasks; a batch that fails, or no embedder at all,
    gets hashed vectors instead, marked as hashed: they may be of another length, so that sides must not be compared; with
    strict it fails instead.  A text without words has no hashed vector and no row.
    """
    if embedder is None:
        return hash_vectors(posts).withColumn("hashed", F.lit(True))
    kind = dict(posts.dtypes)["tweet_id"]

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                try:
                    v = [list(map(float, x)) for x in embedder([(t or "")[:most] for t in part["text"]])]
                except Exception:  # whatever the service raised: these rows fall back
                    if strict:
                        raise
                    v = [None] * len(part)
                yield pd.DataFrame({"tweet_id": part["tweet_id"], "v": v})

    from ..sources.stages import staged

    found = staged(posts.select("tweet_id", "text").mapInPandas(run, f"tweet_id {kind}, v array<double>"), "embedded")
    rest = posts.join(found.where("v is null").select("tweet_id"), "tweet_id", "left_semi")
    return found.where("v is not null").withColumn("hashed", F.lit(False)).unionByName(hash_vectors(rest).withColumn("hashed", F.lit(True)))


def similar_pairs(vectors: DataFrame, threshold: float, at_least: bool = False) -> DataFrame:
    """vectors(tweet_id, v) -> (a, b, cos) with a < b and cosine above (or at) the threshold; zero vectors match nothing.

    All pairs, also those of copies: clusters are made from classes instead, see similarity.
    """
    from .similarity import similar_classes

    return similar_classes(vectors.withColumnRenamed("tweet_id", "id"), threshold, at_least).expanded()


def first_members(members: DataFrame, most: int = 10) -> DataFrame:
    """members(cluster_id, tweet_id) -> (cluster_id, tweet_id, p): a cluster's first posts by id, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("tweet_id"))
    return members.select("cluster_id", "tweet_id").withColumn("p", place).where(F.col("p") <= most)


def coherence(members: DataFrame, vectors: DataFrame, most: int = 10) -> DataFrame:
    """members(cluster_id, tweet_id) -> mean cosine over pairs of a cluster's first posts (by id); 0 for one post."""
    first = first_members(members, most).join(vectors, "tweet_id")
    own = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("x"))  # at most `most` vectors
    flat = own.select("cluster_id", "x", F.posexplode("x").alias("i", "a"))
    pair = flat.select("cluster_id", "a", F.explode_outer(F.slice("x", F.col("i") + 2, most)).alias("b"))
    cos = F.aggregate(F.zip_with("a.v", "b.v", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return pair.groupBy("cluster_id").agg(F.coalesce(F.avg(cos), F.lit(0.0)).alias("coherence"))
