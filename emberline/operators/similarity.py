"""Cosine similarity joins with prefix filtering, between classes of equal vectors.

Equal vectors (of one direction) form a class, named by its smallest id; only one vector of each class is
joined, so that a text posted n times costs one row and not n squared.

Dimensions are ordered by how many vectors hold them, rarest first.  A unit vector's prefix are its dimensions
up to where what follows has a norm below the threshold.  Two vectors that share no dimension of both prefixes
differ in all dimensions up to the end of the shorter prefix, so their inner product is at most the norm of
one's rest, which is below the threshold.  Vectors are therefore posted under the dimensions of their prefixes only,
and those posted under one dimension are compared.  A dimension with many vectors is dealt into blocks, and each
pair of blocks is one group, so that no task holds more than two blocks however common a dimension is.

Where the postings would cost more than all blocks of all vectors (dense vectors, low thresholds) all are
posted under one place; the rows are the same.  Where vectors would be dealt to more than SPREAD groups each, be it under
many dimensions or in many blocks, blocks are written once and compared from files instead (see blocks).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WIDE, block_pairs

#: Vectors on each side of a group.
TILE = 2048
#: Groups that a vector is sent to, on average, before blocks are compared from files.
SPREAD = 4
#: Rows of a class on each side of a group that are paired.
MET = 1024
#: Prefixes are longer by this much, against rounding.
_SLACK = 1e-9


@dataclass
class Similar:
    """members(id, rep): all vectors but zero ones; pairs(a, b, cos): similar classes, a < b; alone(id): zero vectors."""

    members: DataFrame
    pairs: DataFrame
    alone: DataFrame
    copies_pass: bool  # whether the copies of a class are similar to each other

    def ids(self) -> DataFrame:
        return self.members.select("id").unionByName(self.alone)

    def sizes(self) -> DataFrame:
        """(id, size) of the classes."""
        return self.members.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("size"))

    def spread(self, labels: DataFrame, label: str) -> DataFrame:
        """Labels of classes (id, label) for all their members; zero vectors are their own label."""
        found = self.members.join(labels.withColumnRenamed("id", "rep"), "rep").select("id", label)
        return found.unionByName(self.alone.select("id", F.col("id").alias(label)))

    def weights(self) -> DataFrame:
        """(id, weight): the sum of the cosines of each vector that is similar to others, copies too, without the pairs."""
        size = self.sizes()
        both = self.pairs.select("a", "b", "cos").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
        rows = both.join(size.toDF("b", "n"), "b").select(F.col("a").alias("rep"), (F.col("cos") * F.col("n")).alias("w"))
        if self.copies_pass:
            rows = rows.unionByName(size.where("size > 1").select(F.col("id").alias("rep"), (F.col("size") - 1).cast("double").alias("w")))
        return self.members.join(rows.groupBy("rep").agg(F.sum("w").alias("weight")), "rep").select("id", "weight")

    def counted(self) -> DataFrame:
        """One row (n, cos): how many pairs expanded() has, and the sum of their cosines."""
        size = self.sizes()
        rows = self.pairs.join(size.toDF("a", "p"), "a").join(size.toDF("b", "q"), "b").select((F.col("p") * F.col("q")).alias("n"), "cos")
        if self.copies_pass:
            rows = rows.unionByName(size.select(F.expr("size * (size - 1) div 2").alias("n"), F.lit(1.0).alias("cos")))
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("cos") * F.col("n")), F.lit(0.0)).alias("cos"))

    def expanded(self) -> DataFrame:
        """(a, b, cos) of all pairs of vectors, copies too: as many rows as there are pairs."""
        m = self.members
        a, b = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        out = self.pairs.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cos")
        if self.copies_pass:
            own = m.select("rep", F.col("id").alias("a")).join(m.select("rep", F.col("id").alias("b")), "rep").where("a < b")
            out = out.unionByName(own.select("a", "b", F.lit(1.0).alias("cos")))
        return out

    def met(self, rows: DataFrame) -> DataFrame:
        """rows(id, ...) -> (cos, id_x, ..._x, id_y, ..._y) of all pairs as in expanded(), either one x.

        Rows are joined to vectors before these are expanded, and a class with many is dealt into blocks, so that what is shuffled is
        a row and the pairs of blocks it is in, never a pair of rows.
        """
        from ..sources.stages import staged

        m = self.members.join(rows, "id")
        count = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        size = staged(count.select("rep", F.ceil(F.col("n") / MET).cast("int").alias("blocks"), "n"), "class-blocks")
        m = staged(m.join(size.drop("n"), "rep").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "class-rows")
        reach = self.pairs.select("a", "b", "cos")
        if self.copies_pass:
            reach = reach.unionByName(size.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cos")))
        blocks = size.select("rep", "blocks")
        dealt = reach.join(blocks.toDF("a", "p"), "a").join(blocks.toDF("b", "q"), "b")
        dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        dealt = staged(dealt.where("a <> b or i <= j").select("a", "i", "b", "j", "cos"), "block-pairs")
        side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in rows.columns]
        left = dealt.join(m.select(F.col("rep").alias("a"), F.col("block").alias("i"), *side("x")), ["a", "i"])
        right = dealt.drop("cos").join(m.select(F.col("rep").alias("b"), F.col("block").alias("j"), *side("y")), ["b", "j"])
        both = left.join(right, ["a", "i", "b", "j"]).where("a <> b or i <> j or id_x < id_y")
        return both.drop("a", "i", "b", "j")


def _reader():
    """A function that tasks get by value, so that workers need not have this package: offsets and values of a list column."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy(zero_copy_only=False)

    return lists


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vectors(id, v) -> (id, dims, w, key): the places and values, over the norm and rounded to 12 places, that are not 0, and a
    digest of both; null and zero vectors have none."""
    kind, lists = dict(vectors.dtypes)["id"], _reader()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = lists(batch.column(1).cast(pa.list_(pa.float64())))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            x = np.nan_to_num(x.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
            norm = np.sqrt(np.bincount(row, weights=x * x, minlength=batch.num_rows))
            w = np.round(x / np.where(norm > 0, norm, 1.0)[row], 12)
            some = np.flatnonzero(w)
            place = (np.arange(len(x)) - at[:-1][row]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=batch.num_rows))]).astype(np.int32)
            dims, held, offsets = place[some], w[some], pa.array(ends)
            key = [hashlib.blake2b(dims[s:t].tobytes() + held[s:t].tobytes(), digest_size=16).digest() for s, t in zip(ends[:-1], ends[1:])]
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(dims)), pa.ListArray.from_arrays(offsets, pa.array(held)), pa.array(key, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dims", "w", "key"])

    return vectors.select("id", "v").mapInArrow(sparse, f"id {kind}, dims array<int>, w array<double>, key binary")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(id, v) -> (id, u, key): each vector over its norm, rounded to 12 places, and a digest of it; null for a zero vector, and
    no row for one that is null or holds null."""
    kind, lists = dict(vectors.dtypes)["id"], _reader()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = lists(batch.column(1).cast(pa.list_(pa.float64())))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            norm = np.sqrt(np.bincount(row, weights=x * x, minlength=batch.num_rows))
            u = np.round(x / np.where(norm > 0, norm, 1.0)[row], 12) + 0.0
            key = [hashlib.blake2b(u[s:t].tobytes(), digest_size=16).digest() if n != 0 else None for s, t, n in zip(at[:-1], at[1:], norm)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(u)), pa.array(key, pa.binary())], names=["id", "u", "key"])

    known = vectors.select("id", "v").where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return known.mapInArrow(unit, f"id {kind}, u array<double>, key binary")


def postings(classes: DataFrame, threshold: float, order: dict[int, int]) -> DataFrame:
    """classes(id, dims, w) with posted: the dimensions of each prefix.  order: a dimension's place, rarest first."""
    kind, lists = dict(classes.dtypes)["id"], _reader()
    rank = np.zeros(max(order, default=0) + 1, dtype=np.int64)
    rank[list(order)] = list(order.values())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims = lists(batch.column(1))
            w = lists(batch.column(2))[1]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            by = np.lexsort((-rank[dims], row))  # commonest first: what follows a dimension comes before it here
            square = np.cumsum(w[by] ** 2)
            before = np.concatenate([[0], square])[at[:-1]][row]
            rest = np.empty(len(w))
            rest[by] = np.sqrt(np.maximum(square - before, 0))
            inside = np.flatnonzero(rest >= threshold - _SLACK)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[inside], minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(dims[inside].astype(np.int32)))], names=["id", "dims", "w", "posted"])

    return classes.select("id", "dims", "w").mapInArrow(post, f"id {kind}, dims array<int>, w array<double>, posted array<int>")


def _tiles(posted: DataFrame, sizes: dict[int, int], threshold: float, at_least: bool, width: int) -> DataFrame:
    """(a, b, cos) of the vectors that meet under a dimension; a pair may meet several times.  width: dimensions, over all vectors."""
    spark = posted.sparkSession
    kind, lists = dict(posted.dtypes)["id"], _reader()
    blocks = spark.createDataFrame([(d, max(1, -(-n // TILE))) for d, n in sizes.items()], "dim int, blocks int")  # a row a dimension
    p = posted.select("id", "dims", "w", F.explode("posted").alias("dim")).join(F.broadcast(blocks), "dim")
    p = p.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "id", "dims", "w")

    def dense(table: pa.Table) -> np.ndarray:
        out = np.zeros((len(table), width))
        if len(table):
            at, dims = lists(table.column("dims"))
            out[np.repeat(np.arange(len(table)), np.diff(at)), dims] = lists(table.column("w"))[1]
        return out

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        m = dense(table)
        if key[1] == key[2]:
            left = right = np.arange(len(ids))
        else:
            side = table.column("right").to_numpy()
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
        x, y, c = [], [], []
        for lo in range(0, len(left), TILE):  # a block may be somewhat over TILE
            cos = m[left[lo : lo + TILE]] @ m[right].T
            i, j = np.nonzero(cos >= threshold if at_least else cos > threshold)
            x, y, c = [*x, ids[left[lo + i]]], [*y, ids[right[j]]], [*c, cos[i, j]]
        a, b, cos = (np.concatenate(z) if z else np.zeros(0) for z in (x, y, c))
        if key[1] == key[2]:
            one = np.flatnonzero(np.fromiter((s < t for s, t in zip(a, b)), dtype=bool, count=len(a)))
            a, b, cos = a[one], b[one], cos[one]
        else:
            swap = np.flatnonzero(np.fromiter((s > t for s, t in zip(a, b)), dtype=bool, count=len(a)))
            a[swap], b[swap] = b[swap], a[swap].copy()
        return pa.table({"a": pa.array(a.tolist(), table.schema.field("id").type), "b": pa.array(b.tolist(), table.schema.field("id").type), "cos": pa.array(cos.astype(np.float64))})

    return p.groupBy("dim", "i", "j").applyInArrow(tile, f"a {kind}, b {kind}, cos double")


def plan_postings(classes: DataFrame, threshold: float) -> tuple[DataFrame, dict[int, int], int]:
    """(posted classes, vectors by dimension posted under, width); place -1 holds all where that is cheaper.

    The driver sees a row for each dimension of the vectors.
    """
    held = {r["dim"]: r["n"] for r in classes.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = max(held, default=0) + 1
    n = classes.count()
    together = classes.select("id", "dims", "w", F.array(F.lit(-1)).alias("posted")), {-1: n}, width
    if threshold <= _SLACK or n <= TILE:
        return together
    order = {d: i for i, (_, d) in enumerate(sorted((k, d) for d, k in held.items()))}
    posted = postings(classes, threshold, order)  # not written: made again is cheaper than a further copy of the vectors
    sizes = {r["dim"]: r["n"] for r in posted.select(F.explode("posted").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    return (posted, sizes, width) if sum(k * k for k in sizes.values()) < n * n else together


def similar_classes(vectors: DataFrame, threshold: float, at_least: bool = False, forest: bool = False) -> Similar:
    """vectors(id, v), ids distinct -> classes of vectors of one direction, and pairs of classes with cosine above (or at) the threshold.

    Zero and null vectors are similar to nothing, not even to their copies.  With forest, where only components are asked for, pairs of
    classes may be left out that join nothing new.
    """
    from ..sources.stages import staged

    rows = staged(unit_rows(vectors), "unit-vectors")
    some = rows.where(F.size("dims") > 0)
    passes = 1.0 >= threshold if at_least else 1.0 > threshold
    alone = rows.where(F.size("dims") == 0).select("id")
    if passes:  # classes are found by digests, so that the vectors themselves are shuffled once
        first = staged(some.groupBy("key").agg(F.min("id").alias("id")), "class-names")
        classes = staged(some.join(first.select("id"), "id", "left_semi").select("id", "dims", "w"), "vector-classes")
        members = staged(some.select("id", "key").join(first.withColumnRenamed("id", "rep"), "key").select("id", "rep"), "vector-members")
    else:
        classes, members = some, some.select("id", F.col("id").alias("rep"))
    posted, sizes, width = plan_postings(classes, threshold)
    if sum(k * -(-k // TILE) for k in sizes.values()) > SPREAD * max(n := classes.count(), 1) and width <= WIDE:
        pairs = block_pairs(classes, threshold, at_least, n, width, forest=forest)
    else:
        met = _tiles(posted, sizes, threshold, at_least, width)
        pairs = met if len(sizes) == 1 else met.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    return Similar(members, staged(pairs, "class-pairs"), alone, passes)


def similar_components(vectors: DataFrame, threshold: float, at_least: bool = False) -> DataFrame:
    """(id, component): the smallest id that can be reached over similar vectors; copies follow their class."""
    from .cluster import components

    s = similar_classes(vectors, threshold, at_least, forest=True)
    return s.spread(components(s.members.select(F.col("rep").alias("id")).distinct(), s.pairs), "component")


def similar_density(vectors: DataFrame, threshold: float, least: int = 2, at_least: bool = True) -> DataFrame:
    """(id, component): DBSCAN with a vector's copies among its neighbours; see density_clusters."""
    from .cluster import density_clusters

    # with two every vector next to another is a core point, so clusters are components
    s = similar_classes(vectors, threshold, at_least, forest=least <= 2)
    found = density_clusters(s.sizes(), s.pairs, least)
    rows = s.members.join(found.withColumnRenamed("id", "rep"), "rep")
    own = rows.select("id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("component")).alias("component"))
    return own.unionByName(s.alone.select("id", F.col("id").alias("component")))


def similar_leaders(vectors: DataFrame, threshold: float, least: int = 2, at_least: bool = False) -> DataFrame:
    """(id, leader): in order of id, a vector that no cluster holds yet takes all free similar ones if they are `least`, itself counted.

    A vector that finds too few stays free and may be taken later; who is never taken is its own leader.
    """
    from .cluster import counted_leaders

    s = similar_classes(vectors, threshold, at_least)
    found = counted_leaders(s.sizes(), s.pairs, least)
    rows = s.members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    return rows.unionByName(s.alone.select("id", F.col("id").alias("leader")))
