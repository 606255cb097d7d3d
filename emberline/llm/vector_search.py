"""Exact top-k inner products with vector-approximation files.

Vectors become integers floor(scale * x).  One pass over them finds each component's range; a second writes the
approximation file: per vector a cell number of one byte a component, on a grid over the range.  A search scans
cells only: blocks of queries meet blocks of cells, and a cell's middle and half width bound each inner product
from both sides.  The kth greatest lower bound of a query over all blocks is a floor that its kth score can't be
below, so only vectors whose upper bound reaches it stay.  Exact vectors are then joined by id in two steps: the
k best upper bounds of a query first, whose kth exact score is a higher floor, then those whose upper bound still reaches it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, written

QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
#: Cells a component's range is cut into.
CELLS = 256


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, dim, v (packed 64-bit integers).

    Left out: null ids, null vectors, vectors with a null or non-finite component, and components of 2**62 or
    more: neither they nor their products are 64-bit integers, so they have no score to return.
    """
    ship(vectors.sparkSession)

    def scan(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep, dims, out = [], [], []
            for i in range(len(column)):
                if ids[i].is_valid and column[i].is_valid:
                    values = column[i].values
                    if values.null_count == 0:
                        x = np.floor(scale * np.asarray(values, dtype=np.float64))
                        if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
                            keep.append(i)
                            dims.append(len(x))
                            out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pc.take(ids, pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").mapInArrow(scan, f"vec_id {kind}, dim int, v binary")


def _matrix(rows: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows["v"]), dtype="<i8").reshape(len(rows), dim)


def grids(ints: DataFrame) -> DataFrame:
    """One row for each number of components: dim, low and high (packed 64-bit integers), the range of every component."""

    def ranges(frames):
        for f in frames:
            for dim, rows in f.groupby("dim"):
                m = _matrix(rows, int(dim))
                yield pd.DataFrame({"dim": [dim], "low": [m.min(axis=0).tobytes()], "high": [m.max(axis=0).tobytes()]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low = np.min([np.frombuffer(x, "<i8") for x in rows["low"]], axis=0)
        high = np.max([np.frombuffer(x, "<i8") for x in rows["high"]], axis=0)
        return pd.DataFrame({"dim": [key[0]], "low": [low.tobytes()], "high": [high.tobytes()]})

    kind = "dim int, low binary, high binary"
    return ints.select("dim", "v").where("dim > 0").mapInPandas(ranges, kind).groupBy("dim").applyInPandas(merge, kind)


def approximations(ints: DataFrame, grid: DataFrame) -> DataFrame:
    """The approximation file: vec_id, dim, row (a number of its own), cells (a byte a component), low and high of the grid."""
    kind = dict(ints.dtypes)["vec_id"]

    def cut(frames):
        for f in frames:
            cells = []
            for v, low, high in zip(f["v"], f["low"], f["high"]):
                lo, width = _grid(low, high)
                cells.append(np.minimum((np.frombuffer(v, "<i8") - lo) / width, CELLS - 1).astype(np.uint8).tobytes())
            yield pd.DataFrame({"vec_id": f["vec_id"], "dim": f["dim"], "row": f["row"], "cells": cells})

    return ints.join(F.broadcast(grid), "dim").mapInPandas(cut, f"vec_id {kind}, dim int, row long, cells binary")


def _grid(low: bytes, high: bytes) -> tuple[np.ndarray, np.ndarray]:
    lo = np.frombuffer(low, "<i8").astype(np.float64)
    return lo, np.maximum(np.frombuffer(high, "<i8") - lo, 1.0) / CELLS


def bounded(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, cells: np.ndarray, low: bytes, high: bytes, k: int) -> pd.DataFrame:
    """Of a block: the candidates (query_id, vec_id, row, lower, upper) of each query that may be among its k best."""
    lo, width = _grid(low, high)
    qf = q.astype(np.float64)
    near = qf @ (lo + (cells + 0.5) * width).T
    # half a cell in every component, and room for rounding in the products
    far = np.maximum(np.abs(lo), np.abs(lo + CELLS * width))
    error = np.abs(qf) @ (width / 2) + (np.abs(qf) @ far) * 2.0**-44 + 1e-6
    out = []
    for i, own in enumerate(q_ids):
        other = np.flatnonzero(c_ids != own)
        if not len(other):
            continue
        mid = near[i, other]
        kk = min(k, len(other))
        floor_ = np.partition(mid, len(mid) - kk)[len(mid) - kk] - error[i]
        keep = other[mid + error[i] >= floor_]
        out.append(pd.DataFrame({"query_id": own, "vec_id": c_ids[keep], "row": c_rows[keep], "lower": near[i, keep] - error[i], "upper": near[i, keep] + error[i]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": q_ids[:0], "vec_id": c_ids[:0], "row": c_rows[:0], "lower": np.zeros(0), "upper": np.zeros(0)})


def _kth(rows: DataFrame, by: str, k: int, out: str) -> DataFrame:
    """(query_id, out): the kth greatest value of each query, or the least if it has fewer."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by)))
    return rows.withColumn("p", place).where(F.col("p") <= k).groupBy("query_id").agg(F.min(by).alias(out))


def _exact(pairs: DataFrame, asked: DataFrame, ints: DataFrame) -> DataFrame:
    """pairs(query_id, row, vec_id) with score, from the exact vectors of the rows."""
    kind = dict(pairs.dtypes)["vec_id"]
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    near = pairs.select("query_id", "row").join(ints.select("row", "vec_id", "v"), "row").join(q, "query_id").select("query_id", "vec_id", "q", "v")

    def product(frames):
        for f in frames:
            scores = []
            for a, b in zip(f["q"], f["v"]):
                x, y = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                small = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(len(x), 1) < 2.0**62
                scores.append(int(x @ y) if small else int(x.astype(object) @ y.astype(object)))
            yield pd.DataFrame({"query_id": f["query_id"], "vec_id": f["vec_id"], "score": scores})

    return near.mapInPandas(product, f"query_id {kind}, vec_id {kind}, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank (from 1), vec_id, score for the rows chosen by queries.

    A query meets every row of another vec_id and the same length.  A query with fewer partners than
    k gets all; repeated rows of one id count each as a candidate and once as a query (the first of
    its vectors in the order of their bytes).  Vectors without components take no part.  An empty table gives an empty table.
    """
    ints = written(integer_vectors(vectors, scale).where("dim > 0").withColumn("row", F.monotonically_increasing_id()), "integer-vectors")
    asked = written(ints.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v"), "queries")
    grid = written(grids(ints), "grids")
    file = written(approximations(ints, grid), "approximations")
    n, nq = file.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-nq // QUERY_ROWS))

    def block(blocks: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = asked.join(F.broadcast(grid), "dim").select("vec_id", "dim", "v", "low", "high", block(q_blocks, "vec_id").alias("qb"), every(c_blocks).alias("cb"))
    right = file.select("vec_id", "dim", "row", "cells", every(q_blocks).alias("qb"), block(c_blocks, "row").alias("cb"))
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"query_id {kind}, vec_id {kind}, row long, lower double, upper double"

    def scan(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "row": [], "lower": [], "upper": []})
        cells = np.frombuffer(b"".join(b["cells"]), dtype=np.uint8).reshape(len(b), dim)
        return bounded(a["vec_id"].to_numpy(), _matrix(a, dim), b["vec_id"].to_numpy(), b["row"].to_numpy(), cells, a["low"].iloc[0], a["high"].iloc[0], k)

    keys = ["dim", "qb", "cb"]
    found = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, schema), "bounds")
    alive = written(found.join(_kth(found, "lower", k, "floor"), "query_id").where("upper >= floor").drop("floor"), "candidates")
    # exact vectors in the order of their bounds: the k best first, then what may still pass the kth of them
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "row"))
    alive = alive.withColumn("place", place)
    first = written(_exact(alive.where(F.col("place") <= k), asked, ints), "first-scores")
    rest = alive.where(F.col("place") > k).join(_kth(first, "score", k, "kth"), "query_id").where("upper >= kth")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    scored = first.unionByName(_exact(rest, asked, ints))
    best = scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    best = written(best, "top-k")
    discard(found, file)
    return best


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
