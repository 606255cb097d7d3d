"""All pairs of dense unit vectors above a cosine, block by block, from files that tasks map into memory.

Vectors are dealt into blocks by a hash of their ids and written once, as one file a block in the shared folder, which has to
be mounted; a task compares two blocks.  So what is written and shuffled grows with the vectors, not with the pairs of blocks.

A block holds the sparse rows and a sketch: the first coordinates in another orthonormal basis, and the norm of the rest.
An inner product of two sketches is at least that of the vectors, so pairs whose sketches stay below the threshold are
dropped and only the others are computed in full.  The basis and the number of coordinates come from a bounded sample (SAMPLE vectors, by
hash); they decide how many pairs are dropped early, never which are found.  Where only components are asked for, pairs whose ends are joined
already are dropped too.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; vectors that the basis is made from; widest vectors.
SIDE, SAMPLE, WIDE = 16_384, 20_000, 1024
#: Coordinates of a sketch; None takes those for which a sample's pairs cost least.
KEPT: int | None = None
#: Vectors of the sample whose pairs are tried; what a pair that is computed in full costs, in coordinates of sketches.
TRIED, FULL = 1024, 20_000
#: Rows and columns of sketches that are multiplied at once, few enough for a processor's cache.
ROWS, COLUMNS = 256, 1024
#: Sketches are single precision: pairs count as possible from so much below the threshold.
SLACK = 1e-4


def _dense(width: int):
    """A function that tasks get by value: (offsets, dims, values) and row numbers to a matrix."""

    def dense(rows: tuple, at: np.ndarray) -> np.ndarray:
        start, dims, w = rows
        n = start[at + 1] - start[at]
        out = np.zeros((len(at), width))
        cell = np.repeat(start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)), n), dims[cell]] = w[cell]
        return out

    return dense


def _basis(classes: DataFrame, n: int, width: int, threshold: float) -> np.ndarray:
    """Orthonormal columns, those along which a sample of the vectors is longest first, as many as a sketch keeps; the driver sees one matrix."""
    dense, fixed = _dense(width), KEPT
    tries = [k for k in (16, 32, 48, 64, 96, 128, 160, 192, 256, 384, 512, 768) if k < width] + [width]

    def made(batches):
        total, some = np.zeros((width, width)), []
        for batch in batches:
            dims, w = batch.column(0), batch.column(1)
            start = dims.offsets.to_numpy() - dims.offsets[0].as_py()
            m = dense((start, dims.flatten().to_numpy(), w.flatten().to_numpy()), np.arange(batch.num_rows))
            total += m.T @ m
            some.append(m[: TRIED - sum(map(len, some))])
        turn = np.linalg.eigh(total)[1][:, ::-1]
        kept = fixed
        if kept is None:
            own = np.concatenate([np.zeros((0, width)), *some]) @ turn
            upper = np.triu_indices(len(own), 1)

            def cost(k: int) -> float:
                rest = np.sqrt(np.maximum((own[:, k:] ** 2).sum(axis=1), 0))
                met = (own[:, :k] @ own[:, :k].T + np.outer(rest, rest))[upper] >= threshold - SLACK
                return k + FULL * (met.mean() if len(met) else 0.0)

            kept = min(tries, key=cost)
        turn = turn[:, : min(kept, width)]
        yield pa.RecordBatch.from_arrays([pa.array([turn.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    some = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1))))
    m = some.select("dims", "w").repartition(1).mapInArrow(made, "m array<double>").first()["m"]
    return np.array(m).reshape(width, -1).astype(np.float32)


def _forest():
    """A function that tasks get by value: (root, p, q) to the places of those pairs that join two trees; root is changed along."""

    def grow(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        while not np.array_equal(further := root[root], root):
            root[:] = further
        s, t = root[p], root[q]
        apart = np.flatnonzero(s != t)
        _, first = np.unique(np.minimum(s, t)[apart] * len(root) + np.maximum(s, t)[apart], return_index=True)
        kept = []
        for i in apart[first].tolist():
            x, y = top(s[i]), top(t[i])
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(i)
        while not np.array_equal(further := root[root], root):
            root[:] = further
        return np.array(kept, np.int64)

    return grow


def block_pairs(classes: DataFrame, threshold: float, at_least: bool, n: int, width: int, side: int | None = None, forest: bool = False) -> DataFrame:
    """classes(id, dims, w) of unit vectors, n in all -> (a, b, cos) with a < b and cosine above (or at) the threshold.

    With forest a pair of blocks gives only pairs that join its vectors to the same components as all would: fewer than it has vectors.
    """
    from ..sources.stages import shared_folder, track

    spark, dense, grow = classes.sparkSession, _dense(width), _forest()
    kind = dict(classes.dtypes)["id"]
    side = side or min(SIDE, max(2048, -(-n // 8)))
    blocks = max(1, -(-n // side))
    basis = _basis(classes, n, width, threshold)
    folder = shared_folder(spark).removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {folder}")
    folder = track(f"{folder}/stage-blocks-{uuid.uuid4().hex[:12]}")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["id", "dims", "w"]).combine_chunks()
        dims, w = table.column("dims").chunk(0), table.column("w").chunk(0)
        rows = dims.offsets.to_numpy() - dims.offsets[0].as_py(), dims.flatten().to_numpy(), w.flatten().to_numpy()
        sketch = np.empty((len(table), basis.shape[1] + 1), np.float32)
        for lo in range(0, len(table), 2048):
            m = dense(rows, np.arange(lo, min(lo + 2048, len(table))))
            own = m.astype(np.float32) @ basis
            sketch[lo : lo + 2048, :-1] = own
            sketch[lo : lo + 2048, -1] = np.sqrt(np.maximum((m * m).sum(axis=1) - (own.astype(np.float64) ** 2).sum(axis=1), 0))
        table = table.append_column("sketch", pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), sketch.shape[1]))
        os.makedirs(folder, exist_ok=True)
        partial = f"{folder}/{uuid.uuid4().hex}"
        with pa.OSFile(partial, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table, max_chunksize=len(table))
        os.replace(partial, f"{folder}/{key[0]}.arrow")
        return pa.table({"block": pa.array([key[0]], pa.int32())})

    dealt = classes.select("id", "dims", "w", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    there = {r["block"] for r in dealt.groupBy("block").applyInArrow(write, "block int").collect()}  # a row a block

    def read(block: int) -> tuple:
        table = pa.ipc.open_file(pa.memory_map(f"{folder}/{block}.arrow")).read_all()
        ids, dims, w, sketch = (table.column(c).chunk(0) for c in ("id", "dims", "w", "sketch"))
        return ids, (dims.offsets.to_numpy(), dims.values.to_numpy(), w.values.to_numpy()), sketch.values.to_numpy().reshape(len(ids), -1)

    def compare(batches):
        names = ["a", "b", "cos"]
        for batch in batches:
            for number in batch.column(0).to_pylist():
                j = int(((8 * number + 1) ** 0.5 - 1) / 2)
                j += (j + 1) * (j + 2) // 2 <= number
                i = number - j * (j + 1) // 2
                if i not in there or j not in there:
                    continue
                left, right = read(i), read(j)
                shift = 0 if i == j else len(left[0])
                root = np.arange(shift + len(right[0])) if forest else None
                whole = None  # rows of the left block in full
                for hi in range(0, len(right[0]), COLUMNS):
                    to, part, found = min(hi + COLUMNS, len(right[0])), None, []
                    for lo in range(0, to if i == j else len(left[0]), ROWS):
                        bound = left[2][lo : lo + ROWS] @ right[2][hi:to].T
                        rows = np.flatnonzero(bound.max(axis=1) >= threshold - SLACK)
                        if not len(rows):
                            continue
                        p, q = np.nonzero(bound[rows] >= threshold - SLACK)
                        p, q = rows[p], q
                        if i == j:
                            p, q = p[lo + p < hi + q], q[lo + p < hi + q]
                        if forest:  # nothing new between what is joined already
                            apart = np.flatnonzero(root[lo + p] != root[shift + hi + q])
                            p, q = p[apart], q[apart]
                        if not len(p):
                            continue
                        whole = dense(left[1], np.arange(len(left[0]))) if whole is None else whole
                        part = dense(right[1], np.arange(hi, to)) if part is None else part
                        if 32 * len(p) > bound.size:
                            cos = (whole[lo : lo + ROWS] @ part.T)[p, q]
                        else:
                            cos = np.einsum("ij,ij->i", whole[lo + p], part[q])
                        some = np.flatnonzero(cos >= threshold if at_least else cos > threshold)
                        if forest and len(some):
                            some = some[grow(root, lo + p[some], shift + hi + q[some])]
                        if len(some):
                            found.append((lo + p[some], hi + q[some], cos[some]))
                    if found:
                        x, y, cos = map(np.concatenate, zip(*found))
                        a, b = left[0].take(pa.array(x)), right[0].take(pa.array(y))
                        yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(cos)], names)

    tiles = blocks * (blocks + 1) // 2
    return spark.range(0, tiles, 1, min(tiles, 2000)).mapInArrow(compare, f"a {kind}, b {kind}, cos double")
