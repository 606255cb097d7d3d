"""Quality: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Each word has a sparse random index vector: a few +1 and -1 by its hash.  A word's vector is the sum of
the index vectors of its neighbours over all documents, kept by word bucket (a hash), so that the
table has a fixed size however many words there are.  Tasks sum by bucket, Spark adds the sums.  Letters and
signs are words apart, and each word also has a shape (sign, digits, all capitals, capital first, small,
no ASCII letter).

A document is pooled to the mean of its words' vectors, their spread, how far neighbours differ, the
length of its mean index vector, and the shares of shapes and neighbouring shapes.  A hidden layer and an output
give its logit; a temperature, fitted on rows the network did not see, turns that into a probability.

The labelled sample is bounded: at most SAMPLE rows of each label, by a hash of doc_id, weighted back to
the labels' shares.  Word vectors cover all documents, and every text is pooled and scored whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, NOT_SPACE, _word_hashes, fresh, mix, ship, slices, written

SAMPLE = 4000
BITS, DIM, ONES = 15, 32, 4
REACH = 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 0.003, 1e-3
THRESHOLD = 0.3
_SLICE = 1 << 20
#: Words whose vectors are held at once.
_CHUNK = 1 << 18
_SHAPES = 6
#: By byte: 0 white, 1 letters and digits, 2 signs.
_KIND = np.where(ALNUM | (np.arange(256) >= 65) & (np.arange(256) < 91), 1, np.where(NOT_SPACE, 2, 0)).astype(np.uint8)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) < 91)
_SMALL = (np.arange(256) >= 97) & (np.arange(256) < 123)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)


class Tokens:
    """Words of consecutive texts: bucket, shape and, by text, their range [first[i], first[i + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        new = np.ones(len(data) + 1, dtype=bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[offsets] = True
        edge = np.flatnonzero(new)
        start, end = edge[:-1], edge[1:]
        word = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
        start, end = start[word], end[word]
        self.first = np.searchsorted(start, offsets)
        self.bucket = (_word_hashes(data, start, end) >> np.uint64(64 - BITS)).astype(np.int64)
        some = lambda table: np.add.reduceat(np.append(table[data], False).astype(np.int32), np.ravel([start, end], order="F"))[::2] if len(start) else np.zeros(0, np.int32)
        capital, small, digit = some(_CAPITAL), some(_SMALL), some(_DIGIT)
        self.shape = np.select(
            [kind[start] == 2, digit > 0, (capital > 1) & (small == 0), _CAPITAL[data[start]], small > 0], [0, 1, 2, 3, 4], 5
        ).astype(np.int64) if len(start) else np.zeros(0, dtype=np.int64)  # 5: no ASCII letter


def index_vectors() -> np.ndarray:
    """(buckets, DIM): ONES places of each are +1 or -1."""
    h = mix(np.arange(1 << BITS, dtype=np.uint64) + np.uint64(11))
    out = np.zeros((1 << BITS, DIM), dtype=np.float32)
    rows = np.arange(1 << BITS)
    order = np.argsort(mix(h[:, None] + np.arange(DIM, dtype=np.uint64)), axis=1)[:, :ONES]
    for j in range(ONES):
        out[rows, order[:, j]] = 1.0 if j % 2 else -1.0
    return out


def context_sums(t: Tokens, index: np.ndarray, into: np.ndarray, chunk: int = _CHUNK) -> None:
    """Add to each word's row the index vectors of the words around it in its text."""
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    for i in range(0, len(text), chunk):
        j = min(i + chunk, len(text))
        lo, hi = max(0, i - REACH), min(j + REACH, len(text))
        vectors, own = index[t.bucket[lo:hi]], text[lo:hi]
        around = np.zeros((hi - lo, DIM), dtype=np.float32)
        for d in range(1, REACH + 1):
            same = (own[d:] == own[:-d])[:, None]
            around[d:] += vectors[:-d] * same
            around[:-d] += vectors[d:] * same
        around = around[i - lo : j - lo]
        order = np.argsort(t.bucket[i:j], kind="stable")
        b = t.bucket[i:j][order]
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        into[b[head]] += np.add.reduceat(around[order], head, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(buckets, DIM) unit vectors, learnt from all whole texts; buckets without neighbours are zero.

    Sums are of whole numbers, so that they don't depend on how the rows are dealt.  The table is of fixed size.
    """
    ship(docs.sparkSession)

    def count(batches):
        index, total = index_vectors(), np.zeros((1 << BITS, DIM))
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), _SLICE):
                t = Tokens(data, offsets)
                if len(t.bucket):
                    context_sums(t, index, total)
        rows = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[part, j].astype(np.int64)) for j in range(DIM))], names=["bucket", *(f"v{j}" for j in range(DIM))])

    schema = "bucket long, " + ", ".join(f"v{j} long" for j in range(DIM))
    sums = docs.select("text").mapInArrow(count, schema).groupBy("bucket").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)))
    got = sums.toPandas()  # at most 2^BITS rows
    out = np.zeros((1 << BITS, DIM), dtype=np.float64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got.drop(columns="bucket").to_numpy(dtype=np.float64)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


FEATURES = 3 * DIM + _SHAPES + _SHAPES**2 + 3


def pooled(t: Tokens, vectors: np.ndarray, index: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
    """(texts, FEATURES); a text without words has zeros.  A long text is summed a chunk of words at a time."""
    n = np.diff(t.first)
    text = np.repeat(np.arange(len(n)), n)
    # by text: vectors, their squares, steps between neighbours, index vectors, repeated neighbours
    total = np.zeros((len(n), 4 * DIM + 1))
    shape, pairs = np.zeros((len(n), _SHAPES)), np.zeros((len(n), _SHAPES**2))
    for i in range(0, len(text), chunk):
        j = min(i + chunk, len(text))
        own, bucket = text[i:j], t.bucket[i:j]
        v = vectors[t.bucket[i : j + 1]]
        on = np.zeros(j - i, dtype=bool)  # whether the next word is of the same text
        on[: len(v) - 1] = text[i + 1 : j + 1] == text[i : i + len(v) - 1]
        step = np.zeros((j - i, DIM), dtype=np.float32)
        step[: len(v) - 1] = np.abs(v[1:] - v[:-1])
        step[~on] = 0
        v = v[: j - i]
        near = np.flatnonzero(on)
        again = np.zeros((j - i, 1), dtype=np.float32)
        again[near, 0] = t.bucket[i + near] == t.bucket[i + near + 1]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[head]] += np.concatenate([np.add.reduceat(x, head, axis=0) for x in (v, v * v, step, index[bucket], again)], axis=1)
        shape += np.bincount(own * _SHAPES + t.shape[i:j], minlength=shape.size).reshape(shape.shape)
        pairs += np.bincount((own[near] * _SHAPES + t.shape[i + near]) * _SHAPES + t.shape[i + near + 1], minlength=pairs.size).reshape(pairs.shape)
    some = n > 0
    count = np.maximum(n, 1)[:, None]
    mean, square, own, again = (x / count for x in (total[:, :DIM], total[:, DIM : 2 * DIM], total[:, 3 * DIM : 4 * DIM], total[:, 4 * DIM :]))
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    between = np.maximum(count - 1, 1)
    out = [mean, spread, total[:, 2 * DIM : 3 * DIM] / between, shape / count, pairs / between, np.linalg.norm(own, axis=1, keepdims=True), np.log(count), again]
    return (np.concatenate(out, axis=1) * some[:, None]).astype(np.float32)


class Network:
    """Standardised inputs, tanh hidden layer, one output; probability by temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5):
        self.constant: float | None = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        rest = np.zeros(len(y), dtype=bool)
        for label in (0, 1):  # every fifth row is kept for the temperature
            rest[rng.permutation(np.flatnonzero(y == label))[::5]] = True
        if min((~rest & (y == k)).sum() for k in (0, 1)) == 0:
            rest[:] = False
        a = np.flatnonzero(~rest)
        self.mean, self.scale = x[a].mean(axis=0), x[a].std(axis=0) + 1e-3
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"w": f(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "v": f(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        z = self.standard(x)
        t = 0
        for _ in range(max(EPOCHS, -(-400 * BATCH // len(a)))):
            order = rng.permutation(a)
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                t += 1
                for k, g in self.gradient(z[rows], y[rows], weight[rows] / weight.mean()).items():
                    m1, m2 = adam[k]
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g**2 - m2)
                    self.p[k] = self.p[k] - RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        held = np.flatnonzero(rest) if rest.any() else a
        self.temperature = self.calibrated(self.logits(x[held]), y[held], weight[held])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64)

    def gradient(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(z @ p["w"] + p["b"])
        d = weight * (1 / (1 + np.exp(-(h @ p["v"] + p["c"][0]))) - y) / len(y)
        dh = d[:, None] * p["v"] * (1 - h * h)
        return {"w": z.T @ dh + DECAY * p["w"], "b": dh.sum(axis=0), "v": h.T @ d + DECAY * p["v"], "c": np.array([d.sum()])}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.p["w"] + self.p["b"]) @ self.p["v"] + self.p["c"][0]

    @staticmethod
    def calibrated(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """The temperature of least weighted log loss, by golden sections on its logarithm."""
        loss = lambda u: float(weight @ (np.logaddexp(0, logit / np.exp(u)) - y * logit / np.exp(u)))
        lo, hi, g = np.log(0.2), np.log(20.0), (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        return float(np.exp((lo + hi) / 2))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _with_pooled(docs: DataFrame, vectors, give, added: T.StructField) -> DataFrame:
    """docs with a column made of give(features) of its texts."""
    names = docs.columns
    column = names.index("text")
    kind = pa.float64() if isinstance(added.dataType, T.DoubleType) else pa.list_(pa.float32())

    def scan(batches):
        index, own = index_vectors(), vectors.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(column), _SLICE):
                part = batch.slice(lo, hi - lo)
                values = give(pooled(Tokens(data, offsets), own, index))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(values) if values.ndim > 1 else values, kind)], names=[*names, added.name])

    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(scan, T.StructType([*docs.schema.fields, added]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: Column, vectors) -> Network:
    """Fit on the labelled sample among the rows that the condition selects, in one task; the sample is bounded.

    A doc_id with several labels has the highest; several rows of it are several examples.  Null ids and labels
    other than 0 and 1 teach nothing.  With one label only the network is a constant, without labels 0.5.
    """
    marks = written(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(rows), "quality-labels")
    total = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        weight = max(1.0, total.get(label, 0) / SAMPLE)
        part = marks.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("weight", F.lit(weight))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen, "quality-sample")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * SAMPLE ids
    features = _with_pooled(found, vectors, lambda x: x, T.StructField("x", T.ArrayType(T.FloatType()))).select(F.xxhash64("doc_id", "text").alias("o"), "quality", "weight", "x")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "quality"], kind="stable")
        net = Network(np.stack(pdf["x"].to_list()).astype(np.float64), pdf["quality"].to_numpy(dtype=np.float64), pdf["weight"].to_numpy())
        return pd.DataFrame({"net": [pickle.dumps(net)]})

    fitted = features.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(run, "net binary").first()
    return pickle.loads(fitted["net"]) if fitted else Network(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0))


def score(docs: DataFrame, net: Network, vectors, name: str = "score") -> DataFrame:
    """docs with the probability that a text is of quality 1 in a column of that name (replaced if there).

    Null, empty and blank texts are pooled to zeros.  Rows are scored one by one; an empty table stays empty.
    """
    ship(docs.sparkSession)
    return _with_pooled(docs.drop(name), vectors, net.probability, T.StructField(name, T.DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, rows: Column, name: str = "score") -> DataFrame:
    """docs with scores of a network that has learnt from the labels that the condition selects, and word vectors of all texts."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))  # of fixed size
    return score(docs, train(docs, labels, rows, vectors), vectors, name)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold."""
    (name,) = fresh(docs, "quality_score")
    return classify(docs, labels, F.lit(True), name).where(F.col(name) >= threshold).drop(name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
