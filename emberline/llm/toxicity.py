"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its hashed embedding and as the mean of its hashed character n-gram embeddings, so
that unseen words are judged by their spelling.  A text is read in overlapping windows of words, all of
them, whatever its length.  In each window two gated recurrent passes give a state per word, attention
pools the states, and a linear unit gives the window's logit.  The text's probability is a logistic
function of its windows' mean and strongest logits, fitted on training rows that the network did not see.

Only a text's label is known, not its toxic windows.  An epoch draws windows of each text at random and
adds the one that the model (at first: log-odds of words and n-grams, which also start the embeddings)
ranks highest, all with the text's label, so that a logit is the evidence which a window gives.

The training sample is bounded: at most SAMPLE (toxic, clean) rows, chosen by a hash of doc_id, of at
most SAMPLE_BYTES of text.  It is the only thing that is bounded; every text is scored whole.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, fresh, mix, ship, slices, written

SAMPLE, SAMPLE_BYTES = (1500, 3000), 32 << 20
WINDOW, STRIDE = 32, 24
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 18, 17, 8, 8
GRAMS = (4, 5, 6)
#: Embeddings learn at their own rate; a word's own embedding is left out this often, so that spelling counts.
TABLE_RATE, WORD_DROP = 0.003, 0.5
EPOCHS, STEPS, BATCH, RATE = 5, 250, 256, 0.01  # at least so many epochs and steps
#: Windows of each text that an epoch learns from, besides the one that the model ranks highest.
DRAWN = 5
THRESHOLD = 0.7
_CHUNK = 8192


class Features:
    """Distinct words of some texts with their buckets, and each text's windows over them."""

    def __init__(self, w: Words):
        _, at, self.token = np.unique(w.hash, return_index=True, return_inverse=True)
        self.first = w.first
        start, end = w.start[at], w.end[at]
        self.word = (w.hash[at] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # ^word$ of all distinct words in one buffer
        size = end - start + 2
        offset = np.concatenate([[0], np.cumsum(size)])
        text = np.empty(offset[-1], dtype=np.uint8)
        text[offset[:-1]], text[offset[1:] - 1] = 94, 36
        inner = np.ones(len(text), dtype=bool)
        inner[offset[:-1]] = inner[offset[1:] - 1] = False
        place = np.arange(len(text)) - np.repeat(offset[:-1], size)
        text[inner] = w.data[(np.repeat(start, size) + place - 1)[inner]]
        left = np.repeat(offset[1:], size) - np.arange(len(text))
        grams, owner = [], []
        word_of = np.repeat(np.arange(len(at)), size)
        for n in GRAMS:
            h = np.zeros(max(0, len(text) - n + 1), dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + text[j : j + len(h)]
            ok = left[: len(h)] >= n
            grams.append(mix(h[ok] + np.uint64(n)) >> np.uint64(64 - GRAM_BITS))
            owner.append(word_of[: len(h)][ok])
        # words too short for any n-gram have one of their own
        short = np.flatnonzero(size < min(GRAMS))
        grams.append(mix(w.hash[at[short]]) >> np.uint64(64 - GRAM_BITS))
        owner.append(short)
        owner_ = np.concatenate(owner)
        order = np.argsort(owner_, kind="stable")
        self.gram = np.concatenate(grams)[order].astype(np.int32)
        self.gram_n = np.bincount(owner_, minlength=len(at))
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) of distinct words' numbers, -1 beyond a text's end; the text of each window."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(0, np.minimum(nth * STRIDE, n[doc] - WINDOW))
        at = start[:, None] + np.arange(WINDOW)
        inside = at < n[doc][:, None]
        ids = np.full(at.shape, -1, dtype=np.int32)
        ids[inside] = self.token[(self.first[doc][:, None] + at)[inside]]
        return ids, doc


def _gathered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[at], np.add.reduceat(values[order], at, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, a=0.3: rng.normal(0, a, s).astype(np.float32)
        self.word = np.zeros((1 << WORD_BITS, DIM), dtype=np.float32)
        self.gram = np.zeros((1 << GRAM_BITS, DIM), dtype=np.float32)
        h = HIDDEN
        self.p = {"wx": f(2, 2 * DIM, 3 * h), "u": f(2, h, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "va": f(2 * h, a=0.5), "wo": f(2 * h, a=0.5), "bo": np.zeros(1, np.float32)}
        self.final = np.zeros(5)
        self.constant: float | None = None

    def inputs(self, x: Features) -> np.ndarray:
        """(distinct words, 2 DIM): word embedding and mean n-gram embedding."""
        if not len(x.word):
            return np.zeros((0, 2 * DIM), dtype=np.float32)
        chars = np.add.reduceat(self.gram[x.gram], x.gram_at) / x.gram_n[:, None]
        return np.concatenate([self.word[x.word], chars.astype(np.float32)], axis=1)

    def forward(self, table: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; table holds each distinct word's input projections, last row for padding."""
        p, h = self.p, HIDDEN
        n, width = ids.shape
        mask = (ids >= 0).T[:, :, None]
        whole = bool(mask.all())
        states = np.empty((width, n, 2 * h), dtype=np.float32)
        kept: list = []
        for d in (0, 1):
            s = np.zeros((n, h), dtype=np.float32)
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                x = table[d][ids[:, t]]
                g = s @ p["u"][d]
                zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                new = c + z * (s - c)
                if not whole:
                    new = np.where(mask[t], new, s)
                if keep:
                    kept.append((s, z, r, c, g[:, 2 * h :]))
                s = new
                states[t, :, d * h : (d + 1) * h] = s
        e = np.where(mask[:, :, 0], states @ p["va"], -30.0)
        a = np.exp(e - e.max(axis=0))
        a = a / a.sum(axis=0)
        a = np.where(mask[:, :, 0], a, 0.0).astype(np.float32)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, states, kept, a, pooled, mask) if keep else logit

    def table(self, inputs: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 HIDDEN); the last row, for padding, is never used by a state."""
        rows = np.concatenate([inputs, np.zeros((1, 2 * DIM), dtype=np.float32)])
        return np.einsum("nd,kdh->knh", rows, self.p["wx"]) + self.p["b"][:, None, :]

    def logits(self, x: Features, ids: np.ndarray) -> np.ndarray:
        table = self.table(self.inputs(x))
        return np.concatenate([self.forward(table, ids[i : i + _CHUNK]) for i in range(0, len(ids), _CHUNK)])

    def step(self, x: Features, inputs: np.ndarray, ids: np.ndarray, y: np.ndarray, adam: dict, t: int) -> np.ndarray:
        """One gradient step on windows; returns the gradient of inputs."""
        p, h, n = self.p, HIDDEN, len(ids)
        table = self.table(inputs)
        logit, states, kept, a, pooled, mask = self.forward(table, ids, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g["bo"][0], g["wo"] = dl.sum(), pooled.T @ dl
        dpool = dl[:, None] * p["wo"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        de = a * (da - (a * da).sum(axis=0))
        g["va"] = np.einsum("tn,tnh->h", de, states)
        dstates = a[:, :, None] * dpool + de[:, :, None] * p["va"]
        dtable = np.zeros_like(table)
        for d in (0, 1):
            ds = np.zeros((n, h), dtype=np.float32)
            moved = np.empty((WINDOW, n, 3 * h), dtype=np.float32)
            order = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
            for i, pos in reversed(list(enumerate(order))):
                s, z, r, c, gc = kept[d * WINDOW + i]
                m = mask[pos]
                ds = ds + dstates[pos, :, d * h : (d + 1) * h]
                dn = np.where(m, ds, 0)
                dz, dc = dn * (s - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                dx = np.concatenate([dz, dr, dc], axis=1)
                g["u"][d] += s.T @ dg
                moved[pos] = dx
                ds = np.where(m, dn * z, ds) + dg @ p["u"][d].T
            rows, sums = _gathered(ids.T.ravel(), moved.reshape(-1, 3 * h))
            dtable[d][rows] = sums
        dtable[:, -1] = 0
        g["b"] = dtable.sum(axis=1)
        g["wx"] = np.einsum("nd,knh->kdh", inputs, dtable[:, :-1])
        dinputs = np.einsum("knh,kdh->nd", dtable[:, :-1], p["wx"])
        for k in p:
            m1, m2 = adam.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            m1 += 0.1 * (g[k] - m1)
            m2 += 0.001 * (g[k] ** 2 - m2)
            p[k] = p[k] - RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        return dinputs


def _evidence(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """By text: strongest logit, mean of the (up to) three strongest, mean, mean times log count, 1."""
    order = np.lexsort((-logits, doc))
    logits, doc = np.clip(logits[order], -8, 8), doc[order]
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    rank = np.arange(len(doc)) - first[doc]
    top3 = np.bincount(doc[rank < 3], weights=logits[rank < 3], minlength=n) / np.minimum(count, 3)
    mean = np.bincount(doc, weights=logits, minlength=n) / count
    return np.stack([logits[first], top3, mean, mean * np.log(count), np.ones(n)], axis=1)


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on standardised columns (the last is the constant), by safeguarded Newton steps."""
    scale = np.append(f[:, :-1].std(axis=0) + 1e-3, 1.0)
    x = f / scale
    ridge = np.append(np.full(f.shape[1] - 1, 0.3), 1e-3)

    def loss(w):
        m = x @ w
        return np.logaddexp(0, m).sum() - y @ m + 0.5 * ridge @ (w * w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w / scale


def _log_odds(pairs: np.ndarray, bits: int, y: np.ndarray, total: list[np.ndarray]) -> None:
    doc, bucket = pairs >> bits, pairs & ((1 << bits) - 1)
    for label in (0, 1):
        total[label] += np.bincount(bucket[y[doc] == label], minlength=1 << bits)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on whole texts with labels 0 and 1; with one label only, the network is a constant."""
    net = Network(seed)
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y[0]) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    parts, at = [], 0
    for lo, hi, data, offsets in slices(column, 1 << 20):
        parts.append((lo, Features(Words(data, offsets, ALNUM))))
    # texts are dealt by label into those that start the embeddings, train the network and fit the last step
    role = np.empty(len(y), dtype=int)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        role[rows] = np.arange(len(rows)) * 10 // len(rows)
    start, own = role < 4, (role >= 4) & (role < 8)
    for label in (0, 1):
        if not own[y == label].any():
            own |= y == label
    words = [np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS)]
    grams = [np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)]
    for lo, x in parts:
        n = np.diff(x.first)
        doc = lo + np.repeat(np.arange(len(n)), n)
        some = start[doc]
        if not some.any():
            continue
        pair = np.unique((doc[some] << 32) | x.token[some])
        doc, token = pair >> 32, pair & 0xFFFFFFFF
        _log_odds(np.unique((doc << WORD_BITS) | x.word[token]), WORD_BITS, y, words)
        for i in range(0, len(token), 50_000):  # a text may be cut here, which counts some of its n-grams twice
            t, d = token[i : i + 50_000], doc[i : i + 50_000]
            n = x.gram_n[t]
            at = np.repeat(x.gram_at[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            _log_odds(np.unique((np.repeat(d, n) << GRAM_BITS) | x.gram[at]), GRAM_BITS, y, grams)
    size = [float((start & (y == k)).sum()) for k in (0, 1)]
    for table, seen in ((net.word, words), (net.gram, grams)):
        odds = np.log((seen[1] + 0.5) / (size[1] + 1)) - np.log((seen[0] + 0.5) / (size[0] + 1))
        # the root of the likelihood ratio tells chance from evidence: below 2 a bucket starts at nothing
        both = (seen[0] + seen[1]) / (size[0] + size[1])
        ratio = sum(2 * n * np.log(np.maximum(n, 1e-9) / np.maximum(k * both, 1e-9)) for n, k in zip(seen, size))
        sure = np.clip((np.sqrt(np.maximum(ratio, 0)) - 2) / 2.5, 0, 1)
        table[:, 0] = np.clip(odds, -1, 4) * sure / 2
    # all windows, with texts numbered over all parts
    cut = [(x, *x.windows(), lo) for lo, x in parts]

    def drawn(values):
        """Windows to learn from, by part: the highest of each text and some at random."""
        out = []
        for (x, ids, doc, lo), v in zip(cut, values):
            order = np.lexsort((-v, doc))
            count = np.bincount(doc, minlength=len(x.first) - 1)
            first = np.cumsum(count) - count
            at = np.minimum((rng.random((len(first), DRAWN)) * count[:, None]).astype(int), count[:, None] - 1)
            pick = np.unique(np.concatenate([order[first], (first[:, None] + at).ravel()]))
            pick = pick[own[lo + doc[pick]]]
            out.append((x, ids[pick], y[lo + doc[pick]]))
        return out

    def by_odds(x, ids):
        inputs = np.append(np.maximum(net.inputs(x)[:, [0, DIM]], 0).sum(axis=1), 0)
        return inputs[ids].sum(axis=1)

    squares = [np.full(1 << WORD_BITS, 1e-4, dtype=np.float32), np.full(1 << GRAM_BITS, 1e-4, dtype=np.float32)]
    adam: dict = {}
    t = 0
    values = [by_odds(x, ids) for x, ids, _, _ in cut]
    epoch = 0
    while epoch < EPOCHS or t < STEPS:
        if epoch and epoch % 2 == 0:
            values = [net.logits(x, ids) for x, ids, _, _ in cut]
        epoch += 1
        batches = []
        for x, ids, label in drawn(values):
            order = rng.permutation(len(ids))
            batches += [(x, ids[order[i : i + BATCH]], label[order[i : i + BATCH]]) for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            x, ids, label = batches[b]
            t += 1
            used, back = np.unique(ids, return_inverse=True)
            local = back.reshape(len(ids), WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            n = x.gram_n[used]
            at = np.repeat(x.gram_at[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = x.gram[at]
            inputs = np.zeros((len(used), 2 * DIM), dtype=np.float32)
            if len(used):
                heard = (rng.random(len(used)) >= WORD_DROP).astype(np.float32)[:, None]
                inputs[:, :DIM] = net.word[x.word[used]] * heard
                inputs[:, DIM:] = np.add.reduceat(net.gram[g], np.cumsum(n) - n) / n[:, None]
            grad = net.step(x, inputs, local, label, adam, t)
            for table, rows, dx, sq in ((net.word, x.word[used], grad[:, :DIM] * (heard if len(used) else 1), squares[0]), (net.gram, g, np.repeat(grad[:, DIM:] / n[:, None], n, axis=0), squares[1])):
                if len(rows):
                    rows, dx = _gathered(rows, dx)
                    sq[rows] += (dx**2).mean(axis=1)
                    table[rows] -= TABLE_RATE * dx / np.sqrt(sq[rows])[:, None]
    f = np.concatenate([_evidence(net.logits(x, ids), doc, len(x.first) - 1) for x, ids, doc, _ in cut])
    rest = role >= 8
    if min((rest & (y == k)).sum() for k in (0, 1)) < 5:
        rest = np.ones(len(y), dtype=bool)
    net.final = _logistic(f[rest], y[rest])
    return net


def sample(docs: DataFrame, labels: DataFrame, rows: Column) -> DataFrame:
    """(o, text, toxic): the bounded training sample among the labelled rows that the condition selects."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(rows)
    chosen = None
    for label, n in ((1, SAMPLE[0]), (0, SAMPLE[1])):
        part = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen, "toxic-sample")
    # at most sum(SAMPLE) ids
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    found = written(found, "toxic-texts")
    sizes = found.groupBy("doc_id").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept, held = [], 0
    for r in sizes:
        if held + r["size"] <= SAMPLE_BYTES:
            kept.append(r["doc_id"])
            held += r["size"]
    some = found if len(kept) == len(sizes) else found.where(F.col("doc_id").isin(kept))
    return some.select(F.xxhash64("doc_id", "text").alias("o"), F.coalesce("text", F.lit("")).alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: Column) -> Network:
    """Fit on the sample, in one task (the sample is bounded), and fetch the network, which is of fixed size."""
    ship(docs.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "toxic"], kind="stable")
        net = fit(pdf["text"].tolist(), pdf["toxic"].to_numpy())
        return pd.DataFrame({"net": [zlib.compress(pickle.dumps(net), 1)]})

    together = sample(docs, labels, rows).withColumn("all", F.lit(True)).groupBy("all")
    fitted = together.applyInPandas(run, "net binary").first()
    return pickle.loads(zlib.decompress(fitted["net"])) if fitted else fit([], np.zeros(0))


def _scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if net.constant is not None:
        return np.full(n, net.constant)
    x = Features(Words(data, offsets, ALNUM))
    ids, doc = x.windows()
    return 1 / (1 + np.exp(-np.clip(_evidence(net.logits(x, ids), doc, n) @ net.final, -30, 30)))


def score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """docs with its text's probability of being toxic in a column of that name (replaced if there).

    Null, empty and wordless texts have one empty window.  Rows are scored one by one.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(name)
    column = docs.columns.index("text")
    sent = spark.sparkContext.broadcast(net)  # of fixed size: the embedding tables

    def scan(batches):
        own = sent.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(column), 2 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_scores(own, data, offsets), pa.float64())], names=[*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold."""
    net = train(docs, labels, ~held_out(F.col("doc_id")))
    (name,) = fresh(docs, "toxic_score")
    return score(docs, net, name).where(F.col(name) < threshold).drop(name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
