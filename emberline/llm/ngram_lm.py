"""Interpolated modified Kneser-Ney model of any order, counted in Spark and scored from memory-mapped arrays.

Training is a shuffle of packed, pre-aggregated counts (a row is one sorted array, not one n-gram) per level:

1. words: 64-bit word hashes with counts, by hash range; a word's place in the global order is its id;
2. n-grams of the full order with counts, by the last word of the context; a frequent word is spread
   by the words before it and at last by the next one, so no bucket grows with a single word or context;
3. each lower order down to pairs, with the number of distinct words before an n-gram as its count (its
   own count if it starts a text);
4. per word: how many pairs with count 1, 2 and more it begins, their sum, and how many pairs it ends.

Every bucket becomes sorted arrays in files below spark.checkpoint.dir, which scoring tasks map into
memory.  Buckets are sized by the text, so memory per task stays bounded while their number grows.
Pairs have exact 64-bit keys, longer n-grams 64-bit hashes.  Keys cover all training rows; nothing is pruned.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, bucket_count, discard, mix, mix_int, mounted_path, ship, slices, written

#: Hash of the end token: no word, words being hashed with their length.
END = np.uint64(mix_int(0x0E0F0E0F))
#: Distinct entries that a task gathers before it hands them on.
FLUSH = 2_000_000
PAIR_TOKENS = 2_000_000
#: Text that is scored at a time: each n-gram file is mapped once for it.
SCORED_BYTES = 4 << 20
#: Word files that a scoring task keeps mapped.
OPENED = 4000
_S32 = np.uint64(32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed by byte planes: the high bytes of ids and counts hardly vary."""
    out = [np.array([len(arrays), *(len(a) for a in arrays)], dtype=np.int64).tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [np.int64(len(small)).tobytes(), small]
    return b"".join(out)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes.tolist()):
        small = int(np.frombuffer(blob, np.int64, 1, at)[0])
        width = np.dtype(kind).itemsize
        planes = pa.decompress(blob[at + 8 : at + 8 + small], size * width, codec="zstd", asbytes=True) if small else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).ravel() if size else np.zeros(0, dtype=kind))
        at += 8 + small
    return out


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, dtype=np.int64)
    return list(zip(sorted_[at].tolist(), at.tolist(), np.append(at[1:], len(sorted_)).tolist()))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write whole or not at all; tasks that run twice write the same."""
    target = os.path.join(folder, f"{name}.npy")
    partial = f"{target}.{os.getpid()}.part"
    with open(partial, "wb") as f:
        np.save(f, array)
    os.replace(partial, target)


def _load(folder: str, name: str) -> np.ndarray:
    return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams given as columns of word ids: exact up to pairs, hashes beyond."""
    key = columns[0].astype(np.uint64)
    for i, c in enumerate(columns[1:]):
        key = mix(key) + c.astype(np.uint64) if i else (key << _S32) | c.astype(np.uint64)
    return key


def _grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(keys in order, columns, summed counts) of the distinct n-grams."""
    keys = _key(columns)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], [c[order[at]] for c in columns], np.add.reduceat(counts[order], at) if len(keys) else counts


@dataclass
class Model:
    folder: str
    word_bits: int
    pair_buckets: int
    stat_range: int
    base: list[int]  # id of the first word of each word bucket
    vocabulary: int = 0
    tokens: int = 0
    texts: int = 0
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    pairs: int = 0
    order: int = 2
    discounts: dict = field(default_factory=dict)  # by order from 2
    discount_low: tuple = (0.5, 0.5, 0.5)
    low_counts: tuple = (0, 0, 0)

    def opened(self, kind: str, i: int, cache: dict) -> np.ndarray:
        key = f"{kind}-{i}"
        if key not in cache:
            if len(cache) >= OPENED:
                cache.clear()
            cache[key] = _load(self.folder, key)
        return cache[key]

    def ids(self, hashes: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted distinct word hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        bucket = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64)
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            words = self.opened("word", b, cache)
            if len(words):
                i = np.minimum(np.searchsorted(words, hashes[lo:hi]), len(words) - 1)
                ok = words[i] == hashes[lo:hi]
                ids[lo:hi] = np.where(ok, i + self.base[b], -1)
                counts[lo:hi] = np.where(ok, self.opened("count", b, cache)[i], 0)
        return ids, counts

    def frequent(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(ids), dtype=bool)
        ids = ids.astype(np.uint64)
        return self.heavy[np.minimum(np.searchsorted(self.heavy, ids), len(self.heavy) - 1)] == ids

    def bucket_of(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, whether the context is spread over buckets) of n-grams."""
        h = columns[-2].astype(np.uint64)
        more = self.frequent(columns[-2])
        for c in columns[-3::-1]:
            h = np.where(more, mix(h) + c.astype(np.uint64), h)
            more = more & self.frequent(c)
        h = np.where(more, mix(h) + columns[-1].astype(np.uint64), h)
        return (h % np.uint64(self.pair_buckets)).astype(np.int64), more

    def look(self, kind: str, values: tuple, keys: np.ndarray, bucket: np.ndarray, cache: dict) -> np.ndarray:
        """One column for each kind of values, at the keys of the buckets' files; 0 where a key is absent."""
        out = np.zeros((len(keys), len(values)), dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, lo, hi in _runs(bucket[order]):
            if b < 0:
                continue
            rows = order[lo:hi]
            # mapped for these keys only: what a task holds doesn't grow with the model
            have = _load(self.folder, f"{kind}-{b}")
            if len(have):
                i = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                ok = have[i] == keys[rows]
                for c, v in enumerate(values):
                    out[rows[ok], c] = _load(self.folder, f"{v}-{b}")[i[ok]]
        return out

    def gram_counts(self, columns: list[np.ndarray], real: np.ndarray, cache: dict) -> np.ndarray:
        """Counts of n-grams, 0 where not real."""
        k = len(columns)
        out = np.zeros(len(real), dtype=np.int64)
        columns = [c[real] for c in columns]
        keys, one, back = np.unique(_key(columns), return_index=True, return_inverse=True)
        if len(keys):
            out[real] = self.look(f"gram{k}", (f"times{k}",), keys, self.bucket_of([c[one] for c in columns])[0], cache)[back, 0]
        return out

    def contexts(self, columns: list[np.ndarray], seen: np.ndarray, cache: dict) -> np.ndarray:
        """(n, 4): sum of counts, and n-grams with count 1, 2, more, of the contexts of n-grams that are seen in training."""
        k = len(columns)
        out = np.zeros((len(seen), 4), dtype=np.int64)
        columns = [c[seen] for c in columns]
        keys, one, back = np.unique(_key(columns[:-1]), return_index=True, return_inverse=True)
        if len(keys):
            bucket, spread = self.bucket_of([c[one] for c in columns])
            names = ("total", "one", "two", "more")
            found = self.look(f"context{k}", tuple(f"{x}{k}" for x in names), keys, np.where(spread, -1, bucket), cache)
            apart = (mix(keys) % np.uint64(self.pair_buckets)).astype(np.int64)
            found += self.look(f"context{k}s", tuple(f"{x}{k}s" for x in names), keys, np.where(spread, apart, -1), cache)
            found[found[:, 0] == 0] = (1, 1, 0, 0)  # contexts of one token aren't kept
            out[seen] = found[back]
        return out

    def stats(self, ids: np.ndarray, cache: dict) -> np.ndarray:
        """(n, 5): pairs begun with count 1, 2, more; pairs ended; counts of pairs begun; of sorted ids (-1: none)."""
        out = np.zeros((len(ids), 5), dtype=np.float64)
        for r in np.unique(ids[ids >= 0] // self.stat_range):
            lo, hi = np.searchsorted(ids, [r * self.stat_range, (r + 1) * self.stat_range])
            out[lo:hi] = self.opened("stat", r, cache)[ids[lo:hi] - r * self.stat_range]
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts 1 to 4; the middle of each range where they can't tell."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0
    raw = [k - (k + 1) * y * b / a if a and b and y else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(min(max(d, 0.01), k)) for k, d in enumerate(raw, 1))


def _discounted(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(c - np.choose(np.minimum(c, 3).astype(np.int64), [0.0, *d]), 0.0)


def _sequence(w: Words, ids: np.ndarray, end: int, bos: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of the words before and the token, first token by text): every text's words and the end token.

    A text begins after bos, and bos after bos + 1, which only fills the columns.
    """
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    token = np.empty(len(ids) + n, dtype=np.int64)
    closing = first[1:] - 1
    inner = np.ones(len(token), dtype=bool)
    inner[closing] = False
    token[inner], token[closing] = ids, end
    columns = [token]
    for back in range(1, order):
        before = np.empty(len(token), dtype=np.int64)
        before[back:] = token[:-back]
        for d in range(back):
            at = first[:-1] + d
            before[at[at < first[1:]]] = bos if d == back - 1 else bos + 1
        columns.insert(0, before)
    return columns, first


def train(docs: DataFrame, rows: Column, order: int = 2) -> Model:
    """Fit on the rows of docs(text) that the condition selects; null texts are empty texts."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where(rows).select("text")
    n_texts, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    folder = mounted_path(spark, "kneser-ney")
    bits = max(2, (bucket_count(size // 2) - 1).bit_length())
    pair_buckets = bucket_count(size * order // 2)
    often = max(1000, size // 6 // (8 * pair_buckets))
    shift = np.uint64(64 - bits)

    def words(batches):
        gathered: list[tuple] = []
        held = 0

        def flush():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*gathered)))
            own = [(b, _pack(keys[i:j], counts[i:j].astype(np.uint32))) for b, i, j in _runs(keys >> shift)]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(0)):
                h = Words(data, offsets, NOT_SPACE).hash
                keys, counts = np.unique(np.append(h, END), return_counts=True)
                counts[np.searchsorted(keys, END)] += hi - lo - 1
                gathered.append((keys, counts))
                held += len(keys)
                if held >= FLUSH:
                    yield flush()
                    gathered, held = [], 0
        if gathered:
            yield flush()

    def word_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, np.uint64, np.uint32) for x in rows["blob"]]
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.uint64))
        b = int(key[0])
        _save(folder, f"word-{b}", keys)
        _save(folder, f"count-{b}", _narrow(counts))
        frequent = np.flatnonzero(counts >= often)
        return pd.DataFrame({"bucket": [b], "types": [len(keys)], "total": [int(counts.sum())], "frequent": [frequent.tolist()]})

    made = texts.mapInArrow(words, "bucket int, blob binary").groupBy("bucket").applyInPandas(word_bucket, "bucket int, types long, total long, frequent array<long>").collect()  # one row a bucket
    meta = {r.bucket: r for r in made}
    base, vocabulary = [], 0
    for b in range(1 << bits):
        base.append(vocabulary)
        if b in meta:
            vocabulary += meta[b].types
        else:
            for name, kind in (("word", np.uint64), ("count", np.uint8)):
                _save(folder, f"{name}-{b}", np.zeros(0, dtype=kind))
    if vocabulary >= 2**32 - 2:
        raise ValueError("more distinct words than 32-bit ids")
    bos = vocabulary
    heavy = np.array(sorted([bos, bos + 1, *(base[b] + i for b, r in meta.items() for i in r.frequent)]), dtype=np.uint64)
    stat_range = max(1, min(1 << 20, -(-(vocabulary + 1) // 12)))
    model = Model(folder, bits, pair_buckets, stat_range, base, vocabulary, sum(r.total for r in made), n_texts, heavy, order=order)
    if not n_texts:
        return model

    def dealt(kind: int, columns: list[np.ndarray], counts: np.ndarray) -> list[tuple]:
        """(kind, bucket, blob) of n-grams with counts, a row a bucket, in the order of their contexts."""
        bucket = model.bucket_of(columns)[0]
        order_ = np.lexsort(((columns[-2].astype(np.uint64) << _S32) | columns[-3 if len(columns) > 2 else -1].astype(np.uint64), bucket))
        return [(kind, b, _pack(*(c[order_[i:j]].astype(np.uint32) for c in columns), counts[order_[i:j]].astype(np.uint32))) for b, i, j in _runs(bucket[order_])]

    def grams(batches):
        cache: dict = {}
        end = int(model.ids(np.array([END]), cache)[0][0])
        gathered: list[list[np.ndarray]] = []
        held = 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*gathered)]
            _, columns, counts = _grouped(columns, np.ones(len(columns[0]), dtype=np.uint32))
            own = dealt(1, columns, counts)
            return pa.RecordBatch.from_arrays([pa.array([b for _, b, _ in own], pa.int32()), pa.array([x for *_, x in own], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                w = Words(data, offsets, NOT_SPACE)
                known, back = np.unique(w.hash, return_inverse=True)
                columns, _ = _sequence(w, model.ids(known, cache)[0][back], end, bos, order)
                gathered.append([c.astype(np.uint32) for c in columns])
                held += len(columns[0])
                if held >= PAIR_TOKENS:
                    yield flush()
                    gathered, held = [], 0
        if gathered:
            yield flush()

    def level_bucket(k: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            parts = [_unpack(x, *[np.uint32] * (k + 1)) for x in rows["blob"]]
            keys, columns, counts = _grouped([np.concatenate([p[i] for p in parts]) for i in range(k)], np.concatenate([p[k] for p in parts]).astype(np.uint64))
            del parts
            b = int(key[0])
            real = columns[0] != bos + 1
            _save(folder, f"gram{k}-{b}", keys[real])
            _save(folder, f"times{k}-{b}", _narrow(counts[real]))
            of_counts = [int((counts[real] == n).sum()) for n in (1, 2, 3, 4)]
            out = [(0, 0, _pack(np.array([int(real.sum()), *of_counts])))]
            if k > 2:
                # one order down a word before counts once; what starts a text has no word before
                _, shorter, n = _grouped(columns[1:], np.where(real, np.uint64(1), counts))
                out += dealt(1, shorter, n)
            columns, counts = [c[real] for c in columns], counts[real]
            context = _key(columns[:-1])
            by = np.argsort(context, kind="stable")
            context, counts_ = context[by], counts[by]
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)
            tally = [np.add.reduceat(x, at, dtype=np.uint64) if len(at) else np.zeros(0, dtype=np.uint64) for x in (counts_, counts_ == 1, counts_ == 2, counts_ > 2)]
            if k > 2:
                spread = model.bucket_of([c[by[at]] for c in columns])[1]
                _context(folder, k, "", b, context[at], tally, ~spread & (tally[0] > 1))
                parts_ = (mix(context[at]) % np.uint64(pair_buckets)).astype(np.int64)
                out += [(2, int(x), _pack(context[at][own], *(t[own] for t in tally))) for x in np.unique(parts_[spread]) for own in [spread & (parts_ == x)]]
                return pd.DataFrame(out, columns=["kind", "bucket", "blob"])
            u = context[at]
            w, ended = np.unique(columns[1], return_counts=True)
            for r in np.unique(np.concatenate([u.astype(np.int64), w.astype(np.int64)]) // stat_range).tolist():
                i, j = np.searchsorted(u, [r * stat_range, (r + 1) * stat_range])
                x, y = np.searchsorted(w, [r * stat_range, (r + 1) * stat_range])
                if j > i or y > x:
                    out.append((3, r, _pack(u[i:j], *(t[i:j] for t in (*tally[1:], tally[0])), w[x:y].astype(np.uint64), ended[x:y].astype(np.uint64))))
            return pd.DataFrame(out, columns=["kind", "bucket", "blob"])

        return run

    def spread_bucket(k: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            parts = [_unpack(x, *[np.uint64] * 5) for x in rows["blob"]]
            context = np.concatenate([p[0] for p in parts])
            merged = [_summed(context, np.concatenate([p[i] for p in parts])) for i in range(1, 5)]
            _context(folder, k, "s", int(key[0]), merged[0][0], [m[1] for m in merged], merged[0][1] > 1)
            return pd.DataFrame({"bucket": [int(key[0])]})

        return run

    counted = texts.mapInArrow(grams, "bucket int, blob binary")
    for k in range(order, 1, -1):
        found = written(counted.groupBy("bucket").applyInPandas(level_bucket(k), "kind int, bucket int, blob binary"), f"grams-{k}")
        if k < order:
            discard(above)
        above = found
        sums = np.zeros(5, dtype=np.int64)
        buckets = set(range(pair_buckets))
        for x in found.where("kind = 0").select("blob").collect():  # one row a bucket
            sums += _unpack(x.blob, np.int64)[0]
        model.discounts[k] = _discounts([int(x) for x in sums[1:]])
        filled = [("gram", np.uint64), ("times", np.uint8)]
        if k > 2:
            found.where("kind = 2").groupBy("bucket").applyInPandas(spread_bucket(k), "bucket int").count()  # at most one row a bucket
            filled += [(f"{x}{k}{s}", t) for s in ("", "s") for x, t in (("context", np.uint64), ("total", np.uint8), ("one", np.uint8), ("two", np.uint8), ("more", np.uint8))]
            counted = found.where("kind = 1").select("bucket", "blob")
        for name, kind in filled:
            name = f"{name}{k}" if name in ("gram", "times") else name
            for b in buckets:
                if not os.path.exists(os.path.join(folder, f"{name}-{b}.npy")):
                    _save(folder, f"{name}-{b}", np.zeros(0, dtype=kind))

    def stat_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        low = r * stat_range
        table = np.zeros((min(stat_range, vocabulary + 1 - low), 5), dtype=np.uint64)
        for blob in rows["blob"]:
            u, *begun, w, ended = _unpack(blob, *[np.uint64] * 7)
            for column, n in zip((0, 1, 2, 4), begun):
                table[(u - np.uint64(low)).astype(np.int64), column] += n
            table[(w - np.uint64(low)).astype(np.int64), 3] += ended
        _save(folder, f"stat-{r}", table)
        cont = table[:, 3]
        return pd.DataFrame([[r, *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())]], columns=["r", "n1", "n2", "n3", "n4", "more"])

    low = found.where("kind = 3").groupBy("bucket").applyInPandas(stat_bucket, "r int, n1 long, n2 long, n3 long, n4 long, more long")
    low = low.agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more"))).first()
    discard(found)
    model.pairs = int(sums[0])
    model.discount_low = _discounts([low.n1, low.n2, low.n3, low.n4])
    model.low_counts = (low.n1, low.n2, low.more)
    return model


def _context(folder: str, k: int, kind: str, b: int, keys: np.ndarray, tally: list[np.ndarray], own: np.ndarray) -> None:
    _save(folder, f"context{k}{kind}-{b}", keys[own])
    for name, t in zip(("total", "one", "two", "more"), tally):
        _save(folder, f"{name}{k}{kind}-{b}", _narrow(t[own]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), row by row.

    The lower order interpolates continuation counts with a uniform share for each training word and
    one unknown word; a context that is unknown or never followed leaves the lower order alone.
    """
    ship(docs.sparkSession)

    def scan(batches):
        cache: dict = {}
        m = model
        bos, V, N = m.vocabulary, m.vocabulary, m.tokens
        end_id, end_count = (int(x[0]) for x in m.ids(np.array([END]), cache))
        left = sum(d * n for d, n in zip(m.discount_low, m.low_counts)) / m.pairs if m.pairs else 1.0
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), SCORED_BYTES):
                w = Words(data, offsets, NOT_SPACE)
                known, back = np.unique(w.hash, return_inverse=True)
                ids, counts = m.ids(known, cache)
                columns, first = _sequence(w, ids[back], end_id, bos, m.order)
                previous, token = columns[-2:]
                inner = np.ones(len(token), dtype=bool)
                inner[first[1:] - 1] = False
                count = np.full(len(token), end_count, dtype=np.int64)
                count[inner] = counts[back]
                base = np.log10((count + 1) / (N + V + 1))
                # word statistics by distinct id
                some, at = np.unique(np.concatenate([previous, token]), return_inverse=True)
                stat = m.stats(some, cache)
                word = some.copy()
                low = _discounted(stat[:, 3], m.discount_low) / max(m.pairs, 1) + left / (V + 1)
                low[word < 0] = left / (V + 1)
                p, t = at[: len(token)], at[len(token) :]
                prob = low[t]
                if m.discounts:
                    total, tally = stat[p, 4], stat[p, :3]
                    for k in range(2, m.order + 1):
                        gram = columns[-k:]
                        if k > 2:  # a context is an n-gram of the order below, one token back
                            seen = np.zeros(len(token), dtype=bool)
                            seen[1:] = times[:-1] > 0
                            seen[first[:-1]] = False
                            seen &= gram[0] != bos + 1
                            found = m.contexts(gram, seen, cache)
                            total, tally = found[:, 0], found[:, 1:]
                        else:
                            seen = (previous >= 0) & (total > 0)
                        times = m.gram_counts(gram, seen & (token >= 0), cache)
                        size = np.where(seen, total, 1)
                        prob = np.where(seen, (_discounted(times, m.discounts[k]) + tally @ np.array(m.discounts[k]) * prob) / size, prob)
                logs = np.log10(prob)
                n = hi - lo
                add = lambda x: np.add.reduceat(x, first[:-1]) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(add((count > 0).astype(np.int64)), pa.int64()),
                        pa.array(np.full(n, N), pa.int64()),
                        pa.array(add(base), pa.float64()),
                        pa.array(add(logs), pa.float64()),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def digest(docs: DataFrame, order: int = 2) -> DataFrame:
    """Train on the rows that aren't held out and score all."""
    scored = score(docs, train(docs, ~held_out(F.col("doc_id")), order))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
