"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the items' windows of 13 consecutive words (an item of fewer words is one window).
For one window length m a block is B = 2 words (1 for m = 1):

* the shift table tells, by the block that ends at a position, how far the search may move on
  before a window can end: m - B + 1 for blocks that no window holds;
* where the shift is 0, the block (the window's suffix) selects a bucket of windows, and the block at
  the window's start narrows it, as in the published algorithm;
* the words themselves are then compared.

A text is searched by many cursors at once, each in charge of a short stretch, so that every step is a
numpy operation over all live cursors of a slice.  Documents are read once and never shuffled.
Benchmark tables are built by tasks, one for each block of bounded text, as files in the shared folder that
workers memory-map: the benchmark passes neither through the driver nor into the memory of a worker.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, mix, mounted_path, ship, slices

WINDOW = 13
#: Text of benchmark items that one task makes into tables (or one longer item); more text makes more files.
BLOCK_BYTES = 32 << 20
#: Stretch of end positions that one cursor searches, in multiples of the longest shift.
STRETCH = 4

_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _blocks(h: np.ndarray, end: np.ndarray, b: int) -> np.ndarray:
    return h[end] if b == 1 else mix(h[end - 1] * _K1 + h[end])


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, place within its range) of the ranges [first, first + count) one after the other."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + nth, nth


def _joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each starts and ends there."""
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1
    text = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    text[_ranges(end - size, size)[0]] = w.data[_ranges(w.start, size)[0]]
    return text, end - size, end


def tables(names: list[str], texts: list[str], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The search tables of a block of items, as named arrays: a set for each window length, the words and the items' names."""
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM)
    text, start, end = _joined(w)
    label = [n.encode() for n in names]
    out = {"text": text, "names": np.frombuffer(b"".join(label), dtype=np.uint8), "names_at": np.cumsum([0, *map(len, label)])}
    n_words = np.diff(w.first)
    lengths = np.minimum(n_words, window)
    for m in np.unique(lengths[lengths > 0]).tolist():
        b = min(2, m)
        item = np.flatnonzero(lengths == m)
        at, nth = _ranges(w.first[item], n_words[item])
        item = np.repeat(item, n_words[item])
        # a block early in its item is nearest to the end of the first window, any later one ends a window
        ends = nth >= b - 1
        keys, shifts = _blocks(w.hash, at[ends], b), np.maximum(m - 1 - nth[ends], 0)
        order = np.lexsort((shifts, keys))
        keys, one = np.unique(keys[order], return_index=True)
        last, item = at[nth >= m - 1], item[nth >= m - 1]
        combined = mix(_blocks(w.hash, last, b) * _K2 + _blocks(w.hash, last - m + b, b))
        whole = combined
        for k in range(m):
            whole = mix(whole ^ w.hash[last - k])
        by = np.lexsort((last, whole, combined))
        last, item, combined, whole = last[by], item[by], combined[by], whole[by]
        lo, hi = start[last - m + 1], end[last]
        # equal windows are one pattern; windows that only hash alike are told apart by their words
        new = np.ones(len(last), dtype=bool)
        for i in np.flatnonzero((combined[1:] == combined[:-1]) & (whole[1:] == whole[:-1])) + 1:
            new[i] = not np.array_equal(text[lo[i] : hi[i]], text[lo[i - 1] : hi[i - 1]])
        at = np.flatnonzero(new)
        buckets, bucket_at = np.unique(combined[at], return_index=True)
        made = {
            "keys": keys,
            "shifts": shifts[order][one],
            "buckets": buckets,
            "bucket_at": np.append(bucket_at, len(at)),
            "lo": lo[at],
            "hi": hi[at],
            "item_at": np.append(at, len(last)),
            "item": item,
        }
        out |= {f"{m}.{name}": array for name, array in made.items()}
    return out


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, written whole or not at all; tasks that run twice write the same.  The index comes last."""
    partial, index, at = f"{path}.{os.getpid()}.part", {}, 0
    with open(partial, "wb") as f:
        for name, a in arrays.items():
            index[name] = (at, len(a), a.dtype.str)
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
            at += a.nbytes + -a.nbytes % 8
        tail = json.dumps(index).encode()
        f.write(tail + len(tail).to_bytes(8, "little"))
    os.replace(partial, path)


def _load(path: str) -> dict[str, np.ndarray]:
    """Views of a file's arrays: pages are read when they are used and belong to the system's cache."""
    raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    index = json.loads(raw[-8 - int.from_bytes(raw[-8:].tobytes(), "little") : -8].tobytes())
    return {name: np.frombuffer(raw, dtype=kind, count=n, offset=at) for name, (at, n, kind) in index.items()}


class Patterns:
    """The tables of one block of items for windows of one length."""

    def __init__(self, arrays: dict[str, np.ndarray], m: int):
        self.m, self.b, self.most = m, min(2, m), max(1, m - 1)
        self.text, self.names, self.names_at = arrays["text"], arrays["names"], arrays["names_at"]
        for name in ("keys", "shifts", "buckets", "bucket_at", "lo", "hi", "item_at", "item"):
            setattr(self, name, arrays[f"{m}.{name}"])

    def items(self, pattern: int) -> set[str]:
        held = self.item[self.item_at[pattern] : self.item_at[pattern + 1]]
        return {self.names[self.names_at[i] : self.names_at[i + 1]].tobytes().decode() for i in held}

    def search(self, w: Words) -> tuple[np.ndarray, list[int]]:
        """(end word of each occurrence, its pattern), ends in no order."""
        m, h = self.m, w.hash
        counts = np.diff(w.first) - (m - 1)
        docs = np.flatnonzero(counts > 0)
        if not len(docs):
            return np.zeros(0, dtype=np.int64), []
        width = self.most * STRETCH
        lanes = -(-counts[docs] // width)
        doc = np.repeat(docs, lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = w.first[doc] + m - 1 + nth * width
        stop = np.minimum(at + width, w.first[doc + 1])
        found: list[np.ndarray] = []
        while len(at):
            block = _blocks(h, at, self.b)
            i = np.minimum(np.searchsorted(self.keys, block), len(self.keys) - 1)
            shift = np.where(self.keys[i] == block, self.shifts[i], self.most)
            hit = shift == 0
            if hit.any():
                e = at[hit]
                combined = mix(block[hit] * _K2 + _blocks(h, e - m + self.b, self.b))
                j = np.minimum(np.searchsorted(self.buckets, combined), len(self.buckets) - 1)
                e = e[self.buckets[j] == combined]
                if len(e):
                    found.append(e)
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends, which = [], []
        for e in np.concatenate(found) if found else ():
            key = mix(_blocks(h, e[None], self.b) * _K2 + _blocks(h, e[None] - m + self.b, self.b))
            j = int(np.searchsorted(self.buckets, key)[0])
            text = b" ".join([w.bytes(k) for k in range(e - m + 1, e + 1)])
            for p in range(self.bucket_at[j], self.bucket_at[j + 1]):
                if self.text[self.lo[p] : self.hi[p]].tobytes() == text:
                    ends.append(e)
                    which.append(p)
        return np.array(ends, dtype=np.int64), which


def _item_files(benchmark: DataFrame, window: int) -> list[str]:
    """Files of tables, each made by one task from about BLOCK_BYTES of text or one longer item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").distinct()
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    folder = mounted_path(spark, "benchmark")

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "text"])
        _save(os.path.join(folder, str(key[0])), tables(rows["item"].tolist(), rows["text"].tolist(), window))
        return pd.DataFrame({"block": [key[0]]})

    grouped = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).groupBy("block")
    return [os.path.join(folder, str(r.block)) for r in grouped.applyInPandas(make, "block long").collect()]


def _patterns(files: list[str]) -> list[Patterns]:
    held = [_load(f) for f in files]
    return [Patterns(a, m) for a in held for m in sorted(int(k.split(".")[0]) for k in a if k.endswith(".keys"))]


def _hits(w: Words, patterns: list[Patterns]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Hit words of each text, and the items that occur in it."""
    items: dict[int, set[str]] = {}
    cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
    for p in patterns:
        ends, which = p.search(w)
        np.add.at(cover, ends - p.m + 1, 1)
        np.add.at(cover, ends + 1, -1)
        for d, k in zip((np.searchsorted(w.first, ends, side="right") - 1).tolist(), which):
            items.setdefault(d, set()).update(p.items(k))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return hit[w.first[1:]] - hit[w.first[:-1]], items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_hit, items (sorted strings), contaminated, in the order of rows.

    A word inside any occurrence of a window is hit; a document is contaminated if 1 / share of its
    words or more are hit.  Null and empty texts have no words and are clean; rows are judged one by
    one, so repeated and null ids are kept; items with a null id or without words match nothing; an
    empty table on either side is fine.
    """
    spark = docs.sparkSession
    ship(spark)
    files = _item_files(benchmark, window)

    def search(batches):
        patterns = _patterns(files)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, ALNUM)
                n = hi - lo
                n_words = np.diff(w.first)
                n_hit, items = _hits(w, patterns)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                        pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "contaminated"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean"
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns.

    The verdict is made row by row in the same pass, so nothing is joined back.
    """
    ship(docs.sparkSession)
    files = _item_files(benchmark, window)
    column = docs.columns.index("text")

    def keep(batches):
        patterns = _patterns(files)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(column)):
                w = Words(data, offsets, ALNUM)
                n_hit, _ = _hits(w, patterns)
                yield batch.slice(lo, hi - lo).filter(pa.array(~((n_hit > 0) & (share * n_hit >= np.diff(w.first)))))

    return docs.mapInArrow(keep, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
grams AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
  FROM doc, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hits AS (SELECT g.rid, g.i, g.m, win.item_id FROM grams g JOIN win ON win.m = g.m AND win.w = g.w),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN cover USING (rid) LEFT JOIN names USING (rid)
"""
