"""Periodic runs: stretches of words that repeat with a period, found on a grammar of the texts.

The word ids of a slice of texts are compressed by Re-Pair: in each round pairs of symbols that occur
twice or more become a new symbol, the most frequent of neighbouring pairs first, until next to none
are left.  What is left of a text is joined by a balanced tree.  A run is met at the lowest node that
covers it, where it crosses the border of the node's two halves.  So each nonterminal's border is
searched once, at one of its places, and what is found is carried to all places where the symbol was
made; of the stretches with one period those that lie in a longer one go.

A period q at a border is tried only where the few words beside the border come again q words away.
How far equal words go on is read from names of the word groups of 1, 2, 4, ... words (equal groups have
equal names, by sorting), so every answer is exact.  A text in which no group of the size that a
run repeats at least comes twice has no run and enters no grammar.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, ship, slices

#: Text that one grammar covers, or one longer text.
GRAMMAR_BYTES = 2 << 20
#: Places tried at once.
_CHUNK = 1 << 20
#: Re-Pair ends when a round replaces fewer than one symbol in so many; the tree does the rest.
_WORTH = 200


def group_names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """By level k, a number for the 2^k words at each place, equal where the words are, up to groups of longest."""
    names = [ids.astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        half = 1 << (len(names) - 1)
        last = names[-1]
        if len(last) <= half:
            break
        names.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])
    return names


def _ahead(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on (a < b), up to end."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        i = np.flatnonzero(b + out + (1 << k) <= end)
        i = i[names[k][a[i] + out[i]] == names[k][b[i] + out[i]]]
        out[i] += 1 << k
    return out


def _behind(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b, down to begin."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        i = np.flatnonzero(a - out - (1 << k) >= begin)
        i = i[names[k][a[i] - out[i] - (1 << k)] == names[k][b[i] - out[i] - (1 << k)]]
        out[i] += 1 << k
    return out


class Grammar:
    """Re-Pair rules over texts ids[first[i]:first[i + 1]]: each node's place, border and end, and all places of the rules.

    low, mid, high: the words of a node's first place and its border; node i < rules occurs at
    places[at[i]:at[i + 1]]; the others are nodes of the trees over what is left of the texts.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, least: int):
        symbol = ids.astype(np.int64)
        begin = np.arange(len(ids))
        end = begin + 1
        last = np.zeros(len(ids), dtype=bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        rng = np.random.default_rng(1)
        low, mid, high, places = [], [], [], []
        while len(symbol) > 1:
            inside = np.flatnonzero(~last[:-1])
            pairs, which, n = np.unique(symbol[inside] * (int(symbol.max()) + 1) + symbol[inside + 1], return_inverse=True, return_counts=True)
            if not len(n) or n.max() < 2:
                break
            # by frequency, ties at random; 0 where a pair occurs once
            weight = np.where(n >= 2, n * len(n) + rng.permutation(len(n)), 0)
            rank = np.zeros(len(symbol) + 1, dtype=np.int64)  # rank[i + 1]: of the pair at i
            rank[inside + 1] = weight[which]
            # pairs of one symbol can follow each other: of such a stretch every second is taken
            head = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            tail = np.append(head[1:], len(rank))
            after = np.append(rank[head[1:]], 0)
            won = (rank[head] > rank[head - 1]) & (rank[head] > after)
            head, tail = head[won], tail[won]
            size = (tail - head + 1) // 2
            pick = np.repeat(head - 1, size) + 2 * (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            if len(pick) * _WORTH < len(symbol):
                break
            kind = np.searchsorted(inside, pick)
            _, one, new = np.unique(which[kind], return_index=True, return_inverse=True)
            rep = pick[one]
            long = end[rep + 1] - begin[rep] >= least
            order = np.argsort(new, kind="stable")
            order = order[long[new[order]]]
            low.append(begin[rep[long]])
            mid.append(begin[rep[long] + 1])
            high.append(end[rep[long] + 1])
            places += np.split(begin[pick[order]], np.flatnonzero(np.diff(new[order])) + 1) if len(order) else []
            fresh = int(symbol.max()) + 1
            symbol[pick] = fresh + new
            end[pick], last[pick] = end[pick + 1], last[pick + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[pick + 1] = False
            symbol, begin, end, last = symbol[keep], begin[keep], end[keep], last[keep]
        self.rules = sum(map(len, low))
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in places], dtype=np.int64)]).astype(np.int64)
        self.places = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        # border j of a text's k symbols is that of the node from j - t to j + t, t the lowest bit of j
        head = np.searchsorted(begin, first[:-1])
        k = np.diff(np.append(head, len(begin)))
        j = np.arange(len(begin)) - np.repeat(head, k)
        some = j > 0
        j, head, k = j[some], np.repeat(head, k)[some], np.repeat(k, k)[some]
        t = j & -j
        lo, hi = begin[head + j - t], end[head + np.minimum(j + t, k) - 1]
        long = hi - lo >= least
        self.low = np.concatenate([*low, lo[long]]).astype(np.int64)
        self.mid = np.concatenate([*mid, begin[(head + j)[long]]]).astype(np.int64)
        self.high = np.concatenate([*high, hi[long]]).astype(np.int64)


def _crossing(g: Grammar, names: list[np.ndarray], beside: int, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs within a node that cross its border or touch it."""
    level = beside.bit_length() - 1
    near, width = names[level], 1 << level
    n = len(names[0]) + 1
    order = np.argsort(near, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    sorted_ = near[order] * n + order
    span = (g.high - g.low) // times
    # to the right: the words at the border come again q later; to the left: those before it q earlier
    right = np.flatnonzero(g.mid + width < g.high)
    at = g.mid[right]
    most = np.minimum(span[right], g.high[right] - width - at)
    ahead = np.searchsorted(sorted_, near[at] * n + at + most, side="right") - rank[at] - 1
    left = np.flatnonzero(g.mid - width > g.low)
    to = g.mid[left] - width
    most = np.minimum(span[left], to - g.low[left])
    back = rank[to] - np.searchsorted(sorted_, near[to] * n + to - most, side="left")
    node = np.concatenate([right, left])
    size = np.concatenate([ahead, back])
    from_ = np.concatenate([rank[at] + 1, rank[to] - back])
    base = np.concatenate([at, to])
    some = size > 0
    node, size, from_, base = node[some], size[some], from_[some], base[some]
    side = (np.arange(len(some)) < len(right))[some]
    found: list[tuple[np.ndarray, ...]] = []
    cut = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + _CHUNK, side="right")) - 1)
        s = size[i:j]
        who = np.repeat(np.arange(i, j), s)
        other = order[np.repeat(from_[i:j], s) + np.arange(s.sum()) - np.repeat(cut[i:j] - cut[i], s)]
        x = node[who]
        q = np.abs(other - base[who])
        a = np.where(side[who], g.mid[x], g.mid[x] - q)
        start = a - _behind(names, a, a + q, g.low[x])
        end = a + q + _ahead(names, a, a + q, g.high[x])
        ok = end - start >= np.maximum(least, times * q)
        found.append((x[ok], start[ok], end[ok], q[ok]))
        i = j
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    x, start, end, q = (np.concatenate(c) for c in zip(*found))
    return _smallest(x, start, end, q)


def _smallest(x: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each node and stretch, with its smallest period: multiples of a period give the same stretch."""
    order = np.lexsort((q, end, start, x))
    x, start, end, q = x[order], start[order], end[order], q[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return x[keep], start[keep], end[keep], q[keep]


def runs(ids: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs of texts ids[first[i]:first[i + 1]], by start, then period.

    A run has its smallest period, at least `least` words and `times` periods, and can't be longer.
    """
    beside = _beside(least, times)
    none = (np.zeros(0, dtype=np.int64),) * 3
    size = np.diff(first)
    if not len(size) or size.max() < least:
        return none
    g = Grammar(ids, first, least)
    if not len(g.low):
        return none
    x, start, end, q = _crossing(g, group_names(ids, int(size.max())), beside, least, times)
    # to all places of a rule
    rule = x < g.rules
    n = np.where(rule, g.at[np.minimum(x, g.rules - 1) + 1] - g.at[np.minimum(x, g.rules - 1)], 1) if g.rules else np.ones(len(x), dtype=np.int64)
    which = np.repeat(np.arange(len(x)), n)
    shift = np.zeros(len(which), dtype=np.int64)
    on = rule[which]
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    shift[on] = g.places[(g.at[np.minimum(x, max(g.rules - 1, 0))][which] + nth)[on]] - g.low[x[which[on]]]
    start, end, q = start[which] + shift, end[which] + shift, q[which]
    # of stretches with one period those within another go
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    far = q * (len(ids) + 1) + end
    keep = np.ones(len(q), dtype=bool)
    keep[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
    _, start, end, q = _smallest(np.zeros(keep.sum(), dtype=np.int64), start[keep], end[keep], q[keep])
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _beside(least: int, times: int) -> int:
    """Words beside a border, on one side of it, that come again a period away in every run across it."""
    n = least * (times - 2) // (2 * times)
    if times < 3 or n < 1:
        raise ValueError("runs need 3 periods or more, and at least 2 * times / (times - 2) words")
    return n


def repeating(ids: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Whether a text holds some group of words twice, as it does if it has a run (by hash: some others may pass)."""
    width = least - least // times
    h = mix(ids.astype(np.uint64))
    size = 1
    while 2 * size <= width:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]) if len(h) > size else h[:0]
        size *= 2
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(h))
    inside = text[at] == text[np.minimum(at + size - 1, len(text) - 1)] if len(at) else np.zeros(0, dtype=bool)
    h, text = h[inside], text[: len(h)][inside]
    h = mix(h + text.astype(np.uint64))
    order = np.argsort(h)
    out = np.zeros(len(first) - 1, dtype=bool)
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    out[text[order[same]]] = True
    return out


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period; ties by start, then period, as the runs are sorted."""
    best = 0
    for i in range(1, len(start)):
        if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())]


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3, edit: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str = "doc_id") -> DataFrame:
    """docs(text, ...) plus n_words, runs (by start, then period), strongest and collapsed (such columns are replaced).

    Words are what ASCII white space parts.  strongest is the run with the greatest length / period (ties:
    smallest start, then period; null without runs).  collapsed holds, parted by one space, the words that
    no run contains after its first period.  Null, empty and blank texts have no words, no run and an
    empty collapsed text.  Rows are judged one by one, so repeated rows and ids, null ids and an empty table are fine;
    other columns pass through.  A row's words are held by one task.  edit(row's key, words) gives the
    words to judge instead of those of the text, if given.
    """
    _beside(least, times)
    ship(docs.sparkSession)
    docs = docs.drop(*(f.name for f in _ADDED))
    column = docs.columns.index("text")
    names = docs.columns
    id_column = docs.columns.index(key) if edit else None
    added = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("strongest", pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), ("collapsed", pa.string())])

    def judge(texts: list[list[bytes]]) -> list[tuple]:
        number: defaultdict = defaultdict(count().__next__)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ids = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        some = np.flatnonzero(repeating(ids, first, least, times))
        within = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int64)
        part = np.concatenate([ids[first[i] : first[i + 1]] for i in some]) if len(some) else ids[:0]
        start, end, q = runs(part, within, least, times)
        owner = np.searchsorted(within, start, side="right") - 1
        out = [(len(t), [], None, b" ".join(t).decode()) for t in texts]
        cut = np.searchsorted(owner, np.arange(len(some) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            i, rows = int(some[k]), slice(cut[k], cut[k + 1])
            s, e, p = start[rows] - within[k], end[rows] - within[k], q[rows]
            cover = np.zeros(sizes[i] + 1, dtype=np.int64)
            np.add.at(cover, s + p, 1)
            np.add.at(cover, e, -1)
            kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
            words = texts[i]
            found = [{"start": int(a), "length": int(b - a), "period": int(c)} for a, b, c in zip(s, e, p)]
            out[i] = (len(words), found, found[_strongest(s, e - s, p)], b" ".join([words[w] for w in kept]).decode())
        return out

    def scan(batches):
        for batch in batches:
            keys = batch.column(id_column).to_pylist() if edit else None
            for lo, hi, data, offsets in slices(batch.column(column), GRAMMAR_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:])]
                if edit:
                    texts = [edit(k, t) for k, t in zip(keys[lo:hi], texts)]
                part = batch.slice(lo, hi - lo)
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*judge(texts)), added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*names, *added.names])

    # numbered names on the way in: mapInArrow doesn't take names with dots
    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(scan, T.StructType([*docs.schema.fields, *_ADDED]))


def cyclic_tail(key: object, words: list[bytes]) -> list[bytes]:
    """The query's texts: for one key in ten the words from some place on repeat their first few; a null key changes nothing."""
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    found = collapse_runs(docs.select("doc_id", "text"), edit=cyclic_tail)
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    best: Column = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
