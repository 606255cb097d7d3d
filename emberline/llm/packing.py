"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most a sequence's length (only the first of a long document is
shorter).  Pieces are dealt by hash into problems of bounded size, each searched by several islands:
a population of packings whose crossover takes whole well-filled bins of one parent, removes the
other parent's bins that hold their pieces, and best-fits the displaced pieces.  After each epoch the
islands' best packings move on to the next island of the ring.  An island stops early where its best
packing has as few bins as its pieces' total allows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, written

CAPACITY = 2048
PROBLEM_PIECES = 6000
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 3, 6, 10
#: Entries of a worker's table of encoded chunks.
CACHED = 300_000

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as little-endian 32-bit bytes.

    The vocabulary file is read by `tokenizers`; the merging is done by `tiktoken` on the same ranks,
    which is several times faster and gives the same ids (tested).  A text is cut before single
    spaces, where the pattern always cuts, and encoded chunks are remembered.  Texts with two spaces
    in a row, whose runs belong together, are encoded whole.  ids() spells added tokens out like other
    text; document() gives them their own ids, as `tokenizers` does unless told otherwise.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if not t.startswith("<|")}
        self.encode = tiktoken.Encoding("corpus", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks: dict[str, bytes] = {}
        added = tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on the text around them")

    def document(self, text: str) -> bytes:
        if self.cuts is None or not self.cuts.search(text):
            return self.ids(text)
        return b"".join(self.added[x] if i % 2 else self.ids(x) for i, x in enumerate(self.cuts.split(text)))

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if "  " in text:
            return self.whole(text)
        head, *rest = text.split(" ")
        chunks = self.chunks
        missing = set(rest).difference(chunks)
        if missing:
            if len(chunks) + len(missing) > CACHED:
                chunks.clear()
                missing = set(rest)
            chunks.update((c, self.whole(f" {c}")) for c in missing)
        return (self.whole(head) if head else b"") + b"".join(map(chunks.__getitem__, rest))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32; null texts are just the end token."""
    ship(docs.sparkSession)
    closing = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer).document
        for batch in batches:
            ids = batch.column(0)
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + closing
                n = len(data) // 4
                first = n % capacity or capacity
                at = 0
                while at < n:
                    size = first if at == 0 else capacity
                    rows.append(i)
                    piece.append(0 if at == 0 else (at - first) // capacity + 1)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the genetic algorithm


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put items of order into the bins that they fill most, opening bins as needed; bins and fill change."""
    free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        if f < capacity:
            free.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = free[room]
            b = own.pop()
            if not own:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i] = b
        fill[b] += size
        if room > size:
            free.setdefault(room - size, []).append(b)
            mask |= 1 << (room - size)


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _cost(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins used, then how unevenly they are filled: full bins and one empty one are better than equal ones."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def _from_scratch(order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.full(len(lengths), -1, dtype=np.int32)
    best_fit(order, lengths, bins, [], capacity)
    return bins


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """b's well-filled bins go into a whole; a's bins that share a piece with them are dissolved."""
    fill_b = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    taken = np.zeros(len(fill_b), dtype=bool)
    taken[well[rng.random(len(well)) < 0.5]] = True
    given = taken[b]
    hit = np.zeros(a.max() + 1, dtype=bool)
    hit[a[given]] = True
    # the worst remaining bins go as well, so that their pieces find new places
    fill_a = np.bincount(a, weights=lengths)
    hit[np.argsort(fill_a)[: max(1, len(fill_a) // 50)]] = True
    stay = ~given & ~hit[a]
    child = np.full(len(a), -1, dtype=np.int64)
    child[given] = b[given]
    child[stay] = a[stay].astype(np.int64) + len(fill_b)
    placed = child >= 0
    child[placed] = _compact(child[placed])
    fill = np.bincount(child[placed], weights=lengths[placed]).astype(int).tolist()
    loose = np.flatnonzero(~placed)
    loose = loose[np.argsort(-(lengths[loose] + rng.integers(0, 64, len(loose))), kind="stable")]
    best_fit(loose, lengths, child, fill, capacity)
    return _compact(child)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], rng: np.random.Generator, capacity: int) -> list[np.ndarray]:
    """One epoch of an island: the population, best first."""
    least = -(-int(lengths.sum()) // capacity)
    population = [*seeds]
    if not population:
        population.append(_from_scratch(np.argsort(-lengths, kind="stable"), lengths, capacity))
    while len(population) < POPULATION and _cost(population[0], lengths, capacity)[0] > least:
        blur = lengths + rng.integers(0, 256, len(lengths))
        population.append(_from_scratch(np.argsort(-blur, kind="stable"), lengths, capacity))
    ranked = sorted(((_cost(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    count = len(population)
    for _ in range(GENERATIONS):
        if ranked[0][0][0] <= least:
            break
        parents = rng.integers(0, len(ranked), (2, 2)).min(axis=0)
        a, b = ranked[parents[0]][2], ranked[parents[1]][2]
        child = crossover(a, b, lengths, rng, capacity)
        ranked.append((_cost(child, lengths, capacity), count, child))
        count += 1
        ranked = sorted(ranked, key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in ranked]


def pack(found: DataFrame, capacity: int = CAPACITY, seed: int = 1) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) with sequence_id and offset.

    Every row is placed, repeated rows each for itself; no pieces give no rows.  Pieces are dealt to problems by a
    number of their row as well, so that repeated rows and null ids don't gather in one problem.
    """
    ship(found.sparkSession)
    problem, row = fresh(found, "problem", "row")
    # written once: both readers below must see the same numbers
    found = written(found.withColumn(row, F.monotonically_increasing_id()), "pieces")
    n = found.count()
    problems = max(1, -(-n // PROBLEM_PIECES))
    found = found.withColumn(problem, F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", row), F.lit(problems))).drop(row)
    order = ["length", "doc_id", "piece", "ids_crc32"]

    def lay_out(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(rows["length"].to_numpy())[::-1]
        lengths = lengths[lengths < capacity].astype(np.int32)
        return pd.DataFrame({"problem": [key[0]] * ISLANDS, "island": range(ISLANDS), "lengths": [lengths.tobytes()] * ISLANDS, "packing": [None] * ISLANDS, "bins": [0] * ISLANDS, "least": [0] * ISLANDS})

    state = "problem long, island int, lengths binary, packing binary, bins long, least long"
    islands = found.select(F.col(problem).alias("problem"), "length").groupBy("problem").applyInPandas(lay_out, state)

    def epoch(number: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lengths = np.frombuffer(rows["lengths"].iloc[0], dtype=np.int32).astype(np.int64)
            seeds = [np.frombuffer(x, dtype=np.int32) for x in rows["packing"] if x is not None]
            rng = np.random.default_rng([seed, number, int(key[0]), int(key[1])])
            best = evolve(lengths, seeds, rng, capacity)[:2]
            least = -(-int(lengths.sum()) // capacity)
            out = [(key[0], key[1], rows["lengths"].iloc[0], p.astype(np.int32).tobytes(), int(p.max(initial=-1)) + 1, least) for p in best]
            # the best one moves to the next island of the ring too
            p = best[0]
            out.append((key[0], (key[1] + 1) % ISLANDS, rows["lengths"].iloc[0], p.astype(np.int32).tobytes(), int(p.max(initial=-1)) + 1, least))
            return pd.DataFrame(out, columns=["problem", "island", "lengths", "packing", "bins", "least"])

        return run

    for number in range(EPOCHS):
        islands = written(islands.groupBy("problem", "island").applyInPandas(epoch(number), state), "islands")
        if islands.groupBy("problem").agg(F.min("bins").alias("b"), F.max("least").alias("l")).where("b > l").isEmpty():
            break
    best = islands.groupBy("problem").agg(F.min_by("packing", F.struct("bins", "island", F.crc32("packing"))).alias("packing"))

    fields = [f for f in found.schema if f.name != problem]
    names = [f.name for f in fields]

    def place(key: tuple, rows: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        full = int((lengths >= capacity).sum())
        packing = np.frombuffer(solution["packing"].iloc[0], dtype=np.int32).astype(np.int64)
        bins = np.concatenate([np.arange(full), packing + full])
        by = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[by]) - lengths[by]
        first = np.flatnonzero(np.concatenate([[True], bins[by][1:] != bins[by][:-1]]))
        offset = np.empty(len(rows), dtype=np.int64)
        offset[by] = before - np.repeat(before[first], np.diff(np.append(first, len(rows))))
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return found.groupBy(problem).cogroup(best.groupBy("problem")).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id 0 alone; null and repeated ids are kept, each row for itself.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
