"""Helpers shared by the corpus operators: session plumbing and vectorised text scanning.

Text scanning works on the raw UTF-8 buffer of an Arrow string column.  A word's 64-bit hash is made
of its blocks of eight bytes, mixed nonlinearly one after the other; all words take their next block
together, so a batch is tokenised and hashed without a Python loop over words.  Batches are cut into
slices of bounded bytes; a slice always holds whole rows.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="emberline-"), "emberline_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in [root / "emberline/__init__.py", *sorted((root / "emberline/llm").glob("*.py"))]:
            z.write(p, p.relative_to(root))
    sc.addPyFile(target)
    _shipped.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (spark.checkpoint.dir), set here only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/emberline-{name}-{uuid.uuid4().hex[:12]}"


def mounted_path(spark: SparkSession, name: str) -> str:
    """A new folder below shared_dir() as a plain path, for files that workers memory-map."""
    url = urlparse(shared_path(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {url.scheme}://")
    path = unquote(url.path)
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by written() that no later result reads."""
    for df in frames:
        for f in df.inputFiles():
            folder = os.path.dirname(unquote(urlparse(f).path))
            if "/emberline-" in folder and urlparse(f).scheme in ("", "file"):
                shutil.rmtree(folder, ignore_errors=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns (case aside)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
        have.add(name.lower())
    return out


def bucket_count(total_bytes: int, per_bucket: int = 24 << 20, least: int = 12) -> int:
    return max(least, -(-int(total_bytes) // per_bucket))


# ---------------------------------------------------------------- text scanning

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Blocks of eight bytes that all words take together; what a word has beyond them is hashed on its own.
_TOGETHER = 64
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = x + _BASE
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] of each word; they depend on the word's bytes only."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place
    left = end - start
    out = mix(left.astype(np.uint64))
    rows, at = np.arange(len(start)), start
    for _ in range(_TOGETHER):
        if not len(rows):
            return out
        out[rows] = mix(out[rows] ^ (blocks[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i, a, n in zip(rows, at, left):
        out[i] = mix(out[i : i + 1] ^ np.uint64(xxhash.xxh64_intdigest(padded[a : a + n].tobytes())))[0]
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but ASCII white space; ASCII alphanumerics and all beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """Words of consecutive texts: hash, byte range and, by text, their range [first[i], first[i+1])."""

    __slots__ = ("data", "hash", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        self.data = data = LOWER[data]
        inside = table[data]
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = False, inside
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        before[offsets] = False
        start = np.flatnonzero(inside & ~before[:n])
        after[offsets] = False
        end = np.flatnonzero(inside & ~after[1:]) + 1
        self.hash = _word_hashes(data, start, end)
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_word(word: bytes) -> int:
    """The hash that Words gives a word."""
    return int(Words(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]), np.ones(256, dtype=bool)).hash[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(lo, hi, bytes, offsets) of runs of rows of at most limit bytes, or of one row; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
