"""Pairs of rows that share a key, with hot keys split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key on each side of a group; a key with more is dealt into blocks, and blocks meet blocks.
BLOCK = 2048
#: Rows of a side that may be sent to all tasks.
SMALL = 5000


def _dealt(rows: DataFrame, counts: DataFrame, id_: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
    """rows(id_, k, ...) with mine (its own block) and theirs (each block of the other side)."""
    r = rows.join(counts, "k", "left")
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(1)) / BLOCK), F.lit(1)).cast("int")
    r = r.withColumn(mine, F.pmod(F.xxhash64(id_), blocks(F.col(own))).cast("int"))
    return r.select(*rows.columns, mine, F.explode(F.sequence(F.lit(0), blocks(F.col(other)) - 1)).alias(theirs))


def shared_key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(a, k), right(b, k) -> distinct (a, b) with a before b that share a key; null keys are shared by none.

    A left side of at most SMALL rows is sent to all tasks.  Otherwise the rows of a key with more than BLOCK on a
    side are dealt into blocks, and each pair of blocks is a group of its own, whatever Spark finds at run time.
    """
    return _met(left, right, "a", "b").select("a", "b").distinct()


def first_key_rows(left: DataFrame, right: DataFrame, a: str = "id_a", b: str = "id_b", keys: tuple[str, str] = ("keys_a", "keys_b")) -> DataFrame:
    """Rows of left(a, k, keys, ...) and right(b, k, keys, ...), all other columns of different names, with a before b that share a key, once.

    A pair is taken where it meets under the smallest key that both hold, so pairs are neither shuffled nor collected to find those
    that meet several times.  A row stands under each of its keys.
    """
    once = F.col("k") == F.array_min(F.array_intersect(*keys))
    return _met(left, right, a, b).where(once).drop("k", "i", "j", *keys)


def _met(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    left, right = left.where("k is not null"), right.where("k is not null")
    before = F.col(a) < F.col(b)
    if left.limit(SMALL + 1).count() <= SMALL:
        return F.broadcast(left).join(right, "k").where(before)
    # a row for each key that is hot on one side; keys that aren't have one block
    n = left.groupBy("k").agg(F.count(F.lit(1)).alias("l")).join(right.groupBy("k").agg(F.count(F.lit(1)).alias("r")), "k").where((F.col("l") > BLOCK) | (F.col("r") > BLOCK))
    x, y = _dealt(left, n, a, "l", "r", "i", "j"), _dealt(right, n, b, "r", "l", "j", "i")
    return x.join(y, ["k", "i", "j"]).where(before)


def text_key(kind: str, *parts: Column) -> Column:
    """One key of several values; null if one is.  Values that hold the sign between them may share a key with others."""
    return F.concat(F.lit(f"{kind}|"), *(x for p in parts for x in (p.cast("string"), F.lit("|"))))
