"""Sharding by proportional stratified interleaving.

Rows of a source are put into a seeded random order; a row of rank r among n gets the fraction
(r - 1/2) / n.  In the order of fractions every stretch of rows has the sources in proportion, so
cutting that order into equal counts gives shards that each match the mixture.

Both ranks are global but no task holds a whole source: ranks are counted inside narrow buckets of
the sort key, and a running total over bucket counts (a small table) gives each bucket's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROWS_PER_BUCKET = 20_000


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Adds out: the rank from 1 within group by (bucket, order), where bucket grows with the order.

    Windows cover one bucket at a time; buckets' offsets come from partial counts.
    """
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__c"))
    # counts are one row per bucket, a few rows per ROWS_PER_BUCKET input rows
    running = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__c").over(running), F.lit(0))).drop("__c")
    within = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    ranked = df.withColumn("__within", within)
    keys = [*group, bucket]
    renamed = offsets.select(*(F.col(c).alias(f"__o_{c}") for c in keys), "__before")
    on = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in keys]
    return ranked.join(renamed, on).withColumn(out, F.col("__before") + F.col("__within")).drop("__before", "__within", *(f"__o_{c}" for c in keys))


def shard(docs: DataFrame, shards: int = 40, seed: str = "interleave") -> DataFrame:
    """docs(doc_id, text, source) as (doc_id, source, size, text_crc32, shard, slot); counts of shards differ by one at most.

    The seeded order of a source is by md5(seed:doc_id), then doc_id and the text's crc32; rows equal
    in all of these are interchangeable.  A null doc_id or source is a value of its own, a null text
    has size 16 and crc32 0.  With fewer rows than shards some shards are empty; an empty table gives
    an empty table.  Other columns are left out: join them back by doc_id, or write by shard.
    """
    docs = docs.select("doc_id", "text", "source")
    raw = F.coalesce("text", F.lit(""))
    n = docs.count()
    buckets = max(1, -(-n // ROWS_PER_BUCKET)) * 8
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = docs.withColumns({"size": (F.octet_length(raw) + 16).cast("long"), "text_crc32": F.crc32(raw.cast("binary")), "__key": key})
    # 32 leading bits of the key: their order is the key's order
    base = base.withColumn("__b", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long"))
    # narrow rows are written once: everything below reads them several times
    slim = written(base.select("doc_id", "source", "size", "text_crc32", "__key", "__b"), "shard-rows")
    first = _ranked(slim, ["source"], "__b", ["__key", "doc_id", "text_crc32"], "__rank")
    totals = slim.groupBy(F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    first = first.join(totals, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    first = first.withColumn("__f", (2 * F.col("__rank") - 1) / (2 * F.col("__n")))
    first = written(first.withColumn("__b", F.floor(F.col("__f") * F.lit(buckets)).cast("long")), "shard-fractions")
    placed = _ranked(first, [], "__b", ["__f", "__key", "source", "doc_id", "text_crc32"], "__at")
    placed = placed.withColumn("__at", F.col("__at") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((__at * {shards}L) div {max(n, 1)}L as int)"))
    placed = placed.withColumn("slot", F.expr(f"__at - (cast(shard as long) * {n}L + {shards - 1}L) div {shards}L"))
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    return shard(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_BYTES = "regexp_extract_all(hex(encode(coalesce(text, ''))), '..')"
SQL = f"""
WITH tbl AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
base AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 16 AS size, md5('interleave:' || coalesce(doc_id::VARCHAR, '')) AS key,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_BYTES}, lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM documents, tbl),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32) - 1)
  / (2 * count(*) OVER (PARTITION BY source)) AS f FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY f, key, source, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // n)::INTEGER AS shard,
  (pos - ((pos * 40 // n) * n + 39) // 40)::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
