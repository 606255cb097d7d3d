"""Line dedup: drop lines that many documents share, keeping each in one document.

Lines are exploded and normalised (stripped of ASCII white space, A-Z lower-cased), hashed to 128
bits, and documents are counted per hash with a partial aggregate, so that one very common line costs
a row per task.  Only position lists go back to the documents, which are reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "\\u0020\\u0009\\u000a\\u000b\\u000c\\u000d"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def line_key(line: Column) -> Column:
    return ascii_lower(F.call_function("btrim", line, F.expr(f"'{WHITE}'")))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) with text rebuilt, plus n_lines and n_dropped (columns of these names are replaced).

    A line goes if its key has min_chars code points, at least min_docs distinct documents hold it,
    and its document isn't the smallest of them; within that document repeated lines stay.  Null and
    empty texts are one empty line and come back empty.  Rows of one doc_id are one document.  A null
    doc_id never counts as a holder: its shared lines go if min_docs others hold them.  An empty
    table gives an empty table.  Other columns pass through, whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    row, lines_, id_, row_, drop = fresh(docs, "row", "lines", "id", "row_of", "drop")
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, "\n", -1)
    keyed = (
        docs.select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(split).alias("pos", "line"))
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # two long hashes a line: written, so that lines are cut and hashed once
    keyed = written(keyed, "line-hashes")
    held = keyed.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2")
    if min_docs == 2:
        shared = held.agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).where("keep < last")
    else:
        shared = held.agg(F.min("doc_id").alias("keep"), F.countDistinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
    # a table of its own: Spark splits a very common line's rows only where a join reads plain shuffles
    shared = written(shared.select("h1", "h2", "keep"), "shared-lines")
    drops = (
        keyed.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row_))
        .agg(F.collect_set("pos").alias(drop))
    )
    # the split is made below the join, so that above it the lines are a plain array column
    base = docs.withColumns({row: F.xxhash64(text), lines_: split})
    joined = base.join(drops, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(row) == F.col(row_)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.coalesce(drop, F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda p: F.get(lines_, p)), "\n")
    columns = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *columns,
        F.size(lines_).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )


def rebuilt(docs: DataFrame, **options) -> DataFrame:
    """docs with its own columns only: text without shared lines, n_chars (if there) its code points."""
    out = dedup_lines(docs, **options)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH base AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, rid, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM base),
keyed AS (SELECT doc_id, rid, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT a.*, s.keep IS NOT NULL AND a.doc_id <> s.keep AS dropped FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
