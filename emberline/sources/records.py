"""Records of one large JSON document, read in parts: the elements of a top-level array or the entries of a top-level object.

A document without line ends can't be cut at lines, and whether a brace stands within a string depends on all that comes
before it.  The text is read in pieces that end with a closing brace, which Spark cuts from any part of the file;
running sums over the parts, one row a part, carry the number of quotes and then the depth of brackets into each, and a piece
that brings the depth back to one ends a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART = ("file", "part")


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows and the sum of value over all earlier rows of the file: by parts first, then within each part."""
    parts = rows.groupBy(*_PART).agg(F.sum(value).alias("n"))
    earlier = parts.select(*_PART, (F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")).alias("n"))
    inside = F.sum(value).over(Window.partitionBy(*_PART).orderBy("pos")) - value
    return rows.withColumn(name, inside).join(earlier, list(_PART)).withColumn(name, F.col(name) + F.col("n")).drop("n")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, pos, value): the text up to each closing brace, without it; part is where the task's share of the file begins."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("pos"), "value")


def json_records(spark: SparkSession, path: str, keyed: bool) -> DataFrame:
    """(key, record): each element of an array (key null), or each entry of an object if keyed, as JSON text.

    A record that isn't JSON, but whose quotes and brackets match, is one row of nulls (see broken()); one whose don't spoils what follows
    it, as it does for any reader.  Elements that are no objects come with their own text.  Of several files each is one document.
    """
    rows = pieces(spark, path).withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    rows = _before(rows.withColumn("quotes", _count(F.col("plain"), '"')), F.col("quotes"), "quoted")
    inside = F.col("quoted") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("plain")), r'"[^"]*("|$)', "")
    closes = ((F.col("quoted") + F.col("quotes")) % 2 == 0).cast("int")
    steps = _count(outside, "{[") - _count(outside, "]}") - closes
    rows = _before(rows.select(*_PART, "pos", "value", closes.alias("closes"), steps.alias("steps")), F.col("steps"), "depth")
    last = ((F.col("closes") == 1) & (F.col("depth") + F.col("steps") == 1)).cast("int")
    rows = _before(rows.select(*_PART, "pos", "value", last.alias("last")), F.col("last"), "number")
    whole = rows.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "value"))).alias("v"), F.max("last").alias("ended"))
    text = F.array_join(F.transform("v", lambda x: x["value"]), "}")
    # what follows the last object: other elements, and the end of the document
    text = F.when(F.col("ended") == 1, F.concat(text, F.lit("}"))).otherwise(F.regexp_replace(text, r"\s*[\]}]?\s*$", ""))
    body = F.regexp_replace(text, r"^\s*[\[{,]", "")
    null = F.lit(None).cast("string")
    if keyed:
        found = F.map_entries(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>"))
    else:
        found = F.transform(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), lambda x: F.struct(null.alias("key"), F.coalesce(x, F.lit("null")).alias("value")))
    nothing = F.array(F.struct(null.alias("key"), null.alias("value")))
    return whole.select(F.explode(F.coalesce(found, nothing)).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("record"))


def broken(records: DataFrame) -> int:
    """How many records of json_records() are no JSON."""
    return records.where("key is null and record is null").count()
