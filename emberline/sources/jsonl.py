"""JSON and JSONL sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import norm_username
from .records import json_records, pieces

_S, _L = T.StringType(), T.LongType()
METRICS = T.StructType([T.StructField(c, _L) for c in ("like_count", "repost_count", "reply_count", "quote_count")])
REFERENCES = T.ArrayType(T.StructType([T.StructField("type", _S), T.StructField("id", _S)]))
#: Posts as crawled; elements of urls may be strings or structs, so they stay JSON text here.
RAW_POST = T.StructType(
    [
        *(T.StructField(c, _S) for c in ("tweet_id", "author_id", "author_username", "created_at", "text")),
        T.StructField("public_metrics", METRICS),
        T.StructField("referenced_tweets", REFERENCES),
        T.StructField(
            "entities",
            T.StructType([*(T.StructField(c, T.ArrayType(_S)) for c in ("hashtags", "cashtags", "mentions")), T.StructField("urls", T.ArrayType(_S))]),
        ),
    ]
)
ACCOUNT = T.StructType([T.StructField("username", _S), T.StructField("followers_count", _L), T.StructField("user_id", _S)])
CANDIDATE = T.StructType(
    [T.StructField("username", _S), T.StructField("followers_count", _L), T.StructField("bio", _S), T.StructField("list_appearances", _L), T.StructField("verified", T.BooleanType())]
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, missing_ok: bool = True) -> DataFrame:
    """One JSON object a line.  Broken lines are left out, or fail if strict; a missing file is empty if missing_ok."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Crawled posts, with urls as array<struct<url, expanded_url>>; a plain string is a url without expansion."""
    raw = read_jsonl(spark, path, RAW_POST)
    one = T.StructType([T.StructField("url", _S), T.StructField("expanded_url", _S)])

    def element(u):
        parsed = F.from_json(u, one)
        return F.when(u.startswith("{"), parsed).otherwise(F.struct(u.alias("url"), F.lit(None).cast("string").alias("expanded_url")))

    return raw.withColumn("entities", F.col("entities").withField("urls", F.transform("entities.urls", element)))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A candidate pool: a JSON array, an object whose values are records, or JSONL; each is read in parts."""
    first = pieces(spark, path).where(F.trim("value", F.lit(" \t\r\n")) != "").limit(1)
    first = first.select(F.substring(F.trim("value", F.lit(" \t\r\n")), 1, 1).alias("v"), F.from_json(F.concat("value", F.lit("}")), CANDIDATE)["username"].isNotNull().alias("record")).first()
    if first is None:
        return spark.createDataFrame([], CANDIDATE)
    if first.v == "[":
        return json_records(spark, path, keyed=False).where("record like '{%'").select(F.from_json("record", CANDIDATE).alias("x")).select("x.*")
    if first.v == "{" and not first.record:
        values = json_records(spark, path, keyed=True).select(F.from_json("record", CANDIDATE).alias("x")).where("x.username is not null").select("x.*")
        if not values.isEmpty():
            return values
    return spark.read.text(path).select(F.from_json("value", CANDIDATE).alias("x")).where("x.username is not null").select("x.*")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles kept as one object {username: {...}}, read in parts: username (normalised) and followers_count; a missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "username string, followers_count long")
    rows = json_records(spark, path, keyed=True).where("key is not null").select(F.col("key").alias("name"), F.from_json("record", "followers_count long")["followers_count"].alias("n"))
    return rows.groupBy(norm_username(F.col("name")).alias("username")).agg(F.max_by("n", "name").alias("followers_count"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster document's accounts: username (normalised), followers_count (null: 0); of repeated names the last counts."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "username string, followers_count long")
    document = T.StructType([T.StructField("all", T.ArrayType(ACCOUNT))])
    rows = spark.read.schema(document).option("multiLine", True).json(path).select(F.posexplode("all").alias("pos", "a"))
    named = rows.select("pos", norm_username(F.col("a.username")).alias("username"), F.coalesce("a.followers_count", F.lit(0)).alias("followers_count"))
    return named.groupBy("username").agg(F.max_by("followers_count", "pos").alias("followers_count"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as an indented JSON document."""
    row = df.limit(1).toJSON().first()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row) if row else {}, f, ensure_ascii=False, indent=2)
