"""The driver's tables read as posts, roster, pool and relation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").withColumn("k", k)


def _as_posts(e: DataFrame, text: Column, url: Column, tags: Column, cashtags: Column, mentions: Column) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "reposted").when(F.col("event_type") == "purchase", "quoted").when(F.col("event_type") == "view", "replied_to")
    target = (F.col("event_id") - F.col("k")).cast("string")
    value = F.coalesce("value", F.lit(0.0))
    return e.select(
        F.col("event_id").cast("string").alias("tweet_id"),
        F.col("user_id").cast("string").alias("author_id"),
        F.concat(F.lit("@U"), "user_id").alias("author_username"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        text.alias("text"),
        F.struct(
            F.floor(value).alias("like_count"), F.floor(value / 10).alias("repost_count"), (F.col("event_id") % 7).alias("reply_count"), (F.col("event_id") % 3).alias("quote_count")
        ).alias("public_metrics"),
        F.when(kind.isNotNull() & (F.col("k") > 0), F.array(F.struct(kind.alias("type"), target.alias("id")))).otherwise(F.array().cast("array<struct<type:string,id:string>>")).alias("referenced_tweets"),
        F.struct(
            tags.alias("hashtags"), cashtags.alias("cashtags"), mentions.alias("mentions"), F.array(F.struct(url.alias("url"), F.lit(None).cast("string").alias("expanded_url"))).alias("urls")
        ).alias("entities"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawled posts: the type is the hashtag, k makes tickers, urls and references."""
    url = F.concat(F.lit("https://www.site"), F.col("k") % 20, F.lit(".example.com/p/"), F.col("k"))
    text = F.concat(F.col("event_type"), F.lit("  by  "), F.when(F.col("k") % 3 == 0, "tech").otherwise("none"), F.lit(" "), F.col("k"), F.lit(" "), url)
    cash = F.when(F.col("k") % 10 == 0, F.array(F.concat(F.lit("$T"), "k"))).otherwise(_none())
    return _as_posts(_keyed_events(spark, sf_dir), text, url, F.array(F.initcap("event_type")), cash, F.array(F.concat(F.lit("@U"), F.col("k") % 7)))


def _none() -> Column:
    return F.array().cast("array<string>")


#: What news posts are made of, chosen by k.
SUBJECTS = "OpenAI Google Nvidia Tesla Intel Anthropic Sequoia a16z DeepMind Stripe".split()
DEEDS = "launches announced benchmarked raised leaked discusses shipped".split()
THINGS = "GPT-4 Claude CUDA H100 Copilot Gemini Inference Robotics".split()
FIELDS = ("cloud", "startup funding", "chip supply", "new model", "product launch")


def news_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts about companies, deeds and products, for the event and community variants.

    k chooses the words; event_id % 40 makes some posts that rules drop: only a url (0), a repost (1), a short
    "via" (2), only generic words (3), a platform's url (4), no entity and no deed (5), a platform's url in the text (6).
    """
    k, kind = F.col("k"), F.col("event_id") % 40
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    url = F.concat(F.when(kind == 4, "https://www.youtube.com/p/").otherwise(F.concat(F.lit("https://www.site"), k % 20, F.lit(".demo.net/p/"))), k)
    body = F.concat(pick(SUBJECTS), F.lit(" "), pick(DEEDS), F.lit(" "), pick(THINGS), F.lit(" for the "), pick(FIELDS), F.lit(" market. Readers of part "), k, F.lit(" asked why! "), url)
    text = (
        F.when(kind == 0, url)
        .when(kind == 1, F.concat(F.lit("RT @u1 "), body))
        .when(kind == 2, F.concat(F.lit("via @u2 "), pick(SUBJECTS), F.lit(" "), url))
        .when(kind == 3, "AI market growth")
        .when(kind == 5, "no words to see here")
        .when(kind == 6, F.concat(F.lit("https://medium.com/s "), body))
        .otherwise(body)
    )
    bare = kind == 5
    tags = F.when(bare, _none()).otherwise(F.array(F.initcap("event_type")))
    cash = F.when(~bare & (k % 10 == 0), F.array(F.concat(F.lit("$T"), "k"))).otherwise(_none())
    mentions = F.when(bare, _none()).otherwise(F.array(F.concat(F.lit("@U"), k % 7)))
    return _as_posts(_keyed_events(spark, sf_dir), text, url, tags, cash, mentions)


def roster(spark: SparkSession, sf_dir: str, segments: tuple[str, ...] = ("BUILDING", "AUTOMOBILE", "MACHINERY")) -> DataFrame:
    """Customers of some market segments as (username, followers_count)."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin(*segments))
    return c.select(F.concat(F.lit("u"), "c_custkey").alias("username"), F.greatest(F.floor(F.coalesce("c_acctbal", F.lit(0.0))), F.lit(0)).alias("followers_count"))


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates: orders are list appearances, a segment is the verified mark, comments are bios."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("list_appearances"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    bio = F.concat("c_name", F.when(F.col("c_custkey") % 11 == 0, " FREE stuff").otherwise(""))
    return c.select(
        F.concat(F.lit("u"), "c_custkey").alias("username"), F.floor("c_acctbal").alias("followers_count"), bio.alias("bio"), "list_appearances", (F.col("c_mktsegment") == "BUILDING").alias("verified")
    )


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relations of suppliers (seeds) to parts (accounts): (kind, seed_username, target_username)."""
    kind = F.when(F.col("l_returnflag") == "A", "followed").when(F.col("l_returnflag") == "N", "mentioned").otherwise("interacted")
    return table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.concat(F.lit("@S"), "l_suppkey").alias("seed_username"), F.concat(F.lit("P"), "l_partkey").alias("target_username"))


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: the source is the author, ids give times and references."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.col("source").alias("author"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 977).alias("created_ts"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("lang"),
    )
