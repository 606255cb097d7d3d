"""Topic candidates, their aggregates, hot scores and tiered selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assets import TOPIC_KEYWORDS
from ..functions.scalars import any_within, word_list
from .edges import reference_counts

KEYS = ["topic_type", "topic_key"]


def relevant(text: Column, tags: Column | None = None, cashtags: Column | None = None) -> Column:
    """A keyword within the text, a tag within a keyword or a keyword within a tag, or any cashtag."""
    out = any_within(F.lower(F.coalesce(text, F.lit(""))), TOPIC_KEYWORDS)
    if tags is not None:
        words = word_list(TOPIC_KEYWORDS)
        out = out | F.coalesce(F.exists(tags, lambda t: F.exists(words, lambda k: F.contains(F.lower(t), k) | F.contains(k, F.lower(t)))), F.lit(False))
    if cashtags is not None:
        out = out | F.coalesce(F.size(cashtags) > 0, F.lit(False))
    return out


def candidates(posts: DataFrame, edges: DataFrame, filtered: bool = True, content_keywords: bool = False) -> DataFrame:
    """Hashtag, cashtag, domain and centre-post topics as (topic_type, topic_key, tweet_id, author_username, created_at, local_date).

    A centre post outside the table stays, with empty fields, whatever the filter.  content_keywords adds the keywords
    of two posts or more, each with its first post only and no author or time, so that they count one post and no voice.
    """
    base = [F.col("tweet_id"), F.col("author").alias("author_username"), F.col("created_at"), F.col("local_date")]

    def exploded(kind: str, array: str, keep: Column) -> DataFrame:
        rows = posts.select(F.explode(array).alias("topic_key"), "text", *base).where("topic_key <> ''")
        rows = rows.where(keep) if filtered and kind != "cashtag" else rows
        return rows.select(F.lit(kind).alias("topic_type"), "topic_key", "tweet_id", "author_username", "created_at", "local_date")

    tags = exploded("hashtag", "entities.hashtags", relevant(F.col("text"), F.array("topic_key")))
    cash = exploded("cashtag", "entities.cashtags", F.lit(True))
    domains = exploded("domain", "url_domains", relevant(F.col("text")))
    targets = edges.where("target_tweet_id <> ''").select("target_tweet_id").distinct()
    keep = relevant(F.col("text"), F.col("entities.hashtags"), F.col("entities.cashtags")) if filtered else F.lit(True)
    known = posts.select(F.col("tweet_id").alias("target_tweet_id"), keep.alias("keep"), *base[1:])
    centre = targets.join(known, "target_tweet_id", "left").where(F.coalesce("keep", F.lit(True)))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    centre = centre.select(F.lit("center_tweet").alias("topic_type"), F.col("target_tweet_id").alias("topic_key"), F.col("target_tweet_id").alias("tweet_id"), empty("author_username"), empty("created_at"), empty("local_date"))
    out = tags.unionByName(cash).unionByName(domains).unionByName(centre)
    if not content_keywords:
        return out
    from .text import keyword_topics

    none = F.lit("")
    words = keyword_topics(posts.select("tweet_id", F.coalesce("clean_text", "text").alias("text")), filtered=filtered)
    return out.unionByName(words.select(F.lit("content_keyword").alias("topic_type"), "topic_key", "tweet_id", none.alias("author_username"), none.alias("created_at"), none.alias("local_date")))


def aggregate(found: DataFrame, posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per topic: metric sums over candidate rows, but posts, authors and references over distinct posts.

    A centre post's authors are the distinct ones that refer to it.
    """
    m = posts.select("tweet_id", *(F.coalesce(f"public_metrics.{c}_count", F.lit(0)).alias(c) for c in ("like", "repost", "reply", "quote")))
    rows = found.join(m, "tweet_id", "left")
    # one row for each topic and post first: sums add up, and distinct counts need no second shuffle of all rows
    grain = rows.groupBy(*KEYS, "tweet_id").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("like", "repost", "reply", "quote")), F.max("author_username").alias("author"))
    refs = reference_counts(edges).withColumnRenamed("target_tweet_id", "tweet_id")
    grain = grain.join(refs, "tweet_id", "left")
    out = grain.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("tweet_cnt"),
        F.countDistinct(F.nullif("author", F.lit(""))).alias("authors"),
        F.max(F.coalesce("ref_authors", F.lit(0))).alias("ref_authors"),
        *(F.sum(c).alias(f"sum_{c}_cnt") for c in ("like", "repost", "reply", "quote")),
        F.sum(F.coalesce("ref_cnt", F.lit(0))).alias("ref_cnt"),
    )
    authors = F.when(F.col("topic_type") == "center_tweet", F.col("ref_authors")).otherwise(F.col("authors"))
    return out.select(*KEYS, F.lit("24h").alias("window"), "tweet_cnt", authors.alias("unique_author_cnt"), "sum_like_cnt", "sum_repost_cnt", "sum_reply_cnt", "sum_quote_cnt", "ref_cnt")


def topic_followers(found: DataFrame, posts: DataFrame, roster: DataFrame, mode: str = "rows") -> DataFrame:
    """avg_followers per topic: over candidate rows of roster authors ("rows"), over distinct authors with 0 for
    others ("authors"), or the total over distinct posts by the number of distinct authors ("posts")."""
    rows = found.select(*KEYS, "tweet_id").join(posts.select("tweet_id", F.col("author").alias("username")), "tweet_id")
    if mode == "rows":
        return rows.join(roster, "username").groupBy(*KEYS).agg(F.avg("followers_count").alias("avg_followers"))
    unit = [*KEYS, "username"] if mode == "authors" else [*KEYS, "tweet_id", "username"]
    rows = rows.select(*unit).distinct().join(roster, "username", "left")
    total, authors = F.sum(F.coalesce("followers_count", F.lit(0))), F.countDistinct("username")
    return rows.groupBy(*KEYS).agg((total / F.greatest(authors, F.lit(1))).alias("avg_followers"))


def hot_score(centre: Column, tweets: Column, authors: Column, likes: Column, spread: Column, refs: Column, followers: Column) -> Column:
    like = F.when(tweets > 0, likes / tweets).otherwise(0.0)
    log = F.log1p
    weight = F.when(authors < 2, 0.3).otherwise(0.6)
    alone = weight * (0.5 * log(refs) + 0.5 * log(spread) + 0.3 * log(like) + 0.2 * log(followers)) + 1.5 * authors
    many = F.when(tweets > 1, 1 + 0.2 * log(tweets - 1)).otherwise(1.0)
    voices = F.when(authors > 1, 1 + 0.3 * log(authors - 1)).otherwise(1.0)
    group = many * (log(refs) + log(spread) + 0.5 * log(like)) + voices * (3.0 * authors + 0.3 * log(followers)) + 0.5 * log(tweets)
    return F.when(centre, alone).otherwise(group)


def scored(topics: DataFrame, followers: DataFrame) -> DataFrame:
    """topics with avg_followers (0 if unknown) and hot_score."""
    t = topics.join(followers, KEYS, "left").withColumn("avg_followers", F.coalesce("avg_followers", F.lit(0.0)))
    spread = F.col("sum_repost_cnt") + F.col("sum_quote_cnt")
    return t.withColumn("hot_score", hot_score(F.col("topic_type") == "center_tweet", F.col("tweet_cnt"), F.col("unique_author_cnt"), F.col("sum_like_cnt"), spread, F.col("ref_cnt"), F.col("avg_followers")))


def top_tiered(topics: DataFrame, n: int = 5) -> DataFrame:
    """The n best with rank: qualified topics first, then others that aren't centre posts, then any; ties by key."""
    centre = F.col("topic_type") == "center_tweet"
    good = F.when(centre, F.col("unique_author_cnt") >= 2).otherwise((F.col("unique_author_cnt") >= 2) | (F.col("tweet_cnt") >= 2))
    tier = F.when(good, 0).when(~centre, 1).otherwise(2)
    best = topics.withColumn("tier", tier).orderBy("tier", F.desc("hot_score"), *KEYS).limit(n)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy("tier", F.desc("hot_score"), *KEYS))  # n rows
    return best.withColumn("rank", rank)
