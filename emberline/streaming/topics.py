"""Streaming form of the first steps: deduplicated posts and windowed topic counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_username, parsed_time


def unique_posts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Posts with event_time, each tweet_id once as long as its copies come within the lateness."""
    timed = stream.withColumn("event_time", parsed_time(F.col("created_at"))).where("event_time is not null")
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["tweet_id"])


def tag_counts(posts: DataFrame, window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Per window and hashtag: posts, and the approximate number of authors (exact distinct counts can't be kept in a stream)."""
    rows = posts.select("event_time", F.explode("entities.hashtags").alias("tag"), norm_username(F.col("author_username")).alias("author"))
    return rows.groupBy(F.window("event_time", window, slide), F.lower("tag").alias("topic_key")).agg(F.count(F.lit(1)).alias("tweet_cnt"), F.approx_count_distinct("author").alias("authors"))
