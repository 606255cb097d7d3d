"""Propagation edges between posts and what is counted along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_username


def propagation_edges(posts: DataFrame) -> DataFrame:
    """One edge per repost or quote with a target; other reference types go."""
    ref = posts.select("tweet_id", "author_username", "created_at", "local_date", F.explode("referenced_tweets").alias("r"))
    return ref.where(F.col("r.type").isin("reposted", "quoted") & (F.col("r.id") != "")).select(
        F.col("tweet_id").alias("source_tweet_id"),
        norm_username(F.col("author_username")).alias("source_author_username"),
        F.col("r.id").alias("target_tweet_id"),
        F.col("r.type").alias("edge_type"),
        "created_at",
        "local_date",
    )


def is_original(references: Column) -> Column:
    return ~F.coalesce(F.exists(references, lambda r: r["type"].isin("reposted", "quoted")), F.lit(False))


def anchor_of(references: Column) -> Column:
    """The first reposted or quoted post, or null."""
    return F.get(F.filter(references, lambda r: r["type"].isin("reposted", "quoted") & (r["id"] != "")), F.lit(0))["id"]


def reference_counts(edges: DataFrame) -> DataFrame:
    """target_tweet_id, ref_cnt, ref_authors (distinct, not empty)."""
    author = F.nullif("source_author_username", F.lit(""))
    return edges.groupBy("target_tweet_id").agg(F.count(F.lit(1)).alias("ref_cnt"), F.countDistinct(author).alias("ref_authors"))


def author_interactions(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """Unordered author pairs and how many edges join them; own posts and unknown targets don't count."""
    target = posts.select(F.col("tweet_id").alias("target_tweet_id"), F.col("author").alias("other"))
    pair = edges.join(target, "target_tweet_id").where("source_author_username <> other and source_author_username <> '' and other <> ''")
    return pair.groupBy(F.least("source_author_username", "other").alias("author_a"), F.greatest("source_author_username", "other").alias("author_b")).agg(F.count(F.lit(1)).alias("weight"))


def edges_within(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """membership(cluster_id, tweet_id) -> per cluster the edges with both ends in it."""
    a = membership.select("cluster_id", F.col("tweet_id").alias("source_tweet_id"))
    b = membership.select("cluster_id", F.col("tweet_id").alias("target_tweet_id"))
    return edges.join(a, "source_tweet_id").join(b, ["cluster_id", "target_tweet_id"]).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("propagation"))


def edges_into(edges: DataFrame, membership: DataFrame, posts: DataFrame) -> DataFrame:
    """Per cluster the edges to its posts by others than the post's author."""
    m = membership.join(posts.select("tweet_id", "author"), "tweet_id").select("cluster_id", F.col("tweet_id").alias("target_tweet_id"), "author")
    return edges.join(m, "target_tweet_id").where("source_author_username <> author").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("propagation"))


def edges_by_members(edges: DataFrame, membership: DataFrame, authors: DataFrame) -> DataFrame:
    """Per cluster the edges by its authors (cluster_id, author) to its posts."""
    a = authors.select("cluster_id", F.col("author").alias("source_author_username")).distinct()
    b = membership.select("cluster_id", F.col("tweet_id").alias("target_tweet_id")).distinct()
    return edges.join(b, "target_tweet_id").join(a, ["cluster_id", "source_author_username"]).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("propagation"))
