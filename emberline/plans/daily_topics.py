"""The base pipeline: posts to the daily Top-5, its trends and its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import preview
from ..operators import edges as E
from ..operators import normalize as N
from ..operators import series as S
from ..operators import topics as T
from ..sources.stages import staged


@dataclass
class DailyTopics:
    """Stages of one run, each made when it is first asked for; windows are seconds before the latest post."""

    posts: DataFrame
    roster: DataFrame
    offset_hours: int = 8
    short: int = 24 * 3600
    long: int = 14 * 24 * 3600
    filtered: bool = True
    content_keywords: bool = False

    @cached_property
    def clean(self) -> DataFrame:
        """Written once: every stage below reads it, most of them more than once."""
        return staged(N.clean(self.posts, self.roster, self.offset_hours), "clean")

    @cached_property
    def day(self) -> DataFrame:
        """Written, as candidates, topics, followers and reports all read it; posts before it aren't cleaned for it."""
        return staged(self._recent(self.short), "day")

    @cached_property
    def weeks(self) -> DataFrame:
        return N.recent(self.clean, self.long)

    def _recent(self, seconds: int) -> DataFrame:
        return N.recent(self.clean, seconds) if "clean" in self.__dict__ else N.clean_recent(self.posts, self.roster, seconds, self.offset_hours)

    @cached_property
    def day_edges(self) -> DataFrame:
        return E.propagation_edges(self.day)

    @cached_property
    def weeks_edges(self) -> DataFrame:
        return E.propagation_edges(self.weeks)

    @cached_property
    def candidates(self) -> DataFrame:
        return staged(T.candidates(self.day, self.day_edges, self.filtered, self.content_keywords), "candidates")

    @cached_property
    def topics(self) -> DataFrame:
        return staged(T.aggregate(self.candidates, self.day, self.day_edges), "topics")

    @cached_property
    def scored(self) -> DataFrame:
        return T.scored(self.topics, T.topic_followers(self.candidates, self.day, self.roster))

    @cached_property
    def top(self) -> DataFrame:
        return T.top_tiered(self.scored)

    @cached_property
    def daily(self) -> DataFrame:
        return staged(S.topic_daily(self.weeks, self.weeks_edges), "daily")

    @cached_property
    def trends(self) -> DataFrame:
        return S.topic_trends(self.daily, self.topics)

    @cached_property
    def growth(self) -> DataFrame:
        return S.growth_by_steps(self.daily, self.topics)

    def report(self) -> DataFrame:
        """The Top-5 with trend and prediction (none: "Unknown" and "stabilize"), one row a topic."""
        t = self.top.join(self.trends.select(*T.KEYS, "trend_label"), T.KEYS, "left").join(self.growth.select(*T.KEYS, "prediction", "confidence"), T.KEYS, "left")
        title = F.when(F.col("topic_type") == "hashtag", F.concat(F.lit("#"), "topic_key")).otherwise(F.col("topic_key"))
        return t.select(
            "rank", *T.KEYS, preview(title, 50).alias("title"), F.round("hot_score", 6).alias("hot_score"), "tweet_cnt", "unique_author_cnt",
            F.coalesce("trend_label", F.lit("Unknown")).alias("trend_label"), F.coalesce("prediction", F.lit("stabilize")).alias("prediction"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        )

    def examples(self, n: int = 5) -> DataFrame:
        """The n most liked posts of each Top-5 topic, ties by id."""
        from pyspark.sql import Window

        rows = self.top.select("rank", *T.KEYS).join(self.candidates.select(*T.KEYS, "tweet_id").distinct(), T.KEYS).join(self.day, "tweet_id")
        rows = rows.select("rank", *T.KEYS, "tweet_id", "author", F.coalesce("public_metrics.like_count", F.lit(0)).alias("like_count"), preview(F.col("text"), 200).alias("text"))
        order = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("like_count"), "tweet_id"))
        return rows.withColumn("place", order).where(F.col("place") <= n)

    def cards(self) -> DataFrame:
        """The Top-5 with title, description, link, their most liked posts and how many candidate rows they have."""
        from ..operators import reports as R

        tid = F.concat_ws(":", *T.KEYS)
        members = self.candidates.select(tid.alias("key"), "tweet_id").join(self.top.select(tid.alias("key")), "key", "left_semi")
        like = F.coalesce("public_metrics.like_count", F.lit(0)).alias("like_count")
        found = R.evidence(members, self.day.select("tweet_id", F.col("author_username").alias("author"), "text", like, "created_at"), "like_count")
        return R.topic_cards(self.top, self.day).withColumn("key", tid).join(found, "key", "left").drop("key")

    def full_report(self, predictions: bool = False) -> DataFrame:
        """Cards with trends (and predictions), scores rounded for readers."""
        from ..operators import reports as R

        out = R.with_trends(self.cards(), self.trends, self.growth if predictions else None)
        return out.withColumn("hot_score", F.bround("hot_score", 2))
