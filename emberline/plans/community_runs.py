"""The community variants and the topic clusters as whole chains."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assets
from ..functions.scalars import preview
from ..operators import cluster as C
from ..operators import edges as E
from ..operators import entities as N
from ..operators import graph as G
from ..operators import reports as R
from ..operators import semantic as S
from ..operators import vectors as D
from ..operators.similarity import Similar, similar_classes
from ..operators.topics import KEYS, relevant
from ..sources.stages import staged
from .daily_topics import DailyTopics
from .event_runs import engagement, metric

_KINDS = ("tickers", "hashtags", "domains", "mentions", "companies")
#: Entity kinds and extractors of the variants.
VARIANTS = {
    "first": (_KINDS, N.first_entities, None),
    "improved": ((*_KINDS, "products", "technologies"), N.improved_entities, N.improved_keywords),
    "final": ((*_KINDS, "products", "technologies"), N.final_entities, N.final_keywords),
}


@dataclass
class CommunityRun:
    """The graph of the last day's posts, authors and entities; its communities, their scores, centres and Top-5."""

    base: DailyTopics
    variant: str = "first"
    similarity: float = 0.7
    filtered: bool = True

    @property
    def kinds(self) -> tuple[str, ...]:
        return VARIANTS[self.variant][0]

    @cached_property
    def posts(self) -> DataFrame:
        day = self.base.day
        day = day.where(relevant(F.col("text"), F.col("entities.hashtags"), F.col("entities.cashtags"))) if self.filtered else day
        found = VARIANTS[self.variant][1](F.col("text"), F.col("entities"), F.col("url_domains"))
        p = day.select(
            "tweet_id", "author", "author_username", "created_at", "text", "clean_text", engagement().alias("engagement"), metric("like").alias("like_count"), (metric("like") + 2 * metric("repost")).alias("shown"), found.alias("found")
        )
        return staged(p, "posts")

    @cached_property
    def classes(self) -> Similar:
        """Posts of equal vectors, and pairs of such classes above the threshold, and never at 0.7 or below."""
        v = D.hash_vectors(self.posts.select("tweet_id", F.col("clean_text").alias("text")), 3, assets.GRAPH_EMBEDDING_STOPS)
        return similar_classes(v.withColumnRenamed("tweet_id", "id"), max(self.similarity, 0.7))

    @cached_property
    def similar_posts(self) -> DataFrame:
        """(tweet_id, component): posts connected by similarity; one without a vector is alone."""
        found = self.classes.spread(C.components(self.classes.sizes().select("id"), self.classes.pairs), "component")
        return staged(self.posts.join(found.withColumnRenamed("id", "tweet_id"), "tweet_id", "left").select("tweet_id", F.coalesce("component", "tweet_id").alias("component")), "similar-posts")

    @cached_property
    def plain_graph(self) -> DataFrame:
        """The graph without the edges of similar posts, of which there are as many as pairs."""
        entities = self.posts.select("tweet_id", F.explode(N.keyed(F.col("found"), self.kinds)).alias("entity"))
        return staged(G.graph_edges(self.posts, entities, E.author_interactions(self.base.day_edges, self.posts)), "graph")

    @cached_property
    def members(self) -> DataFrame:
        """(community, node): of the whole graph, edges of similar posts too."""
        found = C.class_communities(self.plain_graph.select("a", "b", "weight"), self.classes, "tweet:")
        return staged(found.select("community", F.col("id").alias("node")), "members")

    @cached_property
    def listing(self) -> DataFrame:
        return G.listing(self.members)

    @cached_property
    def scored(self) -> DataFrame:
        return G.community_scores(self.members, self.posts, self.base.day_edges, self.base.roster)

    @cached_property
    def centres(self) -> DataFrame:
        near = self.classes.weights().select(F.concat(F.lit("tweet:"), "id").alias("node"), "weight")
        return G.centres(self.plain_graph, self.members, near) if self.variant == "first" else G.weighted_centres(self.plain_graph, self.members, self.posts, near)

    @cached_property
    def keywords(self) -> DataFrame:
        words = self.posts.select("tweet_id", F.explode(VARIANTS[self.variant][2](F.col("text"))).alias("word"))
        if self.variant == "final":
            return G.community_keywords(self.members, words.withColumn("tech", N._listed(F.upper("word"))), 5, 3)
        return G.community_keywords(self.members, words)

    @cached_property
    def top(self) -> DataFrame:
        """The five best with their centres and keywords."""
        best = self.scored.orderBy(F.desc("community_score"), "community").limit(5)
        best = staged(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("community_score"), "community"))), "top")  # five rows
        c = self.centres.join(best.select("community"), "community", "left_semi").groupBy("community").agg(
            F.max(F.when(F.col("kind") == "entity", F.col("center"))).alias("center_entity"), F.max(F.when(F.col("kind") == "tweet", F.col("center"))).alias("center_tweet")
        )
        best = best.join(c, "community", "left")
        if self.variant == "first":
            return best.withColumn("keywords", F.array().cast("array<string>"))
        k = self.keywords.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keywords"))
        return best.join(k, "community", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))

    def report(self) -> DataFrame:
        """One row a Top-5 community: title, one_liner, why_trending, entities by kind, evidence and metrics."""
        kinds = tuple(k for k in self.kinds if k not in ("domains", "mentions"))
        m = self.members.where("node like 'entity:%'").select(F.col("community").alias("cluster_id"), F.split_part("node", F.lit(":"), F.lit(2)).alias("kind"), F.expr("substring(node, instr(substring(node, 8), ':') + 8)").alias("name"))
        rows = R.with_names(R.with_names(self.top.withColumnRenamed("community", "cluster_id"), m, kinds), m, ("domains",), 3)
        text = self.posts.select(F.col("tweet_id").alias("center_tweet"), F.col("clean_text").alias("center_text"))
        tweets = self.members.where("node like 'tweet:%'").select(F.col("community").alias("cluster_id"), F.expr("substring(node, 7)").alias("tweet_id")).join(self.top.select(F.col("community").alias("cluster_id")), "cluster_id", "left_semi")
        best = tweets.join(self.posts, "tweet_id").groupBy("cluster_id").agg(F.min(F.struct((-F.col("like_count")).alias("o"), "tweet_id", "clean_text")).alias("m")).select("cluster_id", F.col("m.clean_text").alias("liked"))
        shown = self.posts.select("tweet_id", F.col("author_username").alias("author"), "text", "like_count", "created_at", "shown")
        rows = rows.join(text, "center_tweet", "left").join(best, "cluster_id", "left").join(R.evidence(tweets, shown, "shown", "cluster_id"), "cluster_id", "left")
        if self.variant != "first":
            some = sum((F.size(k) for k in (*kinds, "domains")), F.lit(0)) > 0
            rows = rows.withColumn("technologies", F.when(some, F.col("technologies")).otherwise(F.slice("keywords", 1, 3)))
        return rows.select(
            "rank", F.col("cluster_id").alias("community"), R.community_title(rows, self.variant).alias("title"),
            F.coalesce(preview(F.col("center_text"), 150), preview(F.col("liked"), 150), F.lit("多位 KOL 讨论的热点议题")).alias("one_liner"),
            S.why_spread(F.col("author_cnt"), F.col("tweet_cnt"), F.col("propagation"), F.col("engagement")).alias("why_trending"),
            *kinds, "domains", "evidence", "author_cnt", "tweet_cnt", "engagement", "propagation", F.bround("community_score", 2).alias("community_score"), "center_entity", "center_tweet", "keywords",
        )


@dataclass
class SemanticRun:
    """Topics of the base run in clusters by meaning, rolled up, scored and presented."""

    base: DailyTopics
    method: str = "greedy"
    threshold: float = 0.75
    eps: float = 0.5
    least: int = 2

    @cached_property
    def texts(self) -> DataFrame:
        """(id, topic_type, topic_key, text); the id is type and key."""
        t = S.topic_text(self.base.candidates, self.base.day)
        return staged(t.select(F.concat_ws(":", *KEYS).alias("id"), *KEYS, "text"), "texts")

    @cached_property
    def found(self) -> DataFrame:
        return staged(S.semantic_clusters(self.texts, self.method, self.threshold, self.eps, self.least), "found")

    @cached_property
    def topics(self) -> DataFrame:
        return S.semantic_topics(self.found, self.texts)

    @cached_property
    def members(self) -> DataFrame:
        return self.found.join(self.texts.select("id", *KEYS), "id").select(F.concat(F.lit("st_"), "cluster").alias("semantic_id"), *KEYS)

    @cached_property
    def rolled(self) -> DataFrame:
        return S.roll_up(self.members, self.base.topics, self.base.candidates, self.base.day, self.base.roster)

    @cached_property
    def top(self) -> DataFrame:
        return staged(S.semantic_top(self.rolled), "top")

    @cached_property
    def posts(self) -> DataFrame:
        """(semantic_id, tweet_id) of the Top-5."""
        m = self.members.join(self.top.select("semantic_id"), "semantic_id", "left_semi")
        return m.join(self.base.candidates.select(*KEYS, "tweet_id"), KEYS).select("semantic_id", "tweet_id").distinct()

    def _shown(self) -> DataFrame:
        return self.base.day.select("tweet_id", F.col("author_username").alias("author"), "text", metric("like").alias("like_count"), "created_at", (metric("like") + 2 * metric("repost")).alias("shown"))

    def cards(self) -> DataFrame:
        """The Top-5 with titles and descriptions by keywords, and the most liked posts."""
        return R.semantic_cards(self.top, self.members).join(R.evidence(self.posts, self._shown(), "like_count", "semantic_id"), "semantic_id", "left")

    @cached_property
    def extracted(self) -> DataFrame:
        """What the Top-5's most engaging posts are about."""
        place = F.row_number().over(Window.partitionBy("semantic_id").orderBy(F.desc("shown"), "tweet_id"))
        p = self.posts.join(self._shown(), "tweet_id").select(F.col("semantic_id").alias("topic_id"), place.alias("place"), "text")
        return S.topic_extract(p).withColumnRenamed("topic_id", "semantic_id")

    def report(self) -> DataFrame:
        """The Top-5 by what their posts are about, with the trend and prediction of the first member topic."""
        first = self.members.join(self.top.select("semantic_id"), "semantic_id", "left_semi").groupBy("semantic_id").agg(F.min(F.struct(*KEYS)).alias("m")).select("semantic_id", "m.*")
        t = self.top.join(first, "semantic_id", "left").join(self.extracted, "semantic_id", "left").join(R.evidence(self.posts, self._shown(), "shown", "semantic_id"), "semantic_id", "left")
        t = R.with_trends(t, self.base.trends, self.base.growth)
        a, n = F.col("unique_author_cnt"), F.col("tweet_cnt")
        description = R.say(a, " 位 KOL 参与讨论，共 ", n, " 条推文。", F.when(a > 1, "核心内容："), preview(F.col("topic_summary"), 200))
        return t.select(
            "rank", "semantic_id", F.coalesce("topic_title", R.say("热点话题 #", F.col("rank"), "（", a, " 位 KOL 参与）")).alias("title"), description.alias("description"), "event_type", "key_entities", "core_text",
            F.bround("hot_score", 2).alias("hot_score"), "tweet_cnt", "unique_author_cnt", "trend_label", "today_value", "avg_7d", "prediction", "confidence", "evidence", "total",
        )
