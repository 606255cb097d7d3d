"""The event variants as whole chains: posts to candidates, clusters, scores and Top-5."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assets
from ..functions import scalars as X
from ..functions.scalars import any_within, preview, ticker
from ..operators import cluster as C
from ..operators import constrained as Z
from ..operators import edges as E
from ..operators import entities as N
from ..operators import events as V
from ..operators import reports as R
from ..operators import semantic as S
from ..operators import text as W
from ..operators import vectors as D
from ..operators.similarity import Similar, similar_classes, similar_components
from ..operators.topics import relevant
from ..sources.stages import staged
from .daily_topics import DailyTopics


def metric(name: str) -> Column:
    return F.coalesce(F.col(f"public_metrics.{name}_count"), F.lit(0))


def engagement() -> Column:
    return X.weighted_engagement(metric("like"), metric("repost"), metric("reply"), metric("quote"))


def _base(posts: DataFrame) -> DataFrame:
    """What every variant's candidates carry; text is the cleaned one, raw the one that entities are sought in."""
    return posts.where("tweet_id <> ''").select(
        F.col("tweet_id").alias("id"), F.col("created_ts").alias("time"), "created_at", "author", "author_username", F.col("clean_text").alias("text"), F.col("text").alias("raw"),
        engagement().alias("engagement"), metric("like").alias("likes"), metric("repost").alias("reposts"), E.is_original(F.col("referenced_tweets")).alias("original"),
        F.coalesce(E.anchor_of(F.col("referenced_tweets")), F.lit("")).alias("anchor_id"), "entities", "url_domains", F.lower("clean_text").alias("low"),
    )


@dataclass
class EventRun:
    """Stages of one event variant over a base run's last day; each is made when it is first asked for."""

    base: DailyTopics

    @cached_property
    def posts(self) -> DataFrame:
        return staged(_base(self.base.day), "posts")

    @cached_property
    def edges(self) -> DataFrame:
        return staged(self.base.day_edges.select(F.col("source_tweet_id").alias("source"), F.col("target_tweet_id").alias("target"), "source_author_username"), "edges")

    def with_references(self, posts: DataFrame) -> DataFrame:
        """posts with reference_count and is_anchor (referred to at least once)."""
        n = self.edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("reference_count"))
        n = posts.join(n, "id", "left").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)))
        return n.withColumn("is_anchor", F.col("reference_count") >= 1)

    def rest(self, anchored: DataFrame) -> DataFrame:
        """Candidates that no anchor took."""
        return self.kept.join(anchored.select("id"), "id", "left_anti")


@dataclass
class RuleRun(EventRun):
    """Rule-first: hard rules, pairs by conditions and similarity, components, scores with coherence and novelty."""

    similarity: float = 0.65
    least_authors: int = 2
    least_coherence: float = 0.6
    as_of: int | None = None  # seconds; the latest post's time if not given
    kinds = ("tickers", "companies", "products", "people", "hashtags", "domains")

    @cached_property
    def candidates(self) -> DataFrame:
        e = self.posts.withColumn("entities", N.rule_entities(F.col("raw"), F.col("entities"), F.col("url_domains"))).withColumn("verbs", W.actions(F.col("text"), assets.RULE_VERBS))
        n = sum((F.size(f"entities.{k}") for k in self.kinds[:5]), F.lit(0))
        return staged(e.withColumn("drop_reason", W.rule_reason(F.col("text"), F.col("entities.domains"), n, F.size("verbs"))), "candidates")

    @cached_property
    def kept(self) -> DataFrame:
        return self.candidates.where("drop_reason is null").drop("drop_reason")

    @cached_property
    def similar(self) -> Similar:
        v = D.hash_vectors(self.kept.select(F.col("id").alias("tweet_id"), "text"), 3, (), None)
        return similar_classes(v.withColumnRenamed("tweet_id", "id"), self.similarity, at_least=True)

    @property
    def conditions(self) -> DataFrame:
        """What the constraints look at."""
        return self.kept.select("id", "time", "author", N.keyed(F.col("entities"), self.kinds[:4]).alias("entity"))

    @property
    def pairs(self) -> DataFrame:
        """Similar pairs under the constraints: similarity first, since within a day any two authors meet them."""
        return Z.similar_conditions(self.similar, self.conditions, self.edges)

    @cached_property
    def held(self) -> DataFrame:
        """The pairs, written, where clusters are made of them."""
        return staged(self.pairs, "pairs")

    @cached_property
    def near(self) -> DataFrame | None:
        """The clusters from classes, without the pairs; none if posts are so far apart that each pair's times count."""
        if not self.similar.copies_pass or not Z.all_near(self.conditions):
            return None
        return staged(Z.near_clusters(self.similar, self.conditions, self.edges), "near-clusters")

    @cached_property
    def members(self) -> DataFrame:
        if self.near is not None:
            return self.near.select("cluster_id", "id")
        ids = self.held.select(F.col("a").alias("id")).unionByName(self.held.select(F.col("b").alias("id"))).distinct()
        return staged(C.components(ids, self.held).select(F.col("component").alias("cluster_id"), "id"), "members")

    @cached_property
    def entities(self) -> DataFrame:
        return N.cluster_entities(self.members, self.kept, self.kinds)

    @cached_property
    def scored(self) -> DataFrame:
        as_of = self.as_of if self.as_of is not None else self.posts.agg(F.max("time")).first()[0] or 0
        coherence = V.pair_coherence(self.members, self.held) if self.near is None else Z.near_coherence(self.similar, self.near, self.edges)
        return V.cluster_scores(
            self.members, self.kept, self.edges, self.base.roster, least_authors=self.least_authors, coherence=coherence, least_coherence=self.least_coherence, as_of=as_of
        )

    @cached_property
    def top(self) -> DataFrame:
        return staged(V.top_clusters(self.scored), "top")


    def report(self) -> DataFrame:
        """One row a Top-5 event: title, why it trends, entities, the first five posts with why they are in, and how it was decided."""
        rows = R.with_names(self.top, self.entities, ("companies", "products", "tickers", "hashtags"))
        named = (F.size("companies") > 0) | (F.size("products") > 0)
        first = _first_posts(self.members, self.kept, self.top, F.struct("id", "author", F.substring("text", 1, 200).alias("text"), F.size("verbs").alias("verbs")))
        rows = rows.join(first, "cluster_id")
        start = F.trim(F.substring(F.get("posts", F.lit(0))["text"], 1, 50))
        title = F.coalesce(F.get("products", F.lit(0)), F.get("companies", F.lit(0)), F.when(F.length(start) > 10, start), R.say("热点事件 ", F.col("rank")))
        why = lambda x: S.joined_parts_with(" + ", "in cluster", F.when(named, F.lit("shared entity")), F.when(x["verbs"] > 0, F.lit("similar action")))
        posts = F.transform("posts", lambda x: F.struct(x["id"].alias("tweet_id"), x["author"].alias("author"), x["text"].alias("text"), why(x).alias("why_included")))
        return rows.select(
            "rank", "cluster_id", title.alias("title"), S.why_counted(F.col("author_cnt"), F.col("tweet_cnt"), F.col("propagation"), F.col("engagement")).alias("why_trending"),
            "companies", "products", F.col("products").alias("technologies"), "tickers", "hashtags", posts.alias("supporting_tweets"), R.rule_trace(F.col("author_cnt"), F.col("coherence")).alias("passed_rules"),
            "author_cnt", "tweet_cnt", "propagation", "engagement",
        )


def _first_posts(members: DataFrame, events: DataFrame, top: DataFrame, item: Column, n: int = 5) -> DataFrame:
    """(cluster_id, posts): the first n posts by id of the clusters in top."""
    rows = members.select("cluster_id", "id").join(top.select("cluster_id"), "cluster_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    rows = rows.withColumn("p", place).where(F.col("p") <= n).join(events, "id")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("posts"))


@dataclass
class CentricRun(EventRun):
    """Event-centric: entity, action and time; anchor clusters first, then posts that meet two of five conditions."""

    weights = False
    order = ("companies", "products", "tickers", "people")

    @cached_property
    def candidates(self) -> DataFrame:
        found = N.flat(N.rule_entities(F.col("raw"), F.col("entities"), F.col("url_domains")), self.order)
        action = F.get(W.actions(F.col("text"), assets.RULE_VERBS), F.lit(0))
        e = self.posts.withColumn("entity", found).withColumn("action", action)
        return staged(self.with_references(e).withColumn("drop_reason", W.event_reason(F.col("text"), F.size("entity"), F.col("action"))), "candidates")

    @cached_property
    def kept(self) -> DataFrame:
        return self.candidates.where("drop_reason is null").drop("drop_reason")

    @cached_property
    def anchored(self) -> DataFrame:
        return staged(V.anchor_clusters(self.kept, self.edges), "anchored")

    def meet(self, leaders: DataFrame, events: DataFrame) -> DataFrame:
        return V.condition_pairs(events, self.edges, leaders).select("a", "b", F.lit(0.0).alias("weight"))

    @cached_property
    def grown(self) -> DataFrame:
        """(id, leader, weight) of the candidates that no anchor took."""
        rest = staged(self.rest(self.anchored).select("id", "time", "entity", "author", "action", "anchor_id"), "rest")
        return staged(V.block_leaders(rest, self.meet, by_weight=self.weights), "grown")

    @cached_property
    def members(self) -> DataFrame:
        """(cluster_id, id, cluster_weight, cluster_type): anchor clusters and topics of two posts or more."""
        anchor = self.anchored.select(F.concat(F.lit("anchor_"), "cluster_id").alias("cluster_id"), "id", F.lit(10.0).alias("cluster_weight"), F.lit("anchor").alias("cluster_type"))
        return staged(anchor.unionByName(V.kept_clusters(self.grown, 2, "topic_").withColumn("cluster_type", F.lit("incremental"))), "members")

    @cached_property
    def scored(self) -> DataFrame:
        weights = self.members.select("cluster_id", "cluster_weight").distinct() if self.weights else None
        return V.cluster_scores(self.members.select("cluster_id", "id"), self.kept, self.edges, self.base.roster, weights)

    @cached_property
    def top(self) -> DataFrame:
        return staged(V.top_clusters(self.scored), "top")


    def report(self) -> DataFrame:
        """One row a Top-5 event: title by its first entity and its leader's action, why it trends, posts and how it came about."""
        members = self.members.join(self.top.select("cluster_id"), "cluster_id", "left_semi")
        names = members.join(self.kept.select("id", F.explode("entity").alias("name")), "id").select("cluster_id", F.lit("entity").alias("kind"), "name").distinct()
        rows = R.with_names(self.top, names, ("entity",))
        kind = members.select("cluster_id", "cluster_type", F.col("cluster_weight").alias("w")).distinct()
        lead = members.where(F.col("cluster_id").endswith(F.concat(F.lit("_"), "id"))).join(self.kept.select("id", "action"), "id").select("cluster_id", "action")
        first = _first_posts(members, self.kept, self.top, F.struct("id", "author", F.substring("text", 1, 200).alias("text"), "entity", "action"))
        rows = rows.join(kind, "cluster_id").join(lead, "cluster_id", "left").join(first, "cluster_id")
        head = F.get("entity", F.lit(0))
        title = F.when(head.isNotNull(), F.concat_ws(" ", head, "action")).otherwise(R.say("热点事件 ", F.col("rank")))
        weight = F.col("w") if self.weights else None
        why = S.why_counted(F.col("author_cnt"), F.col("tweet_cnt"), F.col("propagation"), F.col("engagement"), weight)
        trace = F.when(F.col("cluster_type") == "anchor", R.ANCHOR_TRACE).otherwise(R.MERGE_TRACE if self.weights else R.TOPIC_TRACE)
        return rows.select(
            "rank", "cluster_id", title.alias("title"), why.alias("why_trending"), F.col("entity").alias("key_entities"), "action", F.col("posts").alias("supporting_tweets"), trace.alias("trace"),
            "author_cnt", "tweet_cnt", "propagation", "engagement", *([F.col("w").alias("cluster_weight")] if self.weights else []),
        )


@dataclass
class GatedRun(CentricRun):
    """Dictionaries gate candidates; topics grow by weighted merge conditions, and weights count in the score."""

    weights = True
    least_weight: float = 4.0

    @cached_property
    def candidates(self) -> DataFrame:
        e = self.posts.withColumn("entity", W.gated_entities(F.col("raw"))).withColumn("action", F.get(W.actions(F.col("text"), W.GATE_VERBS), F.lit(0)))
        gate = F.when(F.size("entity") == 0, "no_entity").when(F.col("action").isNull(), "no_action")
        return staged(self.with_references(e).withColumn("drop_reason", F.coalesce(gate, W.gated_reason(F.col("text")))), "candidates")

    def meet(self, leaders: DataFrame, events: DataFrame) -> DataFrame:
        return V.weighted_pairs(events, leaders).where(F.col("weight") >= self.least_weight)


@dataclass
class SeededRun(EventRun):
    """Seeds (tickers, companies, relevant phrases), average linkage of their posts, merging by shared sets, scores."""

    distance: float = 0.3
    least_size: int = 2
    filtered: bool = True
    kinds = ("tickers", "hashtags", "domains", "mentions", "companies")

    @cached_property
    def tagged(self) -> DataFrame:
        p = self.posts.where(relevant(F.col("raw"), F.col("entities.hashtags"), F.col("entities.cashtags"))) if self.filtered else self.posts
        found = N.first_entities(F.col("raw"), F.col("entities"), F.col("url_domains"))
        return staged(p.withColumn("entities", found).withColumn("phrases", F.array_distinct(F.concat(W.ngrams(F.col("text"), 2), W.ngrams(F.col("text"), 3)))), "tagged")

    @cached_property
    def seeds(self) -> DataFrame:
        """(seed_key, id): `ticker:`, `company:` and `phrase:` keys of posts."""
        return W.seed_keys(self.tagged)

    @cached_property
    def stage_one(self) -> DataFrame:
        """(cluster_id, id) of average-linkage clusters of the seeded posts with over ten characters."""
        seeded = self.tagged.join(self.seeds.select("id").distinct(), "id", "left_semi").where(F.length("text") > 10).select(F.col("id").alias("tweet_id"), "text")
        v = staged(D.hash_vectors(seeded), "vectors").withColumnRenamed("tweet_id", "id")
        found = C.average_linkage(v, similar_components(v, 1 - self.distance), self.distance)
        size = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.least_size).select("cluster")
        return staged(found.join(size, "cluster", "left_semi").select(F.col("cluster").alias("cluster_id"), "id"), "stage-one")

    @cached_property
    def members(self) -> DataFrame:
        phrases = self.stage_one.join(self.tagged.select("id", F.explode("phrases").alias("phrase")), "id").select("cluster_id", "phrase")
        return staged(V.merge_events(self.stage_one, N.cluster_entities(self.stage_one, self.tagged, self.kinds), phrases), "members")

    @cached_property
    def entities(self) -> DataFrame:
        return N.cluster_entities(self.members, self.tagged, self.kinds)

    @cached_property
    def scored(self) -> DataFrame:
        m = self.members.select("cluster_id", F.col("id").alias("tweet_id"))
        edges = self.edges.withColumnsRenamed({"source": "source_tweet_id", "target": "target_tweet_id"}).where("source_author_username <> ''")
        spread = E.edges_into(edges, m, self.posts.select(F.col("id").alias("tweet_id"), "author"))
        compared = self.tagged.select(F.col("id").alias("tweet_id"), "text").join(D.first_members(m).select("tweet_id"), "tweet_id", "left_semi")
        v = D.hash_vectors(compared)  # coherence looks at no other posts
        return V.seeded_scores(self.members, self.tagged, spread, D.coherence(m, v))

    @cached_property
    def top(self) -> DataFrame:
        return staged(V.top_clusters(self.scored), "top")

    def report(self, phrases: int = 15) -> DataFrame:
        """One row a Top-5 event: title by companies, tickers and a relevant phrase, its most liked post, evidence and metrics."""
        rows = R.with_names(R.with_names(self.top, self.entities, ("companies", "tickers", "hashtags")), self.entities, ("domains",), 3)
        own = self.members.join(self.top.select("cluster_id"), "cluster_id", "left_semi")
        keys = own.join(self.tagged.select("id", F.explode("phrases").alias("name")), "id").select("cluster_id", F.lit("key_phrases").alias("kind"), "name").distinct()
        rows = R.with_names(rows, keys, ("key_phrases",), phrases)
        text = own.join(self.tagged, "id").groupBy("cluster_id").agg(F.min(F.struct((-F.col("likes")).alias("o"), "id", "text")).alias("m")).select("cluster_id", F.col("m.text").alias("liked"))
        shown = self.posts.select(F.col("id").alias("tweet_id"), F.col("author_username").alias("author"), F.col("raw").alias("text"), F.col("likes").alias("like_count"), "created_at", (F.col("likes") + 2 * F.col("reposts")).alias("shown"))
        rows = rows.join(text, "cluster_id").join(R.evidence(own.select("cluster_id", F.col("id").alias("tweet_id")), shown, "shown", "cluster_id"), "cluster_id")
        phrase = F.slice(F.filter(F.slice("key_phrases", 1, 3), lambda p: any_within(p, assets.TOPIC_KEYWORDS)), 1, 1)
        parts = F.concat(F.slice("companies", 1, 2), F.transform(F.slice("tickers", 1, 2), ticker), phrase)
        title = F.when(F.size(parts) > 0, R.say(F.array_join(F.slice(parts, 1, 3), " / "), F.when(F.size(parts) > 3, F.lit(" 等话题")))).otherwise(R.say("热点事件 ", F.col("rank")))
        return rows.select(
            "rank", "cluster_id", title.alias("title"), preview(F.col("liked"), 100).alias("one_liner"),
            S.why_spread(F.col("author_cnt"), F.col("tweet_cnt"), F.col("propagation"), F.col("engagement"), whole=False).alias("why_trending"),
            "companies", "tickers", "hashtags", "domains", "evidence", "author_cnt", "tweet_cnt", "engagement", "propagation", F.bround("coherence", 3).alias("coherence"), F.bround("event_score", 2).alias("event_score"),
        )
