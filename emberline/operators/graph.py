"""The graph of posts, authors and entities: edges by kind, weighted degrees and community centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assets import ENTITY_WEIGHTS
from .edges import edges_by_members
from .text import co_occurrence


def graph_edges(posts: DataFrame, entities: DataFrame, interactions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(kind, a, b, weight) with node names `tweet:`, `author:` and `entity:`; entities(tweet_id, entity) may repeat."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    one = F.lit(1.0)
    parts = [
        posts.where("author <> ''").select(F.lit("author-tweet").alias("kind"), name("author", "author").alias("a"), name("tweet", "tweet_id").alias("b"), one.alias("weight")),
        entities.groupBy("tweet_id", "entity").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(F.lit("tweet-entity").alias("kind"), name("tweet", "tweet_id").alias("a"), name("entity", "entity").alias("b"), "weight"),
        interactions.select(F.lit("author-author").alias("kind"), name("author", "author_a").alias("a"), name("author", "author_b").alias("b"), F.col("weight").cast("double").alias("weight")),
        co_occurrence(entities).select(F.lit("entity-entity").alias("kind"), name("entity", "a").alias("a"), name("entity", "b").alias("b"), F.col("weight").cast("double").alias("weight")),
    ]
    if similar is not None:
        parts.append(similar_edges(similar))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar_edges(similar: DataFrame) -> DataFrame:
    """similar(a, b, cos) of posts as edges of the graph."""
    name = lambda c: F.concat(F.lit("tweet:"), F.col(c)).alias(c)
    return similar.select(F.lit("tweet-tweet").alias("kind"), name("a"), name("b"), F.col("cos").alias("weight"))


def degrees(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(node, centrality): the weights of a node's edges of some kinds."""
    e = edges.where(F.col("kind").isin(*kinds))
    return e.select(F.col("a").alias("node"), "weight").unionByName(e.select(F.col("b").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("centrality"))


def centres(edges: DataFrame, members: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """members(community, node) -> the most central tweet and entity of each community, ties by name.

    Posts count edges to posts and entities, entities those to posts and to each other, over the whole graph.  near(node, weight)
    are the weights of a post's edges to posts, summed, where edges come without them.
    """
    by_tweet = degrees(edges, ("tweet-tweet", "tweet-entity")).where("node like 'tweet:%'")
    if near is not None:
        by_tweet = by_tweet.unionByName(near.select("node", F.col("weight").alias("centrality"))).groupBy("node").agg(F.sum("centrality").alias("centrality"))
    by_entity = degrees(edges, ("tweet-entity", "entity-entity")).where("node like 'entity:%'")
    m = members.join(by_tweet.unionByName(by_entity), "node").withColumn("kind", F.substring_index("node", ":", 1))
    place = F.row_number().over(Window.partitionBy("community", "kind").orderBy(F.desc("centrality"), "node"))
    return m.withColumn("p", place).where("p = 1").select("community", "kind", F.expr("substring(node, instr(node, ':') + 1)").alias("center"), "centrality")


def weighted_centres(edges: DataFrame, members: DataFrame, posts: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """As centres, with weights: posts 1.5 for similar posts, 1 for entities and 0.3 log1p(likes + 2 reposts); entities
    1.2 for posts and 1.5 for each other, times a weight of their kind (names are `kind:name`).

    A post also gets a fifth of the mean centrality of its entities within the community: two rounds of a tenth each,
    in which entities don't change.  posts(tweet_id, shown); near as for centres.
    """
    summed = lambda kind, w: edges.where(F.col("kind") == kind).select("a", "b", (w * F.col("weight")).alias("w"))
    ends = lambda e, c: e.select(F.col(c).alias("node"), "w")
    tt, te, ee = summed("tweet-tweet", 1.5), summed("tweet-entity", 1.0), summed("entity-entity", 1.5)
    shown = posts.select(F.concat(F.lit("tweet:"), "tweet_id").alias("node"), (0.3 * F.log1p("shown")).alias("w"))
    by_tweet = ends(tt, "a").unionByName(ends(tt, "b")).unionByName(ends(te, "a")).unionByName(shown)
    if near is not None:
        by_tweet = by_tweet.unionByName(near.select("node", (1.5 * F.col("weight")).alias("w")))
    by_tweet = by_tweet.groupBy("node").agg(F.sum("w").alias("c"))
    kind = F.split_part("node", F.lit(":"), F.lit(2))
    weight = F.lit(1.0)
    for k, w in ENTITY_WEIGHTS.items():
        weight = F.when(kind == k, w).otherwise(weight)
    to_entity = te.select(F.col("b").alias("node"), (1.2 * F.col("w")).alias("w"))
    by_entity = to_entity.unionByName(ends(ee, "a")).unionByName(ends(ee, "b")).groupBy("node").agg(F.sum("w").alias("c")).withColumn("c", F.col("c") * weight)
    inside = members.join(by_entity, "node")
    named = te.select(F.col("a").alias("post"), F.col("b").alias("node")).join(members.select("community", F.col("node").alias("post")), "post").join(inside, ["community", "node"])
    mean = named.groupBy("community", F.col("post").alias("node")).agg((0.2 * F.avg("c")).alias("more"))
    tweets = members.join(by_tweet, "node").join(mean, ["community", "node"], "left").select("community", "node", (F.col("c") + F.coalesce("more", F.lit(0.0))).alias("c"))
    m = tweets.unionByName(inside.select("community", "node", "c")).where("c > 0").withColumn("kind", F.substring_index("node", ":", 1))
    place = F.row_number().over(Window.partitionBy("community", "kind").orderBy(F.desc(F.round("c", 9)), "node"))
    return m.withColumn("p", place).where("p = 1").select("community", "kind", _name().alias("center"), F.col("c").alias("centrality"))


def _name():
    return F.expr("substring(node, instr(node, ':') + 1)")


def listing(members: DataFrame, least: int = 2) -> DataFrame:
    """Nodes by kind of each community of at least so many nodes: (community, tweet_count, author_count, entity_count)."""
    of = lambda kind: F.count(F.when(F.substring_index("node", ":", 1) == kind, 1))
    out = members.groupBy("community").agg(of("tweet").alias("tweet_count"), of("author").alias("author_count"), of("entity").alias("entity_count"), F.count(F.lit(1)).alias("nodes"))
    return out.where(F.col("nodes") >= least).drop("nodes")


def community_scores(members: DataFrame, posts: DataFrame, edges: DataFrame, roster: DataFrame) -> DataFrame:
    """Scores of communities of two nodes or more with a post: authors are author nodes, propagation counts edges by
    them to posts of the community.  One author below an engagement of 50 is dropped.

    posts(tweet_id, author, engagement), edges(source_author_username, target_tweet_id).
    """
    m = members.join(listing(members).where("tweet_count > 0").select("community"), "community", "left_semi").withColumn("kind", F.substring_index("node", ":", 1))
    tweets = m.where("kind = 'tweet'").select("community", _name().alias("tweet_id"))
    authors = m.where("kind = 'author'").select("community", _name().alias("author"))
    t = tweets.join(posts.select("tweet_id", "author", "engagement"), "tweet_id").join(roster.select(F.col("username").alias("author"), "followers_count"), "author", "left")
    rows = t.groupBy("community").agg(F.count(F.lit(1)).alias("tweet_cnt"), F.sum("engagement").alias("engagement"), F.sum(F.coalesce("followers_count", F.lit(0))).alias("followers"))
    rows = rows.join(authors.groupBy("community").agg(F.count(F.lit(1)).alias("author_cnt")), "community", "left")
    spread = edges_by_members(edges, tweets.withColumnRenamed("community", "cluster_id"), authors.withColumnRenamed("community", "cluster_id")).withColumnRenamed("cluster_id", "community")
    rows = rows.join(spread, "community", "left").fillna(0, ["author_cnt", "propagation"])
    a, e = F.col("author_cnt"), F.col("engagement")
    score = F.log1p(e) + 3.0 * a + 1.5 * F.log1p("propagation") + 0.5 * F.log1p("tweet_cnt") + 0.3 * F.log1p(F.col("followers") / F.greatest(a, F.lit(1)))
    return rows.withColumn("community_score", score).where(~((a < 2) & (e < 50)))


def community_keywords(members: DataFrame, words: DataFrame, most: int = 5, technical: int | None = None) -> DataFrame:
    """words(tweet_id, word[, tech]) -> the most frequent words of each community's posts: (community, word, n, place), ties by word.

    With `technical` up to so many words marked tech come first, then others up to `most` in all less those places.
    """
    tweets = members.where("node like 'tweet:%'").select("community", _name().alias("tweet_id"))
    group = F.when(F.col("tech"), 0).otherwise(1) if technical is not None else F.lit(0)
    n = words.join(tweets, "tweet_id").withColumn("g", group).groupBy("community", "word", "g").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("community", "g").orderBy(F.desc("n"), "word"))
    n = n.withColumn("r", rank)
    n = n.where(F.col("r") <= most) if technical is None else n.where(F.when(F.col("g") == 0, F.col("r") <= technical).otherwise(F.col("r") <= most - technical))
    place = F.row_number().over(Window.partitionBy("community").orderBy("g", "r"))
    return n.withColumn("place", place).select("community", "word", "n", "place")
