"""Clusters of topics: their texts, roll-up, score and Top-5; and short explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assets import EVENT_KINDS, TOPIC_NAMES, TOPIC_NOT_NAMES
from ..functions.dictionary import found_lower
from ..functions.scalars import let, preview, strip
from .text import kind_hits, kind_words
from .topics import KEYS

SYMBOLS = ("hashtag", "domain", "cashtag")


def topic_text(found: DataFrame, posts: DataFrame, most: int = 5, cut: int = 200) -> DataFrame:
    """Per topic its first posts' texts (by id, over ten characters, cut), joined by blanks; keyword topics have no text."""
    rows = found.select(*KEYS, "tweet_id").distinct().join(posts.select("tweet_id", "clean_text"), "tweet_id").where(F.length("clean_text") > 10)
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("tweet_id"))
    rows = rows.withColumn("p", place).where(F.col("p") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p", F.substring("clean_text", 1, cut).alias("t")))), lambda x: x["t"])
    own = rows.groupBy(*KEYS).agg(F.array_join(texts, " ").alias("text"))
    out = found.select(*KEYS).distinct().join(own, KEYS, "left")
    return out.select(*KEYS, F.when(F.col("topic_type") == "content_keyword", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def roll_up(members: DataFrame, topics: DataFrame, found: DataFrame, posts: DataFrame, roster: DataFrame) -> DataFrame:
    """members(semantic_id, topic_type, topic_key) -> sums over member topics (shared posts count for each), distinct
    authors of known posts, their mean followers (0 outside the roster), and hot_score."""
    sums = ("tweet_cnt", "sum_like_cnt", "sum_repost_cnt", "sum_reply_cnt", "sum_quote_cnt", "ref_cnt")
    symbol = F.col("topic_type").isin(*SYMBOLS)
    total = members.join(topics, KEYS).groupBy("semantic_id").agg(*(F.sum(c).alias(c) for c in sums))
    kinds = members.groupBy("semantic_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.sum(symbol.cast("int")).alias("symbols"))
    authors = members.join(found.select(*KEYS, "tweet_id"), KEYS).join(posts.select("tweet_id", "author"), "tweet_id").where("author <> ''").select("semantic_id", "author").distinct()
    authors = authors.join(roster.select(F.col("username").alias("author"), "followers_count"), "author", "left")
    voices = authors.groupBy("semantic_id").agg(F.count(F.lit(1)).alias("unique_author_cnt"), F.sum(F.coalesce("followers_count", F.lit(0))).alias("followers"))
    s = total.join(kinds, "semantic_id").join(voices, "semantic_id", "left").fillna(0, ["unique_author_cnt", "followers"])
    a, t = F.col("unique_author_cnt"), F.col("tweet_cnt")
    many = F.when(t > 1, 1 + 0.2 * F.log1p(t - 1)).otherwise(1.0)
    several = F.when(a > 1, 1 + 0.3 * F.log1p(a - 1)).otherwise(1.0)
    words = F.when(F.col("symbols") > 0, 1 + 0.5 * F.log1p("symbols")).otherwise(0.5)
    like = F.when(t > 0, F.col("sum_like_cnt") / t).otherwise(0.0)
    mean = F.when(a > 0, F.col("followers") / a).otherwise(0.0)
    spread = F.col("sum_repost_cnt") + F.col("sum_quote_cnt")
    score = words * (many * (F.log1p("ref_cnt") + F.log1p(spread) + 0.5 * F.log1p(like)) + several * (3.0 * a + 0.3 * F.log1p(mean)) + 0.5 * F.log1p(t))
    return s.withColumn("hot_score", score).drop("followers")


def semantic_top(rolled: DataFrame, n: int = 5) -> DataFrame:
    """The n best clusters with a symbol and two posts, those of two authors first; never padded; ties by id."""
    tier = F.when((F.col("symbols") > 0) & (F.col("tweet_cnt") >= 2), F.when(F.col("unique_author_cnt") >= 2, 0).when(F.col("unique_author_cnt") >= 1, 1))
    best = rolled.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("hot_score"), "semantic_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("hot_score"), "semantic_id")))  # n rows


def joined_parts_with(by: str, none: str, *parts: Column) -> Column:
    """The parts that hold, joined; if none holds, a fixed text."""
    own = F.concat_ws(by, *parts)
    return F.when(own == "", none).otherwise(own)


def joined_parts(none: str, *parts: Column) -> Column:
    return joined_parts_with("；", none, *parts)


def why_counted(authors: Column, tweets: Column, propagation: Column, engagement: Column, weight: Column | None = None) -> Column:
    """Why an event trends, by all its counts above zero; a weight of 10 or more marks an anchor's event."""
    text = lambda before, n, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    parts = [
        F.when(authors > 0, text("", authors, " 位 KOL")),
        F.when(propagation > 0, text("传播链 ", propagation, " 次")),
        F.when(engagement > 0, text("总互动量 ", engagement.cast("long"), "")),
        F.when(tweets > 0, text("共 ", tweets, " 条推文")),
    ]
    if weight is not None:
        parts.append(F.when(weight >= 10, F.lit("传播锚点事件")))
    return joined_parts("讨论热度较高", *parts)


def why_spread(authors: Column, tweets: Column, propagation: Column, engagement: Column, whole: bool = True) -> Column:
    """Why an event or community trends, by the counts that are high; engagement as a whole number or as it is."""
    text = lambda before, n, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    return joined_parts(
        "引发广泛关注",
        F.when(authors >= 3, text("", authors, " 位 KOL 参与讨论")),
        F.when(propagation > 0, text("跨作者传播 ", propagation, " 次")),
        F.when(engagement > 100, text("总互动量 ", engagement.cast("long") if whole else engagement, "")),
        F.when(tweets >= 5, text("共 ", tweets, " 条推文")),
    )


def context(text: Column, name: Column, around: int = 2, most: int = 50) -> Column:
    """The words around the first whole occurrence of a name (whatever the case) in the first sentence that gives more than the name.

    Sentences need over 20 characters and, without urls and punctuation, three words.  Cut; null without one.
    """
    low = F.lower(name)

    def phrase(sentence: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(sentence, r"https?://\S+", ""), r"[^\p{L}\p{N}_\s]", " ")
        words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
        at = F.array_position(F.transform(words, F.lower), low).cast("int")
        start = F.greatest(at - around, F.lit(1))
        own = F.array_join(F.slice(words, start, at + around + 1 - start), " ")
        fits = F.contains(F.lower(sentence), low) & (F.length(sentence) > 20) & (F.size(words) >= 3) & (at > 0)
        return F.when(fits, F.when(F.length(own) > F.length(name), F.substring(own, 1, most)))

    return F.get(F.array_compact(F.transform(F.split(text, r"[.!?]\s+"), phrase)), F.lit(0))


# ---------------------------------------------------------------- clusters of topics

def standardised(vectors: DataFrame) -> DataFrame:
    """vectors(id, v) with each column less its mean and over its population deviation (0 counts as 1)."""
    cells = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    # one row: as many values as a vector has
    one = cells.agg(F.array_sort(F.collect_list(F.struct("dim", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("c"))
    return vectors.join(F.broadcast(one)).select("id", F.zip_with("v", "c", lambda x, c: (x - c["m"]) / c["s"]).alias("v"))


def topic_vectors(texts: DataFrame, size: int = 128) -> DataFrame:
    """texts(id, text) -> (id, v): rank embeddings; a text without words is all zeros."""
    from .vectors import dense, rank_embedding

    v = dense(rank_embedding(texts.select(F.col("id").alias("tweet_id"), "text"), size), size)
    zero = F.array_repeat(F.lit(0.0), size)
    return texts.select("id").join(v.withColumnRenamed("tweet_id", "id"), "id", "left").select("id", F.coalesce("v", zero).alias("v"))


def semantic_clusters(texts: DataFrame, method: str = "greedy", threshold: float = 0.75, eps: float = 0.5, least: int = 2) -> DataFrame:
    """texts(id, text) -> (id, cluster): greedy leaders by cosine above a threshold, or density clusters of standardised vectors.

    A topic that nothing is near to is a cluster of its own.  Clusters are named by their first member.  A greedy leader
    needs `least` free topics near to it, itself included; one that finds fewer may be taken by a later leader.
    """
    from .similarity import similar_density, similar_leaders

    v = topic_vectors(texts)
    if method == "dbscan":
        return similar_density(standardised(v), 1 - eps, least).select("id", F.col("component").alias("cluster"))
    found = similar_leaders(v, threshold, least)
    first = found.groupBy("leader").agg(F.min("id").alias("cluster"))
    return found.join(first, "leader").select("id", "cluster")


def semantic_topics(found: DataFrame, texts: DataFrame, cut: int = 500) -> DataFrame:
    """found(id, cluster), texts(id, text) -> (semantic_id, cluster_size, first_member, representative_text): the longest text, ties to the first."""
    rows = found.join(texts.select("id", "text"), "id")
    longest = F.min(F.struct((-F.length("text")).alias("o"), "id", "text")).alias("m")
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.min("id").alias("first_member"), longest)
    return out.select(F.concat(F.lit("st_"), "cluster").alias("semantic_id"), "cluster_size", "first_member", F.substring("m.text", 1, cut).alias("representative_text"))


# ---------------------------------------------------------------- what a topic is about

#: What titles say after the names, by kind of event.
KIND_TITLES = {
    "invention": " 发布新产品/技术", "announcement": " 发布重要公告", "controversy": " 相关争议/法律问题", "funding": " 融资/收购动态", "breakthrough": " 取得重大突破",
}
NO_SENTENCE = "讨论热点话题"


def key_sentence(text: Column, most: int = 150) -> Column:
    """The text without urls, cut to so many characters; of a longer one up to its last . ? or ! there, if that is beyond 50."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", ""), r"\s+", " "))
    head = F.substring(bare, 1, most)
    whole = F.regexp_extract(head, r"^(.*[.?!])", 1)
    cut = F.when((F.length(bare) > most) & (F.length(whole) > 51), whole).otherwise(head)
    return F.when(bare == "", NO_SENTENCE).otherwise(cut)


def topic_extract(posts: DataFrame, most: int = 10) -> DataFrame:
    """posts(topic_id, place, text), place from 1 by falling heat -> what each topic's first posts are about.

    (topic_id, event_type, key_entities, topic_title, topic_summary, core_text).  The kind with most hits over the texts,
    ties to the kind that scored first; names are known ones and capitalised words, in order.
    """
    p = posts.where(F.col("place") <= most).select("topic_id", "place", F.coalesce("text", F.lit("")).alias("text"))

    def hits(words: Column) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("o"), kind_hits(words, ws).alias("n")) for i, (k, ws) in enumerate(EVENT_KINDS.items())))

    scored = p.select("topic_id", "place", F.explode(let(kind_words(F.col("text"), EVENT_KINDS), hits)).alias("x")).where("x.n > 0")
    kinds = scored.groupBy("topic_id", "x.kind").agg(F.sum("x.n").alias("n"), F.min(F.struct("place", "x.o")).alias("first"))
    kind = kinds.groupBy("topic_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "first", "kind")).alias("m")).select("topic_id", F.col("m.kind").alias("event_type"))
    known = found_lower(F.col("text"), TOPIC_NAMES)
    capital = F.filter(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?![\p{L}\p{N}_])"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*TOPIC_NOT_NAMES))
    names = p.select("topic_id", F.explode(F.array_union(known, capital)).alias("name")).distinct()
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("name"))
    names = names.withColumn("p", place).where("p <= 5").groupBy("topic_id").agg(F.array_sort(F.collect_list("name")).alias("key_entities"))
    core = p.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "place").alias("core")).withColumn("core", key_sentence(F.col("core")))
    out = core.join(kind, "topic_id", "left").join(names, "topic_id", "left").fillna("discussion", ["event_type"]).withColumn("key_entities", F.coalesce("key_entities", F.array().cast("array<string>")))
    after = F.lit(None).cast("string")
    for k, t in KIND_TITLES.items():
        after = F.when(F.col("event_type") == k, t).otherwise(after)
    some = F.size("key_entities") > 0
    title = F.when(some & after.isNotNull(), F.concat(F.array_join(F.slice("key_entities", 1, 3), ", "), after)).when(some, preview(F.col("core"), 60)).otherwise(preview(F.col("core"), 80))
    summary = F.when(F.col("n") > 1, F.concat(F.lit("多位 KOL 讨论："), F.substring("core", 1, 100))).otherwise(F.substring("core", 1, 150))
    return out.select("topic_id", "event_type", "key_entities", title.alias("topic_title"), summary.alias("topic_summary"), F.substring("core", 1, 200).alias("core_text"))
