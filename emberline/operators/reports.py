"""Report rows: titles, descriptions, evidence and whole documents, with the fixed Chinese texts that readers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import permalink, preview, ticker
from .topics import KEYS


def say(*parts) -> Column:
    """Texts and columns joined; a null column is empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _counted(name: Column, label: str, authors: Column, tweets: Column, both: str, several: str, many: str, none: str) -> Column:
    """A description by whether two authors and two posts took part."""
    head = say(f"{label} ", name)
    return (
        F.when((authors >= 2) & (tweets >= 2), say(head, "：", authors, both, "，共 ", tweets, " 条推文"))
        .when(authors >= 2, say(head, "：", authors, several))
        .when(tweets >= 2, say(head, "：共 ", tweets, many))
        .otherwise(say(head, none))
    )


def topic_cards(top: DataFrame, posts: DataFrame) -> DataFrame:
    """top(rank, topic_type, topic_key, ...) with title, description, and for a known centre post its author and link."""
    known = posts.select(F.col("tweet_id").alias("topic_key"), F.lit("center_tweet").alias("topic_type"), F.col("author_username").alias("tweet_author"), F.col("text").alias("tweet_text"))
    t = top.join(known, KEYS, "left")
    key, a, n = F.col("topic_key"), F.col("unique_author_cnt"), F.col("tweet_cnt")
    kind, by, text = F.col("topic_type"), F.col("tweet_author"), F.col("tweet_text")
    tag, cash = say("#", key), ticker(key)
    title = (
        F.when(kind == "hashtag", tag)
        .when(kind == "cashtag", cash)
        .when(kind == "domain", key)
        .when((kind == "center_tweet") & by.isNotNull(), say("热门推文 (@", by, ")", F.when(a >= 2, say(" - ", a, " 位 KOL 转发/引用"))))
        .when(kind == "center_tweet", say("热门推文", F.when(a >= 2, say(" - ", a, " 位 KOL 转发/引用"))))
        .otherwise(key)
    )
    short = preview(text, 150)
    description = (
        F.when(kind == "hashtag", _counted(tag, "话题标签", a, n, " 位 KOL 参与讨论", " 位 KOL 参与讨论", " 条推文", " 在 KOL 中引发热议"))
        .when(kind == "cashtag", _counted(cash, "股票代码", a, n, " 位 KOL 参与讨论", " 位 KOL 关注", " 条推文", " 受到 KOL 关注"))
        .when(kind == "domain", _counted(key, "域名", a, n, " 位 KOL 分享", " 位 KOL 分享", " 条推文被分享", " 在 KOL 推文中被频繁分享"))
        .when((kind == "center_tweet") & by.isNotNull(), F.when(a >= 2, say(short, "（被 ", a, " 位 KOL 转发/引用）")).otherwise(short))
        .when(kind == "center_tweet", F.when(a >= 2, say("推文 ID: ", F.substring(key, 1, 20), "... 被 ", a, " 位 KOL 转发/引用")).otherwise(say("推文 ID: ", F.substring(key, 1, 20), "... 被大量转发/引用")))
        .otherwise(say(kind, ": ", key))
    )
    return t.withColumns({"title": title, "description": description, "tweet_url": F.when(by.isNotNull(), permalink(by, key))}).drop("tweet_text")


def evidence(members: DataFrame, posts: DataFrame, by: str, key: str = "key", n: int = 5) -> DataFrame:
    """members(key, tweet_id), posts(tweet_id, author, text, like_count, created_at, and what to order by) -> (key, evidence, total).

    The n first posts by falling `by`, ties by id, with texts cut to 200; total counts all rows of members.
    """
    rows = members.join(posts, "tweet_id", "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(by), "tweet_id"))
    first = rows.where(F.col("author").isNotNull()).withColumn("place", place).where(F.col("place") <= n)
    item = F.struct("place", "tweet_id", "author", F.substring("text", 1, 200).alias("text"), "like_count", "created_at")
    own = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("place")).alias("evidence"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total")).join(own, key, "left")


def with_trends(top: DataFrame, trends: DataFrame, growth: DataFrame | None = None) -> DataFrame:
    """Rows with topic_type and topic_key -> with trend_label, today_value, avg_7d (and prediction, confidence) where known."""
    out = top.join(trends.select(*KEYS, "trend_label", "today_value", F.bround("avg_7d", 2).alias("avg_7d")), KEYS, "left").fillna({"today_value": 0, "avg_7d": 0.0})
    return out if growth is None else out.join(growth.select(*KEYS, "prediction", "confidence"), KEYS, "left")


def first_names(entities: DataFrame, kind: str, n: int = 5, key: str = "cluster_id") -> DataFrame:
    """entities(key, kind, name) -> (key, <kind>): the first n names of a kind in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("name"))
    own = entities.where(F.col("kind") == kind).withColumn("p", place).where(F.col("p") <= n)
    return own.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias(kind))


def with_names(rows: DataFrame, entities: DataFrame, kinds: tuple[str, ...], n: int = 5) -> DataFrame:
    """rows(cluster_id, ...) with a list column for each kind, empty where there is none."""
    wanted = entities.join(rows.select("cluster_id"), "cluster_id", "left_semi")
    for kind in kinds:
        rows = rows.join(first_names(wanted, kind, n), "cluster_id", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<string>")))
    return rows


def document(rows: DataFrame, name: str, order: str = "rank", **fields: Column) -> DataFrame:
    """One row: the fields and all rows (a Top-n, so few) as a list of structs in order, for write_report()."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.transform(items, lambda x: x["row"]).alias(name)).select(*(c.alias(k) for k, c in fields.items()), name)


def readable(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows under the names that readers see, {shown: column}."""
    return rows.select(*(F.col(c).alias(shown) for shown, c in names.items()))


#: What the readable reports call their columns.
TOPIC_NAMES_SHOWN = {"排名": "rank", "话题": "title", "描述": "description", "热度分数": "hot_score", "推文数": "tweet_cnt", "参与作者数": "unique_author_cnt", "总点赞数": "sum_like_cnt", "总转发数": "sum_repost_cnt", "趋势": "trend"}
EVENT_NAMES_SHOWN = {"排名": "rank", "事件": "title", "一句话描述": "one_liner", "事件分数": "event_score", "参与作者数": "author_cnt", "推文数": "tweet_cnt", "总互动量": "engagement", "传播强度": "propagation", "簇内一致性": "coherence", "为何热门": "why_trending"}
COMMUNITY_NAMES_SHOWN = {"排名": "rank", "议题": "title", "一句话描述": "one_liner", "议题分数": "community_score", "参与作者数": "author_cnt", "推文数": "tweet_cnt", "总互动量": "engagement", "传播强度": "propagation", "为何热门": "why_trending", "中心实体": "center_entity"}
TRACED_NAMES_SHOWN = {"排名": "rank", "事件标题": "title", "为何热门": "why_trending", "支持推文数": "supporting", "决策轨迹": "trace"}

#: How clusters came about.
ANCHOR_TRACE = "传播锚点聚类"
TOPIC_TRACE = "增量式主题形成"
MERGE_TRACE = "增量式事件合并（结构化权重层级）"


def rule_trace(authors: Column, coherence: Column) -> Column:
    c = F.format_string("%.2f", coherence)
    return F.array(F.lit("F2: 有实体和动作词"), say("F3: 时间接近 + 实体交集 + 多KOL (coherence: ", c, ")"), say("G2: author_cnt >= 2 (", authors, "), coherence >= 0.6 (", c, ")"))


def semantic_cards(top: DataFrame, members: DataFrame) -> DataFrame:
    """top(rank, semantic_id, cluster_size, unique_author_cnt, tweet_cnt, ...) with the members' keywords, title and description.

    members(semantic_id, topic_type, topic_key): hashtags, then domains and cashtags as they come in order of type and key.
    """
    m = members.join(top.select("semantic_id"), "semantic_id", "left_semi").where(F.col("topic_type").isin("hashtag", "domain", "cashtag"))
    shown = F.when(F.col("topic_type") == "hashtag", say("#", F.col("topic_key"))).when(F.col("topic_type") == "cashtag", ticker(F.col("topic_key"))).otherwise(F.col("topic_key"))
    place = F.row_number().over(Window.partitionBy("semantic_id").orderBy(*KEYS))
    own = F.row_number().over(Window.partitionBy("semantic_id", "topic_type").orderBy("topic_key"))
    m = m.select("semantic_id", *KEYS, shown.alias("shown"), place.alias("p"), own.alias("q")).where("p <= 3 or q <= 3")
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("topic_type") == kind) & (F.col("q") <= 3), F.struct("q", "shown")))), lambda x: x["shown"]), ", ")
    lists = m.groupBy("semantic_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") <= 3, F.struct("p", "shown")))), lambda x: x["shown"]), ", ").alias("first"), *(of(k).alias(k) for k in ("hashtag", "domain", "cashtag"))
    )
    t = top.join(lists, "semantic_id", "left")
    n = F.col("symbols")
    title = F.when(n > 3, say(F.col("first"), " 等 ", n, " 个关键词")).when(n > 0, F.col("first")).otherwise(say("热点话题 #", F.col("rank"), "（", F.col("cluster_size"), " 个相关主题聚合）"))
    part = lambda label, c: F.when(F.col(c) != "", say(f"{label}: ", F.col(c)))
    info = F.concat_ws("；", part("标签", "hashtag"), part("域名", "domain"), part("股票", "cashtag"))
    head = say(F.when(F.col("cluster_size") > 1, say("聚合了 ", F.col("cluster_size"), " 个相关主题，")), F.col("unique_author_cnt"), " 位 KOL 参与讨论，共 ", F.col("tweet_cnt"), " 条推文")
    return t.withColumns({"title": title, "description": say(head, F.when(info != "", say("。", info)))}).drop("first", "hashtag", "domain", "cashtag")


def community_title(rows: DataFrame, variant: str) -> Column:
    """The title of rows(rank, center_entity, companies, tickers[, products, technologies, keywords, center_text]).

    By the centre if it is of a kind that can be shown, else the first company, product, technology or ticker, else (beyond
    the first variant) keywords, or the first keyword of the centre post's first sentence.  The final variant adds words of
    the centre post, or a keyword, to a title of one name, and ends with the start of the centre post.
    """
    from .entities import final_keywords, improved_keywords
    from .semantic import context

    kind, name = F.substring_index("center_entity", ":", 1), F.expr("substring(center_entity, instr(center_entity, ':') + 1)")
    plain = ("companies",) if variant == "first" else ("companies", "products", "technologies")
    center = F.when(kind.isin(*plain), name).when(kind == "tickers", ticker(name)).when(kind == "hashtags", say("#", name))
    main = F.coalesce(center, *(F.get(k, F.lit(0)) for k in plain), ticker(F.get("tickers", F.lit(0))))
    none = say("热点议题 ", F.col("rank"))
    if variant == "first":
        return F.coalesce(main, none)
    words = F.filter(F.slice("keywords", 1, 2), lambda w: F.length(w) >= 3)
    text = F.col("center_text")
    sentence = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", 1)).otherwise(F.substring(text, 1, 100))
    found = F.get((improved_keywords if variant == "improved" else final_keywords)(sentence), F.lit(0))
    two = F.when(main.isNull() & (F.size(words) == 2), F.array_join(words, " / "))
    main = F.coalesce(main, F.get(words, F.lit(0)), found)
    if variant == "improved":
        return F.coalesce(two, main, none)
    related = F.get(F.filter(F.slice("keywords", 1, 3), lambda w: F.lower(w) != F.lower(main)), F.lit(0))
    around = context(text, main)
    start = F.trim(F.substring(text, 1, 50))
    longer = F.when(around.isNotNull(), say(main, ": ", around)).when(related.isNotNull(), say(main, " / ", related)).otherwise(main)
    return F.coalesce(two, F.when(main.isNotNull(), longer), F.when(F.length(start) >= 10, start), none)
