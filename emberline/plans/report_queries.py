"""Registered queries of the reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import semantic as S
from ..operators import series as Z
from .community_queries import _GREEDY, _SCORED, ROLLED, _by_similarity, graph_sql
from .community_runs import CommunityRun, SemanticRun
from .event_queries import _EVENT_SCORED, CENTRIC_SCORED, GATED_SCORED, RULE_SCORED, _clean_news, _named, _rule, news, news_query
from .event_runs import CentricRun, GatedRun, SeededRun
from .queries import query, run

_TAG, _CASH = "'#' || topic_key", "CASE WHEN starts_with(topic_key, '$') THEN topic_key ELSE '$' || topic_key END"
_A, _N = "unique_author_cnt", "tweet_cnt"


def _counted(name: str, label: str, both: str, several: str, many: str, none: str) -> str:
    return f"""CASE WHEN {_A} >= 2 AND {_N} >= 2 THEN '{label} ' || {name} || '：' || {_A} || '{both}，共 ' || {_N} || ' 条推文' WHEN {_A} >= 2 THEN '{label} ' || {name} || '：' || {_A} || '{several}'
   WHEN {_N} >= 2 THEN '{label} ' || {name} || '：共 ' || {_N} || '{many}' ELSE '{label} ' || {name} || '{none}' END"""


_CARDS = f""", tp AS (SELECT t.*, d.author_username AS poster, d.text FROM top t LEFT JOIN day d ON topic_type = 'center_tweet' AND d.tweet_id = topic_key),
  ex0 AS (SELECT t.rank, c.tweet_id, d.author_username AS who, d.likes FROM top t JOIN cand c USING (topic_type, topic_key) LEFT JOIN day d USING (tweet_id)),
  ex AS (SELECT rank, count(*) AS total, string_agg(tweet_id, ',' ORDER BY likes DESC, tweet_id) FILTER (p <= 5 AND who IS NOT NULL) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY (who IS NULL), likes DESC, tweet_id) AS p FROM ex0) GROUP BY 1),
  cards AS (SELECT tp.*, total, examples, CASE topic_type WHEN 'hashtag' THEN {_TAG} WHEN 'cashtag' THEN {_CASH} WHEN 'domain' THEN topic_key ELSE '热门推文' || CASE WHEN poster IS NOT NULL THEN ' (@' || poster || ')' ELSE '' END
     || CASE WHEN {_A} >= 2 THEN ' - ' || {_A} || ' 位 KOL 转发/引用' ELSE '' END END AS title,
   CASE topic_type WHEN 'hashtag' THEN {_counted(_TAG, '话题标签', ' 位 KOL 参与讨论', ' 位 KOL 参与讨论', ' 条推文', ' 在 KOL 中引发热议')} WHEN 'cashtag' THEN {_counted(_CASH, '股票代码', ' 位 KOL 参与讨论', ' 位 KOL 关注', ' 条推文', ' 受到 KOL 关注')}
   WHEN 'domain' THEN {_counted('topic_key', '域名', ' 位 KOL 分享', ' 位 KOL 分享', ' 条推文被分享', ' 在 KOL 推文中被频繁分享')}
   ELSE CASE WHEN poster IS NOT NULL THEN CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END || CASE WHEN {_A} >= 2 THEN '（被 ' || {_A} || ' 位 KOL 转发/引用）' ELSE '' END
    ELSE '推文 ID: ' || left(topic_key, 20) || CASE WHEN {_A} >= 2 THEN '... 被 ' || {_A} || ' 位 KOL 转发/引用' ELSE '... 被大量转发/引用' END END END AS description,
   CASE WHEN poster IS NOT NULL THEN 'https://x.com/' || poster || '/status/' || topic_key END AS tweet_url FROM tp JOIN ex USING (rank)),
  rep AS (SELECT c.*, trend_label, coalesce(today_value, 0)::BIGINT AS today_value, coalesce(round_even(avg_7d, 2), 0)::DOUBLE AS avg_7d, prediction, confidence, round_even(hot_score, 2) AS score
   FROM cards c LEFT JOIN (SELECT * FROM trends WHERE trend_label IS NOT NULL) t USING (topic_type, topic_key) LEFT JOIN growth g USING (topic_type, topic_key))"""


def _ids(column: str = "evidence", field: str = "tweet_id"):
    return F.array_join(F.transform(column, lambda x: x[field]), ",")


@query(_CARDS + " SELECT rank::INTEGER AS rank, title, description, tweet_url, total, examples FROM cards")
def report_cards(spark, d):
    return run(spark, d).cards().select("rank", "title", "description", "tweet_url", "total", _ids().alias("examples"))


@query(_CARDS + " SELECT rank::INTEGER AS rank, title, score AS hot_score, tweet_cnt, sum_like_cnt, sum_reply_cnt, ref_cnt, trend_label, today_value, avg_7d FROM rep")
def report_daily(spark, d):
    return run(spark, d).full_report().select("rank", "title", "hot_score", "tweet_cnt", "sum_like_cnt", "sum_reply_cnt", "ref_cnt", "trend_label", "today_value", "avg_7d")


@query(_CARDS + " SELECT rank::INTEGER AS rank, title, score AS hot_score, trend_label, prediction, confidence FROM rep")
def report_v1(spark, d):
    return run(spark, d).full_report(True).select("rank", "title", "hot_score", "trend_label", "prediction", "confidence")


@query("SELECT prediction AS label, count(*) AS n FROM growth GROUP BY 1")
def prediction_summary(spark, d):
    return Z.label_counts(run(spark, d).growth, "prediction")


_SHOWN = {"排名": "rank", "话题": "title", "描述": "description", "推文数": "tweet_cnt", "参与作者数": "unique_author_cnt", "总点赞数": "sum_like_cnt", "总转发数": "sum_repost_cnt", "趋势": "coalesce(trend_label, '无趋势数据')"}


@query(_CARDS + f" SELECT rank::INTEGER AS rank, json_object({', '.join(f'{chr(39)}{k}{chr(39)}, {c}' for k, c in _SHOWN.items())})::VARCHAR AS document FROM rep")
def report_readable(spark, d):
    rows = run(spark, d).full_report().withColumn("trend", F.coalesce("trend_label", F.lit("无趋势数据")))
    shown = R.readable(rows, {k: c for k, c in R.TOPIC_NAMES_SHOWN.items() if c != "hot_score"})
    return shown.select(F.col("排名").alias("rank"), F.to_json(F.struct("*")).alias("document"))


@query(
    _GREEDY
    + ROLLED
    + f""", mk AS (SELECT semantic_id, topic_type, CASE topic_type WHEN 'hashtag' THEN {_TAG} WHEN 'cashtag' THEN {_CASH} ELSE topic_key END AS shown, row_number() OVER (PARTITION BY semantic_id ORDER BY topic_type, topic_key) AS p,
    row_number() OVER (PARTITION BY semantic_id, topic_type ORDER BY topic_key) AS q FROM mem WHERE topic_type IN ('hashtag', 'domain', 'cashtag')),
  ml AS (SELECT semantic_id, string_agg(shown, ', ' ORDER BY p) FILTER (p <= 3) AS f, string_agg(shown, ', ' ORDER BY q) FILTER (q <= 3 AND topic_type = 'hashtag') AS h, string_agg(shown, ', ' ORDER BY q) FILTER (q <= 3 AND topic_type = 'domain') AS o,
   string_agg(shown, ', ' ORDER BY q) FILTER (q <= 3 AND topic_type = 'cashtag') AS c FROM mk GROUP BY 1)
  SELECT rank::INTEGER AS rank, semantic_id, CASE WHEN symbols > 3 THEN f || ' 等 ' || symbols || ' 个关键词' ELSE f END AS title,
   CASE WHEN cluster_size > 1 THEN '聚合了 ' || cluster_size || ' 个相关主题，' ELSE '' END || unique_author_cnt || ' 位 KOL 参与讨论，共 ' || tweet_cnt || ' 条推文。' || concat_ws('；', '标签: ' || h, '域名: ' || o, '股票: ' || c) AS description FROM st JOIN ml USING (semantic_id)"""
)
def report_semantic(spark, d):
    return SemanticRun(run(spark, d)).cards().select("rank", "semantic_id", "title", "description")


# ---------------------------------------------------------------- events

_TOP5 = "ORDER BY event_score DESC, cluster_id LIMIT 5"
_WHY = "concat_ws('；', author_cnt || ' 位 KOL', CASE WHEN propagation > 0 THEN '传播链 ' || propagation || ' 次' END, CASE WHEN engagement > 0 THEN '总互动量 ' || floor(engagement)::BIGINT END, '共 ' || tweet_cnt || ' 条推文'{more})"


@news_query(RULE_SCORED + f" SELECT cluster_id, {_WHY.format(more='')} AS why FROM sc")
def why_trending(spark, d):
    c = lambda n: F.col(n)
    return _rule(spark, d).scored.select("cluster_id", S.why_counted(c("author_cnt"), c("tweet_cnt"), c("propagation"), c("engagement")).alias("why"))


_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(s, 'https?://\S+', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@news_query(
    rf""", st AS (SELECT id, t[i] AS s, i FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, regexp_split_to_array(text, '[.!?]\s+') AS t FROM everyone))),
  wd AS (SELECT id, i, string_split({_BARE}, ' ') AS w FROM st WHERE length(s) > 20 AND contains(lower(s), 'gemini')),
  fo AS (SELECT id, i, w, list_position(list_transform(w, lambda x: lower(x)), 'gemini') AS p FROM wd WHERE len(w) >= 3),
  px AS (SELECT id, i, array_to_string(w[greatest(p - 2, 1):p + 2], ' ') AS x FROM fo WHERE p > 0)
  SELECT id AS tweet_id, left(first(x ORDER BY i), 50) AS context FROM px WHERE length(x) > 6 GROUP BY 1"""
)
def entity_context(spark, d):
    return _clean_news(spark, d).select("tweet_id", S.context(F.col("clean_text"), F.lit("Gemini")).alias("context")).where("context is not null")


@news_query(
    RULE_SCORED
    + f""", top5 AS (SELECT *, row_number() OVER (ORDER BY event_score DESC, cluster_id) AS rank FROM sc {_TOP5}),
  nm AS (SELECT cluster_id, min(list_min(products)) AS p, min(list_min(companies)) AS c, string_agg(id, ',' ORDER BY id) AS ids FROM mem JOIN kept USING (id) JOIN top5 USING (cluster_id) GROUP BY 1)
  SELECT rank::INTEGER AS rank, cluster_id, coalesce(p, c) AS title, {_WHY.format(more='')} AS why_trending, array_to_string(string_split(ids, ',')[:5], ',') AS supporting FROM top5 JOIN nm USING (cluster_id) WHERE coalesce(p, c) IS NOT NULL"""
)
def report_rule(spark, d):
    return _rule(spark, d).report().where((F.size("companies") > 0) | (F.size("products") > 0)).select("rank", "cluster_id", "title", "why_trending", _ids("supporting_tweets").alias("supporting"))


def _traced_sql(chain: str, more: str, merge: str) -> str:
    return (
        chain
        + f""", top5 AS (SELECT *, row_number() OVER (ORDER BY event_score DESC, cluster_id) AS rank FROM sc {_TOP5}),
  nm AS (SELECT cluster_id, min(list_min(entity)) AS e, string_agg(id, ',' ORDER BY id) AS ids, max(action) FILTER (cluster_id = 'anchor_' || id OR cluster_id = 'topic_' || id) AS act FROM mem JOIN kept USING (id) JOIN top5 USING (cluster_id) GROUP BY 1)
  SELECT rank::INTEGER AS rank, cluster_id, CASE WHEN e IS NULL THEN '热点事件 ' || rank ELSE concat_ws(' ', e, act) END AS title, {_WHY.format(more=more)} AS why_trending, array_to_string(string_split(ids, ',')[:5], ',') AS supporting,
   CASE cluster_type WHEN 'anchor' THEN '{R.ANCHOR_TRACE}' ELSE '{merge}' END AS trace FROM top5 JOIN nm USING (cluster_id)"""
    )


@news_query(_traced_sql(CENTRIC_SCORED, "", R.TOPIC_TRACE))
def report_ec(spark, d):
    return CentricRun(news(spark, d)).report().select("rank", "cluster_id", "title", "why_trending", _ids("supporting_tweets", "id").alias("supporting"), "trace")


@news_query(_traced_sql(GATED_SCORED, ", CASE WHEN cluster_weight >= 10 THEN '传播锚点事件' END", R.MERGE_TRACE))
def report_new(spark, d):
    return GatedRun(news(spark, d)).report().select("rank", "cluster_id", "title", "why_trending", _ids("supporting_tweets", "id").alias("supporting"), "trace")


_SPREAD = """coalesce(nullif(concat_ws('；', CASE WHEN author_cnt >= 3 THEN author_cnt || ' 位 KOL 参与讨论' END, CASE WHEN propagation > 0 THEN '跨作者传播 ' || propagation || ' 次' END,
   CASE WHEN engagement > 100 THEN '总互动量 ' || {e} END, CASE WHEN tweet_cnt >= 5 THEN '共 ' || tweet_cnt || ' 条推文' END), ''), '引发广泛关注')"""


@news_query(
    _EVENT_SCORED
    + f""", top5 AS (SELECT *, row_number() OVER (ORDER BY event_score DESC, cluster_id) AS rank FROM es {_TOP5}),
  lk AS (SELECT cluster_id, first(text ORDER BY likes DESC, id) AS t, string_agg(id, ',' ORDER BY likes + 2 * reposts DESC, id) AS ids FROM ev JOIN en USING (id) GROUP BY 1)
  SELECT rank::INTEGER AS rank, cluster_id, CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS one_liner, {_SPREAD.format(e='engagement')} AS why_trending, array_to_string(string_split(ids, ',')[:5], ',') AS evidence,
   round_even(coherence, 3) AS coherence, round_even(event_score, 2) AS event_score FROM top5 JOIN lk USING (cluster_id)"""
)
def report_events(spark, d):
    return _named(spark, d).report().select("rank", "cluster_id", "one_liner", "why_trending", _ids().alias("evidence"), "coherence", "event_score")


@news_query()
def report_events_full(spark, d):
    """The seeded variant's report over its own linkage, titles and all."""
    return SeededRun(news(spark, d), distance=0.15).report().drop("evidence")


# ---------------------------------------------------------------- communities


def _community_sql(variant: str) -> str:
    return (
        graph_sql(variant)
        + _SCORED
        + f""", top5 AS (SELECT *, row_number() OVER (ORDER BY community_score DESC, community) AS rank FROM cs ORDER BY community_score DESC, community LIMIT 5),
  lk AS (SELECT community, string_agg(id, ',' ORDER BY likes + 2 * reposts DESC, id) AS ids FROM tm JOIN en USING (id) GROUP BY 1)
  SELECT rank::INTEGER AS rank, community, {_SPREAD.format(e='floor(engagement)::BIGINT')} AS why_trending, array_to_string(string_split(ids, ',')[:5], ',') AS evidence, round_even(community_score, 2) AS community_score FROM top5 JOIN lk USING (community)"""
    )


def _community_report(spark, d, variant: str):
    return _by_similarity(spark, d, variant).report().select("rank", "community", "why_trending", _ids().alias("evidence"), "community_score")


@news_query(_community_sql("a"))
def report_communities(spark, d):
    return _community_report(spark, d, "first")


@news_query(_community_sql("b"))
def report_communities_improved(spark, d):
    return _community_report(spark, d, "improved")


@news_query(_community_sql("c"))
def report_communities_final(spark, d):
    return _community_report(spark, d, "final")


@news_query()
def report_communities_full(spark, d):
    """The final variant's report over communities of the whole graph, titles and all."""
    return CommunityRun(news(spark, d), "final", similarity=0.9).report().drop("evidence")
