"""Registered queries over the driver's tables, and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assets
from ..functions import scalars as X
from ..operators import edges as E
from ..operators import normalize as N
from ..operators import pool as P
from ..operators import series as S
from ..operators import topics as T
from ..sources import posts as src
from .daily_topics import DailyTopics

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_KW = words_sql(assets.TOPIC_KEYWORDS)
_HAS = "len(list_filter({kw}, lambda w: contains(lower(text), w))) > 0"

#: Common table expressions of the base data model; a query uses those it needs.
BASE = f"""
WITH RECURSIVE raw AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT), 0) AS k FROM events),
everyone AS (SELECT event_id::VARCHAR AS tweet_id, '@U' || user_id AS author_username, 'u' || user_id AS author, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  floor(epoch(ts))::BIGINT AS created_ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_date,
  event_type || '  by  ' || CASE WHEN k % 3 = 0 THEN 'tech' ELSE 'none' END || ' ' || k || ' https://www.site' || (k % 20) || '.example.com/p/' || k AS text,
  event_type AS tag, CASE WHEN k % 10 = 0 THEN ['$T' || k] ELSE [] END AS cashtags, 'site' || (k % 20) || '.example.com' AS domain, ['u' || (k % 7)] AS mentions,
  floor(coalesce(value, 0))::BIGINT AS likes, floor(coalesce(value, 0) / 10)::BIGINT AS reposts, event_id % 7 AS replies, event_id % 3 AS quotes,
  CASE WHEN k > 0 AND event_type IN ('click', 'purchase') THEN (event_id - k)::VARCHAR END AS target,
  CASE event_type WHEN 'click' THEN 'reposted' WHEN 'purchase' THEN 'quoted' END AS edge_type, k FROM raw),
roster AS (SELECT 'u' || c_custkey AS username, greatest(floor(coalesce(c_acctbal, 0)), 0)::BIGINT AS followers FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')),
posts AS (SELECT e.* FROM everyone e WHERE author IN (SELECT username FROM roster)),
day AS (SELECT * FROM posts WHERE created_ts > (SELECT max(created_ts) FROM posts) - 86400),
weeks AS (SELECT * FROM posts WHERE created_ts > (SELECT max(created_ts) FROM posts) - 1209600),
edges AS (SELECT tweet_id AS source, author, target, edge_type, created_at, local_date FROM day WHERE target IS NOT NULL),
wedges AS (SELECT tweet_id AS source, author, target, edge_type, created_at, local_date FROM weeks WHERE target IS NOT NULL),
rel AS (SELECT *, {_HAS.format(kw=_KW)} AS hit FROM day),
cand AS (
  SELECT 'hashtag' AS topic_type, tag AS topic_key, tweet_id, author, created_at, local_date FROM rel
    WHERE hit OR len(list_filter({_KW}, lambda w: contains(w, tag) OR contains(tag, w))) > 0
  UNION ALL SELECT 'cashtag', unnest(cashtags), tweet_id, author, created_at, local_date FROM rel
  UNION ALL SELECT 'domain', domain, tweet_id, author, created_at, local_date FROM rel WHERE hit
  UNION ALL SELECT 'center_tweet', t.target, t.target, coalesce(r.author, ''), coalesce(r.created_at, ''), coalesce(r.local_date, '')
    FROM (SELECT DISTINCT target FROM edges) t LEFT JOIN rel r ON r.tweet_id = t.target
    WHERE r.tweet_id IS NULL OR hit OR len(cashtags) > 0 OR len(list_filter({_KW}, lambda w: contains(w, tag) OR contains(tag, w))) > 0),
refs AS (SELECT target, count(*) AS ref_cnt, count(DISTINCT author) AS ref_authors FROM edges GROUP BY target),
sums AS (SELECT topic_type, topic_key, sum(coalesce(likes, 0)) AS l, sum(coalesce(reposts, 0)) AS r, sum(coalesce(replies, 0)) AS y, sum(coalesce(quotes, 0)) AS q
  FROM cand c LEFT JOIN day d USING (tweet_id) GROUP BY 1, 2),
counts AS (SELECT topic_type, topic_key, count(*) AS tweet_cnt, sum(coalesce(ref_cnt, 0)) AS ref_cnt
  FROM (SELECT DISTINCT topic_type, topic_key, tweet_id FROM cand) LEFT JOIN refs ON target = tweet_id GROUP BY 1, 2),
voices AS (SELECT topic_type, topic_key, count(DISTINCT nullif(author, '')) AS authors FROM cand GROUP BY 1, 2),
topics AS (SELECT topic_type, topic_key, '24h' AS "window", tweet_cnt::BIGINT AS tweet_cnt,
  (CASE WHEN topic_type = 'center_tweet' THEN coalesce(ref_authors, 0) ELSE authors END)::BIGINT AS unique_author_cnt,
  l::BIGINT AS sum_like_cnt, r::BIGINT AS sum_repost_cnt, y::BIGINT AS sum_reply_cnt, q::BIGINT AS sum_quote_cnt, c.ref_cnt::BIGINT AS ref_cnt
  FROM counts c JOIN sums USING (topic_type, topic_key) JOIN voices USING (topic_type, topic_key) LEFT JOIN refs ON target = topic_key),
foll AS (SELECT topic_type, topic_key, avg(followers) AS f FROM cand c JOIN day d USING (tweet_id) JOIN roster ON d.author = username GROUP BY 1, 2),
parts AS (SELECT t.*, coalesce(f, 0) AS avg_followers, ln(1 + ref_cnt) AS lr, ln(1 + sum_repost_cnt + sum_quote_cnt) AS ls,
  ln(1 + CASE WHEN tweet_cnt > 0 THEN sum_like_cnt / tweet_cnt ELSE 0 END) AS ll, ln(1 + coalesce(f, 0)) AS lf FROM topics t LEFT JOIN foll USING (topic_type, topic_key)),
scored AS (SELECT *, CASE WHEN topic_type = 'center_tweet' THEN (CASE WHEN unique_author_cnt < 2 THEN 0.3 ELSE 0.6 END) * (0.5 * lr + 0.5 * ls + 0.3 * ll + 0.2 * lf) + 1.5 * unique_author_cnt
  ELSE (CASE WHEN tweet_cnt > 1 THEN 1 + 0.2 * ln(tweet_cnt) ELSE 1 END) * (lr + ls + 0.5 * ll)
   + (CASE WHEN unique_author_cnt > 1 THEN 1 + 0.3 * ln(unique_author_cnt) ELSE 1 END) * (3.0 * unique_author_cnt + 0.3 * lf) + 0.5 * ln(1 + tweet_cnt) END AS hot_score FROM parts),
ranked AS (SELECT *, CASE WHEN topic_type = 'center_tweet' THEN CASE WHEN unique_author_cnt >= 2 THEN 0 ELSE 2 END
  WHEN unique_author_cnt >= 2 OR tweet_cnt >= 2 THEN 0 ELSE 1 END AS tier FROM scored),
top AS (SELECT *, row_number() OVER (ORDER BY tier, hot_score DESC, topic_type, topic_key) AS rank FROM ranked QUALIFY rank <= 5),
dayrefs AS (SELECT target, local_date, count(*) AS refs FROM wedges GROUP BY 1, 2),
occ AS (SELECT 'hashtag' AS topic_type, tag AS topic_key, * FROM weeks UNION ALL SELECT 'cashtag', unnest(cashtags), * FROM weeks UNION ALL SELECT 'domain', domain, * FROM weeks),
daily AS (SELECT topic_type, topic_key, o.local_date, count(*) AS tweet_cnt, count(DISTINCT author) AS unique_author_cnt, sum(reposts)::BIGINT AS sum_repost_cnt, sum(coalesce(refs, 0))::BIGINT AS ref_cnt
  FROM occ o LEFT JOIN dayrefs d ON d.target = tweet_id AND d.local_date = o.local_date GROUP BY 1, 2, 3
  UNION ALL SELECT 'center_tweet', target, local_date, 0, 0, 0, refs FROM dayrefs),
axis AS (SELECT local_date, row_number() OVER (ORDER BY local_date DESC) AS back FROM (SELECT DISTINCT local_date FROM daily)),
nd AS (SELECT least(count(*), 8) AS n8, least(count(*), 4) AS n4 FROM axis),
cell AS (SELECT topic_type, topic_key, back, unique_author_cnt AS a, tweet_cnt AS t FROM daily JOIN axis USING (local_date)),
wide AS (SELECT topic_type, topic_key, count(c.back) AS n_days, coalesce(sum(a) FILTER (back = 1), 0) AS a, coalesce(sum(t) FILTER (back = 1), 0) AS t,
  coalesce(sum(a) FILTER (back = 2), 0) AS y, coalesce(sum(t) FILTER (back = 2), 0) AS ty,
  coalesce(sum(a) FILTER (back BETWEEN 2 AND 4), 0) AS a3, coalesce(sum(t) FILTER (back BETWEEN 2 AND 4), 0) AS t3,
  coalesce(sum(a) FILTER (back BETWEEN 2 AND 8), 0) AS a7, coalesce(sum(a * a) FILTER (back BETWEEN 2 AND 8), 0) AS s7,
  coalesce(max(a) FILTER (back BETWEEN 2 AND 8), 0) AS ma, coalesce(max(t) FILTER (back BETWEEN 2 AND 8), 0) AS mt
  FROM topics LEFT JOIN cell c USING (topic_type, topic_key) GROUP BY 1, 2),
means AS (SELECT *, a7 / (n8 - 1) AS m, a3 / (n4 - 1) AS m3, t3 / (n4 - 1) AS mt3 FROM wide, nd),
trends AS (SELECT topic_type, topic_key, CASE WHEN NOT (a >= 1 OR t >= 2) THEN NULL WHEN a > 0 AND m = 0 THEN 'Emerging' WHEN a >= 1.5 * m AND (a >= 2 OR t >= 2) THEN 'Rising'
  WHEN a >= 3 OR t >= 5 THEN CASE WHEN a >= ma OR t >= mt THEN 'Peak' END WHEN a <= 0.5 * m AND m > 0 THEN 'Fading'
  WHEN a >= 0.8 * m AND a <= 1.2 * m AND (m >= 2 OR t >= 3) THEN 'Persistent' END AS trend_label, a::BIGINT AS today_value, m AS avg_7d FROM means WHERE n8 >= 2),
g AS (SELECT *, a - y AS g1, t - ty AS h1, CASE WHEN m3 > 0 THEN a - m3 ELSE 0 END AS g3, CASE WHEN mt3 > 0 THEN t - mt3 ELSE 0 END AS h3,
  CASE WHEN m3 > 0 THEN (a - y) - (y - m3) ELSE 0 END AS acc FROM means WHERE n_days > 0 AND n4 >= 3),
growth AS (SELECT *, CASE WHEN a = 0 AND t = 0 THEN 'fade' WHEN g1 > 2 AND h1 > 2 THEN 'grow' WHEN g1 > 0 AND acc > 0 THEN 'grow' WHEN g1 < -1 OR h1 < -2 THEN 'fade'
  WHEN abs(g1) <= 1 AND abs(h1) <= 2 THEN 'stabilize' WHEN g3 > 0 AND a >= 2 THEN 'grow' WHEN g3 < 0 THEN 'fade' ELSE 'stabilize' END AS prediction,
  (CASE WHEN a = 0 AND t = 0 THEN 0.8 WHEN g1 > 2 AND h1 > 2 THEN 0.75 WHEN g1 > 0 AND acc > 0 THEN 0.65 WHEN g1 < -1 OR h1 < -2 THEN 0.7
  WHEN abs(g1) <= 1 AND abs(h1) <= 2 THEN 0.6 WHEN g3 > 0 AND a >= 2 THEN 0.55 WHEN g3 < 0 THEN 0.6 ELSE 0.5 END)::DOUBLE AS confidence FROM g)
"""


def anchors_sql(kept: str = "kept", edges: str = "ed", anchor: str = "refs >= 1") -> str:
    """CTEs up to anchored(cluster_id, id): anchors in order of id, one a step."""
    return f""", an AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM {kept} WHERE {anchor}),
  ar AS MATERIALIZED (SELECT DISTINCT source, target FROM {edges} WHERE source <> target AND source IN (SELECT id FROM {kept}) AND target IN (SELECT id FROM an)),
  ae AS MATERIALIZED (SELECT i, an.id, coalesce(list(target) FILTER (target < an.id), []) AS earlier FROM an LEFT JOIN ar ON source = an.id GROUP BY i, an.id),
  af(i, lead) AS (SELECT 0::BIGINT, list(id) FILTER (false) FROM an UNION ALL SELECT f.i + 1, CASE WHEN list_has_any(coalesce(f.lead, []), t.earlier) THEN f.lead ELSE list_append(coalesce(f.lead, []), t.id) END FROM af f JOIN ae t ON t.i = f.i + 1),
  al AS MATERIALIZED (SELECT unnest(lead) AS id FROM af WHERE i = (SELECT count(*) FROM an)),
  anchored AS MATERIALIZED (SELECT id AS cluster_id, id FROM al UNION ALL SELECT min(target), source FROM ar WHERE target IN (SELECT id FROM al) AND source NOT IN (SELECT id FROM al) GROUP BY source)"""


def leaders_sql(items: str, pairs: str, by_weight: bool = False) -> str:
    """CTEs up to grown(id, leader, weight) from items(id) and pairs(a, b, weight), one item a step."""
    best = "w.weight DESC, w.a" if by_weight else "w.a"
    return f""", it AS MATERIALIZED (SELECT i, id, coalesce(list(w.a) FILTER (w.a IS NOT NULL), []) AS earlier FROM (SELECT id, row_number() OVER (ORDER BY id) AS i FROM {items}) s LEFT JOIN {pairs} w ON w.b = s.id GROUP BY i, id),
  lf(i, lead) AS (SELECT 0::BIGINT, list(id) FILTER (false) FROM it UNION ALL SELECT f.i + 1, CASE WHEN list_has_any(coalesce(f.lead, []), t.earlier) THEN f.lead ELSE list_append(coalesce(f.lead, []), t.id) END FROM lf f JOIN it t ON t.i = f.i + 1),
  ld AS MATERIALIZED (SELECT unnest(lead) AS id FROM lf WHERE i = (SELECT count(*) FROM it)),
  grown AS MATERIALIZED (SELECT id, id AS leader, 0.0::DOUBLE AS weight FROM ld UNION ALL SELECT id, leader, weight FROM (SELECT w.b AS id, w.a AS leader, w.weight, row_number() OVER (PARTITION BY w.b ORDER BY {best}) AS n FROM {pairs} w WHERE w.a IN (SELECT id FROM ld) AND w.b NOT IN (SELECT id FROM ld)) WHERE n = 1)"""


_STOP = ", ".join(repr(s) for s in assets.KEYWORD_STOPS)
#: BASE with the day's content keywords among the candidates.
KEYWORD_BASE = BASE.replace(
    "),\nrefs AS (",
    rf"""
  UNION ALL SELECT 'content_keyword', word, min(tweet_id), '', '', '' FROM (
    SELECT tweet_id, word, row_number() OVER (PARTITION BY tweet_id ORDER BY count(*) DESC, min(pos)) AS place FROM (
      SELECT tweet_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (
        SELECT tweet_id, regexp_extract_all(lower(tag || ' by ' || CASE WHEN k % 3 = 0 THEN 'tech' ELSE 'none' END || ' ' || k || ' <URL>'), '[\p{{L}}\p{{N}}_]+') AS t FROM day))
    WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2) WHERE place <= 10 AND len(list_filter({_KW}, lambda w: contains(word, w))) > 0 GROUP BY word HAVING count(*) >= 2),
refs AS (""",
    1,
)


def query(sql: str | None = None, base: bool | str = True):
    """Register a query under its function's name, with the SQL that gives its rows, after BASE or another base."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (base if isinstance(base, str) else BASE if base else "") + sql
        return f

    return add


def clean(spark: SparkSession, d: str) -> DataFrame:
    return N.clean(src.raw_posts(spark, d), src.roster(spark, d))


def run(spark: SparkSession, d: str) -> DailyTopics:
    return DailyTopics(src.raw_posts(spark, d), src.roster(spark, d))


@query("SELECT rank::INTEGER AS rank, topic_type, topic_key, tier::INTEGER AS tier, tweet_cnt, unique_author_cnt, ref_cnt, round(hot_score, 6) AS hot_score FROM top")
def hot_topics_top5(spark, d):
    return run(spark, d).top.select("rank", "topic_type", "topic_key", "tier", "tweet_cnt", "unique_author_cnt", "ref_cnt", F.round("hot_score", 6).alias("hot_score"))


@query("SELECT 'u' || user_id || ' @b' AS a, 'u' || user_id || ' b' AS b, '@@u' || user_id || ' @b' AS c FROM events", base=False)
def norm_usernames(spark, d):
    name = F.concat(F.lit(" @@U"), "user_id", F.lit(" @B "))
    return src.table(spark, d, "events").select(X.norm_username(F.ltrim(name)).alias("a"), X.norm_username_all(name).alias("b"), X.norm_username(name).alias("c"))


@query(
    """SELECT tweet_id, created_ts, strftime(to_timestamp(created_ts + 28800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+08:00' AS created_at_local, local_date FROM everyone"""
)
def time_standardize(spark, d):
    return N.with_times(src.raw_posts(spark, d)).select("tweet_id", "created_ts", "created_at_local", "local_date")


@query("SELECT tweet_id, text AS raw_text, tag || ' by ' || CASE WHEN k % 3 = 0 THEN 'tech' ELSE 'none' END || ' ' || k || ' <URL>' AS clean_text FROM everyone")
def text_standardize(spark, d):
    return N.with_clean_text(src.raw_posts(spark, d)).select("tweet_id", "raw_text", "clean_text")


@query(
    r"""SELECT page_id, nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\.', ''), '') AS domain_a,
  lower(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '')) AS domain_b FROM pages""",
    base=False,
)
def url_domains(spark, d):
    return src.table(spark, d, "pages").select("page_id", X.url_domain(F.col("url")).alias("domain_a"), X.url_domain_or_path(F.col("url")).alias("domain_b"))


@query("SELECT tweet_id, tag AS hashtags, mentions[1] AS mentions, domain AS url_domains FROM everyone")
def entity_standardize(spark, d):
    p = N.with_clean_entities(src.raw_posts(spark, d))
    return p.select("tweet_id", F.array_join("entities.hashtags", ",").alias("hashtags"), F.array_join("entities.mentions", ",").alias("mentions"), F.array_join("url_domains", ",").alias("url_domains"))


@query("SELECT tweet_id, (likes + 2 * reposts + 0.5 * replies + 1.5 * quotes)::DOUBLE AS weighted, (likes + 2 * reposts)::BIGINT AS shown FROM everyone")
def engagement(spark, d):
    m = lambda c: F.col(f"public_metrics.{c}_count")
    return src.raw_posts(spark, d).select("tweet_id", X.weighted_engagement(m("like"), m("repost"), m("reply"), m("quote")).alias("weighted"), X.shown_engagement(m("like"), m("repost")).alias("shown"))


@query("SELECT tweet_id, target IS NULL AS original, target AS anchor_id FROM everyone")
def is_original(spark, d):
    return src.raw_posts(spark, d).select("tweet_id", E.is_original(F.col("referenced_tweets")).alias("original"), E.anchor_of(F.col("referenced_tweets")).alias("anchor_id"))


@query("SELECT tweet_id, author FROM posts")
def kol_filter(spark, d):
    return N.by_roster(src.raw_posts(spark, d), src.roster(spark, d)).select("tweet_id", X.norm_username(F.col("author_username")).alias("author"))


@query(f"SELECT doc_id, {_HAS.format(kw=_KW)} AS relevant FROM documents", base=False)
def capital_tech_filter(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.relevant(F.col("text")).alias("relevant"))


@query("SELECT source AS source_tweet_id, author AS source_author_username, target AS target_tweet_id, edge_type, created_at, local_date FROM wedges")
def propagation_edges(spark, d):
    return run(spark, d).weeks_edges


@query("SELECT target AS target_tweet_id, ref_cnt, ref_authors FROM refs")
def ref_counts(spark, d):
    return E.reference_counts(run(spark, d).day_edges)


@query("SELECT topic_key, author AS author_username, created_at, local_date FROM cand WHERE topic_type = 'center_tweet'")
def center_topics(spark, d):
    return run(spark, d).candidates.where("topic_type = 'center_tweet'").select("topic_key", "author_username", "created_at", "local_date")


@query("SELECT topic_type, topic_key, tweet_id, author AS author_username, created_at, local_date FROM cand")
def topic_candidates(spark, d):
    return run(spark, d).candidates


def keyword_run(spark: SparkSession, d: str) -> DailyTopics:
    return DailyTopics(src.raw_posts(spark, d), src.roster(spark, d), content_keywords=True)


@query("SELECT topic_type, topic_key, tweet_id, author AS author_username, created_at, local_date FROM cand", base=KEYWORD_BASE)
def topic_candidates_keywords(spark, d):
    return keyword_run(spark, d).candidates


@query("SELECT * FROM topics", base=KEYWORD_BASE)
def topic_aggregate_keywords(spark, d):
    return keyword_run(spark, d).topics


@query("SELECT topic_type, topic_key, round(avg_followers, 6) AS avg_followers, round(hot_score, 6) AS hot_score FROM scored", base=KEYWORD_BASE)
def hot_score_keywords(spark, d):
    return keyword_run(spark, d).scored.select("topic_type", "topic_key", F.round("avg_followers", 6).alias("avg_followers"), F.round("hot_score", 6).alias("hot_score"))


@query("SELECT * FROM topics")
def topic_aggregate(spark, d):
    return run(spark, d).topics


@query("SELECT topic_type, topic_key, round(avg_followers, 6) AS avg_followers, round(hot_score, 6) AS hot_score FROM scored")
def hot_score(spark, d):
    return run(spark, d).scored.select("topic_type", "topic_key", F.round("avg_followers", 6).alias("avg_followers"), F.round("hot_score", 6).alias("hot_score"))


@query(
    """, byauthor AS (SELECT topic_type, topic_key, sum(coalesce(followers, 0)) / greatest(count(DISTINCT author), 1) AS f FROM
   (SELECT DISTINCT topic_type, topic_key, d.author FROM cand c JOIN day d USING (tweet_id)) LEFT JOIN roster ON author = username GROUP BY 1, 2),
  bypost AS (SELECT topic_type, topic_key, sum(coalesce(followers, 0)) / greatest(count(DISTINCT author), 1) AS f FROM
   (SELECT DISTINCT topic_type, topic_key, tweet_id, d.author FROM cand c JOIN day d USING (tweet_id)) LEFT JOIN roster ON author = username GROUP BY 1, 2)
  SELECT topic_type, topic_key, round(a.f, 6) AS by_author, round(p.f, 6) AS by_post FROM byauthor a JOIN bypost p USING (topic_type, topic_key)"""
)
def follower_modes(spark, d):
    r = run(spark, d)
    a = T.topic_followers(r.candidates, r.day, r.roster, "authors").withColumnRenamed("avg_followers", "by_author")
    p = T.topic_followers(r.candidates, r.day, r.roster, "posts").withColumnRenamed("avg_followers", "by_post")
    return a.join(p, T.KEYS).select(*T.KEYS, F.round("by_author", 6).alias("by_author"), F.round("by_post", 6).alias("by_post"))


@query("SELECT * FROM daily")
def topic_daily(spark, d):
    return run(spark, d).daily


@query("SELECT local_date, back FROM axis")
def date_axis(spark, d):
    return S.date_axis(run(spark, d).daily)


@query("SELECT topic_type, topic_key, trend_label, today_value, round(avg_7d, 6) AS avg_7d FROM trends WHERE trend_label IS NOT NULL")
def topic_trends(spark, d):
    return run(spark, d).trends.withColumn("avg_7d", F.round("avg_7d", 6))


@query("SELECT trend_label AS label, count(*) AS n FROM trends WHERE trend_label IS NOT NULL GROUP BY 1")
def trend_summary(spark, d):
    return S.label_counts(run(spark, d).trends, "trend_label")


@query("SELECT topic_type, topic_key, prediction, confidence, g1::BIGINT AS author_growth_1d, h1::BIGINT AS tweet_growth_1d, round(g3, 6) AS author_growth_3d, round(h3, 6) AS tweet_growth_3d, round(acc, 6) AS acceleration FROM growth")
def growth_v1(spark, d):
    g = run(spark, d).growth
    return g.withColumns({c: F.round(c, 6) for c in ("author_growth_3d", "tweet_growth_3d", "acceleration")})


@query(
    """, w AS (SELECT *, CASE WHEN y > 0 THEN (a - y) / y ELSE 0 END AS rate, (a - m3) / (m3 + 1) AS mom3, (a - m) / (m + 1) AS mom7,
    sqrt(greatest(s7 / (n8 - 1) - m * m, 0)) AS volatility FROM means WHERE n_days > 0 AND n8 >= 3),
  c AS (SELECT *, CASE WHEN rate > 0.5 AND a >= 2 THEN 'grow' WHEN mom3 > 0.3 AND a >= 2 THEN 'grow' WHEN mom7 > 0.2 AND a >= 3 THEN 'grow' WHEN rate < -0.3 AND a < y THEN 'fade'
    WHEN mom3 < -0.2 AND a < m3 THEN 'fade' WHEN mom7 < -0.15 AND a < m THEN 'fade' ELSE 'stabilize' END AS prediction,
    CASE WHEN rate > 0.5 AND a >= 2 THEN least(0.9, 0.5 + 0.1 * rate) WHEN mom3 > 0.3 AND a >= 2 THEN least(0.85, 0.5 + 0.15 * mom3) WHEN mom7 > 0.2 AND a >= 3 THEN least(0.8, 0.5 + 0.1 * mom7)
    WHEN rate < -0.3 AND a < y THEN least(0.9, 0.5 + 0.1 * abs(rate)) WHEN mom3 < -0.2 AND a < m3 THEN least(0.85, 0.5 + 0.15 * abs(mom3)) WHEN mom7 < -0.15 AND a < m THEN least(0.8, 0.5 + 0.1 * abs(mom7))
    WHEN abs(mom7) < 0.1 AND a >= 2 THEN 0.7 ELSE 0.5 END AS c FROM w)
  SELECT topic_type, topic_key, prediction, round_even(CASE WHEN a < 2 THEN c * 0.7 ELSE c END, 3) AS confidence, round(rate, 6) AS rate, round(mom3, 6) AS mom3, round(mom7, 6) AS mom7, round(volatility, 6) AS volatility FROM c"""
)
def growth_v2(spark, d):
    r = run(spark, d)
    g = S.growth_by_momentum(r.daily, r.topics)
    return g.withColumns({c: F.round(c, 6) for c in ("rate", "mom3", "mom7", "volatility")})


@query(
    """SELECT rank::INTEGER AS rank, topic_type, topic_key, CASE WHEN length(CASE WHEN topic_type = 'hashtag' THEN '#' || topic_key ELSE topic_key END) > 50
    THEN left(CASE WHEN topic_type = 'hashtag' THEN '#' || topic_key ELSE topic_key END, 50) || '...' ELSE CASE WHEN topic_type = 'hashtag' THEN '#' || topic_key ELSE topic_key END END AS title,
    round(hot_score, 6) AS hot_score, tweet_cnt, unique_author_cnt, coalesce(trend_label, 'Unknown') AS trend_label, coalesce(prediction, 'stabilize') AS prediction, coalesce(confidence, 0.5) AS confidence
  FROM top LEFT JOIN trends USING (topic_type, topic_key) LEFT JOIN growth USING (topic_type, topic_key)"""
)
def daily_report(spark, d):
    return run(spark, d).report()


@query(
    """SELECT rank::INTEGER AS rank, topic_type, topic_key, tweet_id, author, likes AS like_count, text, place::INTEGER AS place FROM (SELECT t.rank, t.topic_type, t.topic_key, d.tweet_id, d.author, d.likes,
    CASE WHEN length(d.text) > 200 THEN left(d.text, 200) || '...' ELSE d.text END AS text, row_number() OVER (PARTITION BY t.rank ORDER BY d.likes DESC, d.tweet_id) AS place
    FROM top t JOIN (SELECT DISTINCT topic_type, topic_key, tweet_id FROM cand) c USING (topic_type, topic_key) JOIN day d USING (tweet_id)) WHERE place <= 5"""
)
def evidence_topk(spark, d):
    return run(spark, d).examples()


@query("SELECT author, tweet_id, created_ts FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_ts DESC, tweet_id) AS n FROM everyone) WHERE n = 1")
def dedup_latest(spark, d):
    p = N.with_times(src.raw_posts(spark, d)).select(X.norm_username(F.col("author_username")).alias("tweet_id"), F.lit("x").alias("pad"), F.col("tweet_id").alias("own"), "created_ts")
    return N.latest(p).select(F.col("tweet_id").alias("author"), F.col("own").alias("tweet_id"), "created_ts")


@query(
    """, t AS (SELECT tweet_id AS target, author AS other FROM weeks) SELECT least(author, other) AS author_a, greatest(author, other) AS author_b, count(*) AS weight
  FROM wedges JOIN t USING (target) WHERE author <> other GROUP BY 1, 2"""
)
def author_interactions(spark, d):
    r = run(spark, d)
    return E.author_interactions(r.weeks_edges, r.weeks)


@query("SELECT s.author AS cluster_id, count(*) AS propagation FROM wedges e JOIN weeks s ON s.tweet_id = e.source JOIN weeks t ON t.tweet_id = e.target AND t.author = s.author GROUP BY 1")
def propagation_intra(spark, d):
    r = run(spark, d)
    return E.edges_within(r.weeks_edges, r.weeks.select(F.col("author").alias("cluster_id"), "tweet_id"))


@query("SELECT t.tag AS cluster_id, count(*) AS propagation FROM wedges e JOIN weeks t ON t.tweet_id = e.target WHERE e.author <> t.author GROUP BY 1")
def propagation_cross(spark, d):
    r = run(spark, d)
    return E.edges_into(r.weeks_edges, r.weeks.select(F.get("entities.hashtags", F.lit(0)).alias("cluster_id"), "tweet_id"), r.weeks)


@query("SELECT t.tag AS cluster_id, count(*) AS propagation FROM wedges e JOIN weeks t ON t.tweet_id = e.target WHERE EXISTS (SELECT 1 FROM weeks m WHERE m.tag = t.tag AND m.author = e.author) GROUP BY 1")
def propagation_members(spark, d):
    r = run(spark, d)
    m = r.weeks.select(F.get("entities.hashtags", F.lit(0)).alias("cluster_id"), "tweet_id", "author")
    return E.edges_by_members(r.weeks_edges, m, m)


_SEEDS = """, oc AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), pool AS (SELECT 'u' || c_custkey AS username, floor(c_acctbal)::BIGINT AS followers_count,
  c_name || CASE WHEN c_custkey % 11 = 0 THEN ' FREE stuff' ELSE '' END AS bio, n, c_mktsegment = 'BUILDING' AS verified FROM customer LEFT JOIN oc ON c_custkey = o_custkey),
  seeds AS (SELECT username, followers_count, 3 * coalesce(n, 0) + ln(1 + coalesce(followers_count, 0)) + CASE WHEN verified THEN 1 ELSE 0 END AS seedscore FROM pool
   WHERE coalesce(followers_count, 0) >= 200 AND NOT regexp_matches(coalesce(bio, ''), '(?i)giveaway|promo|coupon|discount|free|airdrops|follow back|dm for promo|onlyfans') ORDER BY seedscore DESC, username LIMIT 100),
  rel2 AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'followed' WHEN 'N' THEN 'mentioned' ELSE 'interacted' END AS kind, 's' || l_suppkey AS seed, 'p' || l_partkey AS username
   FROM lineitem WHERE l_suppkey % 9 = 0),
  exp AS (SELECT username, count(*) FILTER (kind = 'followed') AS f, count(*) FILTER (kind = 'mentioned') AS m, count(*) FILTER (kind = 'interacted') AS i,
   string_agg(seed, ',' ORDER BY seed) FILTER (kind = 'followed') AS ef, string_agg(seed, ',' ORDER BY seed) FILTER (kind = 'mentioned') AS em, string_agg(seed, ',' ORDER BY seed) FILTER (kind = 'interacted') AS ei FROM rel2 GROUP BY 1 HAVING f >= 2 OR m >= 2 OR i >= 2)"""


@query(_SEEDS + " SELECT username, followers_count, round(seedscore, 6) AS seedscore FROM seeds")
def seed_select(spark, d):
    return P.select_seeds(src.candidate_pool(spark, d), exact=False).select("username", "followers_count", F.round("seedscore", 6).alias("seedscore"))


def _expansion(spark, d):
    seeds = src.table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("@S"), "s_suppkey").alias("username"))
    return P.expansion_candidates(src.relation_edges(spark, d), seeds)


@query(
    _SEEDS
    + """ SELECT username, f AS cnt_followed_by_seeds, m AS cnt_mentioned_by_seeds, i AS cnt_interacted_by_seeds, coalesce(ef, '') AS evidence, coalesce(em, '') AS mentioned, coalesce(ei, '') AS interacted FROM exp"""
)
def expansion_candidates(spark, d):
    return _expansion(spark, d).select("username", "cnt_followed_by_seeds", "cnt_mentioned_by_seeds", "cnt_interacted_by_seeds", F.array_join("seed_usernames_followed", ",").alias("evidence"), F.array_join("seed_usernames_mentioned", ",").alias("mentioned"), F.array_join("seed_usernames_interacted", ",").alias("interacted"))


@query(
    _SEEDS
    + """ SELECT username, followers_count, round(seedscore, 6) AS seedscore, NULL::DOUBLE AS expandscore, 'seed' AS origin FROM seeds
  UNION ALL SELECT username, followers_count, NULL, expandscore, 'expanded' FROM (SELECT username, (2 * i + m + f)::DOUBLE AS expandscore FROM exp ORDER BY expandscore DESC, username LIMIT 400)
   LEFT JOIN (SELECT 'p' || p_partkey AS username, floor(p_retailprice)::BIGINT AS followers_count FROM part) USING (username)"""
)
def kol_pool(spark, d):
    profiles = src.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("username"), F.floor("p_retailprice").alias("followers_count"))
    out = P.account_pool(P.select_seeds(src.candidate_pool(spark, d), exact=False), _expansion(spark, d), profiles)
    return out.select("username", "followers_count", F.round("seedscore", 6).alias("seedscore"), "expandscore", "origin")
