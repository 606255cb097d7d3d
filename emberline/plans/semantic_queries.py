"""Registered queries of topic clusters and the post graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets
from ..operators import edges as E
from ..operators import graph as G
from ..operators import semantic as M
from ..operators import text as W
from .queries import query, run, words_sql
from .text_queries import _docs, docs_query

_ROLL = """, mem AS (SELECT 'st_' || left(topic_key, 2) AS semantic_id, topic_type, topic_key FROM topics),
  tot AS (SELECT semantic_id, sum(tweet_cnt)::BIGINT AS tweet_cnt, sum(sum_like_cnt)::BIGINT AS l, sum(sum_repost_cnt)::BIGINT AS r, sum(sum_quote_cnt)::BIGINT AS q, sum(ref_cnt)::BIGINT AS ref_cnt,
   count(*) AS cluster_size, count(*) FILTER (topic_type IN ('hashtag', 'domain', 'cashtag')) AS symbols FROM mem JOIN topics USING (topic_type, topic_key) GROUP BY 1),
  au AS (SELECT DISTINCT semantic_id, d.author FROM mem JOIN cand c USING (topic_type, topic_key) JOIN day d USING (tweet_id)),
  vo AS (SELECT semantic_id, count(*) AS a, sum(coalesce(followers, 0)) AS f FROM au LEFT JOIN roster ON username = author GROUP BY 1),
  ro AS (SELECT t.*, coalesce(a, 0) AS a, coalesce(f, 0) AS f FROM tot t LEFT JOIN vo USING (semantic_id)),
  rs AS (SELECT semantic_id, tweet_cnt, a AS unique_author_cnt, ref_cnt, cluster_size, symbols, CASE WHEN symbols > 0 THEN 1 + 0.5 * ln(1 + symbols) ELSE 0.5 END *
   (CASE WHEN tweet_cnt > 1 THEN 1 + 0.2 * ln(tweet_cnt) ELSE 1 END * (ln(1 + ref_cnt) + ln(1 + r + q) + 0.5 * ln(1 + l / tweet_cnt))
    + CASE WHEN a > 1 THEN 1 + 0.3 * ln(a) ELSE 1 END * (3.0 * a + 0.3 * ln(1 + CASE WHEN a > 0 THEN f / a ELSE 0 END)) + 0.5 * ln(1 + tweet_cnt)) AS hot_score FROM ro)"""


def _rolled(spark, d):
    r = run(spark, d)
    members = r.topics.select(F.concat(F.lit("st_"), F.substring("topic_key", 1, 2)).alias("semantic_id"), "topic_type", "topic_key")
    return M.roll_up(members, r.topics, r.candidates, r.day, r.roster)


@query(_ROLL + " SELECT semantic_id, tweet_cnt, unique_author_cnt, ref_cnt, cluster_size, symbols, round(hot_score, 6) AS hot_score FROM rs")
def semantic_rollup(spark, d):
    return _rolled(spark, d).select("semantic_id", "tweet_cnt", "unique_author_cnt", "ref_cnt", "cluster_size", "symbols", F.round("hot_score", 6).alias("hot_score"))


@query(
    _ROLL
    + """, ti AS (SELECT *, CASE WHEN symbols > 0 AND tweet_cnt >= 2 THEN CASE WHEN unique_author_cnt >= 2 THEN 0 WHEN unique_author_cnt >= 1 THEN 1 END END AS tier FROM rs)
  SELECT row_number() OVER (ORDER BY tier, hot_score DESC, semantic_id)::INTEGER AS rank, semantic_id, tier, round(hot_score, 6) AS hot_score FROM ti WHERE tier IS NOT NULL ORDER BY tier, hot_score DESC, semantic_id LIMIT 5"""
)
def semantic_top5(spark, d):
    return M.semantic_top(_rolled(spark, d)).select("rank", "semantic_id", "tier", F.round("hot_score", 6).alias("hot_score"))


@query(
    """, tx AS (SELECT tweet_id, left(tag || ' by ' || CASE WHEN k % 3 = 0 THEN 'tech' ELSE 'none' END || ' ' || k || ' <URL>', 200) AS t FROM day),
  ex AS (SELECT topic_type, topic_key, tweet_id, t, row_number() OVER (PARTITION BY topic_type, topic_key ORDER BY tweet_id) AS p FROM (SELECT DISTINCT topic_type, topic_key, tweet_id FROM cand) JOIN tx USING (tweet_id) WHERE length(t) > 10)
  SELECT topic_type, topic_key, coalesce(string_agg(t, ' ' ORDER BY p), '') AS text FROM (SELECT DISTINCT topic_type, topic_key FROM cand) LEFT JOIN (SELECT * FROM ex WHERE p <= 5) USING (topic_type, topic_key) GROUP BY 1, 2"""
)
def topic_text(spark, d):
    r = run(spark, d)
    return M.topic_text(r.candidates, r.day)


_GRAPH = """, ents AS (SELECT tweet_id, tag AS entity FROM weeks UNION ALL SELECT tweet_id, domain FROM weeks UNION ALL SELECT tweet_id, unnest(cashtags) FROM weeks),
  tgt AS (SELECT tweet_id AS target, author AS other FROM weeks),
  ge AS (SELECT 'author-tweet' AS kind, 'author:' || author AS a, 'tweet:' || tweet_id AS b, 1.0::DOUBLE AS weight FROM weeks
   UNION ALL SELECT 'tweet-entity', 'tweet:' || tweet_id, 'entity:' || entity, count(*) FROM ents GROUP BY tweet_id, entity
   UNION ALL SELECT 'author-author', 'author:' || least(author, other), 'author:' || greatest(author, other), count(*) FROM wedges JOIN tgt USING (target) WHERE author <> other GROUP BY least(author, other), greatest(author, other)
   UNION ALL SELECT 'entity-entity', 'entity:' || x.entity, 'entity:' || y.entity, count(*) FROM (SELECT DISTINCT * FROM ents) x JOIN (SELECT DISTINCT * FROM ents) y USING (tweet_id) WHERE x.entity < y.entity GROUP BY x.entity, y.entity)"""


def _graph(spark, d):
    r = run(spark, d)
    entities = r.weeks.select("tweet_id", F.explode(F.concat("entities.hashtags", "url_domains", "entities.cashtags")).alias("entity"))
    return r, entities, G.graph_edges(r.weeks, entities, E.author_interactions(r.weeks_edges, r.weeks))


@query(_GRAPH + " SELECT kind, count(*) AS edges, round(sum(weight), 6) AS weight FROM ge GROUP BY 1")
def graph_stats(spark, d):
    return _graph(spark, d)[2].groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    _GRAPH
    + """, deg AS (SELECT node, sum(weight) AS c FROM (SELECT a AS node, kind, weight FROM ge UNION ALL SELECT b, kind, weight FROM ge)
   WHERE (node LIKE 'tweet:%' AND kind = 'tweet-entity') OR (node LIKE 'entity:%' AND kind IN ('tweet-entity', 'entity-entity')) GROUP BY 1),
  mb AS (SELECT tag AS community, 'tweet:' || tweet_id AS node FROM weeks UNION SELECT tag, 'entity:' || domain FROM weeks)
  SELECT community, split_part(node, ':', 1) AS kind, split_part(node, ':', 2) AS center, round(c, 6) AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY community, split_part(node, ':', 1) ORDER BY c DESC, node) AS p FROM mb JOIN deg USING (node)) WHERE p = 1"""
)
def community_center(spark, d):
    r, _, edges = _graph(spark, d)
    tag = F.get("entities.hashtags", F.lit(0)).alias("community")
    m = r.weeks.select(tag, F.concat(F.lit("tweet:"), "tweet_id").alias("node")).unionByName(r.weeks.select(tag, F.concat(F.lit("entity:"), F.get("url_domains", F.lit(0))).alias("node"))).distinct()
    return G.centres(edges, m).withColumn("centrality", F.round("centrality", 6))


@docs_query(f", c AS (SELECT tweet_id, list_filter({words_sql(assets.GRAPH_COMPANIES)}, lambda w: contains(lower(text), w)) AS w FROM docs) SELECT tweet_id, len(w)::INTEGER AS n, array_to_string(w, ',') AS companies FROM c WHERE len(w) > 0")
def document_companies(spark, d):
    found = W.companies(F.col("text"), assets.GRAPH_COMPANIES)
    return _docs(spark, d).select("tweet_id", F.size(found).alias("n"), F.array_join(F.transform(found, F.lower), ",").alias("companies")).where("n > 0")
