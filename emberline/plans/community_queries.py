"""Registered queries of communities and topic clusters over news posts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets
from ..operators import semantic as S
from .community_runs import CommunityRun, SemanticRun
from .event_queries import _GIVEN, _RELEVANT, TECH_C, kinds_sql, news, news_query, vectors_sql  # noqa: F401
from .queries import KEYWORD_BASE, keyword_run, leaders_sql, query, run, words_sql
from .text_queries import _docs, _emb, docs_query

_KIND_COLUMNS = {**_GIVEN, "companies": "companies", "products": "products", "technologies": "technologies"}


def graph_sql(variant: str) -> str:
    """CTEs up to ge(kind, a, b, weight), the graph of relevant posts of the day, and mb(community, node): components of similar posts with the authors and entities of their posts."""
    kinds = {k: c for k, c in _KIND_COLUMNS.items() if variant != "a" or k not in ("products", "technologies")}
    names = " UNION ALL ".join(f"SELECT id, '{k}:' || unnest({c}) AS entity FROM en" for k, c in kinds.items())
    return (
        kinds_sql(variant, f"(SELECT * FROM day WHERE {_RELEVANT})")
        + vectors_sql("en", _emb(3, assets.GRAPH_EMBEDDING_STOPS, 256))
        + f""", si AS MATERIALIZED (SELECT a.tweet_id AS a, b.tweet_id AS b, list_inner_product(a.v, b.v) AS cos FROM vec a JOIN vec b ON a.tweet_id < b.tweet_id WHERE list_inner_product(a.v, b.v) > 0.9),
  nm AS MATERIALIZED ({names}),
  ge AS MATERIALIZED (SELECT 'author-tweet' AS kind, 'author:' || author AS a, 'tweet:' || id AS b, 1.0::DOUBLE AS weight FROM en
   UNION ALL SELECT 'tweet-entity', 'tweet:' || id, 'entity:' || entity, count(*) FROM nm GROUP BY id, entity
   UNION ALL SELECT 'author-author', 'author:' || least(ed.author, t.author), 'author:' || greatest(ed.author, t.author), count(*) FROM ed JOIN en t ON t.id = ed.target WHERE ed.author <> t.author GROUP BY least(ed.author, t.author), greatest(ed.author, t.author)
   UNION ALL SELECT 'entity-entity', 'entity:' || x.entity, 'entity:' || y.entity, count(*) FROM (SELECT DISTINCT * FROM nm) x JOIN (SELECT DISTINCT * FROM nm) y USING (id) WHERE x.entity < y.entity GROUP BY x.entity, y.entity
   UNION ALL SELECT 'tweet-tweet', 'tweet:' || a, 'tweet:' || b, cos FROM si),
  nr AS MATERIALIZED (SELECT a, b FROM si UNION ALL SELECT b, a FROM si), rc AS (SELECT tweet_id AS x, tweet_id AS y FROM vec UNION SELECT r.x, n.b FROM rc r JOIN nr n ON n.a = r.y),
  cc AS MATERIALIZED (SELECT x AS id, 'c' || min(y) AS community FROM rc GROUP BY 1),
  mb AS MATERIALIZED (SELECT community, 'tweet:' || id AS node FROM cc UNION SELECT community, 'author:' || author FROM cc JOIN en USING (id) UNION SELECT community, 'entity:' || entity FROM cc JOIN nm USING (id))"""
    )


def _by_similarity(spark, d, variant: str) -> CommunityRun:
    """A run whose communities are components of similar posts with their authors and entities, so that SQL can follow."""
    r = CommunityRun(news(spark, d), variant, similarity=0.9)
    cc = r.similar_posts.select(F.concat(F.lit("c"), "component").alias("community"), F.concat(F.lit("tweet:"), "tweet_id").alias("node"))
    g = r.plain_graph
    near = g.where(F.col("kind") == "author-tweet").select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(g.where(F.col("kind") == "tweet-entity").select(F.col("a").alias("node"), F.col("b").alias("other")))
    r.members = cc.unionByName(cc.join(near, "node").select("community", F.col("other").alias("node"))).distinct().checkpoint()
    return r


@news_query(graph_sql("b") + " SELECT kind, count(*) AS edges, round(sum(weight), 6) AS weight FROM ge GROUP BY 1")
def news_graph(spark, d):
    r = CommunityRun(news(spark, d), "improved", similarity=0.9)
    plain = r.plain_graph.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    pairs = r.classes.counted().where("n > 0").select(F.lit("tweet-tweet").alias("kind"), F.col("n").alias("edges"), F.col("cos").alias("weight"))
    return plain.unionByName(pairs).select("kind", "edges", F.round("weight", 6).alias("weight"))


_OF = lambda kind: f"count(*) FILTER (node LIKE '{kind}:%')"
_LIST = f"li AS MATERIALIZED (SELECT community, {_OF('tweet')} AS tweet_count, {_OF('author')} AS author_count, {_OF('entity')} AS entity_count FROM mb GROUP BY 1 HAVING count(*) >= 2)"


@news_query(graph_sql("b") + f", {_LIST} SELECT * FROM li")
def community_list(spark, d):
    return _by_similarity(spark, d, "improved").listing


_SCORED = f""", {_LIST}, tm AS (SELECT community, node[7:] AS id FROM mb JOIN li USING (community) WHERE node LIKE 'tweet:%'), am AS (SELECT community, node[8:] AS author FROM mb JOIN li USING (community) WHERE node LIKE 'author:%'),
  ta AS (SELECT community, count(*) AS tweet_cnt, sum(engagement) AS engagement, sum(coalesce(followers, 0)) AS followers FROM tm JOIN en USING (id) LEFT JOIN roster ON username = author GROUP BY 1),
  aa AS (SELECT community, count(*) AS author_cnt FROM am GROUP BY 1), pp AS (SELECT t.community, count(*) AS propagation FROM ed JOIN tm t ON t.id = ed.target JOIN am a ON a.community = t.community AND a.author = ed.author GROUP BY 1),
  cs AS MATERIALIZED (SELECT *, ln(1 + engagement) + 3.0 * author_cnt + 1.5 * ln(1 + propagation) + 0.5 * ln(1 + tweet_cnt) + 0.3 * ln(1 + followers / greatest(author_cnt, 1)) AS community_score
   FROM (SELECT community, tweet_cnt, engagement, followers, coalesce(author_cnt, 0) AS author_cnt, coalesce(propagation, 0)::BIGINT AS propagation FROM ta LEFT JOIN aa USING (community) LEFT JOIN pp USING (community)) WHERE NOT (author_cnt < 2 AND engagement < 50))"""


@news_query(graph_sql("b") + _SCORED + " SELECT community, tweet_cnt, author_cnt, propagation, engagement, round(community_score, 6) AS community_score FROM cs")
def community_score(spark, d):
    return _by_similarity(spark, d, "improved").scored.select("community", "tweet_cnt", "author_cnt", "propagation", "engagement", F.round("community_score", 6).alias("community_score"))


_WEIGHT = "CASE split_part(node, ':', 2) " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in assets.ENTITY_WEIGHTS.items()) + " ELSE 1.0 END"
_CENTRES = f""", dg AS (SELECT a AS node, 1.5 * weight AS w FROM ge WHERE kind = 'tweet-tweet' UNION ALL SELECT b, 1.5 * weight FROM ge WHERE kind = 'tweet-tweet' UNION ALL SELECT a, weight FROM ge WHERE kind = 'tweet-entity'
   UNION ALL SELECT 'tweet:' || id, 0.3 * ln(1 + likes + 2 * reposts) FROM en),
  et AS (SELECT b AS node, 1.2 * weight AS w FROM ge WHERE kind = 'tweet-entity' UNION ALL SELECT a, 1.5 * weight FROM ge WHERE kind = 'entity-entity' UNION ALL SELECT b, 1.5 * weight FROM ge WHERE kind = 'entity-entity'),
  td AS (SELECT node, sum(w) AS c FROM dg GROUP BY 1), ed2 AS (SELECT node, sum(w) * {_WEIGHT} AS c FROM et GROUP BY 1),
  ie AS MATERIALIZED (SELECT community, node, c FROM mb JOIN ed2 USING (node)),
  mo AS (SELECT m.community, m.node, 0.2 * avg(ie.c) AS more FROM ge JOIN mb m ON m.node = ge.a JOIN ie ON ie.node = ge.b AND ie.community = m.community WHERE kind = 'tweet-entity' GROUP BY 1, 2),
  al2 AS (SELECT community, node, c FROM ie UNION ALL SELECT community, node, c + coalesce(more, 0) FROM mb JOIN td USING (node) LEFT JOIN mo USING (community, node)),
  ct AS MATERIALIZED (SELECT community, split_part(node, ':', 1) AS kind, node[strpos(node, ':') + 1:] AS center, c AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY community, split_part(node, ':', 1) ORDER BY round(c, 9) DESC, node) AS p FROM al2) WHERE p = 1)"""


@news_query(graph_sql("b") + _CENTRES + " SELECT community, kind, round(centrality, 6) AS centrality FROM ct")
def community_center_v2(spark, d):
    return _by_similarity(spark, d, "improved").centres.select("community", "kind", F.round("centrality", 6).alias("centrality"))


@news_query(
    graph_sql("c")
    + f""", kc AS (SELECT community, w AS word, count(*) AS n, (len(list_filter({words_sql(assets.FINAL_WHITELIST)}, lambda t: contains(upper(w), upper(t)) OR contains(upper(t), upper(w)))) > 0) AS tech
   FROM (SELECT community, unnest(keywords) AS w FROM cc JOIN en USING (id)) GROUP BY 1, 2),
  kr AS (SELECT *, row_number() OVER (PARTITION BY community, tech ORDER BY n DESC, word) AS r FROM kc)
  SELECT community, word, n, row_number() OVER (PARTITION BY community ORDER BY tech DESC, r)::INTEGER AS place FROM kr WHERE CASE WHEN tech THEN r <= 3 ELSE r <= 2 END"""
)
def community_keywords(spark, d):
    return _by_similarity(spark, d, "final").keywords


@news_query()
def news_communities(spark, d):
    """Communities of the whole graph (sweeps have no SQL; tests hold them against cliques and between their two forms)."""
    return CommunityRun(news(spark, d), "final", similarity=0.9).members


# ---------------------------------------------------------------- topics

_TEXTS = """, tx0 AS (SELECT tweet_id, left(tag || ' by ' || CASE WHEN k % 3 = 0 THEN 'tech' ELSE 'none' END || ' ' || k || ' <URL>', 200) AS t FROM day),
  ex AS (SELECT topic_type, topic_key, tweet_id, t, row_number() OVER (PARTITION BY topic_type, topic_key ORDER BY tweet_id) AS p FROM (SELECT DISTINCT topic_type, topic_key, tweet_id FROM cand) JOIN tx0 USING (tweet_id) WHERE length(t) > 10),
  tt AS MATERIALIZED (SELECT topic_type || ':' || topic_key AS id, topic_type, topic_key, CASE WHEN topic_type = 'content_keyword' THEN '' ELSE coalesce(string_agg(t, ' ' ORDER BY p), '') END AS text FROM (SELECT DISTINCT topic_type, topic_key FROM cand) LEFT JOIN (SELECT * FROM ex WHERE p <= 5) USING (topic_type, topic_key) GROUP BY 2, 3),
  tw AS (SELECT id, t[i] AS word, i AS pos FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM tt))),
  ws AS (SELECT id, ln(1 + count(*)) AS w, row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS dim FROM tw WHERE length(word) > 2 GROUP BY id, word),
  tv AS MATERIALIZED (SELECT id, list(coalesce(w, 0)::DOUBLE ORDER BY dim) AS v FROM (SELECT id, dim FROM tt, (SELECT unnest(range(128)) AS dim)) LEFT JOIN (SELECT id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ws WHERE dim < 128) USING (id, dim) GROUP BY 1)"""
_GREEDY = (
    _TEXTS
    + ", tp AS MATERIALIZED (SELECT a.id AS a, b.id AS b, 1.0::DOUBLE AS weight FROM tv a JOIN tv b ON a.id < b.id WHERE list_inner_product(a.v, b.v) > 0.75)"
    + leaders_sql("tt", "tp")
    + ", sf AS MATERIALIZED (SELECT id, leader AS cluster FROM grown)"
)
_STANDARD = (
    _TEXTS
    + """, fl AS (SELECT id, unnest(v) AS x, unnest(range(128)) AS dim FROM tv), ms AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM fl GROUP BY 1),
  sv AS MATERIALIZED (SELECT id, list((x - m) / s ORDER BY dim) AS v FROM fl JOIN ms USING (dim) GROUP BY 1),
  nn AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM sv a JOIN sv b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.5),
  rr AS (SELECT id AS x, id AS y FROM tt UNION SELECT r.x, n.b FROM rr r JOIN nn n ON n.a = r.y), sf AS MATERIALIZED (SELECT x AS id, min(y) AS cluster FROM rr GROUP BY 1)"""
)
_TOPICS = " SELECT 'st_' || cluster AS semantic_id, count(*) AS cluster_size, min(id) AS first_member, left(first(text ORDER BY length(text) DESC, id), 500) AS representative_text FROM sf JOIN tt USING (id) GROUP BY cluster"


@query(_GREEDY + _TOPICS)
def semantic_topics(spark, d):
    return SemanticRun(run(spark, d)).topics


def _counted(least: int) -> str:
    """CTEs up to sf(id, cluster): one topic a step, which takes its free neighbours if they are enough."""
    return _TEXTS + f""", it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.id) AS i, a.id, coalesce(list(b.id) FILTER (b.id IS NOT NULL), []) AS near FROM tv a LEFT JOIN tv b ON list_inner_product(a.v, b.v) > 0.75 GROUP BY a.id),
  fold(i, used, found) AS (SELECT 0::BIGINT, list(id) FILTER (false), list({{'m': id, 'l': id}}) FILTER (false) FROM it UNION ALL
   SELECT i + 1, CASE WHEN ok THEN list_concat(used, free) ELSE used END, CASE WHEN ok THEN list_concat(found, list_transform(free, lambda x: {{'m': x, 'l': id}})) ELSE found END
   FROM (SELECT *, NOT list_contains(used, id) AND len(free) >= {least} AS ok FROM (SELECT f.i, coalesce(f.used, []) AS used, coalesce(f.found, []) AS found, t.id, list_filter(t.near, lambda x: NOT list_contains(coalesce(f.used, []), x)) AS free FROM fold f JOIN it t ON t.i = f.i + 1))),
  took AS MATERIALIZED (SELECT x.m AS id, x.l AS leader FROM (SELECT unnest(found) AS x FROM fold WHERE i = (SELECT count(*) FROM it))),
  sf AS MATERIALIZED (SELECT tt.id, coalesce(c.cluster, tt.id) AS cluster FROM tt LEFT JOIN took USING (id) LEFT JOIN (SELECT leader, min(id) AS cluster FROM took GROUP BY 1) c USING (leader))"""


@query(_counted(3) + _TOPICS)
def semantic_topics_least3(spark, d):
    """Greedy clusters of three topics or more; a topic that found too few may join a later one."""
    return SemanticRun(run(spark, d), least=3).topics


@query(_counted(4) + _TOPICS)
def semantic_topics_least4(spark, d):
    return SemanticRun(run(spark, d), least=4).topics


@query(_STANDARD + _TOPICS)
def semantic_topics_dbscan(spark, d):
    return SemanticRun(run(spark, d), "dbscan").topics


ROLLED = """, mem AS (SELECT 'st_' || cluster AS semantic_id, topic_type, topic_key FROM sf JOIN tt USING (id)),
  tot AS (SELECT semantic_id, sum(tweet_cnt)::BIGINT AS tweet_cnt, sum(sum_like_cnt)::BIGINT AS l, sum(sum_repost_cnt)::BIGINT AS r, sum(sum_quote_cnt)::BIGINT AS q, sum(ref_cnt)::BIGINT AS ref_cnt,
   count(*) AS cluster_size, count(*) FILTER (topic_type IN ('hashtag', 'domain', 'cashtag')) AS symbols FROM mem JOIN topics USING (topic_type, topic_key) GROUP BY 1),
  au AS (SELECT DISTINCT semantic_id, d.author FROM mem JOIN cand c USING (topic_type, topic_key) JOIN day d USING (tweet_id)),
  vo AS (SELECT semantic_id, count(*) AS a, sum(coalesce(followers, 0)) AS f FROM au LEFT JOIN roster ON username = author GROUP BY 1),
  ro AS (SELECT t.*, coalesce(a, 0) AS a, coalesce(f, 0) AS f FROM tot t LEFT JOIN vo USING (semantic_id)),
  rs AS (SELECT semantic_id, tweet_cnt, a AS unique_author_cnt, ref_cnt, cluster_size, symbols, CASE WHEN symbols > 0 THEN 1 + 0.5 * ln(1 + symbols) ELSE 0.5 END *
   (CASE WHEN tweet_cnt > 1 THEN 1 + 0.2 * ln(tweet_cnt) ELSE 1 END * (ln(1 + ref_cnt) + ln(1 + r + q) + 0.5 * ln(1 + l / tweet_cnt))
    + CASE WHEN a > 1 THEN 1 + 0.3 * ln(a) ELSE 1 END * (3.0 * a + 0.3 * ln(1 + CASE WHEN a > 0 THEN f / a ELSE 0 END)) + 0.5 * ln(1 + tweet_cnt)) AS hot_score FROM ro),
  st AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CASE WHEN unique_author_cnt >= 2 THEN 0 ELSE 1 END, hot_score DESC, semantic_id) AS rank FROM rs WHERE symbols > 0 AND tweet_cnt >= 2 AND unique_author_cnt >= 1 QUALIFY rank <= 5)"""


@query(_GREEDY + ROLLED + " SELECT rank::INTEGER AS rank, semantic_id, cluster_size, symbols, tweet_cnt, unique_author_cnt, round(hot_score, 6) AS hot_score FROM st")
def semantic_score(spark, d):
    return SemanticRun(run(spark, d)).top.select("rank", "semantic_id", "cluster_size", "symbols", "tweet_cnt", "unique_author_cnt", F.round("hot_score", 6).alias("hot_score"))


_REPORT = _GREEDY + ROLLED + """, fm AS (SELECT semantic_id, min(topic_type || chr(1) || topic_key) AS k FROM mem GROUP BY 1)
  SELECT st.rank::INTEGER AS rank, semantic_id, round_even(hot_score, 2) AS hot_score, tweet_cnt, unique_author_cnt, trend_label, coalesce(today_value, 0)::BIGINT AS today_value, coalesce(round_even(avg_7d, 2), 0)::DOUBLE AS avg_7d, prediction, confidence
  FROM st JOIN fm USING (semantic_id) LEFT JOIN (SELECT * FROM trends WHERE trend_label IS NOT NULL) t ON t.topic_type = split_part(k, chr(1), 1) AND t.topic_key = split_part(k, chr(1), 2)
   LEFT JOIN growth g ON g.topic_type = split_part(k, chr(1), 1) AND g.topic_key = split_part(k, chr(1), 2)"""
_REPORT_COLUMNS = "rank", "semantic_id", "hot_score", "tweet_cnt", "unique_author_cnt", "trend_label", "today_value", "avg_7d", "prediction", "confidence"


@query(_REPORT)
def semantic_report(spark, d):
    return SemanticRun(run(spark, d)).report().select(*_REPORT_COLUMNS)


@query(_REPORT, base=KEYWORD_BASE)
def semantic_report_keywords(spark, d):
    """The report with keyword topics, which have no text and so stay alone."""
    return SemanticRun(keyword_run(spark, d)).report().select(*_REPORT_COLUMNS)


@query(_GREEDY + _TOPICS, base=KEYWORD_BASE)
def semantic_topics_keywords(spark, d):
    return SemanticRun(keyword_run(spark, d)).topics


_KINDS = " UNION ALL ".join(
    f"SELECT topic_id, place, '{k}' AS kind, {i} AS o, len(list_filter({words_sql(ws)}, lambda w: contains(lower(text), w))) AS n FROM ps" for i, (k, ws) in enumerate(assets.EVENT_KINDS.items())
)
_SAY = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in S.KIND_TITLES.items())
_CORE = r"trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s+', ' ', 'g'))"


@docs_query(
    rf""", ps AS MATERIALIZED (SELECT * FROM (SELECT author AS topic_id, text, row_number() OVER (PARTITION BY author ORDER BY tweet_id) AS place FROM docs) WHERE place <= 10),
  sc AS (SELECT topic_id, kind, sum(n) AS n, min(place * 10 + o) AS f FROM ({_KINDS}) WHERE n > 0 GROUP BY 1, 2), kd AS (SELECT topic_id, first(kind ORDER BY n DESC, f) AS event_type FROM sc GROUP BY 1),
  nm AS (SELECT DISTINCT topic_id, unnest(list_filter({words_sql(assets.TOPIC_NAMES)}, lambda w: contains(lower(text), lower(w)))) AS name FROM ps
   UNION SELECT topic_id, w FROM (SELECT topic_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM ps) WHERE regexp_matches(w, '^[A-Z][a-z]+$') AND length(w) > 2 AND NOT list_contains({words_sql(assets.TOPIC_NOT_NAMES)}, w)),
  ns AS (SELECT topic_id, list(name ORDER BY name)[:5] AS names FROM nm GROUP BY 1),
  cr AS (SELECT topic_id, (SELECT count(*) FROM ps q WHERE q.topic_id = ps.topic_id) AS n, {_CORE} AS bare FROM ps WHERE place = 1),
  ck AS (SELECT topic_id, n, CASE WHEN bare = '' THEN '{S.NO_SENTENCE}' WHEN length(bare) > 150 AND length(regexp_extract(left(bare, 150), '^(.*[.?!])', 1)) > 51 THEN regexp_extract(left(bare, 150), '^(.*[.?!])', 1) ELSE left(bare, 150) END AS core FROM cr),
  al AS (SELECT topic_id, n, core, coalesce(event_type, 'discussion') AS event_type, coalesce(names, []) AS names FROM ck LEFT JOIN kd USING (topic_id) LEFT JOIN ns USING (topic_id)),
  ti AS (SELECT *, CASE event_type {_SAY} END AS say FROM al)
  SELECT topic_id, event_type, array_to_string(names, ',') AS key_entities, CASE WHEN len(names) > 0 AND say IS NOT NULL THEN array_to_string(names[:3], ', ') || say WHEN len(names) > 0 THEN CASE WHEN length(core) > 60 THEN left(core, 60) || '...' ELSE core END
   ELSE CASE WHEN length(core) > 80 THEN left(core, 80) || '...' ELSE core END END AS topic_title, CASE WHEN n > 1 THEN '多位 KOL 讨论：' || left(core, 100) ELSE left(core, 150) END AS topic_summary, left(core, 200) AS core_text FROM ti"""
)
def topic_extract(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("author").orderBy("tweet_id"))
    p = _docs(spark, d).select(F.col("author").alias("topic_id"), place.alias("place"), "text")
    return S.topic_extract(p).withColumn("key_entities", F.array_join("key_entities", ","))
