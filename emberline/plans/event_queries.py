"""Registered queries of the event variants over news posts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets
from ..operators import entities as N
from ..operators import events as V
from ..operators import normalize as M
from ..operators import text as W
from ..operators import vectors as D
from ..sources import posts as src
from .daily_topics import DailyTopics
from .event_runs import CentricRun, GatedRun, RuleRun, SeededRun
from .queries import _HAS, _KW, anchors_sql, leaders_sql, query, words_sql
from .text_queries import _GENERIC, _NAMES, _URLLESS, _emb

_PICK = lambda words: f"{words_sql(words)}[k % {len(words)} + 1]"
_BODY = f"{_PICK(src.SUBJECTS)} || ' ' || {_PICK(src.DEEDS)} || ' ' || {_PICK(src.THINGS)} || ' for the ' || {_PICK(src.FIELDS)} || ' market. Readers of part ' || k || ' asked why! ' || url"

#: News posts, their last day and its edges.
NEWS = f"""
WITH RECURSIVE raw0 AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT), 0) AS k, event_id % 40 AS e FROM events),
raw1 AS (SELECT *, CASE WHEN e = 4 THEN 'https://www.youtube.com/p/' ELSE 'https://www.site' || (k % 20) || '.demo.net/p/' END || k AS url FROM raw0),
raw2 AS (SELECT *, CASE e WHEN 0 THEN url WHEN 1 THEN 'RT @u1 ' || {_BODY} WHEN 2 THEN 'via @u2 ' || {_PICK(src.SUBJECTS)} || ' ' || url WHEN 3 THEN 'AI market growth' WHEN 5 THEN 'no words to see here'
  WHEN 6 THEN 'https://medium.com/s ' || {_BODY} ELSE {_BODY} END AS raw FROM raw1),
everyone AS (SELECT event_id::VARCHAR AS id, '@U' || user_id AS author_username, 'u' || user_id AS author, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, floor(epoch(ts))::BIGINT AS time, raw, replace(raw, url, '<URL>') AS text,
  CASE WHEN e = 5 THEN [] ELSE [event_type] END AS hashtags, CASE WHEN e <> 5 AND k % 10 = 0 THEN ['$T' || k] ELSE [] END AS tickers, CASE WHEN e = 5 THEN [] ELSE ['u' || (k % 7)] END AS people,
  [CASE WHEN e = 4 THEN 'youtube.com' ELSE 'site' || (k % 20) || '.demo.net' END] AS domains,
  floor(coalesce(value, 0))::BIGINT AS likes, floor(coalesce(value, 0) / 10)::BIGINT AS reposts,
  (floor(coalesce(value, 0)) + 2 * floor(coalesce(value, 0) / 10) + 0.5 * (event_id % 7) + 1.5 * (event_id % 3))::DOUBLE AS engagement,
  CASE WHEN k > 0 AND event_type IN ('click', 'purchase') THEN (event_id - k)::VARCHAR END AS target FROM raw2),
roster AS (SELECT 'u' || c_custkey AS username, greatest(floor(coalesce(c_acctbal, 0)), 0)::BIGINT AS followers FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')),
posts AS (SELECT * FROM everyone WHERE author IN (SELECT username FROM roster)),
day AS MATERIALIZED (SELECT * FROM posts WHERE time > (SELECT max(time) FROM posts) - 86400),
ed AS MATERIALIZED (SELECT id AS source, author, target FROM day WHERE target IS NOT NULL)
"""


def _low(words, column: str = "raw") -> str:
    return f"list_filter({words_sql(words)}, lambda w: contains(lower({column}), lower(w)))"


def _up(words, column: str = "raw") -> str:
    return f"list_filter({words_sql(words)}, lambda w: contains(upper({column}), upper(w)))"


def _title(words) -> str:
    return f"list_transform({_low(words)}, lambda w: upper(w[1]) || w[2:])"


_CAPS = r"list_distinct(regexp_extract_all(raw, '\b[A-Z][a-z]+\b|\b[A-Z]{2,}\b'))"
_TERM = lambda words, of: f"len(list_filter({words_sql(words)}, lambda t: contains({of}, {{t}}))) > 0"
_KB = f"""list_sort(list_distinct(list_concat({_up(assets.IMPROVED_PRODUCTS)}, list_filter({_CAPS}, lambda w: length(w) >= 4 AND NOT list_contains({words_sql(assets.IMPROVED_STOPS)}, w)
  AND ({_TERM(assets.IMPROVED_TERMS, 'lower(w)').format(t='lower(t)')} OR regexp_matches(w, '^[A-Z][a-z]+$'))))))[:10]"""
_LISTED = f"len(list_filter({words_sql(assets.FINAL_WHITELIST)}, lambda t: contains(upper(w), upper(t)) OR contains(upper(t), upper(w)))) > 0"
_ORD = words_sql(assets.FINAL_PLACES + assets.FINAL_NAMES + assets.FINAL_WORDS)
_KC = f"""list_sort(list_distinct(list_concat({_up(assets.FINAL_WHITELIST)}, list_filter({_CAPS}, lambda w: length(w) >= 4 AND NOT list_contains({words_sql(assets.FINAL_STOPS)}, w) AND NOT list_contains({_ORD}, w)
  AND ({_TERM(assets.FINAL_TERMS, 'upper(w)').format(t='t')} OR {_LISTED})))))[:10]"""
TECH_B = _TERM(assets.IMPROVED_TECH, "upper(w)").format(t="t")
TECH_C = f"({_LISTED} OR {_TERM(assets.FINAL_INDICATORS, 'upper(w)').format(t='t')})"


def kinds_sql(variant: str, table: str) -> str:
    """CTE en(id, ..., companies[, products, technologies]) of one community or event variant over a table of posts."""
    if variant == "a":
        return f", en AS MATERIALIZED (SELECT *, {_title(assets.COMPANIES)} AS companies FROM {table})"
    words, tech = (_KB, TECH_B) if variant == "b" else (_KC, TECH_C)
    extra = "" if variant == "b" else f" AND length(w) BETWEEN 4 AND 20 AND NOT list_contains({_ORD}, w)"
    return f""", kw AS MATERIALIZED (SELECT *, {words} AS keywords FROM {table}),
  en AS MATERIALIZED (SELECT *, {_title(assets.GRAPH_COMPANIES)} AS companies, list_filter(keywords, lambda w: NOT {tech}{extra}) AS products, list_filter(keywords, lambda w: {tech}) AS technologies FROM kw)"""


def news_query(sql: str | None = None):
    return query(None if sql is None else NEWS + sql, base=False)


def news(spark, d) -> DailyTopics:
    return DailyTopics(src.news_posts(spark, d), src.roster(spark, d))


def _clean_news(spark, d):
    return M.with_clean_entities(M.with_clean_text(src.news_posts(spark, d)))


def _joined(df, entities, kinds):
    """One text column a kind."""
    return df.select("tweet_id", entities.alias("x")).select("tweet_id", *(F.array_join(f"x.{k}", ",").alias(k) for k in kinds))


def _lists(kinds) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {k}" for k, c in kinds.items())


_GIVEN = {"tickers": "tickers", "hashtags": "hashtags", "domains": "domains", "mentions": "people"}


def _columns():
    return tuple(map(F.col, ("text", "entities", "url_domains")))


@news_query(kinds_sql("a", "everyone") + f" SELECT id AS tweet_id, {_lists({**_GIVEN, 'companies': 'companies'})} FROM en")
def entities_a(spark, d):
    return _joined(_clean_news(spark, d), N.first_entities(*_columns()), (*_GIVEN, "companies"))


_MORE = {**_GIVEN, "companies": "companies", "products": "products", "technologies": "technologies"}


@news_query(kinds_sql("b", "everyone") + f" SELECT id AS tweet_id, {_lists(_MORE)} FROM en")
def entities_b(spark, d):
    return _joined(_clean_news(spark, d), N.improved_entities(*_columns()), tuple(_MORE))


@news_query(kinds_sql("c", "everyone") + f" SELECT id AS tweet_id, {_lists(_MORE)} FROM en")
def entities_c(spark, d):
    return _joined(_clean_news(spark, d), N.final_entities(*_columns()), tuple(_MORE))


_RULE_LISTS = f"{_title(assets.RULE_COMPANIES)} AS companies, list_sort({_up(assets.RULE_PRODUCTS)}) AS products, {_low(sorted(set(assets.RULE_VERBS)), 'text')} AS verbs"
_RU = f", ru AS MATERIALIZED (SELECT *, {_RULE_LISTS} FROM {{table}})"
_FLAT = "list_concat(list_concat(list_concat(companies, products), tickers), people)"


@news_query(_RU.format(table="everyone") + f" SELECT id AS tweet_id, array_to_string({_FLAT}, ',') AS entity FROM ru")
def entities_ec(spark, d):
    return _clean_news(spark, d).select("tweet_id", F.array_join(N.flat(N.rule_entities(*_columns()), CentricRun.order), ",").alias("entity"))


@news_query(_RU.format(table="everyone") + " SELECT id AS tweet_id, array_to_string(verbs, ',') AS verbs, verbs[1] AS action FROM ru")
def verbs(spark, d):
    found = W.actions(F.col("clean_text"), assets.RULE_VERBS)
    return _clean_news(spark, d).select("tweet_id", F.array_join(found, ",").alias("verbs"), F.get(found, F.lit(0)).alias("action"))


# ---------------------------------------------------------------- rule-first

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_GEN = _GENERIC.format(tok=_TOK, words=words_sql(assets.RULE_GENERIC))
_RULE_KEPT = (
    _RU.format(table="day")
    + f""", rr AS MATERIALIZED (SELECT *, CASE WHEN {_URLLESS} THEN 'only_url' WHEN starts_with(trim(text), 'RT @') OR (starts_with(lower(trim(text)), 'via') AND length(text) < 50) THEN 'repost_form'
  WHEN list_has_any(domains, {words_sql(assets.RULE_PLATFORMS)}) THEN 'platform' WHEN len(tickers) + len(companies) + len(products) + len(people) + len(hashtags) = 0 AND len(verbs) = 0 THEN 'no_entity_no_action'
  WHEN {_GEN} THEN 'generic' END AS drop_reason FROM ru),
  kept AS MATERIALIZED (SELECT * FROM rr WHERE drop_reason IS NULL)"""
)


def vectors_sql(table: str, emb: str) -> str:
    """CTE vec(tweet_id, v): dense hashed vectors of a table's texts."""
    return f""", tok AS (SELECT tweet_id, t[i] AS word, i - 1 AS pos FROM (SELECT tweet_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id AS tweet_id, {_TOK} AS t FROM {table}))), {emb},
  vec AS MATERIALIZED (SELECT tweet_id, list(coalesce(w, 0) ORDER BY g.dim) AS v FROM (SELECT tweet_id, dim FROM (SELECT DISTINCT tweet_id FROM emb), (SELECT unnest(range(256))::INTEGER AS dim)) g LEFT JOIN emb USING (tweet_id, dim) GROUP BY 1)"""


_TYPED = "list_concat(list_concat(list_concat(list_transform(tickers, lambda x: 't:' || x), list_transform(companies, lambda x: 'c:' || x)), list_transform(products, lambda x: 'p:' || x)), list_transform(people, lambda x: 'm:' || x))"
_LINKED = "EXISTS (SELECT 1 FROM ed WHERE (source = x.id AND target = y.id) OR (source = y.id AND target = x.id))"
_RULE_CLUSTERS = (
    _RULE_KEPT
    + vectors_sql("kept", _emb(3, (), None))
    + f""", typed AS (SELECT id, time, author, {_TYPED} AS entity FROM kept),
  pr AS MATERIALIZED (SELECT s.a, s.b, cos, (abs(x.time - y.time) <= 172800)::INTEGER + list_has_any(x.entity, y.entity)::INTEGER + (x.author <> '' AND y.author <> '' AND x.author <> y.author)::INTEGER + {_LINKED}::INTEGER AS satisfied
   FROM (SELECT a.tweet_id AS a, b.tweet_id AS b, list_inner_product(a.v, b.v) AS cos FROM vec a JOIN vec b ON a.tweet_id < b.tweet_id) s JOIN typed x ON x.id = s.a JOIN typed y ON y.id = s.b WHERE cos >= 0.85),
  rp AS MATERIALIZED (SELECT * FROM pr WHERE satisfied >= 2), near AS MATERIALIZED (SELECT a, b FROM rp UNION ALL SELECT b, a FROM rp),
  reach AS (SELECT DISTINCT a AS x, a AS y FROM near UNION SELECT r.x, n.b FROM reach r JOIN near n ON n.a = r.y),
  mem AS MATERIALIZED (SELECT min(y) AS cluster_id, x AS id FROM reach GROUP BY x)"""
)


def _rule(spark, d) -> RuleRun:
    run = news(spark, d)
    return RuleRun(run, similarity=0.85, as_of=(run.day.agg(F.max("created_ts")).first()[0] or 0) + 12 * 3600)


@news_query(_RULE_KEPT + " SELECT id, array_to_string(companies, ',') AS companies, array_to_string(products, ',') AS products, array_to_string(verbs, ',') AS verbs, target IS NULL AS original, drop_reason FROM rr")
def event_candidates_rule(spark, d):
    c = _rule(spark, d).candidates
    return c.select("id", F.array_join("entities.companies", ",").alias("companies"), F.array_join("entities.products", ",").alias("products"), F.array_join("verbs", ",").alias("verbs"), "original", "drop_reason")


@news_query(_RULE_CLUSTERS + " SELECT a, b, satisfied, round(cos, 6) AS cos FROM rp")
def rule_pairs(spark, d):
    return _rule(spark, d).pairs.select("a", "b", "satisfied", F.round("cos", 6).alias("cos"))


_UNIONS = " UNION ALL ".join(f"SELECT cluster_id, '{k}' AS kind, unnest(list_distinct({c})) AS name FROM mem JOIN {{table}} USING (id)" for k, c in {"tickers": "tickers", "companies": "companies", "products": "products", "people": "people", "hashtags": "hashtags", "domains": "domains"}.items())


@news_query(_RULE_CLUSTERS + f" SELECT cluster_id, kind, name, count(*) AS posts FROM ({_UNIONS.format(table='kept')}) GROUP BY 1, 2, 3")
def cluster_entities(spark, d):
    return _rule(spark, d).entities


_SCORE = "ln(1 + sum(engagement)) + 3.0 * count(DISTINCT k.author) + 1.5 * ln(1 + coalesce(max(n), 0)) + 0.5 * ln(1 + count(*)) + 0.3 * ln(1 + sum(coalesce(followers, 0)) / greatest(count(DISTINCT k.author), 1))"
_INNER = "inn AS (SELECT a.cluster_id, count(*) AS n FROM ed JOIN mem a ON a.id = source JOIN mem b ON b.id = target AND b.cluster_id = a.cluster_id GROUP BY 1)"
RULE_SCORED = (
    _RULE_CLUSTERS
    + f""", {_INNER}, coh AS (SELECT x.cluster_id, avg(cos) AS coherence FROM rp JOIN mem x ON x.id = a JOIN mem y ON y.id = b AND y.cluster_id = x.cluster_id GROUP BY 1),
  base AS (SELECT m.cluster_id, count(*) AS tweet_cnt, count(DISTINCT k.author) AS author_cnt, sum(engagement) AS engagement, coalesce(max(n), 0)::BIGINT AS propagation, min(time) AS first_ts, max(time) AS last_ts, {_SCORE} AS s
   FROM mem m JOIN kept k USING (id) LEFT JOIN roster ON username = k.author LEFT JOIN inn USING (cluster_id) GROUP BY 1),
  sc AS MATERIALIZED (SELECT b.*, coherence, novelty, s + coherence + 0.5 * novelty AS event_score FROM (SELECT b.*, coalesce(coherence, 0) AS coherence,
    CASE WHEN (SELECT max(time) FROM day) + 43200 - first_ts BETWEEN 86400 AND 259200 THEN 1.0 ELSE 0.0 END::DOUBLE AS novelty FROM base b LEFT JOIN coh USING (cluster_id)) b WHERE coherence >= 0.6 AND author_cnt >= 2)"""
)


@news_query(RULE_SCORED + " SELECT cluster_id, tweet_cnt, author_cnt, propagation, first_ts, last_ts, round(coherence, 6) AS coherence, novelty, round(event_score, 6) AS event_score FROM sc")
def rule_event_score(spark, d):
    s = _rule(spark, d).scored
    return s.select("cluster_id", "tweet_cnt", "author_cnt", "propagation", "first_ts", "last_ts", F.round("coherence", 6).alias("coherence"), "novelty", F.round("event_score", 6).alias("event_score"))


@news_query(RULE_SCORED + " SELECT row_number() OVER (ORDER BY event_score DESC, cluster_id)::INTEGER AS rank, cluster_id, round(event_score, 6) AS event_score FROM sc ORDER BY event_score DESC, cluster_id LIMIT 5")
def rule_top5(spark, d):
    return _rule(spark, d).top.select("rank", "cluster_id", F.round("event_score", 6).alias("event_score"))


# ---------------------------------------------------------------- event-centric and gated

_REFS = "rf AS (SELECT target AS id, count(*) AS refs FROM ed GROUP BY 1)"
_CENTRIC_KEPT = (
    _RU.format(table="day")
    + f""", {_REFS}, ec AS MATERIALIZED (SELECT d.*, {_FLAT} AS entity, verbs[1] AS action, coalesce(refs, 0) AS refs, coalesce(target, '') AS anchor_id FROM ru d LEFT JOIN rf USING (id)),
  er AS MATERIALIZED (SELECT *, CASE WHEN {_URLLESS} THEN 'only_url' WHEN starts_with(trim(text), 'RT @') THEN 'repost_form' WHEN len(entity) = 0 AND action IS NULL THEN 'no_entity_no_action' WHEN {_GEN} THEN 'generic' END AS drop_reason FROM ec),
  kept AS MATERIALIZED (SELECT * FROM er WHERE drop_reason IS NULL)"""
)
_GATED_KEPT = (
    f""", {_REFS}, gt AS MATERIALIZED (SELECT d.*, list_filter({_NAMES}, lambda w: contains(upper(raw), upper(w)) OR contains(lower(raw), lower(w))) AS entity, {_low(sorted(set(W.GATE_VERBS)), 'text')}[1] AS action,
   coalesce(refs, 0) AS refs, coalesce(target, '') AS anchor_id, """
    + r"list_transform(regexp_extract_all(text, 'https?://([^\s/]+)', 1), lambda x: lower(replace(x, 'www.', ''))) AS hosts FROM day d LEFT JOIN rf USING (id)),"
    + f""" er AS MATERIALIZED (SELECT *, CASE WHEN len(entity) = 0 THEN 'no_entity' WHEN action IS NULL THEN 'no_action' WHEN list_has_any(hosts, {words_sql(assets.GATE_PLATFORMS)}) THEN 'platform' WHEN {_URLLESS} THEN 'only_url'
   WHEN {_GENERIC.format(tok=_TOK, words=words_sql(assets.GATE_STOPS))} THEN 'generic' END AS drop_reason FROM gt),
  kept AS MATERIALIZED (SELECT * FROM er WHERE drop_reason IS NULL)"""
)


_REST = ", rest AS MATERIALIZED (SELECT * FROM kept WHERE id NOT IN (SELECT id FROM anchored))"
_NEAR, _SHARED, _SAME = "abs(x.time - y.time) <= 172800", "list_has_any(x.entity, y.entity)", "coalesce(x.action = y.action, false)"
_FIVE = f""", cp AS MATERIALIZED (SELECT x.id AS a, y.id AS b, 0.0::DOUBLE AS weight FROM rest x JOIN rest y ON x.id < y.id WHERE {_SHARED}::INTEGER + ({_SAME})::INTEGER + ({_NEAR})::INTEGER + (x.author <> y.author)::INTEGER + {_LINKED}::INTEGER >= 2)"""
_WEIGHED = f""", cp AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, CASE WHEN x.anchor_id = y.anchor_id AND x.anchor_id <> '' THEN 10.0 WHEN {_SHARED} AND {_SAME} THEN 8.0 WHEN {_SHARED} AND {_NEAR} THEN 6.0
   WHEN x.author <> y.author AND {_NEAR} AND {_SAME} THEN 4.0 END::DOUBLE AS weight FROM rest x JOIN rest y ON x.id < y.id) WHERE weight >= 4)"""
_MEMBERS = """, sz AS (SELECT leader, max(weight) AS cluster_weight FROM grown GROUP BY 1 HAVING count(*) >= 2),
  mem AS MATERIALIZED (SELECT 'anchor_' || cluster_id AS cluster_id, id, 10.0::DOUBLE AS cluster_weight, 'anchor' AS cluster_type FROM anchored UNION ALL SELECT 'topic_' || leader, id, cluster_weight, 'incremental' FROM grown JOIN sz USING (leader))"""


def scored_sql(weighted: bool) -> str:
    extra = " + 0.5 * max(m.cluster_weight)" if weighted else ""
    return f""", {_INNER}, sc AS MATERIALIZED (SELECT m.cluster_id, max(cluster_type) AS cluster_type, max(m.cluster_weight) AS cluster_weight, count(*) AS tweet_cnt, count(DISTINCT k.author) AS author_cnt, sum(engagement) AS engagement,
   coalesce(max(n), 0)::BIGINT AS propagation, {_SCORE}{extra} AS event_score FROM mem m JOIN kept k USING (id) LEFT JOIN roster ON username = k.author LEFT JOIN inn USING (cluster_id) GROUP BY 1 HAVING count(DISTINCT k.author) >= 2)"""


CENTRIC = _CENTRIC_KEPT + anchors_sql() + _REST + _FIVE + leaders_sql("rest", "cp") + _MEMBERS
GATED = _GATED_KEPT + anchors_sql() + _REST + _WEIGHED + leaders_sql("rest", "cp", by_weight=True) + _MEMBERS
CENTRIC_SCORED, GATED_SCORED = CENTRIC + scored_sql(False), GATED + scored_sql(True)
_CANDIDATE = "SELECT id, array_to_string(entity, ',') AS entity, action, refs AS reference_count, refs >= 1 AS is_anchor, drop_reason FROM er"
_ROWS = "SELECT cluster_id, tweet_cnt, author_cnt, propagation, round(event_score, 6) AS event_score FROM sc"


def _candidates(run):
    return run.candidates.select("id", F.array_join("entity", ",").alias("entity"), "action", "reference_count", "is_anchor", "drop_reason")


def _scores(run):
    return run.scored.select("cluster_id", "tweet_cnt", "author_cnt", "propagation", F.round("event_score", 6).alias("event_score"))


@news_query(_CENTRIC_KEPT + " " + _CANDIDATE)
def event_candidates_ec(spark, d):
    return _candidates(CentricRun(news(spark, d)))


@news_query(CENTRIC + " SELECT id, leader FROM grown")
def incremental_ec(spark, d):
    return CentricRun(news(spark, d)).grown.select("id", "leader")


@news_query(CENTRIC_SCORED + " " + _ROWS)
def anchor_event_score(spark, d):
    return _scores(CentricRun(news(spark, d)))


@news_query(_GATED_KEPT + " " + _CANDIDATE)
def event_candidates_new(spark, d):
    return _candidates(GatedRun(news(spark, d)))


@news_query(GATED + " SELECT cluster_id, id, cluster_weight FROM mem")
def event_clusters_new(spark, d):
    return GatedRun(news(spark, d)).members.select("cluster_id", "id", "cluster_weight")


@news_query(GATED_SCORED + " " + _ROWS)
def new_event_score(spark, d):
    return _scores(GatedRun(news(spark, d)))


# ---------------------------------------------------------------- from seeds

_RELEVANT = f"""({_HAS.format(kw=_KW).replace('lower(text)', 'lower(raw)')} OR len(tickers) > 0 OR len(list_filter(hashtags, lambda t: len(list_filter({_KW}, lambda w: contains(w, t) OR contains(t, w))) > 0)) > 0)"""
_TAGGED = (
    kinds_sql("a", f"(SELECT * FROM day WHERE {_RELEVANT})")
    + f""", tk AS (SELECT id, t[i] AS word, i AS pos FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, {_TOK} AS t FROM en))),
  ph AS MATERIALIZED (SELECT DISTINCT a.id, a.word || ' ' || b.word AS phrase FROM tk a JOIN tk b ON b.id = a.id AND b.pos = a.pos + 1 WHERE length(a.word) > 2 AND length(b.word) > 2
   UNION SELECT a.id, a.word || ' ' || b.word || ' ' || c.word FROM tk a JOIN tk b ON b.id = a.id AND b.pos = a.pos + 1 JOIN tk c ON c.id = a.id AND c.pos = a.pos + 2 WHERE length(a.word) > 2 AND length(b.word) > 2 AND length(c.word) > 2),
  sd AS MATERIALIZED (SELECT 'ticker:' || unnest(list_distinct(tickers)) AS seed_key, id FROM en UNION ALL SELECT 'company:' || lower(unnest(companies)), id FROM en
   UNION ALL SELECT 'phrase:' || phrase, id FROM ph WHERE len(list_filter({_KW}, lambda w: contains(phrase, w))) > 0)"""
)


@news_query(_TAGGED + " SELECT seed_key, count(*) AS posts, min(id) AS first_id FROM sd GROUP BY 1")
def event_seed_keys(spark, d):
    return SeededRun(news(spark, d)).seeds.groupBy("seed_key").agg(F.count(F.lit(1)).alias("posts"), F.min("id").alias("first_id"))


@news_query()
def seeded_events(spark, d):
    """Events of the seeded variant: average linkage, then merging by shared sets; held against a loop in tests."""
    return SeededRun(news(spark, d), distance=0.15).members


@news_query()
def seeded_event_score(spark, d):
    s = SeededRun(news(spark, d), distance=0.15).scored
    return s.select("cluster_id", "tweet_cnt", "author_cnt", "propagation", F.round("coherence", 6).alias("coherence"), F.round("event_score", 6).alias("event_score"))


#: Clusters by company instead of linkage, so that SQL can follow: each post joins its first company's cluster.
_BY_NAME = """, s1 AS MATERIALIZED (SELECT list_sort(companies)[1] AS cluster_id, id FROM en WHERE len(companies) > 0)"""
_MERGED = (
    _TAGGED
    + _BY_NAME
    + """, kp AS (SELECT cluster_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY phrase) AS p FROM (SELECT DISTINCT cluster_id, phrase FROM s1 JOIN ph USING (id))) WHERE p <= 10),
  ky AS MATERIALIZED (SELECT cluster_id, 'phrase:' || phrase AS k, 1 AS w FROM kp UNION ALL SELECT DISTINCT cluster_id, 'tickers:' || unnest(tickers), 2 FROM s1 JOIN en USING (id) UNION ALL SELECT DISTINCT cluster_id, 'companies:' || unnest(companies), 2 FROM s1 JOIN en USING (id)),
  cl AS (SELECT DISTINCT cluster_id AS id FROM s1), cp AS MATERIALIZED (SELECT a.cluster_id AS a, b.cluster_id AS b, 1.0::DOUBLE AS weight FROM ky a JOIN ky b USING (k) WHERE a.cluster_id < b.cluster_id GROUP BY 1, 2 HAVING sum(a.w) >= 2)"""
    + leaders_sql("cl", "cp")
    + ", ev AS MATERIALIZED (SELECT leader AS cluster_id, s1.id FROM s1 JOIN grown g ON g.id = s1.cluster_id)"
)


def _named(spark, d):
    run = SeededRun(news(spark, d))
    stage = run.tagged.where(F.size("entities.companies") > 0).select(F.get(F.array_sort("entities.companies"), F.lit(0)).alias("cluster_id"), "id")
    phrases = stage.join(run.tagged.select("id", F.explode("phrases").alias("phrase")), "id").select("cluster_id", "phrase")
    run.members = V.merge_events(stage, N.cluster_entities(stage, run.tagged, run.kinds), phrases)
    return run


@news_query(_MERGED + " SELECT cluster_id, id FROM ev")
def event_merge(spark, d):
    return _named(spark, d).members


_EVENT_SCORED = (
    _MERGED
    + vectors_sql("en", _emb(3, assets.EMBEDDING_STOPS, 256))
    + """, sp AS (SELECT m.cluster_id, count(*) AS n FROM ed JOIN ev m ON m.id = ed.target JOIN day t ON t.id = ed.target WHERE ed.author <> t.author GROUP BY 1),
  fm AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS p FROM ev),
  co AS (SELECT a.cluster_id, avg(list_inner_product(x.v, y.v)) AS coherence FROM fm a JOIN fm b ON b.cluster_id = a.cluster_id AND b.p > a.p JOIN vec x ON x.tweet_id = a.id JOIN vec y ON y.tweet_id = b.id WHERE b.p <= 10 GROUP BY 1),
  b0 AS (SELECT m.cluster_id, count(*) AS tweet_cnt, count(DISTINCT nullif(author, '')) AS author_cnt, sum(engagement) AS engagement, coalesce(max(n), 0)::BIGINT AS propagation, coalesce(max(coherence), 0) AS coherence
   FROM ev m JOIN en USING (id) LEFT JOIN sp USING (cluster_id) LEFT JOIN co USING (cluster_id) GROUP BY 1),
  es AS MATERIALIZED (SELECT *, (ln(1 + engagement) + 3.0 * author_cnt + 1.5 * ln(1 + propagation) + 0.5 * ln(1 + tweet_cnt) * ln(1 + author_cnt) + 2.0 * coherence) * CASE WHEN author_cnt >= 2 THEN 1.0 WHEN engagement < 100 THEN 0.3 ELSE 0.7 END
   * CASE WHEN coherence < 0.3 AND tweet_cnt >= 3 THEN 0.5 ELSE 1.0 END AS event_score FROM b0 WHERE NOT (author_cnt < 2 AND engagement < 50) AND NOT (coherence < 0.2 AND tweet_cnt >= 3))"""
)


@news_query(_EVENT_SCORED + " SELECT cluster_id, tweet_cnt, author_cnt, engagement, propagation, round(coherence, 6) AS coherence, round(event_score, 6) AS event_score FROM es")
def event_score(spark, d):
    s = _named(spark, d).scored
    return s.select("cluster_id", "tweet_cnt", "author_cnt", "engagement", "propagation", F.round("coherence", 6).alias("coherence"), F.round("event_score", 6).alias("event_score"))


@news_query(_EVENT_SCORED + " SELECT row_number() OVER (ORDER BY event_score DESC, cluster_id)::INTEGER AS rank, cluster_id, round(event_score, 6) AS event_score FROM es ORDER BY event_score DESC, cluster_id LIMIT 5")
def event_top5(spark, d):
    return _named(spark, d).top.select("rank", "cluster_id", F.round("event_score", 6).alias("event_score"))
