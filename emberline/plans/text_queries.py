"""Registered queries of the text, vector, cluster and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets
from ..functions import scalars as X
from ..functions.dictionary import token_key
from ..operators import cluster as C
from ..operators import constrained as Z
from ..operators import events as V
from ..operators import similarity as S
from ..operators import text as W
from ..operators import vectors as D
from ..sources import posts as src
from ..sources.stages import staged
from .queries import anchors_sql, leaders_sql, query, run, words_sql

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_DOCS = rf"""WITH RECURSIVE docs AS (SELECT doc_id::VARCHAR AS tweet_id, source AS author, 1700000000 + doc_id * 977 AS created_ts, coalesce(text, '') AS text FROM documents),
tok AS (SELECT tweet_id, t[i] AS word, i - 1 AS pos FROM (SELECT tweet_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT tweet_id, {_TOK} AS t FROM docs))),
comp AS (SELECT tweet_id, list_filter({words_sql(assets.RULE_COMPANIES)}, lambda w: contains(lower(text), w)) AS c FROM docs),
prod AS (SELECT tweet_id, list_filter({words_sql(assets.RULE_PRODUCTS)}, lambda w: contains(upper(text), upper(w))) AS p FROM docs),
verb AS (SELECT tweet_id, list_filter({words_sql(sorted(set(assets.RULE_VERBS)))}, lambda w: contains(lower(text), lower(w))) AS v FROM docs)
"""


def _emb(least: int, stops, top: int | None) -> str:
    stop = f"AND word NOT IN ({', '.join(repr(s) for s in stops)})" if stops else ""
    cut = f"WHERE place <= {top}" if top else ""
    return f"""wc AS (SELECT tweet_id, word, ln(1 + count(*)) * CASE WHEN length(word) > 3 THEN 1 + 0.1 * (length(word) - 3) ELSE 1 END AS w FROM tok WHERE length(word) >= {least} {stop} GROUP BY 1, 2),
dims AS (SELECT tweet_id, ('0x' || right(md5(word), 2))::INTEGER AS dim, sum(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY w DESC, word) AS place FROM wc) {cut} GROUP BY 1, 2),
emb AS (SELECT tweet_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY tweet_id)) AS w FROM dims)"""


_DENSE = """vec AS (SELECT tweet_id, list(coalesce(w, 0) ORDER BY g.dim) AS v FROM (SELECT tweet_id, dim FROM (SELECT DISTINCT tweet_id FROM emb), (SELECT unnest(range(256))::INTEGER AS dim)) g LEFT JOIN emb USING (tweet_id, dim) GROUP BY 1)"""


def docs_query(sql: str | None = None):
    return query(None if sql is None else _DOCS + sql, base=False)


def _docs(spark, d):
    return src.document_posts(spark, d)


def _vectors(spark, d):
    return D.hash_vectors(_docs(spark, d))


@docs_query("SELECT tweet_id, count(*) AS n_tokens, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM tok GROUP BY 1")
def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return _docs(spark, d).select("tweet_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest")).where("n_tokens > 0")


@docs_query(
    """, two AS (SELECT a.tweet_id, a.word || ' ' || b.word AS phrase, b.pos AS last FROM tok a JOIN tok b ON a.tweet_id = b.tweet_id AND b.pos = a.pos + 1 WHERE length(a.word) > 2 AND length(b.word) > 2),
  g AS (SELECT tweet_id, phrase FROM two UNION ALL SELECT two.tweet_id, phrase || ' ' || c.word FROM two JOIN tok c ON c.tweet_id = two.tweet_id AND c.pos = two.last + 1 WHERE length(c.word) > 2)
  SELECT phrase, count(*) AS n, count(DISTINCT tweet_id) AS posts FROM g GROUP BY 1"""
)
def ngrams(spark, d):
    """Phrases of two and of three words."""
    return W.phrase_counts(_docs(spark, d)).groupBy("phrase").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("posts"))


_STOP = ", ".join(repr(s) for s in assets.KEYWORD_STOPS)


@docs_query(
    f""", c AS (SELECT tweet_id, word, count(*) AS n, min(pos) AS pos FROM tok WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT tweet_id, word, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY n DESC, pos) AS place FROM c) WHERE place <= 10"""
)
def content_keywords(spark, d):
    return W.keywords(_docs(spark, d))


@docs_query(
    f""", c AS (SELECT tweet_id, word, count(*) AS n, min(pos) AS pos FROM tok WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY n DESC, pos) AS place FROM c) WHERE place <= 10)
  SELECT word AS topic_key, count(*) AS posts, min(tweet_id) AS tweet_id FROM k WHERE len(list_filter({words_sql(assets.TOPIC_KEYWORDS)}, lambda w: contains(word, w))) > 0 GROUP BY 1 HAVING count(*) >= 2"""
)
def keyword_topics(spark, d):
    return W.keyword_topics(_docs(spark, d))


@docs_query("SELECT tweet_id, array_to_string(c, ',') AS companies, array_to_string(p, ',') AS products, array_to_string(v, ',') AS verbs FROM comp JOIN prod USING (tweet_id) JOIN verb USING (tweet_id)")
def entities_rule(spark, d):
    t = F.col("text")
    found = F.array_join(F.transform(W.companies(t, assets.RULE_COMPANIES), F.lower), ",")
    return _docs(spark, d).select("tweet_id", found.alias("companies"), F.array_join(W.products(t, assets.RULE_PRODUCTS), ",").alias("products"), F.array_join(W.actions(t, assets.RULE_VERBS), ",").alias("verbs"))


_URLLESS = r"regexp_replace(replace(regexp_replace(text, 'https?://\S+', '', 'g'), '<URL>', ''), '\s+', '', 'g') = ''"
_GENERIC = "len({tok}) > 0 AND len(list_filter({tok}, lambda w: NOT list_contains({words}, w))) = 0"
_RULE = f"""CASE WHEN {_URLLESS} THEN 'only_url' WHEN starts_with(trim(text), 'RT @') OR (starts_with(lower(trim(text)), 'via') AND length(text) < 50) THEN 'repost_form'
  WHEN len(c) + len(p) = 0 AND len(v) = 0 THEN 'no_entity_no_action' WHEN {_GENERIC.format(tok=_TOK, words=words_sql(assets.RULE_GENERIC))} THEN 'generic' END"""


def _by_tokens_sql(words) -> str:
    """Entries whose tokens stand side by side in `padded`, in the order given."""
    pairs = ", ".join(f"{{'w': '{w}', 'k': '{token_key(w)}'}}" for w in words)
    return f"list_transform(list_filter([{pairs}], lambda x: contains(padded, x.k)), lambda x: x.w)"


_PADDED = f", pad AS (SELECT tweet_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS padded FROM docs)"


@docs_query(
    f"""{_PADDED} SELECT tweet_id, array_to_string({_by_tokens_sql(assets.RULE_COMPANIES)}, ',') AS companies, array_to_string({_by_tokens_sql(assets.RULE_PRODUCTS)}, ',') AS products,
  array_to_string({_by_tokens_sql(sorted(set(assets.RULE_VERBS)))}, ',') AS actions FROM pad"""
)
def entities_token(spark, d):
    """Companies, products and actions by whole tokens instead of substrings."""
    t = F.col("text")
    found = F.array_join(F.transform(W.companies(t, assets.RULE_COMPANIES, "token"), F.lower), ",")
    more = {"products": W.products(t, assets.RULE_PRODUCTS, "token"), "actions": W.actions(t, assets.RULE_VERBS, "token")}
    return _docs(spark, d).select("tweet_id", found.alias("companies"), *(F.array_join(c, ",").alias(k) for k, c in more.items()))


@docs_query(
    f"""{_PADDED}, g AS (SELECT tweet_id, {_by_tokens_sql(sorted(set(assets.GATE_COMPANIES + assets.GATE_PRODUCTS + assets.GATE_CONCEPTS)))} AS entity,
   {_by_tokens_sql(sorted(set(W.GATE_VERBS)))}[1] AS action FROM pad)
  SELECT tweet_id, array_to_string(entity, ',') AS entity, action, CASE WHEN len(entity) = 0 THEN 'no_entity' WHEN action IS NULL THEN 'no_action' END AS gate_reason FROM g"""
)
def dictionary_gate_token(spark, d):
    return W.gate(_docs(spark, d), match="token").select("tweet_id", F.array_join("entity", ",").alias("entity"), "action", "gate_reason")


@docs_query(
    rf""", dict AS (SELECT DISTINCT title AS entry, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') AS own FROM (SELECT trim(regexp_extract(text, '^\s*(\S+\s+\S+\s+\S+)', 1)) AS title FROM docs) WHERE title <> ''),
  entry AS (SELECT entry, len(own) AS size, array_to_string(own, ' ') AS run FROM dict WHERE len(own) BETWEEN 1 AND 8),
  grams AS (SELECT tweet_id, size, array_to_string(t[i:i + size - 1], ' ') AS run FROM (SELECT tweet_id, {_TOK} AS t FROM docs), (SELECT DISTINCT size FROM entry), unnest(range(1, len(t) - size + 2)) AS u(i) WHERE len(t) >= size)
  SELECT tweet_id, entry, count(*) AS n FROM grams JOIN entry USING (size, run) WHERE run IN (SELECT run FROM entry GROUP BY run) GROUP BY 1, 2"""
)
def token_dictionary(spark, d):
    """Which texts' first three words come, as whole tokens, in which texts: a dictionary that grows with the table."""
    docs = _docs(spark, d)
    head = F.trim(F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+)", 1))
    dictionary = docs.select(head.alias("entry")).where((F.col("entry") != "") & F.size(X.tokens(F.col("entry"))).between(1, W.LONGEST_ENTRY))
    return W.token_hits(docs, dictionary)


def _reasons(spark, d):
    t = F.col("text")
    n = F.size(W.companies(t, assets.RULE_COMPANIES)) + F.size(W.products(t, assets.RULE_PRODUCTS))
    return _docs(spark, d).select("tweet_id", W.rule_reason(t, F.array().cast("array<string>"), n, F.size(W.actions(t, assets.RULE_VERBS))).alias("drop_reason"))


@docs_query(f"SELECT tweet_id, {_RULE} AS drop_reason FROM docs JOIN comp USING (tweet_id) JOIN prod USING (tweet_id) JOIN verb USING (tweet_id)")
def hard_rules(spark, d):
    return _reasons(spark, d)


@docs_query(f"SELECT coalesce({_RULE}, 'kept') AS drop_reason, count(*) AS n FROM docs JOIN comp USING (tweet_id) JOIN prod USING (tweet_id) JOIN verb USING (tweet_id) GROUP BY 1")
def hard_rule_stats(spark, d):
    return _reasons(spark, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@docs_query(
    f"""SELECT tweet_id, CASE WHEN {_URLLESS} THEN 'only_url' WHEN starts_with(trim(text), 'RT @') THEN 'repost_form' WHEN len(c) + len(p) = 0 AND len(v) = 0 THEN 'no_entity_no_action'
  WHEN {_GENERIC.format(tok=_TOK, words=words_sql(assets.RULE_GENERIC))} THEN 'generic' END AS drop_reason FROM docs JOIN comp USING (tweet_id) JOIN prod USING (tweet_id) JOIN verb USING (tweet_id)"""
)
def hard_rules_ec(spark, d):
    t = F.col("text")
    n = F.size(W.companies(t, assets.RULE_COMPANIES)) + F.size(W.products(t, assets.RULE_PRODUCTS))
    return _docs(spark, d).select("tweet_id", W.event_reason(t, n, F.get(W.actions(t, assets.RULE_VERBS), F.lit(0))).alias("drop_reason"))


@docs_query(
    rf""", h AS (SELECT *, list_transform(regexp_extract_all(text, 'https?://([^\s/]+)', 1), lambda x: lower(replace(x, 'www.', ''))) AS hosts FROM docs)
  SELECT tweet_id, CASE WHEN list_has_any(hosts, {words_sql(assets.GATE_PLATFORMS)}) THEN 'platform' WHEN {_URLLESS} THEN 'only_url'
  WHEN {_GENERIC.format(tok=_TOK, words=words_sql(assets.GATE_STOPS))} THEN 'generic' END AS drop_reason FROM h"""
)
def hard_rules_new(spark, d):
    return _docs(spark, d).select("tweet_id", W.gated_reason(F.col("text")).alias("drop_reason"))


_NAMES = words_sql(sorted(set(assets.GATE_COMPANIES + assets.GATE_PRODUCTS + assets.GATE_CONCEPTS)))
_GATED = f""", g AS (SELECT *, list_filter({_NAMES}, lambda w: contains(upper(text), upper(w)) OR contains(lower(text), lower(w))) AS entity,
  list_filter({words_sql(sorted(set(W.GATE_VERBS)))}, lambda w: contains(lower(text), lower(w)))[1] AS action FROM docs)"""


@docs_query(_GATED + " SELECT tweet_id, array_to_string(entity, ',') AS entity, action, CASE WHEN len(entity) = 0 THEN 'no_entity' WHEN action IS NULL THEN 'no_action' END AS gate_reason FROM g")
def dictionary_gate(spark, d):
    return W.gate(_docs(spark, d)).select("tweet_id", F.array_join("entity", ",").alias("entity"), "action", "gate_reason")


@docs_query(
    f""", ph AS (SELECT DISTINCT a.tweet_id, a.word || ' ' || b.word AS p FROM tok a JOIN tok b ON a.tweet_id = b.tweet_id AND b.pos = a.pos + 1 WHERE length(a.word) > 2 AND length(b.word) > 2),
  c AS (SELECT tweet_id, unnest(list_filter({words_sql(assets.COMPANIES)}, lambda w: contains(lower(text), w))) AS w FROM docs)
  SELECT 'company' AS seed_type, upper(w[1]) || w[2:] AS seed_key, tweet_id FROM c
  UNION ALL SELECT 'phrase', p, tweet_id FROM ph WHERE len(list_filter({words_sql(assets.TOPIC_KEYWORDS)}, lambda w: contains(p, w))) > 0"""
)
def event_seeds(spark, d):
    return W.event_seeds(_docs(spark, d))


@docs_query(", e AS (SELECT DISTINCT tweet_id, unnest(p) AS x FROM prod) SELECT a.x AS a, b.x AS b, count(*) AS weight FROM e a JOIN e b ON a.tweet_id = b.tweet_id AND a.x < b.x GROUP BY 1, 2")
def entity_cooccurrence(spark, d):
    return W.co_occurrence(_docs(spark, d).select("tweet_id", F.explode(W.products(F.col("text"), assets.RULE_PRODUCTS)).alias("entity")))


_KINDS = " UNION ALL ".join(
    f"SELECT tweet_id, '{k}' AS kind, {i} AS o, len(list_filter({words_sql(ws)}, lambda w: contains(lower(text), w))) AS hits FROM docs" for i, (k, ws) in enumerate(assets.EVENT_KINDS.items())
)


@docs_query(f", s AS ({_KINDS}) SELECT tweet_id, kind, hits::INTEGER AS hits FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY hits DESC, o) AS n FROM s) WHERE n = 1 AND hits > 0")
def event_kinds(spark, d):
    return W.event_kind(_docs(spark, d))


@docs_query(", " + _emb(3, assets.EMBEDDING_STOPS, 256) + " SELECT tweet_id, dim, round(w, 6) AS w FROM emb")
def hash_embedding(spark, d):
    return D.hash_embedding(_docs(spark, d)).select("tweet_id", "dim", F.round("w", 6).alias("w"))


@docs_query(", " + _emb(3, (), None) + " SELECT tweet_id, dim, round(w, 6) AS w FROM emb")
def hash_embedding_rule(spark, d):
    return D.hash_embedding(_docs(spark, d), 3, (), None).select("tweet_id", "dim", F.round("w", 6).alias("w"))


@docs_query(
    """, c AS (SELECT tweet_id, word, ln(1 + count(*)) AS w, min(pos) AS pos FROM tok WHERE length(word) > 2 GROUP BY 1, 2),
  s AS (SELECT tweet_id, row_number() OVER (PARTITION BY tweet_id ORDER BY pos) - 1 AS dim, w FROM c)
  SELECT tweet_id, dim::INTEGER AS dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY tweet_id)), 6) AS w FROM s WHERE dim < 128"""
)
def embedding_v1(spark, d):
    return D.rank_embedding(_docs(spark, d)).select("tweet_id", F.col("dim").cast("int").alias("dim"), F.round("w", 6).alias("w"))


_SIM = ", " + _emb(3, assets.EMBEDDING_STOPS, 256) + ", " + _DENSE + ", sim AS (SELECT a.tweet_id AS a, b.tweet_id AS b, list_inner_product(a.v, b.v) AS cos FROM vec a JOIN vec b ON a.tweet_id < b.tweet_id)"


@docs_query(_SIM + " SELECT a, b, round(cos, 6) AS cos FROM sim WHERE cos > 0.93")
def similarity_edges(spark, d):
    return D.similar_pairs(_vectors(spark, d), 0.93).select("a", "b", F.round("cos", 6).alias("cos"))


_VECTORS = """WITH RECURSIVE unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sim AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cos FROM unit a JOIN unit b ON a.id < b.id)"""


def _given_vectors(spark, d):
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("tweet_id"), F.col("embedding").cast("array<double>").alias("v"))


@query(_VECTORS + " SELECT a, b, round(cos, 6) AS cos FROM sim WHERE cos > 0.35", base=False)
def vec_similar(spark, d):
    return D.similar_pairs(_given_vectors(spark, d), 0.35).select("a", "b", F.round("cos", 6).alias("cos"))


@query(
    _VECTORS
    + """, near AS MATERIALIZED (SELECT a, b FROM sim WHERE cos >= 0.4 UNION ALL SELECT b, a FROM sim WHERE cos >= 0.4), reach AS (SELECT id AS x, id AS y FROM unit UNION SELECT r.x, n.b FROM reach r JOIN near n ON n.a = r.y)
  SELECT x AS id, min(y) AS component FROM reach GROUP BY 1""",
    base=False,
)
def vec_components(spark, d):
    return S.similar_components(_given_vectors(spark, d).withColumnRenamed("tweet_id", "id"), 0.4, at_least=True)


@docs_query(
    _SIM
    + """, linked AS (SELECT a, b, (abs(x.created_ts - y.created_ts) <= 172800)::INTEGER + (list_has_any(p.p, q.p))::INTEGER + (x.author <> y.author)::INTEGER AS satisfied, cos
   FROM sim JOIN docs x ON x.tweet_id = a JOIN docs y ON y.tweet_id = b JOIN prod p ON p.tweet_id = a JOIN prod q ON q.tweet_id = b WHERE cos >= 0.65)
  SELECT a, b, satisfied, round(cos, 6) AS cos FROM linked WHERE satisfied >= 2"""
)
def constrained_pairs(spark, d):
    e = _docs(spark, d).select(F.col("tweet_id").alias("id"), F.col("created_ts").alias("time"), W.products(F.col("text"), assets.RULE_PRODUCTS).alias("entity"), "author")
    none = e.select(F.col("id").alias("source"), F.col("id").alias("target")).where("1 = 0")
    similar = S.similar_classes(_vectors(spark, d).withColumnRenamed("tweet_id", "id"), 0.65, at_least=True)
    return Z.similar_conditions(similar, e, none).select("a", "b", "satisfied", F.round("cos", 6).alias("cos"))


_EV = """, ev AS (SELECT tweet_id AS id, created_ts AS time, author, entity, action, CASE WHEN tweet_id::BIGINT % 5 = 0 THEN (tweet_id::BIGINT % 40)::VARCHAR ELSE '' END AS anchor_id FROM g WHERE len(entity) > 0),
  wp AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.anchor_id = b.anchor_id AND a.anchor_id <> '' THEN 10.0 WHEN list_has_any(a.entity, b.entity) AND coalesce(a.action = b.action, false) THEN 8.0
   WHEN list_has_any(a.entity, b.entity) AND abs(a.time - b.time) <= 172800 THEN 6.0 WHEN a.author <> b.author AND abs(a.time - b.time) <= 172800 AND coalesce(a.action = b.action, false) THEN 4.0 END::DOUBLE AS weight
   FROM ev a JOIN ev b ON a.id < b.id)"""


def _events(spark, d):
    g = W.gate(_docs(spark, d)).where(F.size("entity") > 0)
    number = F.col("tweet_id").cast("long")
    anchor = F.when(number % 5 == 0, (number % 40).cast("string")).otherwise("")
    return g.select(F.col("tweet_id").alias("id"), F.col("created_ts").alias("time"), "author", "entity", "action", anchor.alias("anchor_id"))


@docs_query(_GATED + _EV + " SELECT a, b, weight FROM wp WHERE weight IS NOT NULL")
def new_pairs(spark, d):
    return V.weighted_pairs(_events(spark, d))


@docs_query(_GATED + _EV + " SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.id < b.id AND abs(a.time - b.time) <= 172800 WHERE a.author <> b.author OR list_has_any(a.entity, b.entity) OR coalesce(a.action = b.action, false)")
def ec_pairs(spark, d):
    e = _events(spark, d)
    none = e.select(F.col("id").alias("source"), F.col("id").alias("target")).where("1 = 0")
    return V.condition_count(V.near_pairs(e), e, none, with_action=True).where("satisfied >= 2").select("a", "b")


@docs_query(
    _SIM
    + """, near AS MATERIALIZED (SELECT a, b FROM sim WHERE cos >= 0.95 UNION ALL SELECT b, a FROM sim WHERE cos >= 0.95), reach AS (SELECT tweet_id AS x, tweet_id AS y FROM vec UNION SELECT r.x, n.b FROM reach r JOIN near n ON n.a = r.y)
  SELECT x AS id, min(y) AS component FROM reach GROUP BY 1"""
)
def connected_components(spark, d):
    return S.similar_components(_vectors(spark, d).withColumnRenamed("tweet_id", "id"), 0.95, at_least=True)


@docs_query(
    _SIM
    + """, near AS MATERIALIZED (SELECT a, b FROM sim WHERE cos >= 0.6 UNION ALL SELECT b, a FROM sim WHERE cos >= 0.6), core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING count(*) + 1 >= 2),
  inner_ AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
  reach AS (SELECT a AS x, a AS y FROM core UNION SELECT r.x, n.b FROM reach r JOIN inner_ n ON n.a = r.y), cc AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
  SELECT tweet_id AS id, coalesce(o.c, (SELECT min(cc.c) FROM near JOIN cc ON near.b = cc.x WHERE near.a = tweet_id), tweet_id) AS component FROM vec LEFT JOIN cc o ON o.x = tweet_id"""
)
def dbscan(spark, d):
    return S.similar_density(_vectors(spark, d).withColumnRenamed("tweet_id", "id"), 0.6, 2)


@docs_query(
    _SIM
    + """, m AS (SELECT author AS cluster_id, tweet_id, row_number() OVER (PARTITION BY author ORDER BY tweet_id) AS p FROM docs JOIN vec USING (tweet_id))
  SELECT cluster_id, round(avg(list_inner_product(x.v, y.v)), 6) AS coherence FROM m a JOIN m b USING (cluster_id) JOIN vec x ON x.tweet_id = a.tweet_id JOIN vec y ON y.tweet_id = b.tweet_id WHERE a.p < b.p AND b.p <= 10 GROUP BY 1"""
)
def coherence(spark, d):
    docs = _docs(spark, d)
    some = F.exists(X.tokens(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*assets.EMBEDDING_STOPS))  # who has a vector
    # only posts that are compared are embedded
    members = staged(D.first_members(docs.where(some).select(F.col("author").alias("cluster_id"), "tweet_id")), "first-members")
    v = D.hash_vectors(docs.join(members.select("tweet_id"), "tweet_id", "left_semi"))
    return D.coherence(members, v).select("cluster_id", F.round("coherence", 6).alias("coherence"))


@docs_query(_GATED + _EV + ", hv AS MATERIALIZED (SELECT * FROM wp WHERE weight >= 4)" + leaders_sql("ev", "hv", by_weight=True) + " SELECT id, leader FROM grown")
def incremental_new(spark, d):
    """Weighted leader clustering of gated events."""
    e = staged(_events(spark, d), "events")
    return V.block_leaders(e, lambda leaders, events: V.weighted_pairs(events, leaders).where("weight >= 4"), by_weight=True).select("id", "leader")


@docs_query(_SIM + ", hv AS MATERIALIZED (SELECT a, b, 1.0::DOUBLE AS weight FROM sim WHERE cos > 0.75), pts AS (SELECT tweet_id AS id FROM vec)" + leaders_sql("pts", "hv") + " SELECT id, leader FROM grown")
def greedy_distance(spark, d):
    return S.similar_leaders(_vectors(spark, d).withColumnRenamed("tweet_id", "id"), 0.75)


@docs_query(
    _SIM
    + """, touch AS MATERIALIZED (SELECT DISTINCT a AS id FROM sim WHERE cos > 0.69 UNION SELECT DISTINCT b FROM sim WHERE cos > 0.69),
  near AS MATERIALIZED (SELECT * FROM sim WHERE a IN (SELECT id FROM touch) AND b IN (SELECT id FROM touch)),
  lk(step, id, c) AS (SELECT 0, tweet_id, tweet_id FROM vec UNION ALL
  SELECT l.step + 1, l.id, CASE WHEN l.c = b.hi THEN b.lo ELSE l.c END FROM lk l, (SELECT least(x.c, y.c) AS lo, greatest(x.c, y.c) AS hi
    FROM lk x JOIN near s ON s.a = x.id JOIN lk y ON y.id = s.b WHERE x.c <> y.c GROUP BY 1, 2 HAVING round(avg(s.cos), 10) > 1 - 0.3 ORDER BY round(avg(s.cos), 10) DESC, 1, 2 LIMIT 1) b)
  SELECT id, c AS cluster FROM lk WHERE step = (SELECT max(step) FROM lk)"""
)
def avg_linkage(spark, d):
    v = staged(_vectors(spark, d).withColumnRenamed("tweet_id", "id"), "vectors")
    return C.average_linkage(v, S.similar_components(v, 0.7), 0.3)


@query()
def communities(spark, d):
    from ..operators import edges as E

    r = run(spark, d)
    e = E.author_interactions(r.weeks_edges, r.weeks).select(F.col("author_a").alias("a"), F.col("author_b").alias("b"), F.col("weight").cast("double").alias("weight"))
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    return C.communities(e, C.components(nodes, e))


@query(
    ", tg AS (SELECT DISTINCT target::BIGINT AS id FROM wedges), ak AS (SELECT tweet_id::BIGINT AS id, tweet_id::BIGINT IN (SELECT id FROM tg) AS is_anchor FROM weeks), ae0 AS (SELECT source::BIGINT AS source, target::BIGINT AS target FROM wedges)"
    + anchors_sql("ak", "ae0", "is_anchor")
    + " SELECT cluster_id, id FROM anchored"
)
def anchor_clusters(spark, d):
    r = run(spark, d)
    edges = r.weeks_edges.select(F.col("source_tweet_id").alias("source"), F.col("target_tweet_id").alias("target"))
    anchors = edges.select(F.col("target").alias("tweet_id"), F.lit(True).alias("is_anchor")).distinct()
    ids = r.weeks.join(anchors, "tweet_id", "left").select(F.col("tweet_id").cast("long").alias("id"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    return V.anchor_clusters(ids, edges.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")))


@query(
    """, pe AS (SELECT p.*, likes + 2 * reposts + 0.5 * replies + 1.5 * quotes AS eng, followers FROM weeks p LEFT JOIN roster ON username = author),
  pr AS (SELECT s.tag AS cluster_id, count(*) AS n FROM wedges e JOIN weeks s ON s.tweet_id = e.source JOIN weeks t ON t.tweet_id = e.target AND t.tag = s.tag GROUP BY 1)
  SELECT tag AS cluster_id, count(*) AS tweet_cnt, count(DISTINCT author) AS author_cnt, sum(eng)::DOUBLE AS engagement, coalesce(max(n), 0)::BIGINT AS propagation,
   round(ln(1 + sum(eng)) + 3.0 * count(DISTINCT author) + 1.5 * ln(1 + coalesce(max(n), 0)) + 0.5 * ln(1 + count(*)) + 0.3 * ln(1 + sum(coalesce(followers, 0)) / greatest(count(DISTINCT author), 1)), 6) AS event_score
  FROM pe LEFT JOIN pr ON cluster_id = tag GROUP BY tag HAVING count(DISTINCT author) >= 2"""
)
def tag_cluster_score(spark, d):
    r = run(spark, d)
    m = lambda c: F.col(f"public_metrics.{c}_count")
    events = r.weeks.select(F.col("tweet_id").alias("id"), "author", X.weighted_engagement(m("like"), m("repost"), m("reply"), m("quote")).alias("engagement"))
    members = r.weeks.select(F.get("entities.hashtags", F.lit(0)).alias("cluster_id"), F.col("tweet_id").alias("id"))
    edges = r.weeks_edges.select(F.col("source_tweet_id").alias("source"), F.col("target_tweet_id").alias("target"))
    out = V.cluster_scores(members, events, edges, r.roster)
    return out.select("cluster_id", "tweet_cnt", "author_cnt", "engagement", "propagation", F.round("event_score", 6).alias("event_score"))
