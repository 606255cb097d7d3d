"""Operators against hand-made rows, and label machines against naive loops."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import scalars as X
from emberline.operators import cluster as C
from emberline.operators import edges as E
from emberline.operators import normalize as N
from emberline.operators import series as S
from emberline.operators import text as W
from emberline.operators import topics as T
from emberline.operators import vectors as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "name, a, b",
    [(None, "", ""), ("", "", ""), ("@@Foo ", "foo", "foo"), (" @Foo", "@foo", "foo"), ("a@b", "a@b", "ab"), ("\t@X\n", "@x", "x")],
)
def test_usernames(spark, name, a, b):
    assert one(spark, name, X.norm_username) == a
    assert one(spark, name, X.norm_username_all) == b


@pytest.mark.parametrize(
    "url, a, b",
    [
        ("https://www.Site.com/p", "Site.com", "site.com"),
        ("https://u:p@host:8080/x?q", "u:p@host:8080", "u:p@host:8080"),
        ("site.com/p", None, "site.com/p"),
        ("//www.www.a.b", "www.a.b", "a.b"),
        (None, None, ""),
        ("", None, ""),
    ],
)
def test_domains(spark, url, a, b):
    assert one(spark, url, X.url_domain) == a
    assert one(spark, url, X.url_domain_or_path) == b


def test_times(spark):
    given = [("1", "2024-01-01T23:30:00Z"), ("2", "2024-01-01T23:30:00+00:00"), ("3", "2024-01-01T23:30:00"), ("4", None), ("5", "bad")]
    got = {r.tweet_id: r for r in N.with_times(spark.createDataFrame(given, "tweet_id string, created_at string")).collect()}
    assert [got[i].local_date for i in "123"] == ["2024-01-02"] * 3
    assert got["1"].created_at_local == "2024-01-02T07:30:00+08:00"
    assert (got["4"].created_ts, got["4"].local_date) == (0, "")
    assert (got["5"].created_ts, got["5"].created_at_local, got["5"].local_date) == (0, "bad", "")


def test_text_and_entities(spark):
    schema = "text string, entities struct<hashtags:array<string>,cashtags:array<string>,mentions:array<string>,urls:array<struct<url:string,expanded_url:string>>>"
    p = spark.createDataFrame([(" go  http://a.b/c \n now", (["AI", "Ai"], [], ["@Me"], [("http://a.b/c", "http://z"), (None, "https://www.q.com/x")]))], schema)
    r = N.with_clean_entities(N.with_clean_text(p)).first()
    assert r.clean_text == "go <URL> now"
    assert r.entities.hashtags == ["ai", "ai"] and r.entities.mentions == ["me"]
    assert r.url_domains == ["a.b", "q.com"]


def test_latest(spark):
    given = [("1", 5, "a"), ("1", 7, "a"), ("1", 7, "longer"), ("", 9, "x"), ("2", 1, "same"), ("2", 1, "same")]
    got = rows(N.latest(spark.createDataFrame(given, "tweet_id string, created_ts long, text string")))
    assert got == [("1", 7, "longer"), ("2", 1, "same")]


def test_edges_and_references(spark):
    schema = "tweet_id string, author_username string, created_at string, local_date string, referenced_tweets array<struct<type:string,id:string>>"
    given = [("1", "@A", "t", "d", [("reposted", "9"), ("replied_to", "8"), ("quoted", "")]), ("2", "B", "t", "d", None), ("3", "", "t", "d", [("quoted", "9")]), ("4", "a", "t", "d", [("quoted", "9")])]
    e = E.propagation_edges(spark.createDataFrame(given, schema))
    assert [(r[0], r[1], r[2], r[3]) for r in rows(e)] == [("1", "a", "9", "reposted"), ("3", "", "9", "quoted"), ("4", "a", "9", "quoted")]
    assert rows(E.reference_counts(e)) == [("9", 3, 1)]


def test_repeated_tag_counts_twice_in_sums_only(spark):
    posts = spark.createDataFrame([("1", "a", (10, 1, 0, 0))], "tweet_id string, author string, public_metrics struct<like_count:long,repost_count:long,reply_count:long,quote_count:long>")
    found = spark.createDataFrame([("hashtag", "ai", "1", "a")] * 2, "topic_type string, topic_key string, tweet_id string, author_username string")
    edges = spark.createDataFrame([("5", "b", "1")], "source_tweet_id string, source_author_username string, target_tweet_id string")
    r = T.aggregate(found, posts, edges).first()
    assert (r.tweet_cnt, r.unique_author_cnt, r.sum_like_cnt, r.ref_cnt) == (1, 1, 20, 1)


def test_top_tiered(spark):
    given = [("center_tweet", "c1", 1, 1, 99.0), ("center_tweet", "c2", 1, 2, 1.0), ("hashtag", "h1", 1, 1, 50.0), ("hashtag", "h2", 2, 1, 2.0), ("domain", "d", 1, 1, 50.0)]
    got = T.top_tiered(spark.createDataFrame(given, "topic_type string, topic_key string, tweet_cnt long, unique_author_cnt long, hot_score double"))
    assert [r.topic_key for r in got.orderBy("rank").collect()] == ["h2", "c2", "d", "h1", "c1"]


def trend(series):
    """series: (authors, tweets) by observed date, oldest first."""
    *past, (a, t) = series[-8:]
    mean = sum(x for x, _ in past) / len(past)
    if not (a >= 1 or t >= 2):
        return None
    if a > 0 and mean == 0:
        return "Emerging"
    if a >= 1.5 * mean and (a >= 2 or t >= 2):
        return "Rising"
    if a >= 3 or t >= 5:
        return "Peak" if a >= max(x for x, _ in past) or t >= max(x for _, x in past) else None
    if a <= 0.5 * mean and mean > 0:
        return "Fading"
    if 0.8 * mean <= a <= 1.2 * mean and (mean >= 2 or t >= 3):
        return "Persistent"
    return None


@pytest.mark.parametrize("dates", [2, 8, 11])
def test_trends_against_loop(spark, dates):
    rng = random.Random(dates)
    table, want = [], {}
    for k in range(60):
        series = [(rng.choice([0, 0, 1, 2, 3, 6]), rng.choice([0, 1, 3, 6])) for _ in range(dates)]
        table += [("hashtag", f"k{k}", f"d{i:02d}", t, a, 0, 0) for i, (a, t) in enumerate(series) if a or t]
        want[f"k{k}"] = trend(series)
    table += [("hashtag", "every", f"d{i:02d}", 1, 1, 0, 0) for i in range(dates)]
    daily = spark.createDataFrame(table, "topic_type string, topic_key string, local_date string, tweet_cnt long, unique_author_cnt long, sum_repost_cnt long, ref_cnt long").repartition(3)
    keys = spark.createDataFrame([("hashtag", k) for k in want], "topic_type string, topic_key string")
    got = {r.topic_key: r.trend_label for r in S.topic_trends(daily, keys).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_one_date_has_no_trends(spark):
    daily = spark.createDataFrame([("hashtag", "k", "d1", 5, 5, 0, 0)], "topic_type string, topic_key string, local_date string, tweet_cnt long, unique_author_cnt long, sum_repost_cnt long, ref_cnt long")
    assert S.topic_trends(daily, daily.select("topic_type", "topic_key")).isEmpty()


def test_rule_reasons(spark):
    given = ["https://a.b <URL>", "RT @x hi", "via short", "AI market", "launch now", "other words", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, text string")
    reason = W.rule_reason(F.col("text"), F.array().cast("array<string>"), F.size(W.products(F.col("text"), ("AI",))), F.size(W.actions(F.col("text"), ("launch",))))
    got = [r.x for r in df.select("i", reason.alias("x")).orderBy("i").collect()]
    assert got == ["only_url", "repost_form", "repost_form", "generic", None, "no_entity_no_action", "only_url"]


def test_leaders_of_a_long_chain(spark):
    items = spark.range(110).coalesce(1).select("id", F.col("id").alias("ord"))
    chain = items.where("id > 0").select((F.col("id") - 1).alias("leader"), F.col("id").alias("follower"), F.lit(1.0).alias("weight"))
    assert dict(C.leaders(items, chain).collect()) == {i: i - i % 2 for i in range(110)}
    circle = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "leader long, follower long, weight double")
    with pytest.raises(RuntimeError):
        C.leaders(items, circle)


def test_latest_without_lengths_and_by_partitions(spark):
    given = [("a", 5, "short"), ("a", 5, "a longer text"), ("a", 4, "the longest text of all"), ("b", None, "no time"), ("b", -3, "early"), ("", 9, "no id"), (None, 9, "no id"), ("c", None, "x"), ("c", None, "yy")]
    schema = "tweet_id string, created_ts long, text string"
    want = {True: [("a", 5, "a longer text"), ("b", -3, "early"), ("c", None, "yy")], False: [("a", 5, "a longer text"), ("b", -3, "early"), ("c", None, "x")]}
    for parts in (1, 5):
        for order in (given, given[::-1]):
            for by_length, rows_ in want.items():  # without lengths the smallest record, as JSON, is kept
                assert rows(N.latest(spark.createDataFrame(order, schema).repartition(parts), by_length)) == sorted(rows_, key=str)
    hot = spark.range(30_000).selectExpr("'hot' tweet_id", "id % 500 created_ts", "cast(id as string) text")
    assert rows(N.latest(hot)) == [("hot", 499, "10499")]


def test_clean_by_time_only(spark):
    entities = "struct<hashtags:array<string>,cashtags:array<string>,mentions:array<string>,urls:array<struct<url:string,expanded_url:string>>>"
    posts = [("1", "@Ann", "2024-05-01T10:00:00Z", "see  https://t.co/x\nnow", (["AI"], [], ["@Bob"], [("https://t.co/x", "https://www.a.com/p")])), ("1", "ann", "2024-05-01T10:00:00Z", "b", ([], [], [], [])), ("2", "zed", "2024-05-01T10:00:00Z", "c", ([], [], [], []))]
    df = spark.createDataFrame(posts, f"tweet_id string, author_username string, created_at string, text string, entities {entities}")
    roster = spark.createDataFrame([("ANN",)], "username string")
    by_length, by_time = N.clean(df, roster).collect(), N.clean(df, roster, by_length=False).collect()
    assert [r.tweet_id for r in by_length] == [r.tweet_id for r in by_time] == ["1"]
    assert (by_length[0].clean_text, by_length[0].entities.hashtags, by_length[0].entities.mentions, by_length[0].author) == ("see <URL> now", ["ai"], ["bob"], "ann")
    # of two records of one time the smaller one as JSON: its author comes before "ann"
    assert by_time[0].author_username == "@Ann" and by_time[0].local_date == "2024-05-01"


def test_components_and_leaders_against_loops(spark):
    rng = random.Random(5)
    for trial in range(2):
        n = 25
        pairs = {(a, b): rng.choice([4.0, 6.0, 8.0]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "id int, ord int")
        table = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a int, b int, weight double")
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert rows(C.components(nodes, table)) == sorted(((i, find(i)) for i in range(n)), key=str)
        compat = table.select(F.col("a").alias("leader"), F.col("b").alias("follower"), "weight")
        for by_weight in (False, True):
            lead, want = [], {}
            for i in range(n):
                fits = [(pairs[(a, i)], a) for a in lead if (a, i) in pairs]
                if not fits:
                    lead.append(i)
                    want[i] = i
                else:
                    want[i] = min(fits, key=lambda x: (-x[0], x[1]))[1] if by_weight else min(a for _, a in fits)
            assert dict(C.leaders(nodes, compat, by_weight).collect()) == want


def test_average_linkage_keeps_far_chains_apart(spark):
    import math

    v = [(i, [math.cos(x), math.sin(x)]) for i, x in enumerate([0.0, 0.1, 0.6, 0.7, 3.0])]
    vectors = spark.createDataFrame(v, "id int, v array<double>")
    pairs = D.similar_pairs(vectors.withColumnRenamed("id", "tweet_id"), 0.8)
    within = C.components(vectors.select("id"), pairs)
    assert dict(C.average_linkage(vectors, within, 0.1).collect()) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 1.0)]
    e = spark.createDataFrame(edges, "a int, b int, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id int")
    got = dict(C.communities(e, C.components(nodes, e)).collect())
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[7]


def test_similar_pairs_against_numpy(spark, monkeypatch):
    import numpy as np

    from emberline.operators import similarity

    monkeypatch.setattr(similarity, "TILE", 10)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(45, 6))
    v[3] = 0
    got = {(r.a, r.b) for r in D.similar_pairs(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "tweet_id int, v array<double>"), 0.6).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert got == {(i, j) for i in range(45) for j in range(i + 1, 45) if u[i] @ u[j] > 0.6}


def test_streaming_counts(spark, tmp_path):
    from emberline.sources.jsonl import RAW_POST, read_posts
    from emberline.streaming.topics import tag_counts, unique_posts

    line = '{"tweet_id": "%s", "author_username": "@A", "created_at": "2024-01-01T00:10:00Z", "entities": {"hashtags": ["AI"], "urls": ["http://x.y", {"url": "http://t.co/1", "expanded_url": "http://z"}]}}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([line % "1", line % "1", line % "2", "not json"]))
    posts = read_posts(spark, str(tmp_path / "in/a.json"))
    assert posts.count() == 3
    assert [u.url for u in posts.first().entities.urls] == ["http://x.y", "http://t.co/1"]
    stream = spark.readStream.schema(RAW_POST).option("mode", "DROPMALFORMED").json(str(tmp_path / "in"))
    query = tag_counts(unique_posts(stream), "1 hour", "1 hour").writeStream.format("memory").queryName("tags").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r.topic_key, r.tweet_cnt) for r in spark.table("tags").collect()] == [("ai", 2)]


def test_sources(spark, tmp_path):
    from emberline.sources import jsonl as J

    array, keyed, lines = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.jsonl"
    array.write_text('[{"username": "x", "followers_count": 3}]')
    keyed.write_text('{"k1": {"username": "x"}, "k2": {"username": "y", "verified": true}}')
    lines.write_text('{"username": "x"}\n{"username": "y"}\n')
    assert [J.read_candidates(spark, str(p)).count() for p in (array, keyed, lines)] == [1, 2, 2]
    assert J.read_jsonl(spark, str(tmp_path / "none"), J.ACCOUNT).isEmpty()
    roster = tmp_path / "r.json"
    roster.write_text('{"all": [{"username": "@A", "followers_count": 1}, {"username": "a", "followers_count": 7}, {"username": "b"}]}')
    assert rows(J.read_roster(spark, str(roster))) == [("a", 7), ("b", 0)]
    J.write_report(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "o.json"))
    assert "é" in (tmp_path / "o.json").read_text()


def test_block_leaders_against_loop(spark):
    from emberline.operators import events as V

    rng = random.Random(3)
    given = [(f"{i:03d}", rng.randrange(0, 400) * 3600, [rng.choice("pqrstu")] if rng.random() < 0.6 else [], rng.choice("xyz"), rng.choice([None, "a", "b", "c"]), rng.choice(["", "", "k1", "k2"])) for i in range(60)]
    e = spark.createDataFrame(given, "id string, time long, entity array<string>, author string, action string, anchor_id string")

    def weight(x, y):
        near, shared, same = abs(x[1] - y[1]) <= V.NEAR, bool(set(x[2]) & set(y[2])), x[4] is not None and x[4] == y[4]
        return 10 if x[5] and x[5] == y[5] else 8 if shared and same else 6 if shared and near else 4 if x[3] != y[3] and near and same else 0

    lead, want = [], {}
    for x in given:
        fits = [(-weight(y, x), y[0]) for y in lead if weight(y, x)]
        want[x[0]] = min(fits)[1] if fits else x[0]
        if not fits:
            lead.append(x)
    for block in (7, 1000):
        got = {r.id: r.leader for r in V.block_leaders(e, lambda leaders, events: V.weighted_pairs(events, leaders), block, by_weight=True).collect()}
        assert got == want


def test_anchors_take_earlier_followers(spark):
    from emberline.operators import events as V

    e = spark.createDataFrame([(1, False), (2, False), (5, True), (7, True), (9, True), (10, True)], "id int, is_anchor boolean")
    edges = spark.createDataFrame([(1, 9), (2, 9), (2, 10), (7, 5), (1, 7), (3, 9)], "source int, target int")
    assert set(rows(V.anchor_clusters(e, edges))) == {(5, 5), (5, 7), (9, 1), (9, 2), (9, 9), (10, 10)}


def test_large_components_by_joins(spark):
    rng = random.Random(8)
    edges = sorted({(a, b) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.35})
    e = spark.createDataFrame([(a, b, float(rng.choice([1, 2, 3]))) for a, b in edges], "a int, b int, weight double")
    within = C.components(spark.createDataFrame([(i,) for i in range(7)], "id int"), e)
    assert rows(C.communities(e, within, most=0)) == rows(C.communities(e, within))
    import math

    v = [(i, [math.cos(x), math.sin(x)]) for i, x in enumerate([0.0, 0.1, 0.1, 0.61, 0.7, 3.0, 2.9])]
    vectors = spark.createDataFrame(v + [(9, [0.0, 0.0])], "id int, v array<double>")
    one_part = vectors.select("id", F.lit(0).alias("component"))
    for most in (0, 100):
        assert dict(C.average_linkage(vectors, one_part, 0.1, most).collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 9: 9}


def test_seeded_scores_and_merging(spark):
    from emberline.operators import events as V

    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "cluster_id string, id int")
    entities = spark.createDataFrame([("a", "tickers", "$T", 1), ("b", "tickers", "$T", 1), ("b", "companies", "X", 1), ("c", "companies", "X", 1), ("d", "hashtags", "h", 1)], "cluster_id string, kind string, name string, posts int")
    phrases = spark.createDataFrame([("a", "p q"), ("d", "p q")], "cluster_id string, phrase string")
    # b follows a by its ticker; c shares a company with b only, and b leads nothing
    assert rows(V.merge_events(members, entities, phrases)) == [("a", 1), ("a", 2), ("c", 3), ("d", 4)]
    lone = spark.createDataFrame([(1, "x", 40.0), (2, "x", 60.0), (3, "y", 120.0), (4, "z", 3.0)], "id int, author string, engagement double")
    none = spark.createDataFrame([], "cluster_id string, propagation long")
    c = spark.createDataFrame([("b", 0.5)], "cluster_id string, coherence double")
    import math

    got = {r.cluster_id: r.event_score for r in V.seeded_scores(members, lone, none, c).collect()}
    assert set(got) == {"b", "c"}
    one = 3 + 0.5 * math.log(2) ** 2
    assert got["b"] == pytest.approx(0.3 * (math.log1p(60) + one + 1)) and got["c"] == pytest.approx(0.7 * (math.log1p(120) + one))


def test_novelty_of_what_began_a_day_ago(spark):
    from emberline.operators import events as V

    hours = [0, 23, 24, 72, 73]
    df = spark.createDataFrame([(1_000_000 - h * 3600,) for h in hours], "t long")
    assert [r.x for r in df.select(V.is_new(F.col("t"), 1_000_000).alias("x")).collect()] == [0, 0, 1, 1, 0]


def test_profiles_and_pools(spark, tmp_path):
    from emberline.operators import pool as P
    from emberline.sources import jsonl as J

    p = tmp_path / "p.json"
    p.write_text('{"@A": {"followers_count": 5}, "b": {}}')
    assert rows(J.read_profiles(spark, str(p))) == [("a", 5), ("b", None)]
    assert J.read_profiles(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "e.json").write_text("")
    assert J.read_candidates(spark, str(tmp_path / "e.json")).isEmpty()
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"username": "x"}\nnot json\n')
    assert J.read_candidates(spark, str(bad)).count() == 1
    with pytest.raises(Exception):
        J.read_jsonl(spark, str(bad), J.CANDIDATE, strict=True).collect()
    with pytest.raises(Exception):
        J.read_jsonl(spark, str(tmp_path / "none"), J.CANDIDATE, missing_ok=False).collect()
    J.write_jsonl(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().a == "é"
    pool = spark.createDataFrame([("u", 300, "", 1, True)], J.CANDIDATE)
    assert P.select_seeds(pool, 1).count() == 1
    with pytest.raises(ValueError):
        P.select_seeds(pool, 2)


def test_embedder_and_fallback(spark):
    posts = spark.createDataFrame([(1, "good words"), (2, "bad words"), (3, "x" * 9)], "tweet_id int, text string")

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.tweet_id: r.v for r in D.embed(posts, embedder, most=5, batch=1).collect()}
    assert got[1] == [5.0, 1.0] and got[3] == [5.0, 1.0] and len(got[2]) == 256
    assert D.embed(posts).where("hashed").count() == 3
    marks = {r.tweet_id: r.hashed for r in D.embed(posts, embedder, most=5, batch=1).collect()}
    assert set(marks.values()) == {False, True} and all(len(got[i]) == 2 for i, hashed in marks.items() if not hashed)
    with pytest.raises(Exception, match="ValueError"):
        D.embed(posts, embedder, most=5, batch=1, strict=True).collect()


def test_display_helpers(spark):
    assert [one(spark, v, X.ticker) for v in ("T", "$T")] == ["$T", "$T"]
    assert one(spark, "7", lambda c: X.permalink(F.lit("me"), c)) == "https://x.com/me/status/7"
    from emberline.operators import semantic as S

    long = "a" * 60 + ". " + "b" * 100
    assert [one(spark, v, S.key_sentence) for v in ("http://x.y", "short. text", long)] == [S.NO_SENTENCE, "short. text", "a" * 60 + "."]
    found = one(spark, "Tiny. We saw the new Gemini model in use today! More", lambda c: S.context(c, F.lit("gemini")))
    assert found == "the new Gemini model in" and one(spark, "nothing here at all, really", lambda c: S.context(c, F.lit("gemini"))) is None


def test_community_titles(spark):
    from emberline.operators import reports as R

    given = [
        (1, "companies:Google", ["A"], [], [], [], ["K"], "we like Google search more. Bye"),
        (2, "hashtags:ai", [], [], [], [], [], None),
        (3, None, [], ["T"], [], [], [], None),
        (4, None, [], [], [], [], ["Codex", "GPT"], None),
        (5, None, [], [], [], [], [], "only small words in here"),
        (6, "companies:Meta", [], [], [], [], ["meta", "GPU"], "no"),
    ]
    lists = ", ".join(f"{c} array<string>" for c in ("companies", "tickers", "products", "technologies", "keywords"))
    df = spark.createDataFrame(given, f"rank int, center_entity string, {lists}, center_text string")
    of = lambda v: [r.t for r in df.select("rank", R.community_title(df, v).alias("t")).orderBy("rank").collect()]
    assert of("first") == ["Google", "#ai", "$T", "热点议题 4", "热点议题 5", "Meta"]
    assert of("improved") == ["Google", "#ai", "$T", "Codex / GPT", "热点议题 5", "Meta"]
    assert of("final") == ["Google: we like Google search more", "#ai", "$T", "Codex / GPT", "only small words in here", "Meta / GPU"]
