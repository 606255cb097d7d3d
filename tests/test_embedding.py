"""Words counted where a post is read: the same rows as SQL, without shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import text as W
from emberline.operators import vectors as D
from emberline.plans import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Long texts in which words of unlike counts and lengths weigh the same."""
    draw, where = random.Random(7), tmp_path_factory.mktemp("texts")
    words = [chr(97 + i % 26) * (3 + i % 20) + chr(97 + i // 26) for i in range(500)]
    rows = [(i, " ".join(w for w in draw.sample(words, 420) for _ in range(draw.choice((1, 1, 3, 7)))), "en", f"s{i % 3}", 0) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [*rows, (60, None, "en", "s0", 0), (61, "a of", "en", "s0", 0)])
    con.execute(f"COPY documents TO '{where}/documents.parquet'")
    return con, str(where)


@pytest.mark.parametrize("name", ["hash_embedding", "hash_embedding_rule", "content_keywords", "keyword_topics", "embedding_v1", "ngrams"])
def test_words_as_in_sql(spark, tables, name):
    con, where = tables
    got = QUERIES[name](spark, where)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_words_are_not_shuffled(spark):
    posts = spark.createDataFrame([("1", "lithium words lithium"), ("2", None), ("3", "")], "tweet_id string, text string")
    for made in (D.hash_embedding(posts), D.hash_vectors(posts), D.rank_embedding(posts), W.keywords(posts), W.word_counts(posts, 3, ())):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert {r.tweet_id for r in made.collect()} == {"1"}


def test_vectors_as_long_rows(spark, tables):
    posts = spark.read.parquet(f"{tables[1]}/documents.parquet").select(F.col("doc_id").cast("string").alias("tweet_id"), "text")
    long = {(r.tweet_id, r.dim): r.w for r in D.hash_embedding(posts).collect()}
    assert long == {(r.tweet_id, i): x for r in D.hash_vectors(posts).collect() for i, x in enumerate(r.v) if x}


def test_texts_of_a_repeated_id_count_together(spark):
    schema = "tweet_id string, text string"
    posts = spark.createDataFrame([("1", "zeta alpha alpha"), ("1", "beta zeta"), ("2", "beta"), (None, "delta"), (None, "delta")], schema)
    got = {(r.tweet_id, r.word): (r.n, r.pos) for r in W.word_counts(posts, 3, ()).collect()}
    assert got == {("1", "zeta"): (2, 0), ("1", "alpha"): (2, 1), ("1", "beta"): (1, 0), ("2", "beta"): (1, 0), (None, "delta"): (2, 0)}


def test_phrases_are_counted_in_one_shuffle(spark, tables):
    plan = QUERIES["ngrams"](spark, tables[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_coherence_embeds_only_the_posts_it_compares(spark, tables, monkeypatch):
    con, where = tables
    plain, seen = D.hash_vectors, []
    monkeypatch.setattr(D, "hash_vectors", lambda posts, *a: seen.append(posts.count()) or plain(posts, *a))
    got = QUERIES["coherence"](spark, where)
    want = con.execute(f"SELECT cluster_id, coherence FROM ({ORACLE_SQL['coherence']})").fetchall()
    assert sorted(map(tuple, got.select("cluster_id", "coherence").collect())) == sorted(want) and seen == [30]


def test_phrases_of_two_and_of_three_words(spark):
    posts = spark.createDataFrame([("1", "Alpha beta gamma alpha beta gamma of delta"), ("1", "beta gamma"), ("2", "alpha beta"), ("3", "beta gamma alpha"), ("4", ""), ("5", None), ("6", "zeta")], "tweet_id string, text string")
    got = {}
    for r in W.phrase_counts(posts).collect():
        got.setdefault(r.phrase, []).append(r.n)
    two = {"alpha beta": [1, 2], "beta gamma": [1, 3], "gamma alpha": [1, 1]}
    three = {"alpha beta gamma": [2], "beta gamma alpha": [1, 1], "gamma alpha beta": [1]}
    assert {k: sorted(v) for k, v in got.items()} == two | three
    assert {r.phrase for r in W.phrase_counts(posts, sizes=(2,)).collect()} == set(two)
    assert W.phrase_counts(posts.where("tweet_id > '3'")).count() == 0
