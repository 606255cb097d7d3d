"""Word lists found by one automaton, as substrings and as tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.functions import dictionary as D
from emberline.operators import entities as N
from emberline.operators import text as W


def texts(n, seed=3):
    r = random.Random(seed)
    bits = ["ai", "AI", "agi", "imaging", "GPT-4", "gpt 4", "gpt4", "é", "ſ", "ß", "K", "x", "İ", " ", "-", ",", "Stable Diffusion", "stable  diffusion", "_ai", "ai9", "中文", "\n"]
    return ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(0, 12))) for _ in range(n)] + ["", None, "AI " * 50_000]


WORDS = ("AI", "AGI", "GPT-4", "GPT", "x", "ss", "k", "Stable Diffusion", "s", "中文", "AI", "--")


def run(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string").repartition(3)
    return {r.i: r.w for r in rows.select("i", column(F.col("t")).alias("w")).collect()}, {r.i: (r.low, r.up) for r in rows.select("i", F.lower("t").alias("low"), F.upper("t").alias("up")).collect()}


@pytest.mark.parametrize("how", ["within", "lower", "upper", "either"])
def test_the_same_words_as_one_search_a_word(spark, how):
    values = texts(300)
    column = {"within": D.found_within, "lower": D.found_lower, "upper": D.found_upper, "either": D.found_either_case}[how]
    got, folded = run(spark, lambda t: column(t, WORDS), values)
    for i, text in enumerate(values):
        low, up = folded[i]
        test = {
            "within": lambda w: w in text,
            "lower": lambda w: w.lower() in low,
            "upper": lambda w: w.upper() in up,
            "either": lambda w: w.lower() in low or w.upper() in up,
        }[how]
        assert got[i] == ([w for w in WORDS if test(w)] if text is not None else []), text


def test_whole_tokens_only(spark):
    values = texts(300, 4)
    got, folded = run(spark, lambda t: D.found_lower(t, WORDS, "token"), values)
    for i, text in enumerate(values):
        own = re.findall(r"\w+", folded[i][0] or "")
        want = []
        for w in WORDS:
            key = re.findall(r"\w+", w.lower())
            if key and any(own[j : j + len(key)] == key for j in range(len(own))):
                want.append(w)
        assert got[i] == want, text


def test_match_is_one_of_two(spark):
    for f in (D.found_lower, D.found_upper, D.found_either_case):
        with pytest.raises(ValueError):
            f(F.lit("a"), ("a",), "words")
    assert spark.range(1).select(D.found_within(F.lit("abc"), ()).alias("w")).first().w == []
    assert spark.range(0).select(D.found_within(F.lit("abc"), ("a",)).alias("w")).collect() == []


def test_extractors_by_tokens(spark):
    post = "Meta imaging at metadata; OpenAI launched GPT 4, exact AGIs"
    rows = spark.createDataFrame([(post,)], "text string").selectExpr(
        "text", "cast(null as struct<hashtags:array<string>,cashtags:array<string>,mentions:array<string>>) as entities", "cast(null as array<string>) as domains"
    )
    args = F.col("text"), F.col("entities"), F.col("domains")
    r = rows.select(
        N.rule_entities(*args).alias("a"), N.rule_entities(*args, match="token").alias("b"), N.first_entities(*args, match="token").alias("c"),
        N.improved_entities(*args, match="token").alias("d"), N.final_entities(*args, match="token").alias("e"), W.gated_entities(F.col("text"), "token").alias("f"),
        W.actions(F.col("text"), ("launch", "launched"), "token").alias("g"),
    ).first()
    assert "AGI" in r.a.products and "X" in r.a.companies
    assert r.b.products == ["GPT-4", "GPT"] or sorted(r.b.products) == ["GPT", "GPT-4"]
    assert r.b.companies == ["Openai", "Meta"] == r.c.companies == r.d.companies == r.e.companies
    assert r.f == ["GPT-4", "Meta", "OpenAI"] and r.g == ["launched"]


def test_a_dictionary_of_any_size(spark):
    values = texts(200, 5)
    entries = ["AI", "ai", "GPT-4", "Stable Diffusion", "x", "--", "", None, "x", "ai ai ai", "never there"]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(values)], "tweet_id string, text string").withColumn("entry", F.lit("clash")).repartition(3)
    listed = spark.createDataFrame([(e,) for e in entries], "entry string").withColumn("tweet_id", F.lit("clash"))
    got = {(r.tweet_id, r.entry): r.n for r in W.token_hits(posts, listed).collect()}
    lower = {r.tweet_id: r.t for r in posts.select("tweet_id", F.lower("text").alias("t")).collect()}
    want = {}
    for i, _ in enumerate(values):
        own = re.findall(r"\w+", lower[str(i)] or "")
        for e in {e for e in entries if e}:
            key = re.findall(r"\w+", e.lower())
            n = sum(own[j : j + len(key)] == key for j in range(len(own))) if key else 0
            if n:
                want[str(i), e] = n
    assert got == want
    with pytest.raises(ValueError):
        W.token_hits(posts, listed, longest=2)
    assert W.token_hits(posts, listed.limit(0)).count() == 0 and W.token_hits(posts.limit(0), listed).count() == 0
