"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from emberline.llm import spelling_variants
from emberline.llm.spelling_variants import digest, number_nodes, spelling_groups, word_counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if v != w and one_apart(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=str)


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("words_a_range,batch", [(50_000, 10_000), (7, 5)])
def test_groups_equal_all_pairs(spark, monkeypatch, words_a_range, batch):
    monkeypatch.setattr(spelling_variants, "RANGE_WORDS", words_a_range)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(words_a_range)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([1, 1, 2, 10, 15, 100, 150, 1500]) for _ in range(260)}
    counts |= {"a" * 40: 3, "a" * 41: 30, "a" * 42: 300, "\U0001f600x": 2, "\U0001f600y": 20}
    try:
        assert rows(spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))) == brute(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_chain_of_forms(spark):
    counts = {"a" * (7 + i): 10**i for i in range(12)}
    got = rows(spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {r[2] for r in got} == {"a" * 18}


def test_nodes_that_span_ranges_have_one_number():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    for size in (1, 2, 3, 50, 200):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        ranges = spelling_variants._ranges([(p, w[0], w[-1]) for p, w in enumerate(parts)])
        number = {}
        for p, part in enumerate(parts):
            for word, nodes in zip(part, number_nodes(part, p, *ranges[p])):
                assert len(nodes) == len(word) + 1
                for i, x in enumerate(nodes):
                    assert number.setdefault(word[:i], x) == x
        assert len(set(number.values())) == len(number)


def edited(i, word):
    h = zlib.crc32(f"{i}:{word}".encode())
    return word if i is None or h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def test_digest_of_whole_texts(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdÉé÷") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    texts = [" ".join(rng.choice(base) for _ in range(60)).title() for _ in range(30)]
    texts += [None, "", "short", "x1aaaaaaaa9bbbbbbbb", "long" * 3000, "long" * 3000, "long" * 3000 + "g", "Łódźłłłłłłłłł aaaaaaab", "AAAAAAAb aaaaaaab"]
    docs = list(enumerate(texts)) + [(None, "nullable NULLABLE"), (None, "nullable"), (2, texts[2])]
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = edited(i, w.translate({c: c + 32 for c in range(65, 91)}))
            if len(w) >= 7:
                counts[w] += 1
    got = rows(digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert got == brute({w: n for w, n in counts.items() if n >= 2}) and any(r[1] for r in got) and any(r[4] for r in got)


def test_flushed_counts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "_COUNTED", 2)
    df = spark.createDataFrame([(i, f"alphabet gammaray word{'abc'[i % 3]} alphabet", "clash") for i in range(9)], "doc_id long, text string, word string")
    assert sorted(map(tuple, word_counts(df, min_chars=5).collect())) == [("alphabet", 18), ("gammaray", 9), ("worda", 3), ("wordb", 3), ("wordc", 3)]
    assert digest(df.where("false")).count() == 0
    assert rows(spelling_groups(spark.createDataFrame([("", 5), (None, 5), ("a", 1), ("b", 20), ("", 5)], "word string, n long"))) == [("a", "b", "b", 1, 1, 20), ("b", None, "b", 20, 1, None)]
    with pytest.raises(ValueError):
        spelling_groups(df.selectExpr("word", "doc_id n"), ratio=1)
