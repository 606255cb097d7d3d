"""Periodic runs against a loop over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fractions import Fraction

from emberline.llm import periodic_runs
from emberline.llm.periodic_runs import Grammar, collapse_runs, cyclic_tail, digest, repeating, runs


def brute(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b) for (a, b), q in found.items())


def random_text(rng, n, k):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        elif kind < 0.8:
            period = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            m = rng.randint(2, 40)
            out += (period * m)[:m]
        else:
            out += out[: rng.randint(0, len(out))]
    return out[:n]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (24, 4), (12, 5)])
def test_runs_equal_the_loop(least, times):
    rng = random.Random(least * times)
    for _ in range(60):
        texts = [random_text(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 6))]
        first = np.cumsum([0] + [len(t) for t in texts])
        ids = np.array(sum(texts, []), dtype=np.int64)
        got = sorted(zip(*(x.tolist() for x in runs(ids, first, least, times))))
        want = sorted((a + f, b + f, q) for f, t in zip(first, texts) for a, q, b in brute(t, least, times))
        assert got == want
        has = repeating(ids, first, least, times)
        assert all(h for h, t in zip(has, texts) if brute(t, least, times))


def test_grammar_shortens_a_power():
    ids = np.zeros(1 << 14, dtype=np.int64)
    g = Grammar(ids, np.array([0, len(ids)]), 24)
    assert len(g.low) < 40  # nodes, for 16384 words
    assert [x.tolist() for x in runs(ids, np.array([0, len(ids)]))] == [[0], [1 << 14], [1]]


def test_parameters_that_could_lose_runs_are_refused():
    for least, times in ((24, 2), (5, 3)):
        with pytest.raises(ValueError):
            runs(np.zeros(30, dtype=np.int64), np.array([0, 30]), least, times)


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    drop = {i for s, q, e in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_digest_equals_the_loop(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a " * 24, "a " * 23, "é É é É " * 6, "x\x0b\x0cy " * 12, "w " * 3000, "a b c " * 9, "a b c d e f g h " * 3, "a b c d e f g h " * 2 + "a b c d e f g"]
    texts += [" ".join(map(str, random_text(rng, rng.randint(20, 200), rng.choice([2, 9])))) for _ in range(120)]
    texts += ["same words " * 30] * 3
    rows = list(enumerate(texts)) + [(None, "a b " * 20), (None, "a b " * 20), (7, "z y x " * 10)]
    got = digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5


def test_slices_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{'p q r ' * 12} own {i} " * 2) for i in range(40)], "doc_id long, text string").repartition(1)
    want = sorted(map(str, digest(df).collect()))
    monkeypatch.setattr(periodic_runs, "GRAMMAR_BYTES", 100)
    assert sorted(map(str, digest(df).collect())) == want


def test_columns_pass_through_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "go " * 30, "old", "x")], "doc_id long, text string, runs string, `a.b` string")
    row = collapse_runs(df).first()
    assert (row["a.b"], row.n_words, row.collapsed) == ("x", 30, "go") and [tuple(r) for r in row.runs] == [(0, 30, 1)]
    assert collapse_runs(df.where("false")).count() == 0 and digest(df.where("false")).count() == 0
    assert cyclic_tail(None, [b"a"]) == [b"a"]
