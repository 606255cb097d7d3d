"""Corpus operators on small tables: brute force, round trips and edge cases."""

import os
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import decontaminate, html_extract, line_dedup, near_dedup, ngram_lm, packing, sharding, toxicity, url_filter, vector_search
from emberline.llm.graph import connected_components
from emberline.llm.queries import tokenizer_path

WORDS = "the of and lorem ipsum dolor sit amet élan naïve 漢字 x1 Q".split()
ODD = [None, "", " ", "\n\n", "one", "A b", "é", "same text here\nsecond line of text", "same text here\nsecond line of text", "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __row string"


def table(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 2}" if i != 3 else None, None, "clash", "clash") for i, t in zip(ids, texts)], SCHEMA).repartition(parts)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(1, 60))]
        out.append(" ".join(base))
        if rng.random() < 0.4:
            near = [w if rng.random() < 0.95 else "changed" for w in base]
            out.append(" ".join(near) + ("\n" + "a shared passage of text" if rng.random() < 0.5 else ""))
    return out


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


# ---------------------------------------------------------------- line dedup


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(key(x)) >= 10 and len(held[key(x)]) >= 2 and min(held[key(x)]) != i)]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    texts = corpus() + ["  A Shared passage of TEXT\t", "A shared passage of text\nA shared passage of text\nkeep"]
    ids = [*range(len(texts) - 1), 2]
    got = line_dedup.digest(line_dedup.dedup_lines(table(spark, texts, ids)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(list(zip(ids, texts)))
    out = line_dedup.rebuilt(table(spark, texts))
    assert out.columns == table(spark, ["x"]).columns
    assert line_dedup.dedup_lines(table(spark, texts), min_docs=3).count() == len(texts)
    assert line_dedup.digest(line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA))).count() == 0
    lone = line_dedup.dedup_lines(spark.createDataFrame([(None, "a line of ten or more"), (1, "a line of ten or more")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in lone.collect()} == {None: "a line of ten or more", 1: "a line of ten or more"}


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["row", "lines", "id", "row_of", "drop", "_row", "N_Lines", "a.b"]
    df = spark.createDataFrame([(i, f"a shared line of text\nown {i}", *(f"{c}{i}" for c in names)) for i in (1, 2)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2].text == "own 2" and got[1].text == "a shared line of text\nown 1" and (got[2].n_lines, got[2].n_dropped) == (2, 1)
    for i in (1, 2):
        assert [got[i][c] for c in names if c != "N_Lines"] == [f"{c}{i}" for c in names if c != "N_Lines"]


# ---------------------------------------------------------------- decontamination


def brute_hits(docs, items, window=13):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = defaultdict(set)
    for i, t in items:
        w = words(t, pattern)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[k : k + m])].add(i)
    lengths = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = words(t, pattern)
        hit, names = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    names |= wins[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 2, 1, 30, 20])] + [("90", None), ("91", ""), ("92", "Q q")]
    # equal windows within an item, between items and in repeated rows; an id with two texts; an item with no words but marks
    items += [("93", "zz " * 30), ("94", "zz " * 20), items[0], ("0", items[1][1]), ("95", "?!"), ("\u00e9", "\u00e9t\u00e9 " * 13)]
    texts = corpus(40, 2) + ["zz-" * 40, "ZZ " * 12, "\u00e9t\u00e9, " * 14, "", None] + [f"start {items[0][1].upper()} end", f"{items[1][1]}, {items[2][1]}", items[6][1].replace(" ", "--"), "x " * 500 + items[7][1]]
    bench = spark.createDataFrame([*items, (None, "lost item")], "item_id string, text string")
    got = decontaminate.digest(decontaminate.contamination(table(spark, texts), bench))
    want = brute_hits(list(enumerate(texts)), items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = decontaminate.decontaminate(table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontaminate.contamination(table(spark, texts), bench.limit(0)).where("n_hit > 0").isEmpty()


# ---------------------------------------------------------------- near dedup


def brute_near(docs, shingle):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


@pytest.mark.parametrize("shingle, tile", [(2, 400), (5, 3)])
def test_near_dedup(spark, monkeypatch, shingle, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(9)
    texts = corpus(40, 3)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    for _ in range(40):  # copies around the threshold, so that components meet in buckets
        texts.append(" ".join(w if rng.random() < 0.95 else f"v{rng.randrange(9)}" for w in base))
    got = near_dedup.near_duplicates(table(spark, texts), shingle)
    assert sorted(map(tuple, got.collect())) == brute_near(list(enumerate(texts)), shingle)
    kept = near_dedup.drop_near_duplicates(table(spark, texts), shingle)
    assert kept.columns == table(spark, ["x"]).columns


def test_near_dedup_odd_tables(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c"), (1, "a b c"), (1, "other words entirely"), (2, "other words entirely"), (3, "a b c")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)], key=str)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    own = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in own}


# ---------------------------------------------------------------- packing


def test_encoder_matches_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    e = packing.encoder(tokenizer_path())
    rng = random.Random(3)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "1", ".", "'", "s", "é", " ", "　", "漢", "\r", "ll", "\U0001f600", "##", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert e.ids(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(s)


def test_documents_keep_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = packing.encoder(tokenizer_path())
    assert np.frombuffer(e.document("a<|endoftext|>b"), dtype="<u4").tolist() == [64, 50256, 65]
    rng = random.Random(4)
    alphabet = [" ", " ", "\n", "a", "1", "'", "s", "é", "漢", "<|", "|>", "<|endoftext|>", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert e.document(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(s)
    got = packing.pack_documents(table(spark, ["a<|endoftext|>b"]), tokenizer_path(), 256).first()
    assert (got.length, got.ids_crc32) == (4, zlib.crc32(np.array([64, 50256, 65, 0], dtype="<u4").tobytes()))


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PROBLEM_PIECES", 40)
    t = Tokenizer.from_file(tokenizer_path())
    texts = corpus(60, 5) + ["unusual " * 5000]
    got = packing.pack_documents(table(spark, texts), tokenizer_path(), 256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(math.ceil(len(ids) / 256)))
        assert all(r.length == 256 for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(seqs) <= total / 256 * 1.05 + 4
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_packing_deals_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PROBLEM_PIECES", 50)
    rows = [(None, 0, 0, 10 + i % 3, 7, f"p{i}", i) for i in range(400)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, problem string, row int")
    got = packing.pack(found, 64).collect()
    assert sorted((r.problem, r.row, r.length) for r in got) == sorted((p, i, n) for _, _, _, n, _, p, i in rows)
    assert len({r.sequence_id >> 32 for r in got}) == 8
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 64


def test_genetic_search_keeps_every_piece_and_improves():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(60, 140, 300))[::-1].astype(np.int64)
    first = packing._from_scratch(np.arange(300), lengths, 256)
    best = first
    seeds = []
    for _ in range(6):
        seeds = packing.evolve(lengths, seeds, rng, 256)
    best = seeds[0]
    fill = np.bincount(best, weights=lengths)
    assert len(best) == 300 and fill.max() <= 256 and (fill > 0).all()
    assert packing._cost(best, lengths, 256) <= packing._cost(first, lengths, 256)
    child = packing.crossover(first, best, lengths, rng, 256)
    assert np.bincount(child, weights=lengths).max() <= 256 and (child >= 0).all()


# ---------------------------------------------------------------- vectors


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATE_ROWS", 60)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 2)
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (230, 8))
    v[20:80] = v[0]
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)] + [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [0.0] * 8), (700, [1.0] * 3)]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    ints = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x in rows[:230]}
    want = []
    for q in range(0, 230, 50):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == want
    # a repeated id is one query but each of its rows a candidate, and never its own partner
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.5, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.top_k(twice, F.col("vec_id") % 50 == 0, 3).collect())) == [(50, 1, 7, 65536), (50, 2, 7, 65536), (50, 3, 8, -65536)]
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- language model


def test_kneser_ney_against_dictionaries(spark):
    texts = corpus(50, 7)
    docs = table(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    got = {r.doc_id: r for r in ngram_lm.digest(docs).collect()}
    tok = [[*words(t), None] for t in texts]
    train = [x for x, h in zip(tok, held) if not h]
    uni = Counter(w for d in train for w in d)
    N, V = sum(uni.values()), len(uni)
    bi = Counter(p for d in train for p in zip([0, *d[:-1]], d))
    cont = Counter(w for _, w in bi)
    D = ngram_lm._discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    L = ngram_lm._discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    ctx, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in bi.items():
        ctx[u] += c
        kinds[u][min(c, 3) - 1] += 1
    left = sum(L[min(c, 3) - 1] for c in cont.values()) / len(bi)
    less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    low = lambda w: less(cont.get(w, 0), L) / len(bi) + left / (V + 1)

    def p(u, w):
        if not ctx.get(u):
            return low(w)
        return (less(bi.get((u, w), 0), D) + sum(a * b for a, b in zip(D, kinds[u])) * low(w)) / ctx[u]

    assert abs(sum(p(b"the", w) for w in uni) + p(b"the", b"@unknown") - 1) < 1e-9
    for i, x in enumerate(tok):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(w in uni for w in x), N)
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip([0, *x[:-1]], x)), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((uni.get(w, 0) + 1) / (N + V + 1)) for w in x), rel_tol=1e-9, abs_tol=1e-9)
    assert ngram_lm.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_higher_order_against_dictionaries(spark, order):
    texts = corpus(50, 7) + ["the of and the of to", "the of and the of " * 1000] * 3
    docs = table(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    got = {r.doc_id: r for r in ngram_lm.digest(docs, order=order).collect()}
    tok = [[*words(t), None] for t in texts]
    train = [x for x, h in zip(tok, held) if not h]
    V = len({w for d in train for w in d})
    ending = lambda d, j, k: tuple([0, *d][max(0, j + 2 - k) : j + 2])
    count = {order: Counter(ending(d, j, order) for d in train for j in range(len(d)))}
    shorter = {g: c for g, c in count[order].items() if len(g) < order}
    count[order] = Counter({g: c for g, c in count[order].items() if len(g) == order})
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
        count[k].update({g: c for g, c in shorter.items() if len(g) == k})
    D = {k: ngram_lm._discounts([sum(c == n for c in count[k].values()) for n in (1, 2, 3, 4)]) for k in count}
    kinds, total = defaultdict(lambda: [0, 0, 0]), Counter()
    for k in count:
        for g, c in count[k].items():
            kinds[g[:-1]][min(c, 3) - 1] += 1
            total[g[:-1]] += c

    def p(g):
        k, context = len(g), g[:-1]
        rest = p(g[1:]) if k > 1 else 1 / (V + 1)
        if not total[context]:
            return rest
        c = count[k].get(g, 0)
        return ((max(c - D[k][min(c, 3) - 1], 0) if c else 0) + sum(a * b for a, b in zip(D[k], kinds[context])) * rest) / total[context]

    for i, x in enumerate(tok):
        want = sum(math.log10(p(ending(x, j, order))) for j in range(len(x)))
        assert math.isclose(got[i].score, want, rel_tol=1e-9, abs_tol=1e-9)
    assert ngram_lm.digest(docs.limit(0), order=order).count() == 0


# ---------------------------------------------------------------- sharding and urls


@pytest.mark.parametrize("rows", [3, 95])
def test_shards_match_the_mixture(spark, rows):
    texts = corpus(80, 8)[:rows]
    got = sharding.digest(table(spark, texts), 10).collect()
    assert len(got) == rows and {r.law for r in got} == {"rows"}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    sizes = [len(by.get(s, ())) for s in range(10)]
    assert max(sizes) - min(sizes) <= 1
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        if rows > 50:
            odd = sum(r.doc_id % 2 for r in s)
            assert abs(odd - len(s) / 2) <= 2


def test_url_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.net/x", "https://B.Example.NET/en/1?q#f", "http://example.com/de/1", "http://x.org/fr/2", "http://x.org/de/2", "http://bad.host.com/1", "http://good.host.com/2", "http://x.net?y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    marks = [("bad.host.com", 1)] * 60 + [("good.host.com", int(i % 20 == 0)) for i in range(60)] + [(f"h{i % 30}.com", int(i % 9 == 0)) for i in range(300)]
    outcomes = spark.createDataFrame(marks, "host string, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert [got[i].verdict for i in range(12)] == ["allow"] * 4 + ["block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert [got[i].rule for i in range(9)] == [None] * 4 + ["net/", "example.net/en/", "example.com/de/", "org/fr/", None]
    assert (got[5].host, got[5].path) == ("b.example.net", "/en/1")
    assert url_filter.filter_urls(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 2
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_reputation_levels_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://new.bad.co.uk/1", "k", "b"), (2, "http://new.good.co.uk:8080/2", "k", "b")], "page_id long, url string, key string, bad string")
    marks = [(f"h{i % 3}.bad.co.uk", 1) for i in range(300)] + [(f"h{i % 3}.good.co.uk", 0) for i in range(300)]
    outcomes = spark.createDataFrame(marks, "host string, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    # hosts without outcomes: judged by their registered domains
    assert [got[i].verdict for i in (1, 2)] == ["block", "allow"] and all((got[i].key, got[i].bad) == ("k", "b") for i in (1, 2))
    hosts = spark.createDataFrame([("a.b.co.uk:80",), ("b.com",), ("x.b.com",), ("com",), ("co.uk",), ("",)], "h string")
    found = [tuple(r) for r in hosts.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()]
    assert found == [("b.co.uk", "co.uk"), ("b.com", "com"), ("b.com", "com"), ("com", "com"), ("co.uk", "co.uk"), ("", "")]
    numbers = spark.createDataFrame([("http://h/en/853/",), ("http://h/x/474.html?p=9",), ("http://h/7/about",), ("http://h/12#t",), (None,)], "u string")
    assert [r[0] for r in numbers.select(url_filter.document_number(F.col("u"))).collect()] == [853, 474, None, 12, None]


def test_lower_bound_is_near_the_beta_quantile(spark):
    given = [(5.0, 15.0), (40.0, 120.0), (2.0, 30.0), (300.0, 100.0)]
    got = [r[0] for r in spark.createDataFrame(given, "a double, b double").select(url_filter.lower_bound(F.col("a"), F.col("b"))).collect()]
    x = (np.arange(200_000) + 0.5) / 200_000
    for (a, b), bound in zip(given, got):
        logs = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
        weight = np.exp(logs - logs.max())
        below = np.cumsum(weight) / weight.sum()
        assert abs(np.interp(bound, x, below) - 0.159) < 0.03


def test_lower_bound_has_the_exact_moments_of_the_log_odds(spark):
    given = [(2.1, 0.05), (0.3, 0.7), (5.02, 0.1), (0.01, 0.02), (1.0, 1.0), (300.0, 4.0)]
    got = [r[0] for r in spark.createDataFrame(given, "a double, b double").select(url_filter.lower_bound(F.col("a"), F.col("b"))).collect()]

    def moments(x):
        """Digamma and trigamma by differences of the logarithm of gamma."""
        h = 1e-3 * x
        g = [math.lgamma(x + i * h) for i in (-2, -1, 0, 1, 2)]
        return (g[0] - 8 * g[1] + 8 * g[3] - g[4]) / (12 * h), (-g[0] + 16 * g[1] - 30 * g[2] + 16 * g[3] - g[4]) / (12 * h * h)

    for (a, b), bound in zip(given, got):
        (ma, va), (mb, vb) = moments(a), moments(b)
        assert bound == pytest.approx(1 / (1 + math.exp(-(ma - mb - url_filter.Z * math.sqrt(va + vb)))), rel=1e-3)
    ends = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "a double, b double").select(url_filter.lower_bound(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in ends] == [0.0, 1.0]


# ---------------------------------------------------------------- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu entry</a></li></ul></nav>
<div class="cookie-notice">We use cookies of the kind that is needed for the site and the rest of it, as you know.</div>
<article><h1>The head &amp; line</h1><p>First <b>bold</b>
 part &eacute;&#233;.<p>Second one</p><aside>Aside of the text</aside><div class="ad">Buy</div>
<form><p>Sign up</p><input></form><section id="comments"><p>Nice one, says a reader of the article</p></section></article>
<div class="sidebar"><p>See the other one</p></div><footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    want = "The head & line\nFirst bold part éé.\nSecond one"
    assert html_extract.extract(PAGE) == want
    for odd in (None, "", "<", "<p", "<div><p>open", "</p></div>", "<!-- never closed", "<a href='x>y'>", "<script>open"):
        html_extract.extract(odd)
    plain = "<div>" + "It is the story of a man and of the sea that he was in, and it is told for all of the people. " * 3 + "</div>"
    menu = "<div><a href=x>Home</a> <a href=y>About</a></div>"
    assert html_extract.extract(f"<body>{menu}<h2>Head</h2>{plain}<p>Short one.</p>{plain}{menu}</body>").count("\n") == 3
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0)}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_article_is_a_prior_only():
    text = "It is the story of a man and of the sea that he was in, and it is told for all of the people."
    article = f"<article><h1><a href=x>The linked head</a></h1><p>{text}</p></article>"
    want = f"The linked head\n{text}"
    for page in (article, f"<div class='layout has-sidebar'>{article}</div>", f"<div class='no-sidebar'>{article}</div>", f"<div class='widget'><div id=side>{article}</div></div>", f"<form>{article}</form>"):
        assert html_extract.extract(page) == want, page
    assert html_extract.extract(f"{article}<section class=comments><article><p>{text}</p></article></section>") == want
    assert html_extract.extract(f"<article><header class='header'><h1>Head</h1></header><p>{text}</p></article>") == f"Head\n{text}"
    links = "<div><a href=x>One</a> <a href=y>Two</a></div>"
    assert html_extract.extract(f"<article><p>{text}</p>{links}<p>Share this story</p>{links}<p>{text}</p></article>") == f"{text}\n{text}"
    assert html_extract.extract(f"<div class='cookie-notice'><p>{text}</p></div>{article}") == want
    plain = f"<div class='no-sidebar'><h1>Head</h1><p>{text} {text} {text}</p></div>"
    assert html_extract.extract(plain).startswith("Head\n")


def test_html_of_broken_and_long_pages_takes_linear_time():
    import time

    text = "It is the story of a man and of the sea that he was in, and it is told for all of the people."
    for odd in ('<a "' * 250_000, "<div>" * 200_000 + text, "<a href='" * 100_000 + ">", "</p>" * 250_000, "<p>" + "a < b and " * 100_000, "<script" * 150_000, "<aside>" * 150_000 + f"<main><p>{text}</p></main>"):
        began = time.perf_counter()
        html_extract.extract(odd)
        assert time.perf_counter() - began < 15, odd[:20]


def test_pages_give_the_lines_of_their_articles(spark):
    """Held against a plain reading of the given pages: the text of the article's paragraphs and headings."""
    import html as H
    import re

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page, text in spark.read.parquet(path).join(html_extract.digest(spark.read.parquet(path)).select("page_id", "text"), "page_id").select("html", "text").collect():
        body = re.search(r"(?is)<(main|article)\b[^>]*>(.*)</\1>", page)[2]
        for inner in ("script", "style", "aside", "form", "nav", "footer"):
            body = re.sub(rf"(?is)<{inner}\b.*?</{inner}>", "", body)
        want = [" ".join(H.unescape(re.sub(r"(?s)<[^>]+>", "", x)).split()) for _, x in re.findall(r"(?is)<(p|h[1-6])\b[^>]*>(.*?)(?=</\1>|<p\b|</article|$)", body)]
        lines = text.split("\n")
        found = [w for w in want if w]
        assert found and set(lines) <= set(found) | {x for x in lines if x in body or x in H.unescape(body)}


# ---------------------------------------------------------------- toxicity


def toxic_corpus(n=240, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) + rng.choice(["", "er", "ly", "."]) for _ in range(rng.randint(5, 200))]
        y = int(i % 3 == 0)
        for _ in range(max(1, len(w) // 40) if y else 0):
            w[rng.randrange(len(w))] = rng.choice(["gruk", "grukken", "blarf", "Blarfo", "zonk"])
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    docs = table(spark, texts + ODD)
    marks = spark.createDataFrame([(i, None, y) for i, y in enumerate(labels)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, marks).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    tests = [i for i in range(len(texts)) if got[i].held_out]
    ranks = sorted(tests, key=lambda i: got[i].score)
    pos = [k for k, i in enumerate(ranks, 1) if labels[i]]
    auc = (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(tests) - len(pos)))
    assert auc > 0.9
    assert toxicity.digest(docs, marks.limit(0)).where("score <> 0").count() == 0


def test_gradients():
    """Backpropagation against differences of the loss."""
    from emberline.llm.common import ALNUM, Words

    raw = np.frombuffer(("alpha beta gamma delta " * 12).encode(), dtype=np.uint8)
    x = toxicity.Features(Words(raw, np.array([0, len(raw)]), ALNUM))
    ids, _ = x.windows()
    ids[0, -3:] = -1
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    inputs = rng.normal(0, 0.5, (len(x.word), 2 * toxicity.DIM)).astype(np.float32)
    y = np.array([1.0] + [0.0] * (len(ids) - 1))

    def loss(v):
        z = net.forward(net.table(v.astype(np.float32)), ids).astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).mean())

    saved = {k: v.copy() for k, v in net.p.items()}
    grad = net.step(x, inputs, ids, y, {}, 1)
    net.p = saved
    for _ in range(6):
        i, j = rng.integers(len(inputs)), rng.integers(inputs.shape[1])
        up, down = inputs.copy(), inputs.copy()
        up[i, j] += 0.05
        down[i, j] -= 0.05
        assert math.isclose((loss(up) - loss(down)) / 0.1, grad[i, j], rel_tol=0.08, abs_tol=2e-4)
