"""Spelling variants: words that differ in one code point, and the common form that each rare one stands for.

All words are put in a trie, and all reversed words in another, and the nodes of both are numbered.
Tasks number the nodes of a range of the sorted words; a node that spans several ranges is numbered by
the first of them, which one row a range (its first and last word) tells.  A word's prefix is then
one integer, and so is its suffix, however long it is.

A pair of integers (prefix node, suffix node) stands for a word with a place between the two.  Each word
gives a pair for each code point that is skipped and for each place where one could be inserted.  Two
words with a skipped pair in common differ by a replaced code point; a skipped pair of one that is an
insertion pair of the other is a deleted one.  A pair belongs to at most one word by insertion and to
as many by skipping as there are letters, so that groups are bounded and no word is hot.  Of equal
neighbouring letters only the first counts as deleted, so that each pair of words meets once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucket_count, discard, ship, written

#: Runs of these letters are words; only A-Z have a lower case here.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of one range of the sorted vocabulary, about.
RANGE_WORDS = 50_000
#: Distinct words that a task counts before it passes them on.
_COUNTED = 200_000
_SKIP, _SKIP_FIRST, _INSERT = 0, 1, 2


def dropped_letter(key: object) -> Callable[[str], str]:
    """The query's misspelling: of one word in 31 of a document a code point is left out; a null key changes nothing."""
    if key is None:
        return lambda word: word
    seed = zlib.crc32(f"{key}:".encode())

    def edit(word: str) -> str:
        h = zlib.crc32(word.encode(), seed)
        if h % 31:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    return edit


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 1, edit: Callable[[object], Callable[[str], str]] | None = None, key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least min_chars code points, with A-Z lower-cased, and how often they occur in all whole texts.

    edit(row's key) gives a function that may shorten a word.  Null and empty texts have no words; an
    empty table gives none; repeated rows count each.  Words seen fewer than min_count times are left out.
    """
    ship(docs.sparkSession)
    find = re.compile("[%s]{%d,}" % (LETTERS.replace("A-Z", ""), min_chars)).findall
    lower = LOWER.tobytes()

    def count(batches):
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return batch

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                own = Counter(find(text.encode().translate(lower).decode()))
                if edit:
                    change = edit(k)
                    for word, n in own.items():
                        word = change(word)
                        if len(word) >= min_chars:
                            total[word] += n
                else:
                    total.update(own)
                if len(total) > _COUNTED:
                    yield out()
        yield out()

    parts = docs.select(F.col(key).alias("k"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _ranges(first_last: list[tuple[int, str, str]]) -> dict[int, tuple[list[tuple[int, int]], int, str]]:
    """By range: the nodes that it begins in, as (depth up to, range that numbers them), and how deep it shares its last word with the next."""
    out = {}
    entering: list[tuple[int, int]] = []
    for i, (part, first, last) in enumerate(first_last):
        on = _shared(last, first_last[i + 1][1]) if i + 1 < len(first_last) else 0
        out[part] = (entering, on, last)
        through = min(entering[-1][0] if entering else 0, _shared(first, last), on)
        leaving, below = [], 0
        for depth, owner in entering:
            if below < through:
                leaving.append((min(depth, through), owner))
                below = min(depth, through)
        if on > through:
            leaving.append((on, part))
        entering = leaving
    return out


def number_nodes(words: list[str], part: int, entering: list[tuple[int, int]], on: int, last: str) -> list[list[int]]:
    """For each of a range's sorted words the numbers of its trie nodes, from the root (0) to the whole word."""
    base = part << 34
    path, below = [0], 0
    for depth, owner in entering:
        path += [(owner << 34) + 2 * d for d in range(below + 1, depth + 1)]
        below = depth
    fresh = base + 1
    out = []
    before = None
    for word in words:
        keep = len(path) - 1 if before is None else _shared(before, word)
        del path[keep + 1 :]
        if keep < on:  # nodes that go on in the next range are named by their depth
            r = min(on, _shared(word, last))
            path += [base + 2 * d for d in range(keep + 1, r + 1)]
        n = len(word) + 1 - len(path)
        path += range(fresh, fresh + 2 * n, 2)
        fresh += 2 * n
        out.append(path[:])
        before = word
    return out


def trie_nodes(words: DataFrame) -> DataFrame:
    """words(part, id, word), parts being ranges of the order of distinct words -> (id, nodes, first): its prefixes' numbers, by length; whether each code point differs from the one before."""
    rows = words.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("part").collect()  # one row a range
    ranges = words.sparkSession.sparkContext.broadcast(_ranges([tuple(r) for r in rows]))

    def number(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        words = table.column("word").to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)  # by code point, as the bytes of UTF-8 are
        nodes = number_nodes([words[i] for i in order], part, *ranges.value[part])
        ids = table.column("id").combine_chunks().take(pa.array(order))
        flat = np.fromiter((x for path in nodes for x in path), dtype=np.int64, count=sum(map(len, nodes)))
        offsets = np.concatenate([[0], np.cumsum([len(path) for path in nodes])]).astype(np.int32)
        points = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), dtype=np.uint32)
        at = offsets - np.arange(len(offsets), dtype=np.int32)  # a word has a code point less than nodes
        new = np.ones(len(points), dtype=bool)
        new[1:] = points[1:] != points[:-1]
        new[at[:-1]] = True
        return pa.table({"id": ids, "nodes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "first": pa.ListArray.from_arrays(pa.array(at), pa.array(new))})

    return words.groupBy("part").applyInArrow(number, "id long, nodes array<long>, first array<boolean>")


def _sorted_ranges(words: DataFrame, by: str, parts: int) -> DataFrame:
    return words.repartitionByRange(parts, by).sortWithinPartitions(by)


def _met(batches):
    """Rows sorted by (p, s, n descending, id) -> for each word of a pair of nodes with several: its near words there, how many and the first."""
    held: list = []

    def groups(table: pa.Table):
        p, s, n, i, kind = (table.column(c).to_numpy() for c in ("p", "s", "n", "id", "kind"))
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        total = int(group[-1]) + 1 if len(p) else 0
        none = len(p)

        def nth(rows: np.ndarray, which: int) -> np.ndarray:
            """By group, the row that comes so many-th among the given ones (none: no such)."""
            g = group[rows]
            head = np.searchsorted(g, np.arange(total))
            at = head + which
            ok = (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == np.arange(total)) if len(g) else np.zeros(total, dtype=bool)
            out = np.full(total, none)
            out[ok] = rows[at[ok]]
            return out

        skip, one, insert = np.flatnonzero(kind != _INSERT), np.flatnonzero(kind == _SKIP_FIRST), np.flatnonzero(kind == _INSERT)
        skips, ones = np.bincount(group[skip], minlength=total), np.bincount(group[one], minlength=total)
        f1, f2, single, longer = nth(skip, 0), nth(skip, 1), nth(insert, 0), nth(one, 0)
        near = np.where(kind == _INSERT, ones[group], skips[group] - 1 + ((kind == _SKIP_FIRST) & (single[group] < none)))
        best = np.where(kind == _INSERT, longer[group], np.where(f1[group] == np.arange(none), f2[group], f1[group]))
        shorter = np.where(kind == _SKIP_FIRST, single[group], none)
        best = np.minimum(best, shorter)  # rows of a group are in the order of preference
        some = np.flatnonzero(near > 0)
        return pa.RecordBatch.from_pydict({"id": pa.array(i[some]), "near": pa.array(near[some].astype(np.int64)), "best_n": pa.array(n[best[some]]), "best": pa.array(i[best[some]])})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # a group may go on in the next batch
        p, s = batch.column("p").to_numpy(), batch.column("s").to_numpy()
        cut = np.flatnonzero((p != p[-1]) | (s != s[-1]))
        if len(cut):
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, cut[-1] + 1)])
            held = [batch.slice(cut[-1] + 1)]
            yield groups(whole)
    if held:
        yield groups(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """words(id, word, n, part), ids in the order of the words -> (id, n_near, best_n, best): how many words are near, and the one of largest n, then smallest id.

    Words without a near word are left out.
    """
    spark = words.sparkSession
    ship(spark)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")).first()
    parts = max(1, -(-size["n"] // RANGE_WORDS))
    backward = written(_sorted_ranges(words.select("id", F.reverse("word").alias("word")), "word", parts).withColumn("part", F.spark_partition_id()), "reversed-words")
    prefix = trie_nodes(words).withColumnRenamed("nodes", "prefix")
    suffix = trie_nodes(backward).select("id", F.reverse("nodes").alias("suffix"))
    paths = written(words.select("id", "n").join(prefix, "id").join(suffix, "id"), "trie-paths")
    last = F.size("first")
    skips = F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", i + 1).alias("s"), F.when(F.get("first", i), _SKIP_FIRST).otherwise(_SKIP).cast("byte").alias("kind")),
    )
    inserts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", i).alias("s"), F.lit(_INSERT).cast("byte").alias("kind")))
    pairs = paths.select("id", "n", F.explode(F.concat(skips, inserts)).alias("x")).select("x.p", "x.s", "n", "id", "x.kind")
    rows = 2 * (size["chars"] or 0) + size["n"]
    dealt = pairs.repartition(bucket_count(rows * 33), "p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")
    met = dealt.mapInArrow(_met, "id long, near long, best_n long, best long")
    by = F.max(F.struct("best_n", (-F.col("best")).alias("best")))
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"), by.alias("x")).select("id", "n_near", F.col("x.best_n").alias("best_n"), (-F.col("x.best")).alias("best"))
    near = written(near, "near-words")
    discard(backward, paths)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """forms(id, form) without circles -> (id, form, root): pointers are followed twice as far in each round."""
    at = written(forms.withColumn("root", F.col("form")), "forms")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if at.join(further, "root", "left_semi").isEmpty():
            return at
        after = written(at.join(further, "root", "left").select("id", "form", F.coalesce("next", "root").alias("root")), "forms")
        discard(at)
        at = after


def spelling_groups(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """counts(word, n), words distinct -> (word, form, root, n, n_near, form_n).

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them.  form is
    the near word of largest n (ties: smallest in code-point order) if that is at least ratio times n, else
    null; root is where following forms ends, the word itself without a form.  ratio must be over 1, so
    that forms make no circle.  Null and empty words are left out; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counts = written(counts.where(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n")), "word-counts")
    parts = max(1, -(-counts.count() // RANGE_WORDS))
    ids = _sorted_ranges(counts, "word", parts).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), "word", "n")
    words = written(ids, "numbered-words")
    near = near_words(words)
    known = near.join(words.select("id", "n"), "id").withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    forms = _roots(known.where("form is not null").select("id", "form"))
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    named = forms.join(name("form"), "form").join(name("root"), "root").select("id", "form_word", "root_word", "form_n")
    all_ = words.select("id", "word", "n").join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return all_.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return spelling_groups(word_counts(docs, min_chars=7, min_count=2, edit=dropped_letter), ratio=10)


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE tbl AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')), '{_UPPER}', '{_SMALL}') AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS k FROM found WHERE length(r) >= 7 GROUP BY doc_id, r),
hashed AS (SELECT r, k, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode(doc_id || ':' || r)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) END AS h FROM own, tbl),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS w, k FROM hashed),
voc AS (SELECT w, sum(k)::BIGINT AS n FROM edited WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
cut AS (SELECT w, n, i, left(w, i::INTEGER) AS a, substr(w, i::INTEGER + 2) AS b FROM (SELECT w, n, unnest(range(length(w))) AS i FROM voc)),
less AS (SELECT DISTINCT w, n, a || b AS v FROM cut),
near AS (SELECT x.w, y.w AS v, y.n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b WHERE x.w <> y.w
  UNION ALL SELECT less.w, voc.w, voc.n FROM less JOIN voc ON voc.w = less.v
  UNION ALL SELECT voc.w, less.w, less.n FROM less JOIN voc ON voc.w = less.v),
best AS (SELECT w, count(*) AS n_near, first(v ORDER BY n DESC, v) AS v, max(n) AS vn FROM near GROUP BY w),
forms AS (SELECT voc.w, voc.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN vn >= 10 * voc.n THEN v END AS form,
  CASE WHEN vn >= 10 * voc.n THEN vn END AS form_n FROM voc LEFT JOIN best ON best.w = voc.w),
chase AS (SELECT w, w AS r FROM forms UNION ALL SELECT chase.w, forms.form FROM chase JOIN forms ON forms.w = chase.r WHERE forms.form IS NOT NULL)
SELECT forms.w AS word, forms.form, chase.r AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chase ON chase.w = forms.w JOIN forms AS e ON e.w = chase.r WHERE e.form IS NULL
"""
