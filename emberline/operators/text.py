"""Keywords, phrases, entities, actions and rule filters over post texts (tweet_id, text, ...)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assets
from ..functions.dictionary import found_either_case, found_lower, found_upper, found_within
from ..functions.scalars import any_within, let, tokens, word_list
from .topics import relevant

#: Longest dictionary entry, in tokens, of token_hits().
LONGEST_ENTRY = 8
#: The bitmap of a dictionary in token_hits() has at most 2 ** FILTER_BITS bits (8 MiB).
FILTER_BITS = 26


def ngrams(text: Column, n: int, least: int = 3) -> Column:
    """Runs of n neighbouring tokens, each of at least so many characters, joined by blanks."""
    words = tokens(text)
    pieces = [words] + [F.slice(words, i + 1, F.size(words)) for i in range(1, n)]
    runs = F.filter(F.arrays_zip(*(p.alias(f"w{i}") for i, p in enumerate(pieces))), lambda r: _all(r, n, least))
    return F.transform(runs, lambda r: F.concat_ws(" ", *(r[f"w{i}"] for i in range(n))))


def _all(run: Column, n: int, least: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        out = out & (F.coalesce(F.length(run[f"w{i}"]), F.lit(0)) >= least)
    return out


def _token_lists(posts: DataFrame) -> DataFrame:
    """(tweet_id, t): the tokens of each text of an id, one row an id.  Only texts of repeated ids are shuffled, which are sought first."""
    from ..sources.stages import staged

    again = posts.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("tweet_id").alias("again"))
    own = posts.select("tweet_id", tokens(F.col("text")).alias("t"))
    if again.isEmpty():
        return own.select("tweet_id", F.array("t").alias("t"))
    again = staged(again, "repeated-ids")
    same = F.col("tweet_id").eqNullSafe(F.col("again"))
    once = own.join(again, same, "left_anti").select("tweet_id", F.array("t").alias("t"))
    return once.unionByName(own.join(again, same, "left_semi").groupBy("tweet_id").agg(F.collect_list("t").alias("t")))


def _word_counter(least: int, stops: tuple[str, ...]):
    """A function that tasks get by value: lists of token lists to (row, word, words, n, first place), one entry a row and distinct word."""

    def count(column: pa.Array) -> tuple:
        outer, texts = column.offsets.to_numpy().astype(np.int64), column.flatten()
        inner, found = texts.offsets.to_numpy().astype(np.int64), texts.flatten().dictionary_encode()
        size, words = np.diff(inner), found.dictionary
        wanted = pc.and_(pc.greater_equal(pc.utf8_length(words), least), pc.invert(pc.is_in(words, value_set=pa.array(stops, pa.string())))).to_numpy(zero_copy_only=False)
        code = found.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(column)), np.diff(outer)), size)
        place = np.arange(len(code)) - np.repeat(inner[:-1] - inner[0], size)
        kept = np.flatnonzero(wanted[code])
        key = row[kept] * max(len(words), 1) + code[kept]
        by = np.argsort(key, kind="stable")
        key, start, n = np.unique(key[by], return_index=True, return_counts=True)
        first = np.minimum.reduceat(place[kept][by], start) if len(start) else start
        return key // max(len(words), 1), key % max(len(words), 1), words, n, first

    return count


def per_post(posts: DataFrame, least: int, stops: tuple[str, ...], use, schema: str, rows: int = 1000) -> DataFrame:
    """(tweet_id, ...) of what `use` makes of the words of each post: words of at least so many characters that aren't stop words.

    A post's words are counted where its text is read, without a shuffle.  use(row, word, words, n, first, posts) gets the counts of
    some posts, ordered by row and word number, and gives the rows and the columns of the schema.
    """
    count, kind = _word_counter(least, tuple(stops)), posts.select("tweet_id").schema["tweet_id"].dataType.simpleString()
    names = ["tweet_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                row, columns = use(*count(part.column(1)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *columns], names)

    return _token_lists(posts).mapInArrow(run, f"tweet_id {kind}, {schema}")


def word_counts(posts: DataFrame, least: int, stops: tuple[str, ...]) -> DataFrame:
    """tweet_id, word, n and pos (first place) of words of at least so many characters that aren't stop words."""

    def rows(row, word, words, n, first, posts):
        return row, [words.take(pa.array(word, pa.int64())), pa.array(n, pa.int64()), pa.array(first, pa.int32())]

    return per_post(posts, least, stops, rows, "word string, n bigint, pos int")


def phrase_counts(posts: DataFrame, least: int = 3, rows: int = 1000, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(phrase, n), a row a post and distinct phrase of so many neighbouring words of at least so many characters each, counted where the text is read."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                column = batch.column(0).slice(at, rows)
                outer, texts = column.offsets.to_numpy().astype(np.int64), column.flatten()
                inner, found = texts.offsets.to_numpy().astype(np.int64), texts.flatten().dictionary_encode()
                words, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
                long = pc.greater_equal(pc.utf8_length(words), least).to_numpy(zero_copy_only=False)[code]
                text = np.repeat(np.arange(len(texts)), np.diff(inner))
                row = np.repeat(np.arange(len(column)), np.diff(outer))[text]
                for size in sizes:
                    end = max(len(code) - size + 1, 0)  # phrases start before it
                    start = np.flatnonzero(np.logical_and.reduce([long[i : end + i] for i in range(size)]) & (text[:end] == text[size - 1 :][:end]))
                    group = code[start]
                    for i in range(1, size):  # numbered anew for each word, so that numbers stay small
                        group = np.unique(group * max(len(words), 1) + code[start + i], return_inverse=True)[1]
                    _, one, n = np.unique(row[start] * max(len(start), 1) + group, return_index=True, return_counts=True)
                    parts = (words.take(pa.array(code[start[one] + i], pa.int64())) for i in range(size))
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, " "), pa.array(n, pa.int64())], ["phrase", "n"])

    return _token_lists(posts).select("t").mapInArrow(run, "phrase string, n bigint")


def keywords(posts: DataFrame, least_count: int = 2, top: int = 10) -> DataFrame:
    """The most frequent words of each post, ties by first place: tweet_id, word, n, place."""

    def best(row, word, words, n, first, posts):
        kept = np.flatnonzero(n >= least_count)
        by = kept[np.lexsort((word[kept], first[kept], -n[kept], row[kept]))]
        place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
        by, place = by[place < top], place[place < top]
        return row[by], [words.take(pa.array(word[by], pa.int64())), pa.array(n[by], pa.int64()), pa.array(place + 1, pa.int32())]

    return per_post(posts, 4, assets.KEYWORD_STOPS, best, "word string, n bigint, place int")


def keyword_topics(posts: DataFrame, least_posts: int = 2, filtered: bool = True) -> DataFrame:
    """Keywords of at least so many posts, with their number and the first post (smallest id)."""
    k = keywords(posts, 1)
    k = k.where(relevant(F.col("word"))) if filtered else k
    return k.groupBy(F.col("word").alias("topic_key")).agg(F.count(F.lit(1)).alias("posts"), F.min("tweet_id").alias("tweet_id")).where(F.col("posts") >= least_posts)


def companies(text: Column, names: tuple[str, ...], match: str = "substring") -> Column:
    """Names (lower case) within the lower-cased text, with a capital; match="token": as whole tokens."""
    return F.transform(found_lower(text, names, match), F.initcap)


def products(text: Column, names: tuple[str, ...], match: str = "substring") -> Column:
    """Names whose upper-cased form is within the upper-cased text; match="token": as whole tokens."""
    return found_upper(text, names, match)


def gated_entities(text: Column, match: str = "substring") -> Column:
    """Dictionary entries within the text whatever the case, sorted; match="token": as whole tokens."""
    return found_either_case(text, tuple(sorted(set(assets.GATE_COMPANIES + assets.GATE_PRODUCTS + assets.GATE_CONCEPTS))), match)


def actions(text: Column, verbs: tuple[str, ...], match: str = "substring") -> Column:
    """Verbs within the text, sorted; match="token": as whole tokens."""
    return found_lower(text, tuple(sorted(set(verbs))), match)


GATE_VERBS = tuple(v for group in assets.GATE_VERBS.values() for v in group)


def _only_urls(text: Column) -> Column:
    """Nothing but urls and white space; most texts are settled by how they begin."""
    bare = F.replace(F.regexp_replace(text, r"https?://\S+", ""), F.lit("<URL>"), F.lit(""))
    return text.rlike(r"^\s*(?:https?://|<URL>|$)") & (F.regexp_replace(bare, r"\s+", "") == "")


def _only(text: Column, words: tuple[str, ...]) -> Column:
    """Tokens, all of them among the words; most texts are settled by their first token."""
    first = r"^[^\p{L}\p{N}_]*+(?:" + "|".join(f"\\Q{w}\\E" for w in words) + r")(?![\p{L}\p{N}_])"
    return F.lower(text).rlike(first) & let(tokens(text), lambda own: (F.size(own) > 0) & (F.size(F.array_except(own, word_list(words))) == 0))


def rule_reason(text: Column, domains: Column, n_entities: Column, n_verbs: Column) -> Column:
    """Why the rule-first variant drops a post: the first rule that fits, or null."""
    bare = F.trim(text)
    return (
        F.when(_only_urls(text), "only_url")
        .when(bare.startswith("RT @") | ((F.lower(F.left(bare, F.lit(3))) == "via") & (F.length(text) < 50)), "repost_form")
        .when(F.arrays_overlap(domains, word_list(assets.RULE_PLATFORMS)), "platform")
        .when((n_entities == 0) & (n_verbs == 0), "no_entity_no_action")
        .when(_only(text, assets.RULE_GENERIC), "generic")
    )


def event_reason(text: Column, n_entities: Column, action: Column) -> Column:
    """As rule_reason for the event-centric variant."""
    return (
        F.when(_only_urls(text), "only_url")
        .when(F.trim(text).startswith("RT @"), "repost_form")
        .when((n_entities == 0) & action.isNull(), "no_entity_no_action")
        .when(_only(text, assets.RULE_GENERIC), "generic")
    )


def gated_reason(text: Column) -> Column:
    """As rule_reason for the gated variant."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit(r"https?://([^\s/]+)"), F.lit(1)), lambda h: F.lower(F.replace(h, F.lit("www."), F.lit(""))))
    return (
        F.when(F.arrays_overlap(hosts, word_list(assets.GATE_PLATFORMS)), "platform").when(_only_urls(text), "only_url").when(_only(text, assets.GATE_STOPS), "generic")
    )


def token_hits(posts: DataFrame, dictionary: DataFrame, longest: int = LONGEST_ENTRY) -> DataFrame:
    """posts(tweet_id, text), dictionary(entry) of any size -> (tweet_id, entry, n): entries whose tokens are neighbouring tokens of a text, and how often.

    Runs of neighbouring tokens are joined to the entries' tokens.  Before that, each run is tested by a hash against a bitmap
    of the dictionary (at most 2 ** FILTER_BITS bits, sent to all tasks), so that hardly any but true matches are shuffled.
    Only run lengths that entries have are tested.  Entries that differ by case or punctuation alone are all found; those
    without tokens, null or empty find nothing, repeated ones count once, and one of more than `longest` tokens is an
    error.  Null and empty texts and empty tables give no rows.
    """
    spark = posts.sparkSession
    listed = dictionary.where("entry is not null").select("entry").distinct().select("entry", tokens(F.col("entry")).alias("t")).where(F.size("t") > 0)
    size = listed.groupBy(F.size("t").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").limit(longest + 1).collect()  # at most longest + 1 rows
    if size and size[-1].size > longest:
        raise ValueError(f"an entry has {size[-1].size} tokens, more than {longest}")
    sizes = tuple(r.size for r in size)
    bits = min(FILTER_BITS, max(6, (16 * sum(r.n for r in size)).bit_length()))
    slots = _run_slots(bits)

    def of_entries(batches):
        for batch in batches:
            found = [int(slots(t, len(t))[0]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["slot"])

    marked = listed.select("t").mapInArrow(of_entries, "slot long")
    groups = marked.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toPandas()  # at most 2 ** (bits - 6) rows
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[groups["at"].to_numpy(np.int64)] = groups["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(bitmap)

    def of_texts(batches):
        marks = sent.value
        for batch in batches:
            ids, runs = [], []
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                for n in sizes:
                    if len(t) >= n:
                        at = slots(t, n)
                        for k in ((marks[at >> 6] >> (at & 63)) & 1).nonzero()[0].tolist():
                            ids.append(i)
                            runs.append(" ".join(t[k : k + n]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(runs, pa.string())], ["tweet_id", "run"])

    kind = posts.select("tweet_id").schema["tweet_id"].dataType.simpleString()
    runs = posts.select("tweet_id", tokens(F.col("text")).alias("t")).mapInArrow(of_texts, f"tweet_id {kind}, run string")
    return runs.join(listed.select("entry", F.array_join("t", " ").alias("run")), "run").groupBy("tweet_id", "entry").agg(F.count(F.lit(1)).alias("n"))


def _run_slots(bits: int):
    """A function of a list of tokens and n to one number below 2 ** bits for each run of n neighbouring ones."""

    def slots(words: list, n: int):
        h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        end = len(words) - n + 1
        out = h[:end].copy()
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : end + k]
        return ((out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)

    return slots


def gate(posts: DataFrame, match: str = "substring") -> DataFrame:
    """posts with entity, action (first in order) and gate_reason (null if both are there)."""
    text = F.col("text")
    p = posts.withColumns({"entity": gated_entities(text, match), "action": F.get(actions(text, GATE_VERBS, match), F.lit(0))})
    reason = F.when(F.size("entity") == 0, "no_entity").when(F.col("action").isNull(), "no_action")
    return p.withColumn("gate_reason", reason)


def event_seeds(posts: DataFrame) -> DataFrame:
    """Posts by company and by relevant two-word phrase: (seed_type, seed_key, tweet_id)."""
    a = posts.select(F.lit("company").alias("seed_type"), F.explode(companies(F.col("text"), assets.COMPANIES)).alias("seed_key"), "tweet_id")
    phrases = posts.select(F.lit("phrase").alias("seed_type"), F.explode(F.array_distinct(ngrams(F.col("text"), 2))).alias("seed_key"), "tweet_id").where(F.size(found_within(F.col("seed_key"), assets.TOPIC_KEYWORDS)) > 0)
    return a.unionByName(phrases).distinct()


def seed_keys(tagged: DataFrame) -> DataFrame:
    """tagged(id, entities, phrases) -> (seed_key, id): tickers, companies (lower case) and phrases that hold a topic keyword."""
    part = lambda kind, c: tagged.select(F.explode(c).alias("x"), "id").select(F.concat(F.lit(f"{kind}:"), "x").alias("seed_key"), "id")
    relevant_phrases = F.filter("phrases", lambda p: any_within(p, assets.TOPIC_KEYWORDS))
    lowered = F.transform("entities.companies", F.lower)
    return part("ticker", F.col("entities.tickers")).unionByName(part("company", lowered)).unionByName(part("phrase", relevant_phrases)).distinct()


def co_occurrence(entities: DataFrame) -> DataFrame:
    """entities(tweet_id, entity) -> unordered pairs within a post and in how many posts they meet."""
    own = entities.groupBy("tweet_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    a = own.select("e", F.posexplode("e").alias("i", "a"))
    return a.select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def event_kind(posts: DataFrame) -> DataFrame:
    """tweet_id, kind and hits: the kind with most of its keywords within the text, ties to the first; none: no row."""
    def scores(hits: Column) -> Column:
        return F.array(*(F.struct(kind_hits(hits, ws).alias("hits"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, ws) in enumerate(assets.EVENT_KINDS.items())))

    best = posts.select("tweet_id", F.array_max(let(kind_words(F.col("text"), assets.EVENT_KINDS), scores)).alias("x"))
    return best.select("tweet_id", "x.kind", "x.hits").where("hits > 0")


def kind_words(text: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    """The words of all kinds that are within the lower-cased text."""
    return found_within(F.lower(text), tuple(dict.fromkeys(w for words in kinds.values() for w in words)))


def kind_hits(hits: Column, words: tuple[str, ...]) -> Column:
    """How many of the words are among those found by kind_words."""
    return F.size(F.filter(word_list(words), lambda w: F.array_contains(hits, w)))
