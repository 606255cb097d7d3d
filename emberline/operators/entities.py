"""Entities of posts (text, entities, url_domains): typed lists by variant, and their flat forms.

Known names are substrings of a text; with match="token" they are whole tokens of it, so that AGI isn't found in imaging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assets
from ..functions.dictionary import found_upper_inline
from ..functions.scalars import let
from .text import companies, products

#: Capitalised words and words all in capitals, whole ones in any script.
_CAPITALISED = r"(?<![\p{L}\p{N}_])(?:[A-Z][a-z]+|[A-Z]{2,})(?![\p{L}\p{N}_])"


def _list(c: Column) -> Column:
    """Entries that are there and not empty; a null list is empty."""
    return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def given(entities: Column, domains: Column) -> dict[str, Column]:
    """What comes with a post: tickers, hashtags, domains and mentions."""
    return {"tickers": _list(entities["cashtags"]), "hashtags": F.transform(_list(entities["hashtags"]), F.lower), "domains": _list(domains), "mentions": _list(entities["mentions"])}


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def first_entities(text: Column, entities: Column, domains: Column, match: str = "substring") -> Column:
    """Tickers, hashtags, domains, mentions and companies."""
    return _struct({**given(entities, domains), "companies": companies(text, assets.COMPANIES, match)})


def _any(words: tuple[str, ...], test) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(w)
    return out


def improved_keywords(text: Column, least: int = 4, most: int = 10, match: str = "substring") -> Column:
    """Known products, and capitalised words that aren't stop words; a word all in capitals needs a technical term in it.  Sorted, cut."""

    def fits(w: Column) -> Column:
        term = _any(assets.IMPROVED_TERMS, lambda t: F.contains(F.lower(w), F.lit(t.lower())))
        return (F.length(w) >= least) & ~w.isin(*assets.IMPROVED_STOPS) & (term | w.rlike("^[A-Z][a-z]+$"))

    words = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(0))), fits)
    return F.slice(F.array_sort(F.array_union(found_upper_inline(text, assets.IMPROVED_PRODUCTS, match), words)), 1, most)


def _named(text: Column, keywords: Column, match: str) -> Column:
    """Keywords and companies side by side: dictionaries are searched outside of the functions over lists."""
    return F.struct(keywords.alias("keywords"), companies(text, assets.GRAPH_COMPANIES, match).alias("companies"))


def improved_entities(text: Column, entities: Column, domains: Column, match: str = "substring") -> Column:
    """As first_entities with more companies, and keywords as technologies (a term within the upper-cased word) or products."""
    tech = lambda w: _any(assets.IMPROVED_TECH, lambda t: F.contains(F.upper(w), F.lit(t)))
    return let(
        _named(text, improved_keywords(text, match=match), match),
        lambda n: _struct(
            {
                **given(entities, domains),
                "companies": n["companies"],
                "products": F.filter(n["keywords"], lambda w: ~tech(w)),
                "technologies": F.filter(n["keywords"], tech),
            }
        ),
    )


def _listed(upper: Column) -> Column:
    """A whitelisted name within the word, or the word within such a name."""
    return _any(assets.FINAL_WHITELIST, lambda t: F.contains(upper, F.lit(t.upper())) | F.contains(F.lit(t.upper()), upper))


_ORDINARY = assets.FINAL_PLACES + assets.FINAL_NAMES + assets.FINAL_WORDS


def final_keywords(text: Column, least: int = 4, most: int = 10, match: str = "substring") -> Column:
    """Whitelisted names, and capitalised words that are neither stop words, places, names nor ordinary and touch a technical term.  Sorted, cut."""

    def fits(w: Column) -> Column:
        up = F.upper(w)
        return (F.length(w) >= least) & ~w.isin(*assets.FINAL_STOPS, *_ORDINARY) & (_any(assets.FINAL_TERMS, lambda t: F.contains(up, F.lit(t))) | _listed(up))

    words = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(0))), fits)
    return F.slice(F.array_sort(F.array_union(found_upper_inline(text, assets.FINAL_WHITELIST, match), words)), 1, most)


def final_entities(text: Column, entities: Column, domains: Column, match: str = "substring") -> Column:
    """As improved_entities by the whitelist; what is left is a product only if of 4 to 20 characters and not ordinary."""
    tech = lambda w: _listed(F.upper(w)) | _any(assets.FINAL_INDICATORS, lambda t: F.contains(F.upper(w), F.lit(t)))
    product = lambda w: ~tech(w) & F.length(w).between(4, 20) & ~w.isin(*_ORDINARY)
    return let(
        _named(text, final_keywords(text, match=match), match),
        lambda n: _struct(
            {**given(entities, domains), "companies": n["companies"], "products": F.filter(n["keywords"], product), "technologies": F.filter(n["keywords"], tech)}
        ),
    )


def rule_entities(text: Column, entities: Column, domains: Column, match: str = "substring") -> Column:
    """Tickers, companies, products, people, hashtags and domains."""
    g = given(entities, domains)
    found = {"companies": companies(text, assets.RULE_COMPANIES, match), "products": F.array_sort(products(text, assets.RULE_PRODUCTS, match))}
    return _struct({"tickers": g["tickers"], **found, "people": g["mentions"], "hashtags": g["hashtags"], "domains": g["domains"]})


def flat(entities: Column, kinds: tuple[str, ...]) -> Column:
    """The names of some kinds in one list."""
    return F.concat(*(entities[k] for k in kinds))


def keyed(entities: Column, kinds: tuple[str, ...]) -> Column:
    """The names of some kinds as `kind:name`."""

    def named(kind: str) -> Column:
        return F.transform(entities[kind], lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.concat(*map(named, kinds))


def cluster_entities(members: DataFrame, events: DataFrame, kinds: tuple[str, ...], entities: str = "entities") -> DataFrame:
    """members(cluster_id, id), events(id, entities) -> the union of the members' entities as rows (cluster_id, kind, name, posts)."""
    own = events.select("id", F.explode(F.array_distinct(keyed(F.col(entities), kinds))).alias("key"))
    rows = members.join(own, "id").groupBy("cluster_id", "key").agg(F.count(F.lit(1)).alias("posts"))
    return rows.select("cluster_id", F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("name"), "posts")
