"""Cleaning of crawled posts: roster filter, times, texts, entities and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_username, parsed_time, strip, url_domain

#: Accounts that may be broadcast (some 50 bytes a name); a larger roster is joined by shuffle.
BROADCAST_ACCOUNTS = 100_000


def by_roster(posts: DataFrame, roster: DataFrame) -> DataFrame:
    """Posts whose normalised author is in the roster; an empty name there lets empty authors through.

    Names are sent to every task only if there are at most BROADCAST_ACCOUNTS (counted up to that bound).
    """
    names = roster.select(norm_username(F.col("username")).alias("__name")).distinct()
    if roster.select("username").limit(BROADCAST_ACCOUNTS + 1).count() <= BROADCAST_ACCOUNTS:
        names = F.broadcast(names)
    return posts.join(names, norm_username(F.col("author_username")) == F.col("__name"), "left_semi")


def with_times(posts: DataFrame, offset_hours: int = 8) -> DataFrame:
    """created_ts (0 if unreadable), created_at_local (else the text, Z written out) and local_date (else empty)."""
    ts = parsed_time(F.col("created_at"))
    seconds = F.unix_seconds(ts)
    local = F.timestamp_seconds(seconds + offset_hours * 3600)
    sign = "+" if offset_hours >= 0 else "-"
    zone = f"{sign}{abs(offset_hours):02d}:00"
    written = F.regexp_replace("created_at", "Z$", "+00:00")
    return posts.withColumns(
        {
            "created_ts": F.coalesce(seconds, F.lit(0)),
            "created_at_local": F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone)), written),
            "local_date": F.coalesce(F.date_format(local, "yyyy-MM-dd"), F.lit("")),
        }
    )


def with_clean_text(posts: DataFrame) -> DataFrame:
    """raw_text, and clean_text with the entities' urls as <URL> and white space as single blanks."""
    text = F.coalesce("text", F.lit(""))
    urls = F.filter(F.transform(F.coalesce("entities.urls", F.array().cast("array<struct<url:string,expanded_url:string>>")), lambda u: u["url"]), lambda u: u.isNotNull() & (u != ""))
    marked = F.aggregate(urls, text, lambda t, u: F.replace(t, u, F.lit("<URL>")))
    return posts.withColumns({"raw_text": text, "clean_text": strip(F.regexp_replace(marked, r"\s+", " "))})


def with_clean_entities(posts: DataFrame) -> DataFrame:
    """Lower-cased hashtags, normalised mentions, and url_domains: the distinct domains of url or else expanded_url, in order."""
    urls = F.transform("entities.urls", lambda u: url_domain(F.coalesce(F.nullif(u["url"], F.lit("")), u["expanded_url"])))
    domains = F.array_sort(F.array_distinct(F.filter(urls, lambda d: d.isNotNull())))
    entities = F.col("entities").withField("hashtags", F.transform("entities.hashtags", F.lower)).withField("mentions", F.transform("entities.mentions", norm_username))
    return posts.withColumns({"entities": entities, "url_domains": F.coalesce(domains, F.array().cast("array<string>"))})


def latest(posts: DataFrame, by_length: bool = True) -> DataFrame:
    """One row a tweet_id: the latest, then (by_length) the longest record, then the smallest record; empty ids go.

    A partial aggregate keeps one record of each id a task before the shuffle, so that an id with very many records
    costs a row a task.  A null time is earlier than any other.
    """
    record = F.to_json(F.struct(*(F.col(c) for c in sorted(posts.columns))))
    order = F.struct(F.col("created_ts").isNull().alias("none"), (-F.col("created_ts")).alias("ts"), (-F.length(record) if by_length else F.lit(0)).alias("size"), record.alias("record"))
    best = posts.where("tweet_id <> ''").groupBy("tweet_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in posts.columns)), order).alias("best"))
    return best.select("best.*")


def clean(posts: DataFrame, roster: DataFrame | None = None, offset_hours: int = 8, by_length: bool = True) -> DataFrame:
    """All cleaning steps: a roster filter, one projection and one shuffle by id; by_length as in latest()."""
    return _cleaned(_timed(posts, roster, offset_hours), by_length)


def clean_recent(posts: DataFrame, roster: DataFrame | None, seconds: int, offset_hours: int = 8, by_length: bool = True) -> DataFrame:
    """recent(clean(...), seconds) without cleaning and shuffling older records.

    An id keeps its latest record, so that one is among the recent records if any is, and the latest time is that of all records.
    """
    return _cleaned(recent(_timed(posts, roster, offset_hours).where("tweet_id <> ''"), seconds), by_length)


def _timed(posts: DataFrame, roster: DataFrame | None, offset_hours: int) -> DataFrame:
    return with_times(posts if roster is None else by_roster(posts, roster), offset_hours)


def _cleaned(timed: DataFrame, by_length: bool) -> DataFrame:
    return latest(with_clean_entities(with_clean_text(timed)), by_length).withColumn("author", norm_username(F.col("author_username")))


def recent(posts: DataFrame, seconds: int) -> DataFrame:
    """Posts later than so many seconds before the latest one.

    The latest time is read first (one value), so that the scan gets a constant to filter by.
    """
    last = posts.agg(F.max("created_ts")).first()[0]
    return posts.where(F.col("created_ts") > (0 if last is None else last - seconds))
