"""Column functions: names, times, texts, domains and engagement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_username(name: Column) -> Column:
    """Lower case, leading @ signs off, then white space off; null is empty.  A leading blank protects the @."""
    return strip(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "^@+", ""))


def norm_username_all(name: Column) -> Column:
    """As norm_username, with every @ sign off."""
    return strip(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("@")))


def url_domain(url: Column) -> Column:
    """Authority of a url with one leading www. off, its case kept; null if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def url_domain_or_path(url: Column) -> Column:
    """Authority or else path, every www. off, lower-cased."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.replace(F.when(host != "", host).otherwise(path), F.lit("www."), F.lit("")))


def parsed_time(text: Column) -> Column:
    """ISO 8601 text as a timestamp (no offset: UTC), null if it can't be read."""
    return F.try_to_timestamp(text)


def weighted_engagement(likes: Column, reposts: Column, replies: Column, quotes: Column) -> Column:
    return (likes + 2 * reposts + 0.5 * replies + 1.5 * quotes).cast("double")


def shown_engagement(likes: Column, reposts: Column) -> Column:
    return likes + 2 * reposts


def preview(text: Column, k: int) -> Column:
    return F.when(F.length(text) > k, F.concat(F.substring(text, 1, k), F.lit("..."))).otherwise(text)


def ticker(tag: Column) -> Column:
    return F.when(tag.startswith("$"), tag).otherwise(F.concat(F.lit("$"), tag))


def permalink(author: Column, post: Column) -> Column:
    return F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), post)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_list(words: tuple[str, ...]) -> Column:
    """A constant array, as one expression that is folded while planning."""
    return F.split(F.lit("\x01".join(words)), "\x01")


def any_within(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any word is a substring."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
