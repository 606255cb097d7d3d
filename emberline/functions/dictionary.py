"""Word lists searched in texts by one automaton for all their words.

A list of w words costs one pass over a text instead of w; the automaton is built once a task and texts come in Arrow
batches.  Every word that is there is found, also words within or across others.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, tokens

#: How entries are matched: as substrings, or only as whole neighbouring tokens.
MATCHES = ("substring", "token")


def token_key(word: str) -> str:
    """The tokens of an entry between blanks (` gpt 4 ` for GPT-4); empty if it has none."""
    own = re.findall(r"\w+", word.lower())
    return f" {' '.join(own)} " if own else ""


def token_text(text: Column) -> Column:
    """The tokens of a text between blanks, so that a token_key within it is a run of whole tokens.  Null: one blank each side."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


@lru_cache(maxsize=None)
def _finder(entries: tuple[tuple[str, tuple[str, ...]], ...]):
    """The function behind found(), one object a list, so that a plan with two uses of it runs it once."""
    built = []

    def automaton():
        if not built:
            import ahocorasick

            by_key: dict[str, list[int]] = {}
            for i, (_, keys) in enumerate(entries):
                for key in keys:
                    by_key.setdefault(key, []).append(i)
            a = ahocorasick.Automaton()
            for key, at in by_key.items():
                a.add_word(key, tuple(at))
            a.make_automaton()
            built.append(a)
        return built[0]

    def find(texts: pd.Series) -> pd.Series:
        a = automaton()
        out = []
        for text in texts:
            groups = {at for _, at in a.iter(text)} if text else ()
            out.append([entries[i][0] for i in sorted({i for at in groups for i in at})])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<string>")


def found(text: Column, entries: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """entries: (name, keys) pairs.  The names with a key that is a substring of the text, in the order given; null text: none."""
    entries = tuple((name, tuple(k for k in keys if k)) for name, keys in entries)
    return _finder(entries)(text) if any(keys for _, keys in entries) else F.array().cast("array<string>")


def found_within(text: Column, words: tuple[str, ...]) -> Column:
    """The words that are substrings, in the order given."""
    return found(text, tuple((w, (w,)) for w in words))


def _by_tokens(match: str) -> bool:
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    return match == "token"


def found_lower(text: Column, words: tuple[str, ...], match: str = "substring") -> Column:
    """The words whose lower-cased form is within the lower-cased text, in the order given; by whole tokens if so asked."""
    if _by_tokens(match):
        return found_tokens(text, words)
    return found(F.lower(text), tuple((w, (w.lower(),)) for w in words))


def found_upper(text: Column, words: tuple[str, ...], match: str = "substring") -> Column:
    """As found_lower by upper-cased forms; they differ in letters whose cases don't pair (the long s, sharp s, ...)."""
    if _by_tokens(match):
        return found_tokens(text, words)
    return found(F.upper(text), tuple((w, (w.upper(),)) for w in words))


def found_either_case(text: Column, words: tuple[str, ...], match: str = "substring") -> Column:
    """The words that found_lower or found_upper finds, in the order given.

    A text of ASCII alone is searched once, as both agree there; any other once in each case, with a zero character between.
    """
    if _by_tokens(match):
        return found_tokens(text, words)
    both = F.when(text.rlike(r"[^\x00-\x7F]"), F.concat(F.lower(text), F.lit("\x00"), F.upper(text))).otherwise(F.lower(text))
    return found(both, tuple((w, tuple(dict.fromkeys((w.lower(), w.upper())))) for w in words))


def found_tokens(text: Column, words: tuple[str, ...]) -> Column:
    """The words whose tokens are neighbouring tokens of the text, in the order given: AGI isn't in imaging, GPT-4 is in gpt 4."""
    return found(token_text(text), tuple((w, (token_key(w),)) for w in words))


def found_upper_inline(text: Column, words: tuple[str, ...], match: str = "substring") -> Column:
    """As found_upper; substrings are searched without Python, so that it may stand within functions over lists."""
    if _by_tokens(match):
        return found_tokens(text, words)
    return let(F.upper(text), lambda up: F.array_compact(F.array(*(F.when(F.contains(up, F.lit(w.upper())), F.lit(w)) for w in words))))
