"""Text column helpers: counts, presence, domains, tags and citation markers."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"


def count_of(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a substring. Texts without it, which are most, are neither copied nor measured."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    size = F.length(needle)
    return F.when(size > 0, F.when(~F.contains(text, needle), 0).otherwise((removed / size).cast("int"))).otherwise(0)


def word_spaced(text: Column) -> Column:
    """The text with every non-word character doubled into blanks, blanks at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(text, f"[^{_WORD}]", "  "), F.lit(" "))


def whole_word_count(spaced: Column, word: Column) -> Column:
    """Occurrences of a word (or phrase) that touch no other word character, in any script.

    `spaced` is word_spaced(text), computed once however many words are counted.
    """
    return count_of(spaced, word_spaced(word))


def word_total(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def any_present(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def weighted_presence(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the words that occur at least once."""
    return reduce(
        lambda a, b: a + b,
        [F.when(F.contains(text, F.lit(w)), F.lit(float(v))).otherwise(F.lit(0.0))
         for w, v in weights.items()],
    )


def presence_count(text: Column, words: list[str]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.when(F.contains(text, F.lit(w)), F.lit(1)).otherwise(F.lit(0)) for w in words],
    )


def pattern_hits(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """Total number of matches of several patterns."""
    flag = "(?i)" if ignore_case else ""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(flag + p)) for p in patterns])


def lookup(key: Column, mapping: dict) -> Column:
    """Value of a literal map, NULL when absent."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def first_upper(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def squeeze(text: Column) -> Column:
    """Whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def domain_of(url: Column) -> Column:
    """Lower-case network location (port included), one leading www. dropped."""
    netloc = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(netloc, r"^www\.", "")


def normalise_citations(text: Column) -> Column:
    """[n], [^n], (Sn) and {Sn} all become [Sn]."""
    step = F.regexp_replace(text, r"\[\^?(\d+)\]", "[S$1]")
    step = F.regexp_replace(step, r"\(\s*[Ss]\s*(\d+)\s*\)", "[S$1]")
    return F.regexp_replace(step, r"\{\s*[Ss]\s*(\d+)\s*\}", "[S$1]")


def cited_numbers(text: Column, max_id: Column) -> Column:
    """Distinct cited numbers within 1..max, in order of first appearance."""
    raw = F.regexp_extract_all(normalise_citations(text), F.lit(r"\[S(\d+)\]"), F.lit(1))
    numbers = F.transform(raw, lambda s: s.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= max_id)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to the value, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
