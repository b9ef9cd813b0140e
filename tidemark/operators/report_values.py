"""Values, directions and changes told in report sentences, read off the words around every number of percent.

A text is cut in front of each decimal number followed by "percent". Each cut is a mention: its value, the words before and behind it, and
what stands earlier on its line and in its clause. Which mention is the index's level, which is sure, and whether the text
talks about a change, is decided by tables over those words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import any_present, let, lookup

_CUT = r"(?i)(?<![\d.+-])(?=[+-]?\d+\.\d+\s*" + V.PERCENT + r"\b)"
_NUMBER = r"(?i)^[+-]?(\d+\.\d+)\s*" + V.PERCENT + r"\b"
#: Characters before a number in which its own two words are looked for; those of the tables are shorter by far.
_NEAR = 100


def _one_of(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def mentions(text: Column) -> Column:
    """Of each "<number> percent": at, value, signed, the two words before, the two behind (a comma left out), whether a word for the index stands before
    it on its line or in its clause, whether it is on the first line, and whether the text (but for a month) ends with it."""
    def mention(parts: Column, part: Column, i: Column) -> Column:
        def of(before: Column) -> Column:
            near, line = F.lower(F.right(before, F.lit(_NEAR))), F.lower(F.substring_index(before, "\n", -1))
            clause = F.lower(F.element_at(F.split(before, r"[^\p{L}\p{N}\s®_]"), -1))
            behind = F.lower(F.trim(F.regexp_replace(part, _NUMBER, "")))
            return F.struct(
                i.alias("at"), F.regexp_extract(part, _NUMBER, 1).alias("value"), part.rlike(r"^[+-]").alias("signed"),
                F.regexp_extract(near, r"([\p{L}_]+)\s*$", 1).alias("before"), F.regexp_extract(near, r"([\p{L}_]+)\s+[\p{L}_]+\s*$", 1).alias("before_that"),
                F.regexp_replace(F.regexp_extract(behind, r"^,?\s*(\p{L}+\s+\p{L}+)", 1), r"\s+", " ").alias("behind"),
                F.arrays_overlap(words_of(line), _texts(V.LEVEL_NOUNS)).alias("on_line"), F.arrays_overlap(words_of(clause), _texts(V.LEVEL_SUBJECTS)).alias("in_clause"),
                (~F.contains(before, F.lit("\n"))).alias("first_line"), behind.rlike(r"^(?:in\s+\p{L}+)?$").alias("ends"))

        return let(F.array_join(F.slice(parts, F.lit(1), i), ""), of)

    def found(parts: Column) -> Column:
        # a text that begins with a mention is cut there as well, or not at all
        whole = F.when(F.get(parts, F.lit(0)).rlike(_NUMBER), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
        return let(whole, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda part, i: mention(p, part, i + 1)))

    return let(F.split(text, _CUT), found)


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _best(of: Column, rank) -> Column:
    """Value of the mention with the lowest rank, the first of equals; NULL if none has one."""
    ranked = F.filter(F.transform(of, lambda m: F.struct(rank(m).alias("rank"), m["at"].alias("at"), m["value"].alias("value"))), lambda r: r["rank"].isNotNull())
    return F.get(F.array_sort(ranked), F.lit(0))["value"].try_cast("double")


def level(of: Column) -> Column:
    """The level among mentions: behind a verb, else behind a noun for it on the same line, else the first."""
    return _best(of, lambda m: F.when(_one_of(m["before"], V.LEVEL_VERBS), 0).when(m["on_line"], 1).otherwise(2))


def sure_level(of: Column) -> Column:
    """The level if its setting is one of: the index, then a verb; a phrase for it, then the end of the text (a month may follow); a verb on the first
    line, then a reading or change. Only values of two digits before the point are sure."""
    two_digits = F.filter(of, lambda m: m["value"].rlike(r"^\d{2,}\."))

    def rank(m: Column) -> Column:
        named = (m["before"] == "of") & _one_of(m["before_that"], V.LEVEL_NOUNS)
        return (F.when(_one_of(m["before"], V.SURE_VERBS) & m["in_clause"], 0)
                .when(m["ends"] & (named | (m["before"] == V.SURE_VERBS[0])), 1)
                .when(m["first_line"] & _one_of(m["before"], V.SURE_VERBS[:2]) & _one_of(m["behind"], V.SURE_ENDS), 2))

    return _best(two_digits, rank)


def tells_change(text: Column, of: Column) -> Column:
    """Whether percent points of change, a signed number or a number behind a verb of change are mentioned."""
    points = [f"{V.PERCENT} point {noun}" for noun in V.CHANGE_NOUNS]
    return F.exists(of, lambda m: m["signed"] | _one_of(m["before"], V.CHANGE_VERBS)) | any_present(F.regexp_replace(F.lower(text), r"\s+", " "), points)


def told_direction(text: Column) -> Column:
    """The standard direction of the first word that tells one; NULL if it has none."""
    return lookup(F.get(F.filter(words_of(text), lambda x: _one_of(x, V.DIRECTION_MENTIONS)), F.lit(0)), V.DIRECTION_WORDS)


# ---- glance rows --------------------------------------------------------------------------
def glance_rows(section: Column, names: list[str], directions: list[str]) -> Column:
    """(index_name, value, direction) of each index: the first number behind its name and a verb, with the first direction on the rest of its line.

    One pass over the section lists all names with their numbers and the rest of the line; directions are looked for in those short parts. The longest
    name that fits counts.
    """
    listed = "|".join(sorted(names, key=len, reverse=True))
    entry = rf"(?i)\b({listed})®?\s+(?:{'|'.join(V.GLANCE_VERBS)})\s*(\d+\.\d+)(?=([^\n]*))"
    known = {n.lower(): n for n in names}
    direction = rf"(?i)({'|'.join(directions)})"

    def rows(parts: Column) -> Column:
        told = F.transform(F.arrays_zip(parts["n"], parts["v"], parts["r"]), lambda p: F.struct(
            lookup(F.lower(p["n"]), known).alias("index_name"), p["v"].alias("value"), F.initcap(F.regexp_extract(p["r"], direction, 1)).alias("direction")))
        return F.filter(told, lambda r: r["direction"] != "")

    def firsts(found: Column) -> Column:
        return F.filter(found, lambda r, i: F.array_position(F.transform(found, lambda x: x["index_name"]), r["index_name"]) == i + 1)

    parts = F.struct(*[F.regexp_extract_all(section, F.lit(entry), F.lit(g)).alias(c) for g, c in enumerate("nvr", 1)])
    return F.when(section.isNotNull(), let(let(parts, rows), firsts))


# ---- names in sentences -------------------------------------------------------------------
def _behind(text: Column, mark: str) -> Column:
    """What follows the first place of the mark, whatever its case; NULL if it is not there."""
    at = F.instr(F.lower(text), F.lit(mark))
    return F.when(at > 0, F.substr(text, at + len(mark), F.length(text)))


def listed_names(sentence: Column) -> Column:
    """The list in a sentence: behind the colon that follows a noun for industries, else behind "including", else behind any colon; up to a full stop or semicolon."""
    low = F.lower(sentence)
    nouns = F.array_min(F.filter(F.array(*[F.instr(low, F.lit(n)) for n in V.LIST_NOUNS]), lambda p: p > 0))
    tails = [_behind(F.substr(sentence, nouns, F.length(sentence)), ":"), _behind(sentence, "including "), _behind(sentence, ": ")]
    return F.coalesce(*[F.nullif(F.substring_index(F.substring_index(t, ".", 1), ";", 1), F.lit("")) for t in tails])
