"""Licence phrases by a positional index of rare words, in DataFrame operations alone.

* Templates are short licence sentences with a label. The document frequency of each of their words is counted over all
  documents; a template's anchors are its words with the highest inverse document frequency.
* The index posts every anchor with its template and position. A text's anchors are looked up; each one at word i, posted
  at position p, proposes that the template begins at word i - p. Anchors that propose the same begin intersect.
* A proposal counts if enough anchors agree on it and the template's mandatory key phrase stands in its place. Its coverage is
  the share of the template's words that stand in theirs.

All of it happens inside the text's own row, so nothing but word counts is shuffled. Base templates are phrases that must stand
whole: all their words are mandatory, and their rarest word finds every place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, ensure_columns

#: What separates words, after A-Z became lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Anchors of a template, and how many of them must agree.
ANCHORS, AGREE = 3, 2
#: A template's begin is kept as begin + _SHIFT, below _SPAN: templates are short, and an array has less than 2 ** 31 words.
_SHIFT, _SPAN = 1 << 16, 1 << 33


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: The mandatory phrase and where it begins in the template.
    key: tuple[str, ...]
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i: i + n] == self.key)


def _template(label: str, text: str, key: str | None = None) -> Template:
    return Template(label, tuple(text.split()), tuple((key or text).split()), key is None)


#: Base phrases and their labels, then sentences with their mandatory phrases.
TEMPLATES = (
    _template("cc-by", "cc by"),
    _template("gpl", "general public license"),
    _template("reserved", "all rights reserved"),
    _template("mit", "released under the mit license", "mit license"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    _template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    _template("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
)


def split_words(text: Column) -> Column:
    """The words of a text as an array (null text: empty)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each of the words (a short list) occurs, and the number of documents."""
    present = F.array_intersect(split_words(F.col("text")), F.array(*map(F.lit, words)))
    rows = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return {w: counts.get(w, 0) for w in words}, counts.get("", 0)


def anchors(templates: tuple[Template, ...], frequency: dict[str, int], total: int) -> list[list[tuple[str, int]]]:
    """For each template its anchors (word, position): the highest idf first, ties by position; of a base template one."""

    def idf(w: str) -> float:
        return math.log((total + 1) / (frequency[w] + 1))

    out = []
    for t in templates:
        first = {w: i for i, w in reversed(list(enumerate(t.words)))}
        ranked = sorted(first.items(), key=lambda x: (-idf(x[0]), x[1]))
        out.append(ranked[: 1 if t.base else ANCHORS])
    return out


def _sql(value: object) -> str:
    """A constant as SQL text."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dict):
        return f"named_struct({', '.join(f"'{k}', {_sql(v)}" for k, v in value.items())})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_sql, value))})"
    return f"'{value}'"


def _places(templates: tuple[Template, ...], found: list[list[tuple[str, int]]]) -> str:
    """SQL over the row's ``words`` and ``hits`` (word, at): where templates begin, by template, then begin, without repeats."""
    posted = _sql([{"word": w, "t": t, "p": p} for t, a in enumerate(found) for w, p in a])
    facts = _sql([{"label": t.label, "words": t.words, "key": t.key, "key_at": t.key_at, "base": t.base, "agree": min(len(a), AGREE),
                   "anchors": [{"word": w, "p": p} for w, p in a]} for t, a in zip(templates, found, strict=True)])
    # template and begin as one number, which array_distinct can hash and array_sort puts in order
    begins = f"""flatten(transform(hits, h -> transform(filter({posted}, p -> p.word = h.word), p -> p.t * {_SPAN} + h.at - p.p + {_SHIFT})))"""
    split = f"""transform(array_sort(array_distinct({begins})), c -> named_struct('t', element_at({facts}, CAST(c DIV {_SPAN} AS INT) + 1),
                'b', CAST(c % {_SPAN} - {_SHIFT} AS INT)))"""
    agree = "size(filter(x.t.anchors, a -> coalesce(get(words, x.b + a.p) = a.word, false))) >= x.t.agree"
    phrase = "x.b + x.t.key_at >= 0 AND slice(words, greatest(x.b + x.t.key_at, 0) + 1, size(x.t.key)) = x.t.key"
    same = "size(filter(transform(x.t.words, (w, i) -> coalesce(get(words, x.b + i) = w, false)), same -> same))"
    return f"""transform(filter({split}, x -> {agree} AND {phrase}), x -> named_struct(
        'label', x.t.label, 'start', CAST(x.b AS BIGINT), 'coverage', CAST({same} AS DOUBLE) / size(x.t.words), 'base', x.t.base))"""


def scan(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``n_words`` and ``places``, an array of (label, start, coverage, base) by template, then start.

    A template may begin before the text's first word (start below 0) if only its mandatory phrase is inside. A null or empty text has no
    words and no places. Repeated rows and null ids are kept; other columns are ignored. An empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")
    vocabulary = sorted({w for t in templates for w in t.words})
    frequency, total = document_frequencies(docs.select("text"), vocabulary)
    found = anchors(templates, frequency, total)
    names = sorted({w for posted in found for w, _ in posted})
    # inline() of one struct keeps the optimizer from copying the expression into each of its uses
    split = docs.select("doc_id", F.inline(F.array(F.struct(split_words(F.col("text")).alias("words")))))
    words, hits = F.col("words"), F.col("hits")
    anchored = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(names))
    none = F.array().cast("array<struct<word:string,at:int>>")
    marked = split.select("doc_id", "words", F.inline(F.array(F.struct(
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, names))), anchored).otherwise(none).alias("hits")))))
    places = F.expr(_places(templates, found))
    empty = F.array().cast("array<struct<label:string,start:bigint,coverage:double,base:boolean>>")
    return marked.select("doc_id", F.size(words).cast("long").alias("n_words"), F.inline(F.array(F.struct(
        F.when(F.size(hits) > 0, places).otherwise(empty).alias("places")))))
