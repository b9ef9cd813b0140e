"""Web pages and evidence: article text, publication date, semantic filter, hit joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.stats import cosine
from tidemark.functions.text import matched, squeeze
from tidemark.runtime import with_imports

MAX_CONTENT = 5000
#: Characters of pages behind one batch of results.
BATCH_BYTES = 8 << 20
# HTML entities decoded in page text (fixed values)
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# fixed values: what holds a page's article, and the elements whose text belongs to it
CONTAINER_TAGS = {"article", "main"}
CONTAINER_CLASSES = {"article", "post", "content"}
CONTAINER_PROPERTY = "articlebody"
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
SKIPPED_TAGS = {"script", "style"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class ArticleText(HTMLParser):
    """Text of the first container of a page in document order, nested elements included, and of all paragraphs.

    Only text inside TEXT_TAGS counts, each stretch once, however such elements are nested. An end tag closes all elements
    opened since its own; one without a start is ignored.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements by tag, so that no event walks over them
        self.skipped = 0  # open elements whose text is none
        self.container: int | None = None  # its depth, while it is open
        self.texts = 0  # open text elements from the container on
        self.found = False
        self.inside: list[str] = []
        self.paragraphs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in TEXT_TAGS or tag == "br":
            self._add(" ")
        if tag in VOID_TAGS:
            return
        if not self.found:
            own = {k: (v or "").lower() for k, v in attrs}
            if tag in CONTAINER_TAGS or CONTAINER_CLASSES & set(own.get("class", "").split()) or own.get("itemprop") == CONTAINER_PROPERTY:
                self.found, self.container = True, len(self.open)
        self._count(tag, 1)
        self.open.append(tag)

    def _count(self, tag: str, step: int) -> None:
        self.count[tag] += step
        self.skipped += step * (tag in SKIPPED_TAGS)
        self.texts += step * (self.container is not None and tag in TEXT_TAGS)

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        last = None
        while last != tag:
            last = self.open.pop()
            self._count(last, -1)
            if self.container == len(self.open):
                self.container, self.texts = None, 0
        if tag in TEXT_TAGS:
            self._add(" ")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            if self.texts:
                self.inside.append(data)
            if self.count["p"]:
                self.paragraphs.append(data)

    def _add(self, blank: str) -> None:
        self.inside.append(blank)
        self.paragraphs.append(blank)


def main_text(html: str | None) -> str | None:
    """The text of a page's article, white space collapsed; null for a null page."""
    if html is None:
        return None
    parser = ArticleText()
    parser.feed(html)
    parser.close()
    return " ".join("".join(parser.inside if parser.found else parser.paragraphs).split())


def _main_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without their page and with its text; one page is an object at a time, and a result holds BATCH_BYTES of pages at most (one at least)."""
    for batch in batches:
        column, kept = batch.column("html"), batch.drop_columns(["html"])
        texts, begin, size = [], 0, 0
        for i in range(batch.num_rows):
            html = column[i].as_py()
            texts.append(main_text(html))
            size += len(html or "")
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                yield kept.slice(begin, i + 1 - begin).append_column("content", pa.array(texts, pa.string()))
                texts, begin, size = [], i + 1, 0


def decoded(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def visible_text(html: Column) -> Column:
    """Tags become blanks, entities are decoded, whitespace collapsed."""
    return squeeze(decoded(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]+>", " ")))


def page_title(html: Column) -> Column:
    title = visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title == "", "No title found").otherwise(title)


def page_articles(pages: DataFrame, limit: int = MAX_CONTENT) -> DataFrame:
    """Title and main content of each page.

    The content is the first article container of any tag, properly nested, else all paragraphs; longer contents
    are cut at the limit with '...' appended. Nesting is beyond patterns, so pages are parsed in Arrow batches.
    """
    rows = pages.select("page_id", "url", "html", page_title(F.col("html")).alias("title"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("html").schema)
    parsed = with_imports(rows).mapInArrow(_main_texts, f"{schema}, content string")
    return parsed.withColumn("content", F.when(F.length("content") > limit, F.concat(
        F.substring("content", 1, limit), F.lit("..."))).otherwise(F.col("content")))


def publication_date(html: Column) -> Column:
    """Content of the first date meta tag found, tags in priority order, either attribute order."""
    options = []
    for key, name in V.DATE_META_TAGS:
        tag = name.replace(".", r"\.")
        options += [
            matched(html, rf"(?is)<meta\b[^>]*\b{key}=[\"']{tag}[\"'][^>]*\bcontent=[\"']([^\"']+)[\"']", 1),
            matched(html, rf"(?is)<meta\b[^>]*\bcontent=[\"']([^\"']+)[\"'][^>]*\b{key}=[\"']{tag}[\"']", 1)]
    return F.coalesce(*options)


def fetched_hits(hits: DataFrame, pages: DataFrame, limit: int = 20) -> DataFrame:
    """Search hits joined to their pages: first hit per (query, url), first `limit` per query."""
    first = hits.groupBy("query_id", "url").agg(F.min("seq").alias("seq"))
    joined = first.join(pages.select("url", "title"), "url")
    order = W.partitionBy("query_id").orderBy("seq")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def semantic_filter(queries: DataFrame, evidence: DataFrame, as_of: Column, max_age: int = 45, top: int = 5) -> DataFrame:
    """Best matches per query among its fresh evidence; rows without a readable date stay.

    queries(query_id, query_vector), evidence(query_id, item_id, published, vector).
    """
    day = F.coalesce(F.col("published").try_cast("date"))
    fresh = evidence.where(day.isNull() | (day >= F.date_sub(as_of, max_age)))
    scored = fresh.join(queries, "query_id").select(
        "query_id", "item_id", cosine(F.col("query_vector"), F.col("vector")).alias("similarity"))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


IMPLICATION = r"(?im)^[-*]\s*(Sector|Company)[:\-]\s*(.+?)\s*\((bullish|bearish)\)"
IMPLICATION_SCHEMA = ("sectors array<struct<name:string,impact:string>>,"
                      "companies array<struct<name:string,ticker:string,impact:string>>,timing string")


def implications(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Sectors and companies with their impact: JSON where the text is JSON, else marked lines."""
    parsed = F.from_json("note", IMPLICATION_SCHEMA)
    is_json = F.col("note").rlike(r"^\s*\{")

    def tagged(kind: str) -> Column:
        source = F.coalesce(F.col("parsed_")[kind], F.array().cast(
            "array<struct<name:string,impact:string>>" if kind == "sectors"
            else "array<struct<name:string,ticker:string,impact:string>>"))
        label = "sector" if kind == "sectors" else "company"
        return F.transform(source, lambda e: F.struct(
            F.lit(label).alias("kind"), e["name"].alias("name"), F.lower(e["impact"]).alias("impact")))

    kinds, names, impacts = (F.regexp_extract_all(F.col("note"), F.lit(IMPLICATION), F.lit(i)) for i in (1, 2, 3))
    lines = F.transform(F.arrays_zip(kinds.alias("k"), names.alias("n"), impacts.alias("i")), lambda e: F.struct(
        F.lower(e["k"]).alias("kind"), F.trim(e["n"]).alias("name"), F.lower(e["i"]).alias("impact")))
    rows = notes.withColumn("parsed_", F.when(is_json, parsed))
    found = F.when(is_json, F.concat(tagged("sectors"), tagged("companies"))).otherwise(lines)
    return rows.select(*keys, F.inline(found))
