"""Report configs in YAML: the subset that such files use, folded inside each file's row.

Keys, nested once; lists of scalars as "- item" lines or in brackets; plain and quoted scalars; comments; block texts (``|`` and ``>``), whose
lines are passed over. A file with anything else (tabs before text, lines that are neither key nor item, open quotes or brackets, items without a
key, anchors and the like) is broken and gets a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import let

_KEY = r"""^("[^"]*"|'[^']*'|[^\s"'\[\]{}&*!|>%@`,#-][^:]*?)\s*:(?:\s+(.*))?$"""
_ITEM = r"^-\s+(.*)$"
_SCALAR = r"""^(?:"[^"]*"|'[^']*'|[^\s"'\[\]{}&*!|>%@`].*)$"""
_LIST = r"""^\[\s*(?:(?:"[^"]*"|'[^']*'|[^\[\]{},"']+)\s*(?:,\s*(?:"[^"]*"|'[^']*'|[^\[\]{},"']+)\s*)*)?\]$"""
_PART = r"""("[^"]*"|'[^']*'|[^\[\],"']*[^\[\],"'\s][^\[\],"']*)"""


def unquoted(scalar: Column) -> Column:
    return F.regexp_replace(F.trim(scalar), r"""^"([^"]*)"$|^'([^']*)'$""", "$1$2")


def _inline(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(_PART), F.lit(1)), unquoted)


def _lines(text: Column) -> Column:
    """at, indent, key, item, value of each line that says something, outside of block texts; a line that can't be read has neither key nor item."""
    def read(x: Column, i: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), r"""^([^"'#]*?)\s+#.*$""", "$1")
        return F.struct(
            i.alias("at"), F.length(F.regexp_extract(x, r"^ *", 0)).alias("indent"), x.rlike(r"^ *\t").alias("tab"),
            F.when(bare.rlike(_KEY), unquoted(F.regexp_extract(bare, _KEY, 1))).alias("key"), F.when(bare.rlike(_ITEM), F.regexp_extract(bare, _ITEM, 1)).alias("item"),
            F.when(bare.rlike(_KEY), F.regexp_extract(bare, _KEY, 2)).alias("value"))

    said = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x, i: F.when(~x.rlike(r"^\s*(#.*)?$|^(---|\.\.\.)\s*$"), read(x, i))), lambda r: r.isNotNull())

    def outside(found: Column) -> Column:
        heads = F.filter(found, lambda r: r["value"].rlike(r"^[|>][+-]?$"))
        return F.filter(found, lambda r: ~F.exists(heads, lambda h: (h["at"] < r["at"]) & (h["indent"] < r["indent"]) & ~F.exists(
            found, lambda m: (m["at"] > h["at"]) & (m["at"] < r["at"]) & (m["indent"] <= h["indent"]))))

    return let(said, outside)


def _parent(lines: Column, r: Column) -> Column:
    """The key line that a line belongs to; an item may stand as far left as its key."""
    above = F.filter(lines, lambda p: (p["at"] < r["at"]) & p["key"].isNotNull() & ((p["indent"] < r["indent"]) | ((p["indent"] == r["indent"]) & r["item"].isNotNull())))
    return F.try_element_at(above, F.lit(-1))


def _below(lines: Column, head: Column) -> Column:
    """The list under a key: its items, or those in brackets on its own line."""
    items = F.filter(lines, lambda r: r["item"].isNotNull() & (_parent(lines, r)["at"] == head["at"]))
    return F.when(head["value"].rlike(_LIST), _inline(head["value"])).otherwise(F.transform(items, lambda r: unquoted(r["item"])))


def _root(lines: Column, key: str) -> Column:
    return F.get(F.filter(lines, lambda r: (r["indent"] == 0) & (r["key"] == key)), F.lit(0))


def _root_list(lines: Column, key: str) -> Column:
    head = _root(lines, key)
    return F.when(head.isNotNull(), _below(lines, head))


def _root_map(lines: Column, key: str) -> Column:
    head = _root(lines, key)
    inner = F.filter(lines, lambda r: r["key"].isNotNull() & (_parent(lines, r)["at"] == head["at"]))
    return F.when(head.isNotNull(), F.map_from_entries(F.transform(inner, lambda r: F.struct(r["key"], _below(lines, r)))))


def _reason(lines: Column) -> Column:
    """Why a file can't be read; NULL if it can."""
    def wrong(r: Column) -> Column:
        value = r["value"]
        return (F.when(r["tab"], "tab before text")
                .when(r["key"].isNull() & r["item"].isNull(), "neither key nor item")
                .when(r["item"].isNotNull() & ~r["item"].rlike(_SCALAR), "item is no scalar")
                .when(r["item"].isNotNull() & (F.coalesce(_parent(lines, r)["value"], F.lit("-")) != ""), "item without a list")
                .when(value.isNotNull() & (value != "") & ~value.rlike(_SCALAR) & ~value.rlike(_LIST) & ~value.rlike(r"^[|>][+-]?$"), "value is neither scalar nor list")
                .when((r["indent"] > 0) & r["key"].isNotNull() & (F.coalesce(_parent(lines, r)["value"], F.lit("-")) != ""), "key below a value"))

    found = F.get(F.filter(F.transform(lines, lambda r: F.struct(r["at"].alias("at"), wrong(r).alias("why"))), lambda x: x["why"].isNotNull()), F.lit(0))
    twice = F.filter(lines, lambda r: r["key"].isNotNull() & (F.size(F.filter(lines, lambda o: (o["key"] == r["key"]) & F.coalesce(
        _parent(lines, o)["at"], F.lit(-1)).eqNullSafe(F.coalesce(_parent(lines, r)["at"], F.lit(-1))))) > 1))
    return F.coalesce(F.when(found.isNotNull(), F.concat(F.lit("line "), (found["at"] + 1).cast("string"), F.lit(": "), found["why"])),
                      F.when(F.size(twice) > 0, "repeated key"), F.when(_root(lines, "indices").isNull(), "no indices"))


def read_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """path, indices, index_categories, canonical_industries and ``reason`` (NULL if readable) of each .yaml or .yml file below a folder."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = text.where(F.col("path").rlike(r"\.ya?ml(/|$)")).select("path", F.inline(F.array(F.struct(_lines(F.col("value")).alias("lines")))))
    rows = rows.select("path", "lines", F.inline(F.array(F.struct(_reason(F.col("lines")).alias("reason")))))
    lines, fine = F.col("lines"), F.col("reason").isNull()
    return rows.select("path", F.when(fine, _root_list(lines, "indices")).alias("indices"), F.when(fine, _root_map(lines, "index_categories")).alias("index_categories"),
                       F.when(fine, _root_list(lines, "canonical_industries")).alias("canonical_industries"), "reason")
