"""Which texts contain which strings, and canonical names from a table, by postings instead of scans.

Containment: each text posts its distinct stretches of one to GRAM characters. A string asks by its rarest stretch only, as counted over the texts
(a shorter string by itself, which answers it exactly), and what the posting lists is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Words that a name and a spelling may share before candidates are verified one by one; up to there the first name of each set of words is known.
SETS = 3


def _stretches(text: Column, size: Column | int) -> Column:
    """The distinct stretches of a text that have so many characters; none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``asked``, ``text``): all texts of the same keys that contain an asked string, case and all.

    texts: keys, text; asked: keys, asked. Nulls and empty strings are never found and find nothing; repeated rows count once.
    """
    wanted = asked.select(*keys, "asked").where("asked <> ''").distinct()
    by_gram = wanted.select(*keys, "asked", F.explode(_stretches(F.col("asked"), F.least(F.length("asked"), F.lit(GRAM)))).alias("gram"))
    own = texts.select(*keys, "text").where("text <> ''").distinct()
    every = F.concat(*[_stretches(F.col("text"), n) for n in range(1, GRAM + 1)])
    postings = own.select(*keys, "text", F.explode(every).alias("gram")).join(by_gram.select(*keys, "gram").distinct(), [*keys, "gram"], "left_semi")
    sizes = postings.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    # a stretch that no text has rules its string out
    rarest = by_gram.join(sizes, [*keys, "gram"], "left").groupBy(*keys, "asked").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram")).where("n > 0")
    return postings.join(rarest.drop("n"), [*keys, "gram"]).where(F.contains("text", F.col("asked"))).select(*keys, "asked", "text")


# ---- canonical names ----------------------------------------------------------------------
def aliases_of(names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``alias``, ``name``): lower-case spellings of each name: itself, without " Products", with "and" for "&", the part before either; later names win."""
    name = F.col("name")
    parted = F.when(F.contains(name, F.lit(" & ")) | F.contains(name, F.lit(" and ")), F.substring_index(F.replace(name, F.lit(" and "), F.lit(" & ")), " & ", 1))
    spellings = F.array(name, F.regexp_replace(name, " Products$", ""), F.replace(name, F.lit(" & "), F.lit(" and ")), parted)
    rows = names.select(*keys, "position", "name", F.explode(F.array_distinct(F.array_compact(spellings))).alias("alias"))
    return rows.groupBy(*keys, F.lower("alias").alias("alias")).agg(F.max_by("name", "position").alias("name"))


def _contained(spellings: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clean, name, position, size): names that contain the spelling or stand in it; size is that of the shorter one."""
    low = names.select(*keys, F.lower("name").alias("low"), "name", "position")
    inside = containing(low.withColumnRenamed("low", "text"), spellings.select(*keys, F.col("clean").alias("asked")), keys).select(*keys, F.col("asked").alias("clean"), F.col("text").alias("low"))
    around = containing(spellings.withColumnRenamed("clean", "text"), low.select(*keys, F.col("low").alias("asked")), keys).select(*keys, F.col("text").alias("clean"), F.col("asked").alias("low"))
    return inside.unionByName(around).distinct().join(low, [*keys, "low"]).withColumn("size", F.least(F.length("clean"), F.length("low")))


def _spellings(raw: DataFrame, keys: list[str]) -> DataFrame:
    return raw.select(*keys, F.lower(F.trim("raw")).alias("clean")).where("clean IS NOT NULL").distinct()


def _answered(raw: DataFrame, names: DataFrame, aliases: DataFrame, keys: list[str], found: list[DataFrame], rest: Column) -> DataFrame:
    """raw with ``name``: by alias, else by the first of the found tables (keys, clean, name) that has it, else the rest."""
    rows = raw.select(*keys, "raw").distinct().withColumn("clean", F.lower(F.trim("raw")))
    tables = [aliases.select(*keys, F.col("alias").alias("clean"), "name"), *found]
    for i, t in enumerate(tables):
        rows = rows.join(t.select(*keys, "clean", F.col("name").alias(f"name{i}")), [*keys, "clean"], "left")
    return rows.select(*keys, "raw", F.coalesce(*[F.col(f"name{i}") for i in range(len(tables))], rest).alias("name"))


def canonical_names(raw: DataFrame, names: DataFrame, keys: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """(keys, raw, name) of each distinct spelling: by alias, else the longest containment either way (the earlier name on a tie), else itself without
    a footnote if over two characters, else NULL.

    raw: keys, raw; names: keys, position, name (a user's own list, of any length); aliases: keys, alias (lower case), name, by default those of
    ``aliases_of``. Null spellings have no row with a name.
    """
    contained = _contained(_spellings(raw, keys), names, keys).groupBy(*keys, "clean").agg(F.max_by("name", F.struct("size", -F.col("position"))).alias("name"))
    bare = F.trim(F.regexp_replace(F.trim("raw"), r"\s*\(\d+\)$", ""))
    return _answered(raw, names, aliases_of(names, keys) if aliases is None else aliases, keys, [contained], F.when(F.length(bare) > 2, bare))


def _sets(words: Column, size: int) -> Column:
    """All sets of so many of the words, in their order, as strings."""
    def join(*parts: Column) -> Column:
        return F.concat_ws("\u0000", *parts)

    if size == 1:
        return words
    if size == 2:
        return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: join(a, b))))
    return F.flatten(F.transform(words, lambda a, i: F.flatten(F.transform(words, lambda b, j: F.when(j > i, F.transform(F.slice(words, j + 2, F.size(words)), lambda c: join(a, b, c))).otherwise(
        F.array().cast("array<string>"))))))


def names_by_overlap(raw: DataFrame, names: DataFrame, keys: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """(keys, raw, name) of each distinct spelling: by alias, else the first containment in the order of names, else the name with most words in common
    (the earlier one on a tie), else itself.

    Words in common are found by sets of words, not by single ones: for one and two words the first name with each set answers, so a word that a
    third of all names share costs one row. Names that share three words or more meet the spelling by those and are counted.
    """
    spellings = _spellings(raw, keys)
    contained = _contained(spellings, names, keys).groupBy(*keys, "clean").agg(F.min_by("name", "position").alias("name"))

    def words_of(text: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))

    known = names.select(*keys, "name", "position", words_of(F.lower("name")).alias("words"))
    vocabulary = known.select(*keys, F.explode("words").alias("word")).distinct()
    # words that no name has can't be shared; without them long spellings have few sets
    asked = spellings.select(*keys, "clean", F.explode(words_of(F.col("clean"))).alias("word")).join(vocabulary, [*keys, "word"], "left_semi").groupBy(*keys, "clean").agg(
        F.array_sort(F.collect_set("word")).alias("asked"))  # the words of one spelling
    found = []
    for size in range(SETS, 0, -1):
        posted = known.select(*keys, "name", "position", "words", F.explode(_sets(F.col("words"), size)).alias("set"))
        wanted = asked.select(*keys, "clean", "asked", F.explode(_sets(F.col("asked"), size)).alias("set"))
        if size < SETS:
            first = posted.groupBy(*keys, "set").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
            best = wanted.join(first, [*keys, "set"]).groupBy(*keys, "clean").agg(F.min_by("name", "position").alias("name"))
        else:
            shared = F.size(F.array_intersect("asked", "words"))
            best = wanted.join(posted, [*keys, "set"]).groupBy(*keys, "clean").agg(F.max_by("name", F.struct(shared, -F.col("position"))).alias("name"))
        found.append(best)
    return _answered(raw, names, aliases_of(names, keys) if aliases is None else aliases, keys, [contained, *found], F.trim("raw"))
