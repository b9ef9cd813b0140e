"""Exact duplicates by a tree-merge of digest runs, in DataFrame operations alone.

Every partition of the input is a run of digests. In each round, groups of ``fan_in`` runs exchange their entries and
merge them: per run group and digest the smallest identifier and the number of rows stay. A run's own rows are
combined before they are sent (partial aggregation), so a third of all rows with one text is one entry per run
from the start, and no later step sees more of it than one entry per run. After the last round one run, still dealt
over all tasks by digest, holds every distinct text. Its entries go back to the first runs' entries, and from those,
by (run, digest), to the rows: the run salts hot texts.

An entry is verified at every level by what it is keyed by: SHA-256, a second hash of another family and the byte
length. Texts themselves are never sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, whole_texts
from tidemark.llm.storing import shuffled, small_or_shuffled, stored

FAN_IN = 8
#: Dropped rows of up to 60 bytes that may be broadcast.
BROADCAST_ROWS = 300_000
_KEY = ["digest", "second", "bytes"]


def normalised(text: Column) -> Column:
    """Runs of the six ASCII white-space characters as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("second"), F.octet_length("text").alias("bytes"))


def _merged(entries: DataFrame, run: Column) -> DataFrame:
    return entries.groupBy(run.alias("run"), *_KEY).agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))


def _members(docs: DataFrame, fan_in: int) -> DataFrame:
    """Per row: its keys, ``row``, and of its group ``first`` (null?, doc_id, row) and ``rows``."""
    leaves = stored(_keyed(whole_texts(docs)).withColumns({"run": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("row"))
    first_runs = _merged(leaves.select("run", *_KEY, order.alias("first"), F.lit(1).alias("rows")), F.col("run"))
    runs = 1 + (leaves.agg(F.max("run")).first()[0] or 0)
    level = first_runs
    while True:
        level = _merged(level, F.floor(F.col("run") / fan_in).cast("int"))
        runs = -(-runs // fan_in)
        if runs == 1:
            break
    groups = first_runs.select("run", *_KEY).join(shuffled(level.drop("run")), _KEY)
    return leaves.join(shuffled(groups), ["run", *_KEY])


def groups(docs: DataFrame, *, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the smallest doc_id stays; null ids come last, and among rows with the same id one
    stays. Null text equals empty text. Other columns are ignored. An empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")
    return _members(docs, fan_in).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("rows").cast("long").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, *, fan_in: int = FAN_IN) -> DataFrame:
    """docs with all its columns, without the rows that ``groups`` drops.

    Dropped rows are named by (doc_id, digests). Where rows repeat an id and a text, the one that stays is any of them. Null and empty texts are one
    group; a null id comes after all others. An empty table stays empty. Column names that begin with two underscores are reserved.
    """
    members = stored(_members(docs, fan_in).select(
        "doc_id", *_KEY, (F.col("row") == F.col("first.row")).alias("kept"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("same_id")), "members")
    names = {k: f"__{k}" for k in ("doc_id", *_KEY)}
    gone = small_or_shuffled(members.where(~F.col("same_id")).select(*[F.col(k).alias(v) for k, v in names.items()]).distinct(), BROADCAST_ROWS)
    text = normalised(F.col("text"))
    marked = docs.withColumns({"__at_digest": F.unhex(F.sha2(text, 256)), "__at_second": F.xxhash64(text), "__at_bytes": F.octet_length(text)})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    for k in _KEY:
        same &= F.col(f"__at_{k}") == F.col(f"__{k}")
    left = marked.join(gone, same, "left_anti")
    if members.where("same_id AND NOT kept").limit(1).count():
        left = left.dropDuplicates(["doc_id", *[f"__at_{k}" for k in _KEY]])
    return left.drop(*[f"__at_{k}" for k in _KEY])
