"""Repeated passages by content-defined chunking with a gear hash.

* A gear hash rolls over the bytes of a text; its value depends on the last 16 bytes only. A chunk ends where the hash is larger than
  at the NEAR bytes before and not smaller than at the NEAR bytes after. Such places depend on the bytes around them and on nothing else, so an insertion
  moves no boundary but its own; chunks have more than NEAR bytes, about twice as many on average, and LONGEST at most.
* The unit of comparison is a chunk with MARGIN bytes on each side, which are among those that its boundaries depend on anyway (about 73 bytes):
  a copied passage of 250 bytes holds one whole wherever it stands, and unrelated texts hardly share one.
* Units are deduplicated by digest. Counts by digest come from one aggregation; only units that occur again are gathered further. The unit's first
  occurrence (smallest doc_id, then start) stays, the others are repeats of it. Repeats that follow one another in both documents join to one passage.
* Of equal texts only the first is cut into units; the others repeat it as a whole.
* Each passage is then extended byte by byte against its first occurrence, as far as the next passage of its document: what agrees beyond that
  lies in units of its own. Only the bytes at its two ends travel, REACH at first; the few that agree all the way, in stretches without boundaries,
  go again with more, up to FARTHEST at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, slices, whole_texts
from tidemark.llm.storing import small_or_shuffled, stored

NEAR, LONGEST = 20, 1024
#: Bytes on each side of a chunk that belong to its unit.
MARGIN = 16
#: Bytes at the ends of a passage that the first round of extension compares.
REACH = 128
FARTHEST = 8192
#: Bytes that a task holds as objects at a time while it compares ends.
SLICE_BYTES = 8 << 20
#: Rows of 60 bytes on equal texts that may be broadcast.
BROADCAST_EQUAL = 200_000
#: Bytes of the shortest unit.
SHORTEST = 50
_GEAR = np.random.default_rng(7).integers(1, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the gear values of the last 16 bytes, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def boundaries(text: bytes, near: int = NEAR, longest: int = LONGEST) -> list[int]:
    """Where the chunks of a text begin and end, 0 and its length included."""
    n = len(text)
    if not n:
        return [0]
    h = gear(np.frombuffer(text, np.uint8))
    padded = np.concatenate((np.zeros(near, np.uint32), h, np.zeros(near, np.uint32)))
    width, top = 1, padded
    while width < near:
        step = min(width, near - width)
        top, width = np.maximum(top[:-step], top[step:]), width + step
    places = np.flatnonzero((h > top[:n]) & (h >= top[near + 1: near + 1 + n])) + 1
    cuts = [0]
    for p in [*places.tolist(), n]:
        while p - cuts[-1] > longest:
            cuts.append(cuts[-1] + longest)
        if p > cuts[-1]:
            cuts.append(p)
    return cuts


def units(text: bytes) -> list[tuple[int, int]]:
    """Begin and end of each chunk with its margins, at the text's ends widened to SHORTEST bytes; a shorter text has none."""
    n = len(text)
    if n < SHORTEST:
        return []
    cuts = boundaries(text)
    found = [(max(0, a - MARGIN), min(n, b + MARGIN)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sorted({(min(a, max(0, b - SHORTEST)), max(b, min(n, a + SHORTEST))) for a, b in found})


def _equal_texts(docs: DataFrame) -> DataFrame:
    """Of texts that occur again: doc_id, digest, bytes, the smallest id (``first``) and the number of rows (``n``).

    Rows find their group by (digest, salt), the salt being drawn from the id, so a hot text is dealt over all tasks. Texts are not exchanged.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).where(
        F.col("bytes") >= SHORTEST)
    entries = rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = entries.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    return stored(rows.join(entries.select("digest", "salt").join(groups, "digest"), ["digest", "salt"]).select("doc_id", "digest", "bytes", "first", "n"), "equal")


def _units(docs: DataFrame, equal: DataFrame) -> DataFrame:
    """doc_id, start, length (bytes), the two halves of the digest and the weight (rows with this text) of each unit of all different texts."""
    fields = [("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("weight", pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [units(t) for t in texts]
            spans = np.array([s for own in found for s in own], np.int32).reshape(-1, 2)
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[a:b]) for t, own in zip(texts, found, strict=True) for a, b in own]), ">i8").reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(texts)), [len(own) for own in found]))
            columns = [part.column("doc_id").take(row), spans[:, 0], spans[:, 1] - spans[:, 0], digests[:, 0].astype(np.int64), digests[:, 1].astype(np.int64), part.column("weight").take(row)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)],
                                             names=[name for name, _ in fields])

    # rows that repeat an id and a text share the weight
    weight = F.greatest(F.expr("max(n) div count(*)"), F.lit(1).cast("long"))
    again = small_or_shuffled(equal.groupBy("doc_id", "digest").agg(F.max("first").alias("first"), weight.alias("n")).select(
        F.col("doc_id").alias("of"), F.col("digest").alias("with"), "first", "n"), BROADCAST_EQUAL)
    marked = docs.join(again, (F.col("doc_id") == F.col("of")) & (F.unhex(F.sha2("text", 256)) == F.col("with")), "left")
    rows = marked.where("first IS NULL OR first = doc_id").select("doc_id", "text", F.coalesce("n", F.lit(1)).cast("long").alias("weight"))
    return in_batches(rows, work, "doc_id bigint, start int, length int, high bigint, low bigint, weight bigint")


def _ends(docs: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """spans (doc_id, start, end) with ``before`` (the ``reach`` bytes before the start, backwards) and ``after`` (those after the end).

    Where rows that repeat an id have different bytes there, both are empty.
    """
    wanted = spans.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the document's length
    texts = whole_texts(docs).join(wanted, F.col("doc_id") == F.col("of")).select("doc_id", "text", "spans")
    names = ["doc_id", "start", "end", "before", "after"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    most = max(1, SLICE_BYTES // (2 * reach))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            rows = ((key, s["start"], s["end"], t[max(0, s["start"] - reach): s["start"]][::-1], t[s["end"]: s["end"] + reach])
                    for key, t, own in zip(part.column("doc_id").to_pylist(), texts, part.column("spans").to_pylist(), strict=True) for s in own)
            while some := list(islice(rows, most)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], kind) for i, kind in enumerate(kinds)], names=names)

    cut = in_batches(texts, work, "doc_id bigint, start int, end int, before binary, after binary")
    bytes_of = F.xxhash64("before", "after")
    one = cut.groupBy("doc_id", "start", "end").agg(F.min("before").alias("before"), F.min("after").alias("after"), (F.min(bytes_of) == F.max(bytes_of)).alias("one"))
    return one.select("doc_id", "start", "end", *[F.when(F.col("one"), F.col(c)).otherwise(F.lit(b"")).alias(c) for c in ("before", "after")])


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    other = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((other & -other).bit_length() - 1) // 8


def _with_room(runs: DataFrame) -> DataFrame:
    """runs with ``room_before`` and ``room_after``: the bytes up to the neighbouring passages of the document, 0 where another passage goes on."""
    along = Window.partitionBy("doc_id").orderBy("start", "end")  # the passages of one document
    fresh = F.coalesce((F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    numbered = runs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
    islands = numbered.groupBy("doc_id", "island").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("island")
    islands = islands.withColumns({"ahead": F.coalesce(F.lag("last").over(order), F.lit(0)), "behind": F.coalesce(F.lead("first").over(order), F.lit(2**31 - 1))})
    return numbered.join(islands, ["doc_id", "island"]).withColumns({
        "room_before": F.when(F.col("start") == F.col("first"), F.col("first") - F.col("ahead")).otherwise(0),
        "room_after": F.when(F.col("end") == F.col("last"), F.col("behind") - F.col("last")).otherwise(0)}).drop("island", "first", "last", "ahead", "behind")


def _extended(docs: DataFrame, runs: DataFrame, reach: int = REACH) -> DataFrame:
    """runs (doc_id, start, end, keep_id, shift, copies) as far as the bytes around agree with those around the first occurrence, up to the next run."""
    columns = ["doc_id", "start", "end", "keep_id", "shift", "copies"]
    rooms = ["room_before", "room_after"]
    runs = stored(_with_room(runs), "rooms")
    done = runs.where("room_before = 0 AND room_after = 0").select(columns)
    runs = runs.where("room_before > 0 OR room_after > 0")

    def compared(reach: int):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = max(1, SLICE_BYTES // (4 * reach))
            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    part = batch.slice(at, most)
                    moved, left = [], []
                    for side, room in zip(("before", "after"), rooms, strict=True):
                        room = np.array(part.column(room).to_pylist(), np.int64)
                        agree = np.array([common(a, b) for a, b in zip(part.column(f"own_{side}").to_pylist(), part.column(f"keep_{side}").to_pylist(), strict=True)], np.int64)
                        moved.append(np.minimum(agree, room))
                        left.append(np.where(agree == reach, np.maximum(room - reach, 0), 0))
                    start = np.array(part.column("start").to_pylist(), np.int64) - moved[0]
                    end = np.array(part.column("end").to_pylist(), np.int64) + moved[1]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *[part.column(c) for c in columns[3:]],
                                                      *[pa.array(x, pa.int32()) for x in left]], names=[*columns, *rooms])

        return work

    while not runs.isEmpty():
        at_keep = runs.select(F.col("keep_id").alias("doc_id"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
        ends = stored(_ends(docs, runs.select("doc_id", "start", "end").union(at_keep).distinct(), reach), "ends")
        own = ends.select("doc_id", "start", "end", F.col("before").alias("own_before"), F.col("after").alias("own_after"))
        keep = ends.select(F.col("doc_id").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("before").alias("keep_before"), F.col("after").alias("keep_after"))
        both = runs.join(own, ["doc_id", "start", "end"]).join(
            keep, (F.col("keep_id") == F.col("k")) & (F.col("start") + F.col("shift") == F.col("s")) & (F.col("end") + F.col("shift") == F.col("e"))).drop("k", "s", "e")
        moved = stored(in_batches(both, compared(reach), "doc_id bigint, start int, end int, keep_id bigint, shift int, copies bigint, room_before int, room_after int"), "extended")
        done = done.unionByName(moved.where("room_before = 0 AND room_after = 0").select(columns))
        runs, reach = moved.where("room_before > 0 OR room_after > 0"), min(reach * 8, FARTHEST)
    return done.groupBy("doc_id", "start", "end", "keep_id", "shift").agg(F.max("copies").alias("copies"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id``, ``start`` and ``length`` (UTF-8 bytes of the text), ``keep_id`` and ``keep_start`` (where its
    first occurrence stands), ``copies`` (occurrences of its most frequent unit) and ``kept`` (whether it is that first occurrence).

    A passage reaches as far as its bytes equal those of the first occurrence, or as the next passage of its document; a kept row covers all that its
    repeats do. A text that equals an earlier one is one passage as a whole, a repeat of the first such text; ``copies`` counts rows. Texts without repeated
    passages have no row; nor have null and empty texts, and rows with a null id. Rows that repeat an id count as further occurrences; passages of such
    rows whose texts differ around them are not extended. Other columns are ignored; an empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")
    docs = whole_texts(docs.where(F.col("doc_id").isNotNull()))
    equal = _equal_texts(docs)
    rows = stored(_units(docs, equal), "units")
    # written before they are joined, so that Spark can split the rows of a very common unit
    again = stored(rows.groupBy("high").agg(F.count("*").alias("n")).where("n > 1").select("high"), "again")
    shared = stored(rows.join(again, "high", "left_semi"), "shared")
    first = shared.groupBy("high", "low").agg(F.count("*").alias("n"), F.sum("weight").alias("copies"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1")
    first = stored(first, "first")
    found = shared.join(first, ["high", "low"]).select(
        "doc_id", "start", "length", F.col("first.doc_id").alias("keep_id"), (F.col("first.start") - F.col("start")).alias("shift"), "copies")
    # a run of units at one shift: each begins before the one in front of it ends
    run = Window.partitionBy("doc_id", "keep_id", "shift").orderBy("start", "length")
    fresh = F.coalesce((F.col("start") > F.max(F.col("start") + F.col("length")).over(run.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    numbered = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    joined = stored(numbered.groupBy("doc_id", "keep_id", "shift", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("copies").alias("copies")), "runs")
    is_first = (F.col("doc_id") == F.col("keep_id")) & (F.col("shift") == 0)
    whole = equal.where("doc_id > first").select("doc_id", F.lit(0).alias("start"), F.col("bytes").alias("end"), F.col("first").alias("keep_id"), F.lit(0).alias("shift"), F.col("n").alias("copies"))
    copied = stored(_extended(docs, joined.where(~is_first).select("doc_id", "start", "end", "keep_id", "shift", "copies")).unionByName(whole), "copied")
    covered = copied.select(F.col("keep_id").alias("doc_id"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"), "copies").union(
        joined.where(is_first).select("doc_id", "start", "end", "copies")).groupBy("doc_id", "start", "end").agg(F.max("copies").alias("copies"))
    along = Window.partitionBy("doc_id").orderBy("start", "end")  # distinct spans of one document, bounded by its length
    fresh = F.coalesce((F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    firsts = covered.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    firsts = firsts.select("doc_id", "start", "end", F.col("doc_id").alias("keep_id"), F.lit(0).alias("shift"), "copies", F.lit(True).alias("kept"))
    return copied.withColumn("kept", F.lit(False)).unionByName(firsts).select(
        "doc_id", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"), "keep_id",
        (F.col("start") + F.col("shift")).cast("long").alias("keep_start"), "copies", "kept")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with all its columns, each text without the passages that are repeats of an earlier one; documents stay, even if nothing is left.

    A row whose id is null keeps its text; null and empty texts stay as they are, and so does an empty table. The spans of one document travel as one array
    to its row. The column names ``__of`` and ``__gone`` are reserved.
    """
    ensure_columns(docs, "doc_id", "text")
    gone = repeats(docs).where("NOT kept").groupBy(F.col("doc_id").alias("__of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__gone"))  # bounded by the document's length
    kinds = docs.schema
    marked = docs.join(gone, docs["doc_id"] == gone["__of"], "left").drop("__of")
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            spans, known = part.column("__gone").to_pylist(), part.column(place).is_valid().to_pylist()
            new = []
            for text, own in zip(texts, spans, strict=True):
                kept, at = [], 0
                for s in own or ():
                    if s["start"] > at:
                        kept.append(text[at: s["start"]])
                    at = max(at, s["start"] + s["length"])
                new.append((b"".join(kept) + text[at:]).decode("utf-8", "ignore"))
            column = pa.array([t if ok else None for t, ok in zip(new, known, strict=True)], part.schema.field(place).type)
            yield part.set_column(place, part.schema.field(place), column).select(kinds.names)

    return in_batches(marked, work, kinds)
