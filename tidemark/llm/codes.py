"""Vectors as product codes: each part of a vector becomes the index of its nearest codebook entry.

Codebooks come from rounds of assignment and averaging over all vectors, in whole numbers, so that the result depends on
neither the order of rows nor the number of tasks. A round is one pass over the vectors: tasks keep sums by (part,
entry), Spark adds them, and only the codebooks (at most 256 entries a part) reach the driver.

An assignment does not compare a part with every entry. The part's coarse cell (its components divided by ``cell``) is
looked up in a table of cells already met. For a new cell the entries are compared over the cell's whole box: the entry
nearest to its middle is held against all others, and an entry that is farther than it everywhere in the box (the
difference of the two squared distances, at its minimum over the box, is above zero) is dominated and left out. The rest are kept
for the cell, and exact squared distances are computed for those alone. The bounds are whole numbers as well, so no
nearest entry is lost, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches
from tidemark.llm.storing import small_or_shuffled, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Width of a coarse cell, in units of 1 / SCALE.
CELL = 64
#: Cells that a task remembers before it starts over, and rows, boxes that are worked on at a time.
CELLS = 1 << 16
ROWS = 2048
BOXES = 256
#: Components from this size on (65,536 before scaling) could make sums of squares pass 64 bits.
LARGEST = 1 << 26
BROADCAST_LABELS = 50_000


class Cells:
    """The candidates of each coarse cell of one part position, worked out when the cell is first met."""

    def __init__(self, entries: np.ndarray, cell: int) -> None:
        self.entries, self.cell = entries, cell
        self.squares = (entries * entries).sum(1)
        self.apart = np.array([np.abs(entries - e).sum(1) for e in entries]).reshape(len(entries), len(entries))
        self.kept: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Per row of whole-numbered cells, the ascending indexes of the entries that can be nearest in it."""
        keys = [row.tobytes() for row in cells]
        if len(self.kept) > CELLS:
            self.kept.clear()
        new = list({k: i for i, k in enumerate(keys) if k not in self.kept}.values())
        for at in range(0, len(new), BOXES):
            rows = new[at: at + BOXES]
            for i, found in zip(rows, self._undominated(cells[rows])):
                self.kept[keys[i]] = found
        return [self.kept[k] for k in keys]

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        # twice the middle of each box [low, low + cell - 1], a whole number
        middle = cells * (2 * self.cell) + (self.cell - 1)
        products = _products(middle, self.entries)
        best = (self.squares - products).argmin(1)
        # |x - e|^2 - |x - b|^2 = |e|^2 - |b|^2 - 2 x (e - b), least where 2 x (e - b) is largest
        largest = products - products[np.arange(len(best)), best][:, None] + (self.cell - 1) * self.apart[best]
        box, entry = np.nonzero(self.squares - self.squares[best][:, None] - largest <= 0)
        return np.split(entry, np.flatnonzero(np.diff(box)) + 1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in whole numbers; by floating point where that is exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Coder:
    """Nearest entries of all parts; keeps the cells of each part position."""

    def __init__(self, books: np.ndarray, cell: int) -> None:
        self.books = books
        self.cells = [Cells(b, cell) for b in books]
        self.cell = cell

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of indexes and of squared distances; ties go to the lower index."""
        width = self.books.shape[2]
        index = np.empty((len(vectors), len(self.books)), np.int64)
        distance = np.empty_like(index)
        for p, cells in enumerate(self.cells):
            part = vectors[:, p * width: (p + 1) * width]
            found = cells.candidates(part // self.cell)
            sizes = np.array([len(x) for x in found])
            entry = np.concatenate(found)
            row = np.repeat(np.arange(len(part)), sizes)
            d = np.empty(len(entry), np.int64)
            for at in range(0, len(entry), 1 << 15):
                apart = part[row[at: at + (1 << 15)]] - cells.entries[entry[at: at + (1 << 15)]]
                d[at: at + (1 << 15)] = np.einsum("ij,ij->i", apart, apart)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            distance[:, p] = np.minimum.reduceat(d, first)
            nearest = np.flatnonzero(d == np.repeat(distance[:, p], sizes))
            index[:, p] = entry[nearest[np.unique(row[nearest], return_index=True)[1]]]
        return index, distance


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)


def _sums(books: Broadcast[np.ndarray], cell: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, part and entry: the number of parts assigned to it and their sum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books.value, cell)
        parts, entries, width = coder.books.shape
        n = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for _, vectors in _vectors(batches):
            index, _ = coder.assign(vectors)
            for p in range(parts):
                np.add.at(n[p], index[:, p], 1)
                np.add.at(sums[p], index[:, p], vectors[:, p * width: (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                               pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return work


def _codes(books: Broadcast[np.ndarray], cell: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books.value, cell)
        for part, vectors in _vectors(batches):
            index, distance = coder.assign(vectors)
            yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array([row.tobytes().hex() for row in index.astype(np.uint8)]),
                                   pa.array(distance.sum(1))], ["vec_id", "label", "code", "error"])

    return work


def whole_numbers(vectors: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (floor of ``scale`` times each component); rows whose vector is null, empty or holds null or non-finite components are left out."""
    v = F.col("embedding")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(usable).select("vec_id", label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def _start(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    lengths = rows.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.max(F.expr("array_max(transform(vector, x -> abs(x)))")).alias("top")).first()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if lengths["least"] != lengths["most"] or lengths["most"] % parts:
        raise ValueError(f"vectors need one length that {parts} divides, found {lengths['least']} to {lengths['most']}")
    if lengths["top"] >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more in size would pass 64 bits")
    return np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def codebooks(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> np.ndarray:
    """(part, entry, component) after ``rounds`` rounds over ``whole_numbers``."""
    books = _start(rows, entries, parts)
    if not books.size:
        return books
    width = books.shape[2]
    spark = rows.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = in_batches(rows, _sums(sent, cell), "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        after = books.copy()
        for r in sums.collect():  # a row for each entry at most
            after[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        sent.unpersist()
        if (after == books).all():
            break  # further rounds would change nothing
        books = after
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``, a row for each usable vector.

    Rows whose ``embedding`` is null or empty, or holds null or non-finite components, are dropped. With fewer vectors than
    entries the codebooks are shorter; repeated vectors give repeated entries, of which the first is used. Null vec_ids
    come last in the order that the first entries are taken in, repeated vec_ids are ordered by their vectors. Null labels form one group,
    without a label column all do. Vectors of different lengths, or of a length that ``parts`` does not divide, and components of
    65,536 or more raise ValueError. An empty table gives no rows. Other columns are ignored.

    Errors of a label are summed by (label, salt) first and come back to the rows by it, so a label that a third of
    all vectors carry is dealt over all tasks.
    """
    ensure_columns(vectors, "vec_id", "embedding")
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = stored(whole_numbers(vectors, scale=scale), "whole")
    books = codebooks(rows, parts=parts, entries=entries, rounds=rounds, cell=cell)
    spark = rows.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    ident = rows.schema["vec_id"].dataType.simpleString()
    coded = stored(in_batches(rows, _codes(spark.sparkContext.broadcast(books), cell), f"vec_id {ident}, label {kind}, code string, error bigint"), "codes")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    salted = coded.groupBy("label", "salt").agg(F.sum("error").alias("error"))
    totals = salted.groupBy("label").agg(F.sum("error").alias("label_error"))
    entry = salted.select(F.col("label").alias("of"), F.col("salt").alias("at")).join(totals.withColumnRenamed("label", "total_of"), F.col("of").eqNullSafe(F.col("total_of"))).drop("total_of")
    back = small_or_shuffled(stored(entry, "label-errors"), BROADCAST_LABELS)
    joined = coded.join(back, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
