"""Packing of documents into fixed windows by multiway differencing (Karmarkar-Karp).

Every task packs the documents of its own partition, block by block, so nothing is shuffled, memory is bounded by
the block and a lost task is simply run again (ids of windows come from the partition number and a counter).

* A document is its token ids and one end id. Whole stretches of ``window`` ids become full windows at once.
* What is left of a document (less than a window) is cut into pieces of at most ``piece`` ids. The pieces of about
  ``block`` windows are partitioned together: partial partitions are merged, the two of the largest spread first,
  the largest slots of the one with the smallest of the other, so that their imbalances oppose each other.
* If the fullest window exceeds its capacity, the number of windows rises by one and the block is done again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import ensure_columns, in_batches, slices, tokenizer_path, whole_texts
from tidemark.llm.tokens import SLICE_BYTES, encoder

WINDOW = 2048
END_ID = 1
#: Pieces of a document's rest, in ids. Smaller pieces give more equal windows and more cuts.
PIECE = 512
#: Windows that are filled together, and the part of them that is left free for the differences that remain.
BLOCK, FREE = 256, 0.005
OUT_BYTES = 8 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of the sizes, in ``ways`` groups of near-equal sums (empty groups are left out).

    A partial partition holds its non-empty slots, largest first, as (sum, members); members are an index or a pair.
    """
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        alone_a, alone_b = max(0, ways - len(b)), max(0, ways - len(a))
        merged = a[:alone_a] + b[:alone_b]
        merged += [(x[0] + (y := b[ways - 1 - i])[0], (x[1], y[1])) for i, x in enumerate(a[alone_a:], alone_a)]
        merged.sort(key=lambda slot: -slot[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    groups = []
    for _, members in heap[0][2] if heap else []:
        stack, group = [members], []
        while stack:
            m = stack.pop()
            if isinstance(m, tuple):
                stack.extend(m)
            else:
                group.append(m)
        groups.append(sorted(group))
    return groups


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups whose sums stay within the capacity; starts with the fewest windows that could do."""
    ways = -(-sum(sizes) // capacity)
    while True:
        groups = differencing(sizes, ways)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        ways += 1


def pack(docs: DataFrame, *, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK, vocabulary: str | None = None,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in that window, without gaps from 0.

    docs: columns ``doc_id`` and ``text``; all others are ignored, whatever their names. A null or empty text is the
    end id alone. Repeated rows and equal or null ids are packed like any others. An empty table gives no rows. A text of any length is encoded
    whole, one at a time if it is longer than a slice.
    """
    ensure_columns(docs, "doc_id", "text")
    if not 0 < piece <= window:
        raise ValueError("a piece must fit into a window")
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base, used = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = out = 0
        room = max(window, int(block * window * (1 - FREE)))

        def place(pieces: list[tuple]) -> None:
            nonlocal used, out
            for group in fill([len(p[2]) // 4 for p in pieces], window):
                offset = 0
                for i in group:
                    doc_id, start, ids, total = pieces[i]
                    n = len(ids) // 4
                    rows.append((doc_id, start, n, ids, total, base + used, offset))
                    offset += n
                    out += len(ids)
                used += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            out = 0
            return batch

        for part, texts in slices(batches, "text", SLICE_BYTES):
            end = np.array([end_id], "<u4").tobytes()
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                total, at = len(ids) // 4, 0
                while total - at >= window:
                    rows.append((doc_id, at, window, ids[4 * at: 4 * (at + window)], total, base + used, 0))
                    used, at, out = used + 1, at + window, out + 4 * window
                while at < total:
                    n = min(piece, total - at, room - held)
                    waiting.append((doc_id, at, ids[4 * at: 4 * (at + n)], total))
                    at, held = at + n, held + n
                    if held == room:
                        place(waiting)
                        waiting, held = [], 0
                if out > OUT_BYTES:
                    yield flush()
        if waiting:
            place(waiting)
        if rows:
            yield flush()

    return in_batches(whole_texts(docs), work, SCHEMA)
