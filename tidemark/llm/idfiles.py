"""Token ids as binary files: one concatenated id array per block with Elias-Fano coded document boundaries.

Format: a folder of Parquet files that Spark's own committed writer makes, so any store that Spark reaches will do and
lost executors leave no half files. A row is a block of whole documents (about BLOCK_IDS ids, at least one document):

    shard, block   order of the blocks; documents ascend by doc_id over (shard, block)
    n_docs, n_ids  long
    no_id          documents at the block's start whose doc_id is null
    first_id       smallest doc_id, or null
    doc_ids        Elias-Fano code of doc_id - first_id, for the documents that have one
    bounds         Elias-Fano code of the n_docs + 1 boundaries (0 ... n_ids)
    width          bytes of an id, 2 or 4
    ids            n_ids little-endian unsigned ids

Elias-Fano code of n values up to u, ascending: ``n``, ``u`` (u64), ``l`` (u8), ``samples`` (u32 count), the positions
of every 256th set bit of the upper part (u32 each, for select), then n*l bits of lower parts and the upper
parts in unary: about 2 + log2(u/n) bits a value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, slices, tokenizer_path, whole_texts
from tidemark.llm.tokens import SLICE_BYTES, encoder

END_ID = 1
BLOCK_IDS = 1 << 21
SAMPLE = 256
#: Rows of 20 bytes; 2 MB at most.
BROADCAST_BLOCKS = 100_000
_HEAD = struct.Struct("<QQBI")
SCHEMA = ("shard int, block int, n_docs bigint, n_ids bigint, no_id bigint, first_id bigint, doc_ids binary, bounds binary, "
          "width int, ids binary")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("no_id", pa.int64()),
                    ("first_id", pa.int64()), ("doc_ids", pa.binary()), ("bounds", pa.binary()), ("width", pa.int32()), ("ids", pa.binary())])


def ef_encode(values: np.ndarray) -> bytes:
    """Code of ascending unsigned values (repeats are allowed)."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    upper[places] = 1
    lower = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    samples = places[::SAMPLE].astype("<u4")
    return (_HEAD.pack(n, top, low, len(samples)) + samples.tobytes() + np.packbits(lower, bitorder="little").tobytes()
            + np.packbits(upper, bitorder="little").tobytes())


class EliasFano:
    """Reader of a code: single values by select, or all of them at once."""

    def __init__(self, code: bytes):
        self.n, self.top, self.low, samples = _HEAD.unpack_from(code)
        at = _HEAD.size + 4 * samples
        self.samples = np.frombuffer(code, "<u4", samples, _HEAD.size)
        size = -(-self.n * self.low // 8)
        self.lower = np.frombuffer(code, np.uint8, size, at)
        self.upper = np.frombuffer(code, np.uint8, -1, at + size)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i: jumps to the sampled set bit before it, counts on from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, bit = divmod(place + 1, 8)
            head = int(self.upper[byte]) >> bit << bit if byte < len(self.upper) else 0
            while (count := head.bit_count()) < left:
                left, byte = left - count, byte + 1
                head = int(self.upper[byte])
            for _ in range(left - 1):
                head &= head - 1
            place = 8 * byte + (head & -head).bit_length() - 1
        low = 0
        for k in range(self.low):
            bit = i * self.low + k
            low |= (int(self.lower[bit >> 3]) >> (bit & 7) & 1) << k
        return (place - i << self.low) | low

    def values(self) -> np.ndarray:
        """All values, as uint64."""
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def write_ids(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all documents, ascending by ``doc_id`` (nulls first; equal ids by text), to a new folder.

    docs: columns ``doc_id`` and ``text``; others are ignored. A null or empty text is the end id alone; repeated rows are
    written again. An empty table gives a folder without blocks. Texts are range-partitioned by doc_id and
    tokenised where they arrive; only the text crosses the network.
    """
    ensure_columns(docs, "doc_id", "text")
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        shard, block = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        held: list[bytes] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, count
            bounds = np.cumsum([0, *(len(x) // 4 for x in held)])
            ids = np.frombuffer(b"".join(held), "<u4")
            width = 2 if int(ids.max()) < 1 << 16 else 4
            known = np.array([k for k in keys if k is not None], dtype=np.int64)
            first = int(known[0]) if len(known) else None
            shifted = known.view(np.uint64) - np.array([first or 0], np.int64).view(np.uint64)
            row = [shard, block, len(keys), len(ids), len(keys) - len(known), first, ef_encode(shifted), ef_encode(bounds), width,
                   ids.astype(f"<u{width}").tobytes()]
            keys.clear(), held.clear()
            block, count = block + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for part, texts in slices(batches, "text", SLICE_BYTES):
            for key, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                keys.append(key)
                held.append(ids + end)
                count += len(ids) // 4 + 1
                if count >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    ordered = whole_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_batches(ordered, work, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a folder: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (little-endian unsigned 32-bit), cut out of the id arrays at the decoded boundaries.

    Starts need the ids of earlier shards. Those totals are one row per shard; only they are summed up in one task. The
    starts of blocks are broadcast while they are few enough, and joined by a shuffle of the blocks beyond.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    in_shard = Window.partitionBy("shard").orderBy("block")
    heads = blocks.select("shard", "block", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("shard_start"))
    starts = heads.withColumn("block_start", F.sum("n_ids").over(in_shard) - F.col("n_ids")).join(before, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block_start")).alias("before"))
    if starts.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                bounds = EliasFano(one["bounds"]).values().astype(np.int64)
                keys = (EliasFano(one["doc_ids"]).values() + np.array([one["first_id"] or 0], np.int64).view(np.uint64)).view(np.int64)
                keys = pa.concat_arrays([pa.nulls(one["no_id"], pa.int64()), pa.array(keys, pa.int64())])
                ids = np.frombuffer(one["ids"], f"<u{one['width']}").astype("<u4")
                if len(bounds) != one["n_docs"] + 1 or bounds[-1] != len(ids) or len(keys) != one["n_docs"]:
                    raise ValueError(f"damaged block {one['block']} of shard {one['shard']}")
                n = len(keys)
                whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([keys, pa.array(bounds[:-1] + one["before"]), pa.array(np.diff(bounds)), whole], schema=arrow)

    return in_batches(blocks.join(starts, ["shard", "block"]), work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
