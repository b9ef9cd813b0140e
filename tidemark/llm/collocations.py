"""Collocations: phrases of two to three words that stand together more often than their parts would.

The phrases are mined by partitioning (SON). Documents are dealt to a few shards by their id. A phrase found ``support``
times or more in a language's whole text is found ``ceil(support * share)`` times or more in one shard at least, share
being that shard's part of the language's words. So

1. every shard is mined completely at its lowered support, first words and pairs, then triples: longer phrases are
   looked at only where both phrases that are one word shorter can still reach the support;
2. the locally frequent phrases of all shards are united. What a phrase lacks in a shard it missed its support there by
   one at least; phrases whose counts cannot add up to the support any more go;
3. all others are counted exactly over all documents, and those below the support go.

A shard is no task: its documents lie in all partitions, a task counts slices of bounded size, and Spark sums them. In
steps 1 and 2 a phrase is a 64-bit hash, and a set of them a bitmap of fixed size (``BITMAP_BITS``), the only thing of the
texts that is broadcast. Collisions can only add phrases, which step 3 then counts exactly and drops; nothing is lost. Should a
corpus have more frequent phrases than the bitmap has bits, it prunes less and the exchanges grow up to all distinct
phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, slices
from tidemark.llm.storing import small_or_shuffled, stored

SUPPORT = 10
LONGEST = 3
SHARDS = 4
BITMAP_BITS = 1 << 27
#: Shards of languages (24 bytes each) that may be broadcast.
BROADCAST_GROUPS = 10_000
NO_LANGUAGE = "und"
#: Bytes of text that a task turns into words at a time.
SLICE_BYTES = 4 << 20
_WORD = r"[^.,;:!?\x09-\x0D\x20]+"
#: What ends a piece becomes a full stop, which therefore is never part of a word.
_PIECE_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BUCKET_BYTES = 4096


class Words:
    """The words of a slice of texts as numbers, with a break (number 0) after every piece.

    ``hashes(k)`` and ``places(k)`` have an entry per place where k words can begin.
    """

    def __init__(self, texts: list[bytes], languages: list[str], parts: list[int]) -> None:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        number[b"."]
        ids = []
        for text in texts:
            tokens = text.lower().translate(_PIECE_ENDS).replace(b".", b" . ").split()
            tokens.append(b".")
            ids.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
        lengths = [len(x) for x in ids]
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.words = list(number)
        self.is_word = self.ids > 0
        self.names = sorted(set(languages))
        own = {x: i for i, x in enumerate(self.names)}
        self.language = np.repeat(np.array([own[x] for x in languages], np.int32), lengths)
        self.parts, part_of = np.unique(np.array(parts, np.int64), return_inverse=True)
        self.part = np.repeat(part_of.astype(np.int32), lengths)
        word_hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.names], np.uint64)
        self._word_hash = word_hash
        self._hashes = [_mixed(word_hash[self.ids] ^ np.take(seeds, self.language) if len(seeds) else np.zeros(0, np.uint64))]

    def places(self, k: int) -> np.ndarray:
        """Marks the places where k words of one piece begin; n - k + 1 of them."""
        n = max(0, len(self.ids) - k + 1)
        marks = np.ones(n, bool)
        for i in range(k):
            marks &= self.is_word[i: i + n]
        return marks

    def hashes(self, k: int) -> np.ndarray:
        while len(self._hashes) < k:
            shorter = self._hashes[-1]
            n = max(0, len(shorter) - 1)
            follow = self._word_hash[self.ids[len(self.ids) - n:]]
            self._hashes.append(_mixed(shorter[:n] * _ODD + follow))
        return self._hashes[k - 1]

    def phrases(self, begin: np.ndarray, k: int) -> pa.Array:
        """The k words from each of these places, with a space between."""
        words = pa.array(self.words, pa.binary())
        parts = [words.take(pa.array(self.ids[begin + i])) for i in range(k)]
        return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")).cast(pa.string())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _position(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes.view(np.int64) & (bits - 1)


def _holds(bitmap: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bitmap[position >> 3] >> (position & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(spark: SparkSession, hashes: DataFrame, bits: int) -> Broadcast[np.ndarray]:
    """Broadcasts the set of all values of ``hash``, cut to ``bits`` positions, as a bitmap of bits / 8 bytes."""
    p = F.col("hash").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits")).collect()
    found = np.zeros(max(bits // 8, _BUCKET_BYTES), np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * _BUCKET_BYTES
        found[at: at + _BUCKET_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(found)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for part, texts in slices(batches, "text", SLICE_BYTES):
        yield Words(texts, part.column("lang").to_pylist(), part.column("part").to_pylist())


def _local_counts(sizes: tuple[int, ...], shorter: Broadcast[np.ndarray] | None, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per slice, part (a shard of a language) and hash of so many words: how often it is found where both shorter phrases are in the bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _sliced(batches):
            for k in sizes:
                marks = words.places(k)
                if shorter is not None and len(marks):
                    held = _holds(shorter.value, _position(words.hashes(k - 1), bits))
                    marks &= held[:-1] & held[1:]
                at = np.flatnonzero(marks)
                group, hashes = words.part[at], words.hashes(k)[at]
                for g in np.unique(group):
                    own, found = np.unique(hashes[group == g], return_counts=True)
                    yield pa.record_batch([pa.repeat(pa.scalar(int(words.parts[g]), pa.int64()), len(own)), pa.array(own.view(np.int64)), pa.array(found, pa.int64())], ["part", "hash", "count"])

    return work


def _global_counts(united: Broadcast[np.ndarray], longest: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per slice and phrase of the united set, its exact count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _sliced(batches):
            for k in range(1, longest + 1):
                at = np.flatnonzero(words.places(k) & _holds(united.value, _position(words.hashes(k), bits)))
                language = words.language[at]
                for g in np.unique(language):
                    own = at[language == g]
                    key = words.ids[own].astype(np.int64)
                    for i in range(1, k):  # what is longer than a pair by numbers, so that a key never passes 64 bits
                        key = (key if i == 1 else np.unique(key, return_inverse=True)[1]) * len(words.words) + words.ids[own + i]
                    _, first, found = np.unique(key, return_index=True, return_counts=True)
                    yield pa.record_batch([pa.repeat(pa.scalar(words.names[g], pa.string()), len(first)), words.phrases(own[first], k),
                                           pa.repeat(pa.scalar(k, pa.int32()), len(first)), pa.array(found, pa.int64())], ["lang", "phrase", "words", "count"])

    return work


def _supports(texts: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``n``), and (``part``, ``least``, ``slack``): the lowered support, and what phrases can have in all shards without reaching it in any."""
    n = F.sum(F.regexp_count("text", F.lit(_WORD)).cast("long"))
    parts = stored(texts.groupBy("part", "lang").agg(n.alias("n")).where("n > 0"), "parts")
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    # ceil(support * n of the part / n), in whole numbers
    least = F.expr(f"(cast(n AS decimal(20,0)) * {int(support)} + total - 1) div total")
    lowered = parts.join(totals.withColumnRenamed("n", "total"), "lang").select("part", "lang", least.alias("least"))
    slack = lowered.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    return totals, stored(lowered.join(slack, "lang").drop("lang"), "supports")


def counts(docs: DataFrame, *, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words found ``support`` times or more, and the number of words per language.

    Returns (``lang``, ``phrase``, ``words``, ``count``) and (``lang``, ``n``).
    """
    ensure_columns(docs, "doc_id", "text", "lang")
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang, F.pmod(F.xxhash64("doc_id"), F.lit(shards))).alias("part"))
    totals, supports = _supports(texts, support)
    supports = small_or_shuffled(supports, BROADCAST_GROUPS)
    shorter, united = None, None
    for sizes in [(1, 2), *[(k,) for k in range(3, longest + 1)]]:
        local = in_batches(texts, _local_counts(sizes, shorter, bits), "part bigint, hash bigint, count bigint").groupBy("part", "hash").agg(F.sum("count").alias("count"))
        frequent = stored(local.join(supports, "part").where("count >= least").select("hash", "count", "least", "slack"), "frequent")
        possible = frequent.groupBy("hash").agg(F.sum(F.col("count") - F.col("least") + 1).alias("over"), F.max("slack").alias("slack")).where(
            F.col("over") + F.col("slack") >= support).select("hash")
        if shorter is not None:
            shorter.unpersist()
        shorter = _bitmap(spark, possible, bits)
        united = shorter.value if united is None else united | shorter.value
    sent = spark.sparkContext.broadcast(united)
    found = in_batches(texts, _global_counts(sent, longest, bits), "lang string, phrase string, words int, count bigint").groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
    return stored(found.where(F.col("count") >= support), "phrases"), totals


def collocations(docs: DataFrame, *, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, swallowed: int = 50, most: int = 2000, bits: int = BITMAP_BITS) -> DataFrame:
    """Per language its ``most`` best phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Text is lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest floor(1000000 a a / (l r)), ties to the
    first cut; ``n`` all words of the language. A phrase inside a longer one that is found in ``swallowed`` percent of its
    places or more is left out. Order: score, a (both descending), phrase by UTF-8 bytes.

    Null text counts as empty, null lang as ``und``, null and repeated doc_ids as any other (each row counts). Languages
    without a phrase, and an empty table, give no rows. Other columns are ignored. Texts may be of any length; one text is
    cut into words at a time at least, so a task's memory follows its longest text.
    """
    found, totals = counts(docs, support=support, longest=longest, shards=shards, bits=bits)
    phrases = found.where("words > 1").withColumnRenamed("count", "a")
    word = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", "a", "words", word.alias("word"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "words", "k", F.concat_ws(" ", F.slice("word", F.lit(1), F.col("k"))).alias("front"),
        F.concat_ws(" ", F.slice("word", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"))
    left = found.select("lang", F.col("phrase").alias("front"), F.col("count").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    parts = cut.join(left, ["lang", "front"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * 1000000) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    scored = parts.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # every stretch of words inside a longer phrase, with the highest count of such a phrase
    inner = phrases.where("words > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> concat_ws(' ', slice(split(phrase, ' '), i, m)))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < swallowed * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
