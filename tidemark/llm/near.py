"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct word shingles, 64-bit hashes of them. Documents with the same set are one node. A
node's signature is ``chunks * width`` MinHash values of 16 bits; the distance of two signatures is the number of places
where they differ.

* Pigeonhole: of two signatures at a distance below ``chunks * (errors + 1)``, at least one chunk differs in at most
  ``errors`` places. Every chunk is therefore posted once for each choice of ``errors`` places that may be wrong, keyed by
  the chunk, the choice and the values at the other places. All pairs under that distance share a key; none is missed.
  With 8 chunks of 4 and one error that is every pair at a distance of 15 or less, and of two sets with a similarity of
  0.8, whose signatures differ at 6.4 places on average, the chance to share no key is one in a million (0.18 ** 8).
* Candidates are confirmed on their full sets.
* A bucket (the nodes of one key) may hold a third of all rows. Its pairs are not written out. First every member meets the bucket's leader,
  the node that shares most keys with others, because the source of many copies is likely to be linked with them all; confirmed
  links join components, and buckets whose members now lie in one component are closed. The members of all other buckets are gathered once by the
  component that is largest in their bucket. There every node outside that component meets every node of the gathering, in blocks of bounded
  size; a task works out all intersections of two blocks at once and returns only the pairs of components that it found linked, a forest at most. So
  every candidate pair is either compared on full sets or already in one component: no link is lost.
* Every join says how it is done: a table is broadcast if a count shows that it is small, else both sides are shuffled. Spark's own estimate leaves out
  that a signature is posted under 32 keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, kept_by_worker, slices, whole_texts
from tidemark.llm.storing import shuffled, small_or_shuffled, stored
from tidemark.runtime import with_imports

WORDS = 5
SIMILARITY = (80, 100)
CHUNKS, WIDTH, ERRORS, FAR = 8, 4, 1, 20
#: Hashes of the sets in one block, and how many hashes a set counts for at least: a block has 2048 sets at most.
BLOCK_HASHES, LEAST_HASHES = 1 << 19, 256
#: Shingles whose incidences are multiplied at a time.
SLICE = 4096
#: Rows (40 bytes or less) of a table of nodes, keys or components that may be broadcast.
BROADCAST_ROWS = 300_000
#: Words that a worker keeps hashed.
KEPT_WORDS = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept between tasks."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _word_hashes() -> WordHashes:
    kept = kept_by_worker("words", WordHashes)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    return kept


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of a shorter text, the one of all its words; else none.

    Words are what stands between ASCII white space, with A-Z in lower case.
    """
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, split), np.uint64, len(split))
    if len(hashes) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(split), seed=len(split))], np.uint64)
    rolled = np.zeros(len(hashes) - words + 1, np.uint64)
    for i in range(words):
        rolled = _mix(rolled * _MULTIPLIER + hashes[i: i + len(rolled)])
    return np.unique(rolled)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_24)
    return r.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signature(found: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The low 16 bits of the smallest hash under each seeded function."""
    out = []
    for a, b in zip(*seeds, strict=True):
        h = found * a + b
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIER
        out.append(int(h.min()) >> 20 & 0xFFFF)
    return out


def _sketches(docs: DataFrame, words: int, places: int) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set, null if it is empty) and sig."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(places)
        for part, texts in slices(batches, "text"):
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s, seeds) if len(s) else None for s in sets], pa.list_(pa.int32()))], names=["doc_id", "n", "digest", "sig"])

    return in_batches(whole_texts(docs), work, "doc_id bigint, n bigint, digest binary, sig array<int>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its full set, for the given nodes (node, doc_id, digest). Read again from the texts of their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            node, want = part.column("node").to_pylist(), part.column("digest").to_pylist()
            out = [(n, s.view(np.int64)) for n, d, s in zip(node, want, (shingles(t, words) for t in texts), strict=True)
                   if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == d]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))],
                                             names=["node", "hashes"])

    wanted = small_or_shuffled(nodes.select("node", "doc_id", "digest"), BROADCAST_ROWS)
    return in_batches(whole_texts(docs).join(wanted, "doc_id"), work, "node bigint, hashes array<bigint>")


def _keys(sig: Column, chunks: int, width: int, errors: int) -> Column:
    """All keys of a signature: for each chunk, one for each choice of places that may be wrong."""
    out = []
    for c in range(chunks):
        for k, right in enumerate(combinations(range(width), width - errors)):
            out.append(F.xxhash64(F.lit(1000 * c + k), *[sig[c * width + i] for i in right]))
    return F.array(*out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge (a, b): the smallest node that it can reach.

    Large-star and small-star steps in turn, each a grouping and a join, until the edges are stars.
    """
    both = edges.select("a", "b").where("a <> b")
    before, ends = None, 2 * edges.count()
    while True:
        sides = both.union(both.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(small_or_shuffled(least, BROADCAST_ROWS, ends), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_or_shuffled(least, BROADCAST_ROWS, ends), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        both = stored(small.distinct(), "stars")
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, ends = now, 2 * now[0]


def links(docs: DataFrame, *, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, chunks: int = CHUNKS, width: int = WIDTH,
          errors: int = ERRORS, far: int = FAR) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (whether doc_id is component_id).

    Documents are linked if intersection / union of their sets is at least ``similarity`` (a fraction); component_id is the
    smallest doc_id that links reach, the document's own included. A text without words has an empty set and no links. Rows with a
    null id take no part: component_id null, kept. Of rows that repeat an id, each
    has the component of its own text. Other columns are ignored; an empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")
    rows = stored(_sketches(docs, words, chunks * width), "sketches")
    nodes = stored(
        rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = _linked(docs, nodes, words, similarity, chunks, width, errors, far)
    named = nodes.select("node", "doc_id", "digest").join(small_or_shuffled(found, BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = stored(named.groupBy("root").agg(F.min("doc_id").alias("component")), "components")
    of_digest = named.join(small_or_shuffled(first, BROADCAST_ROWS), "root").select(F.col("digest").alias("__digest"), "component")
    out = rows.join(shuffled(of_digest), rows["digest"] == of_digest["__digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int], chunks: int, width: int, errors: int, far: int) -> DataFrame:
    """(node, root) for all nodes that are linked with another."""
    posted = nodes.select("node", F.explode(_keys(F.col("sig"), chunks, width, errors)).alias("key"))
    shared = stored(posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    members = stored(posted.join(small_or_shuffled(shared, BROADCAST_ROWS), "key"), "members")
    centre = stored(members.groupBy("node").agg(F.sum("members").alias("shared")), "centres")
    facts = stored(nodes.join(small_or_shuffled(centre, BROADCAST_ROWS), "node"), "facts")
    members = members.select("key", "node")
    hashes = stored(_sets(docs, facts, words), "sets")
    part, whole = similarity
    lead = members.join(small_or_shuffled(centre, BROADCAST_ROWS), "node").groupBy("key").agg(F.max(F.struct("shared", "node")).alias("lead"))
    lead = stored(lead.select("key", F.col("lead.node").alias("a")), "leads")
    pairs = members.join(small_or_shuffled(lead, BROADCAST_ROWS), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    left, right = (facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    differ = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x != y), lambda d: d))
    near = pairs.join(shuffled(left), "a").join(shuffled(right), "b").where((whole * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b")) & (differ <= far))
    sets_a, sets_b = (hashes.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = near.select("a", "b", "n_a", "n_b").join(shuffled(sets_a), "a").join(shuffled(sets_b), "b")
    links = stored(near.where(whole * both >= part * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"), "links")
    roots = components(links)
    rows = members.join(small_or_shuffled(roots, BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    unlike = stored(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "unlike")
    open_ = stored(rows.join(small_or_shuffled(unlike, BROADCAST_ROWS), "key", "left_semi").select("key", "node", "root"), "open")
    more = stored(_between(open_, hashes, similarity), "between")
    if not more.limit(1).count():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _between(open_: DataFrame, hashes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components that share a bucket, as a forest for each block pair. open_: key, node and root."""
    largest = open_.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("x")).select("key", F.col("x.root").alias("home"))
    largest = small_or_shuffled(stored(largest, "largest"), BROADCAST_ROWS)
    gathered = open_.join(largest, "key").select("home", "node", "root").distinct()
    gathered = stored(gathered.join(shuffled(hashes), "node").select("home", "node", "root", F.greatest(F.size("hashes"), F.lit(LEAST_HASHES)).alias("weight")), "gathered")

    def blocks(weight: Column) -> Column:
        return F.greatest(F.ceil(F.sum(weight) / BLOCK_HASHES), F.lit(1)).cast("int")

    outside = F.col("root") != F.col("home")
    sizes = gathered.groupBy("home").agg(blocks(F.when(outside, F.col("weight")).otherwise(0)).alias("outer"), blocks(F.col("weight")).alias("inner"))
    sized = gathered.join(small_or_shuffled(stored(sizes, "sizes"), BROADCAST_ROWS), "home").join(shuffled(hashes), "node")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in their own block, once for each block of the other side."""
        return rows.select("home", "root", "hashes", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(f"{own}_block"),
                           F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block"))

    keys = ["home", "outer_block", "inner_block"]
    left = dealt(sized.where(outside), "outer", "inner").select(*[F.col(c).alias(f"l_{c}") for c in [*keys, "root", "hashes"]])
    right = dealt(sized, "inner", "outer")
    part, whole = similarity

    def compare(outer: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        if not len(outer) or not len(inner):
            return pd.DataFrame({"a": [], "b": []})
        return pd.DataFrame(linked_roots(outer["l_hashes"].tolist(), outer["l_root"].to_numpy(), inner["hashes"].tolist(), inner["root"].to_numpy(), part, whole), columns=["a", "b"])

    return with_imports(left).groupBy(*[f"l_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a bigint, b bigint")


def linked_roots(sets_a: list[np.ndarray], roots_a: np.ndarray, sets_b: list[np.ndarray], roots_b: np.ndarray, part: int, whole: int) -> list[tuple[int, int]]:
    """A forest of links between different roots, for two lists of sets: every linked pair's roots are connected by it."""
    size_a, size_b = (np.array([len(s) for s in sets], np.float64) for sets in (sets_a, sets_b))
    distinct, place = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    row_a, row_b = np.repeat(np.arange(len(sets_a)), size_a.astype(int)), np.repeat(np.arange(len(sets_b)), size_b.astype(int))
    place_a, place_b = place[: len(row_a)], place[len(row_a):]
    # only shingles on both sides can be shared; they get the numbers of the incidence columns
    shared = np.zeros(len(distinct), bool)
    shared[place_a] = True
    on_b = np.zeros(len(distinct), bool)
    on_b[place_b] = True
    column = np.cumsum(shared := shared & on_b) - 1
    row_a, place_a = row_a[shared[place_a]], column[place_a[shared[place_a]]]
    row_b, place_b = row_b[shared[place_b]], column[place_b[shared[place_b]]]
    both = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for begin in range(0, int(shared.sum()), SLICE):
        sides = []
        for row, at, n in ((row_a, place_a, len(sets_a)), (row_b, place_b, len(sets_b))):
            here = (at >= begin) & (at < begin + SLICE)
            incidence = np.zeros((n, SLICE), np.float32)
            incidence[row[here], at[here] - begin] = 1
            sides.append(incidence)
        both += sides[0] @ sides[1].T
    found = [np.zeros((0, 2), np.int64)]
    for i in range(0, len(sets_a), 256):
        common = both[i: i + 256].astype(np.float64)
        linked = whole * common >= part * (size_a[i: i + 256, None] + size_b[None, :] - common)
        a, b = np.nonzero(linked & (roots_a[i: i + 256, None] != roots_b[None, :]))
        found.append(np.unique(np.stack([roots_a[i + a], roots_b[b]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs.tolist():
        if (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, **options: object) -> DataFrame:
    """docs with all its columns: of each component the document with the smallest id; documents without links stay.

    Options as in ``links``. Rows that repeat a doc_id stay if one of them does. Rows with a null id, and null or empty texts, which are linked with
    nothing, stay. An empty table stays empty. The column name ``__gone`` is reserved.
    """
    gone = links(docs, **options).groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("kept")).where("NOT kept").select("__gone")
    gone = small_or_shuffled(stored(gone, "gone"), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
