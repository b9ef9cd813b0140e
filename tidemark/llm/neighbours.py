"""Approximate nearest neighbours by a permutation index.

* Pivots are a bounded sample of the vectors: about SHARE times the root of their number, MOST at most, those with the smallest hash.
* A vector is represented by its POSTED nearest pivots in order, and posted with their ranks in the inverted files of all of them.
* A query visits the files of its first pivots: VISITED_SHARE of all pivots, VISITED at least. A fixed number would leave ever more neighbours in
  files that are not visited as pivots grow with the table; a fixed share keeps recall. A posting adds what its rank is nearer to the query's
  than a pivot outside the order, so the sums over all visited files rank the vectors by the footrule distance of their pivot orders
  (the sum of the differences of ranks). This is one addition a posting, about 4 n a query.
* RERANKED times the root of the number of vectors, the nearest by footrule, are reranked by the exact inner product; all of them in tables up to 10,000.
  More pivots order more finely, so a falling share of the table keeps recall.

Equal vectors are one entry of the index, which keeps the ``k + 1`` smallest ids; equal query vectors are searched once. Vectors and queries
are cut into blocks of bounded size by a hash; a block of vectors holds its part of every file and reranks its part of the best, so no task holds a
whole file, however many vectors share a pivot, and a vector travels once for each block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches
from tidemark.llm.storing import stored
from tidemark.runtime import with_imports

K = 20
SHARE, LEAST, MOST = 0.76, 64, 4096
POSTED, VISITED = 16, 16
#: Share of the pivots whose files a query visits; VISITED of LEAST pivots.
VISITED_SHARE = 0.25
#: Vectors that are reranked, as a multiple of the root of their number, and candidates at least in a block (times k + 1).
RERANKED, RERANKED_LEAST = 100, 4
#: Vectors and queries that meet in one group.
BLOCK = 8192
#: Numbers that a task computes at a time: vectors times pivots, or queries times vectors of a block.
CELLS = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not all zero and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _permuted(entries: DataFrame, pivots: np.ndarray, depth: int) -> DataFrame:
    """entries (node, first_id, v) with ``perm``, the ``depth`` nearest pivots in order (largest inner product first, ties to the first pivot)."""

    def nearest(v: np.ndarray) -> np.ndarray:
        far = -(v.astype(np.float64) @ pivots.T)
        if depth == len(pivots):
            return np.argsort(far, axis=1, kind="stable")
        near = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1)
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(pivots))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                order = nearest(np.array(part.column("v").flatten()).reshape(part.num_rows, -1)).astype(np.int32)
                perm = pa.ListArray.from_arrays(np.arange(0, order.size + 1, depth, dtype=np.int32), order.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, perm], names=[*part.schema.names, "perm"])

    return in_batches(entries, work, f"node bigint, first_id bigint, v {entries.schema['v'].dataType.simpleString()}, perm array<int>")


class _Files:
    """The part of every inverted file that one block of vectors holds."""

    def __init__(self, perms: np.ndarray, pivots: int) -> None:
        order = np.argsort(perms, axis=None, kind="stable")
        self.entry, self.place = order // perms.shape[1], (order % perms.shape[1]).astype(np.int32)
        self.bounds = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))
        self.size = len(perms)

    def nearness(self, perms: np.ndarray) -> np.ndarray:
        """visitors x vectors: by how much their footrule distance over the visited pivots is less than that of orders without a pivot in common."""
        visited = perms.shape[1]
        out = np.zeros((len(perms), self.size), np.int32)
        asked = np.argsort(perms, axis=None, kind="stable")
        visitor, place = asked // visited, (asked % visited).astype(np.int32)
        files, begins = np.unique(perms.ravel()[asked], return_index=True)
        for p, begin, end in zip(files, begins, [*begins[1:], len(asked)], strict=True):
            post = slice(self.bounds[p], self.bounds[p + 1])
            gain = visited + 1 - np.abs(place[begin:end, None] - self.place[None, post])
            out[visitor[begin:end, None], self.entry[None, post]] += np.maximum(gain, 0)
        return out


def _meet(k: int, pivots: int, share: float) -> object:
    """Function of one block of visitors and one block of vectors: the visitors' best k + 1 candidates there."""

    def run(visitors: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(file):
            return pd.DataFrame({"qnode": [], "node": [], "first_id": [], "score": []})
        vectors = np.stack(file["v"].to_numpy()).astype(np.float64)
        nodes, first = file["node"].to_numpy(), file["first_id"].to_numpy()
        asked, perms = np.stack(visitors["q_v"].to_numpy()).astype(np.float64), np.stack(visitors["q_perm"].to_numpy())
        take = min(len(nodes), max(RERANKED_LEAST * (k + 1), math.ceil(share * len(nodes))))
        files = _Files(np.stack(file["perm"].to_numpy()), pivots) if take < len(nodes) else None
        found, scores = [], []
        step = max(1, CELLS // len(nodes))
        for begin in range(0, len(asked), step):
            near = files.nearness(perms[begin:begin + step]) if files else None
            for i, q in enumerate(asked[begin:begin + step]):
                chosen = np.argpartition(near[i], -take)[-take:] if files else np.arange(len(nodes))
                score = vectors[chosen] @ q if files else vectors @ q
                if len(chosen) > k + 1:
                    best = np.flatnonzero(score >= np.partition(score, -(k + 1))[-(k + 1)])
                    chosen, score = chosen[best], score[best]
                best = np.lexsort((first[chosen], -score))[: k + 1]
                found.append(chosen[best])
                scores.append(score[best])
        at = np.concatenate(found)
        return pd.DataFrame({"qnode": np.repeat(visitors["q_node"].to_numpy(), [len(f) for f in found]), "node": nodes[at], "first_id": first[at], "score": np.concatenate(scores)})

    return run


def _blocks(entries: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
    """entries with their block of so many, once for each block of the other side."""
    return entries.select("node", "first_id", "v", "perm", F.pmod(F.xxhash64("node"), F.lit(own)).cast("int").alias(names[0]),
                          F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]))


def search(vectors: DataFrame, queries: Column, *, k: int = K, share: float = SHARE, least: int = LEAST, most: int = MOST, posted: int = POSTED,
           visited: int = VISITED, visited_share: float = VISITED_SHARE, reranked: float = RERANKED, block: int = BLOCK) -> DataFrame:
    """For each query row (condition ``queries`` on the row's ``vec_id``) its ``k`` nearest found: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    vectors: columns ``vec_id`` and ``embedding``; others are ignored. Score is the inner product in double precision; ties go to the
    smaller vec_id. A query's own id is no candidate. Rows with a null id, with an unusable vector (see ``usable``), or whose vector has another
    length than most take no part. Repeated rows count once. No usable row: no result.
    """
    ensure_columns(vectors, "vec_id", "embedding")
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    rows = stored(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if lengths:
        rows = rows.where(F.size("v") == lengths[0]["n"])
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    same = stored(rows.withColumn("place", place).where(F.col("place") <= k + 1), "copies")
    entries = stored(same.where("place = 1").select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").alias("first_id"), "v"), "entries")
    n = entries.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    count = min(max(least, round(share * math.sqrt(n))), most, n)
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(count).collect()
    pivots = np.array([r["v"] for r in sample], np.float64)
    posted, visited = min(posted, count), min(max(visited, math.ceil(visited_share * count)), count)
    asked = stored(rows.where(queries).select(F.col("vec_id").alias("query_id"), "v").join(entries.select("node", "v"), "v").select("query_id", "node"), "queries")
    searched = stored(_permuted(entries.join(asked.select("node").distinct(), "node", "left_semi").select(entries.columns), pivots, visited), "searched")
    file_blocks, query_blocks = math.ceil(n / block), max(1, math.ceil(searched.count() / block))
    keys = ["file_block", "query_block"]
    file = _blocks(_permuted(entries, pivots, posted), file_blocks, query_blocks, ("file_block", "query_block"))
    visitors = _blocks(searched, query_blocks, file_blocks, ("query_block", "file_block"))
    visitors = visitors.toDF(*[f"q_{c}" for c in visitors.columns])
    met = with_imports(visitors).groupBy(*[f"q_{c}" for c in keys]).cogroup(file.groupBy(*keys)).applyInPandas(
        _meet(k, count, min(1.0, reranked / math.sqrt(n))), "qnode bigint, node bigint, first_id bigint, score double")
    order = Window.partitionBy("qnode").orderBy(F.desc("score"), "first_id")
    found = stored(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("qnode", "node", "score"), "found")
    ids = same.select("vec_id", "v").join(entries.select("node", "v"), "v").select("node", "vec_id")
    full = asked.join(found.withColumnRenamed("node", "other"), asked["node"] == found["qnode"]).select("query_id", "other", "score")
    full = full.join(ids, full["other"] == ids["node"]).where("query_id <> vec_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
