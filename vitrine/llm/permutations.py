"""Nearest neighbours by inner product with a permutation index.

A vector is represented by the order of its nearest pivots. Index and queries are dealt in blocks: a task holds one
block of the index, as inverted files (for each pivot, the vectors that have it among their nearest, with its place),
and one block of queries. Each query adds up, over the files of its own nearest pivots, how far the places agree, which
ranks the block's vectors by footrule distance; the nearest share of them is reranked by the inner product, in double
precision, and the best of each block meet once more. Pivots are a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

PIVOTS = 128
NEAREST = 64
SHARE = 0.4  # of a block's vectors that are reranked
K = 20
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot (column) in the order of nearness to every vector (row)."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    found = np.empty_like(order)
    np.put_along_axis(found, order, np.arange(len(pivots))[None, :], axis=1)
    return found


class Index:
    """Pivot inverted files over a block of vectors, which are sorted by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, nearest: int):
        self.ids, self.vectors, self.pivots, self.nearest = ids, vectors, pivots, nearest
        found = places(vectors, pivots)
        self.files = []
        for pivot in range(len(pivots)):
            held = np.flatnonzero(found[:, pivot] < nearest)
            self.files.append((held, found[held, pivot]))

    def search(self, ids: np.ndarray, queries: np.ndarray, share: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(self.ids)
        wanted = min(n, max(int(np.ceil(share * n)), 10 * k))
        back = np.arange(n)[::-1]
        for query_id, query, found in zip(ids, queries, places(queries, self.pivots)):
            agreed = np.zeros(n, dtype=np.int64)
            for pivot in np.flatnonzero(found < self.nearest):
                held, theirs = self.files[pivot]
                agreed[held] += self.nearest - np.maximum(theirs, found[pivot])  # half of what the footrule falls by
            key = agreed * n + back
            near = np.argpartition(-key, wanted - 1)[:wanted] if wanted < n else np.arange(n)
            near = near[self.ids[near] != query_id]
            score = (self.vectors[near] * query).sum(axis=1)
            best = np.lexsort((self.ids[near], -score))[:k]
            yield query_id, self.ids[near[best]], score[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, nearest: int = NEAREST,
    share: float = SHARE, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id` and `score` (inner product) of the nearest found for every query.

    Both tables have `vec_id` and `embedding`; a query's own id is no candidate; ties go to the smaller id. Vectors that
    are null, zero, not finite, of another length than most, or without id take no part. Repeated ids: each row is a
    candidate, a query is asked once. Fewer than `k` candidates are all returned; no rows give no rows.
    """
    def read(df: DataFrame) -> DataFrame:
        chosen = df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        return chosen.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    every = materialise(read(vectors), "vectors")
    sizes = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length, n = (sizes["n"], sizes["count"]) if sizes else (0, 0)
    every = every.where(F.size("v") == length)
    asked = read(queries).where(F.size("v") == length).dropDuplicates(["vec_id"])
    sample = every.orderBy(F.xxhash64("v")).select("v").distinct().orderBy(F.xxhash64("v")).limit(pivots).collect()
    chosen = np.array([r["v"] for r in sample]).reshape(len(sample), length)
    chosen = chosen / np.maximum(np.linalg.norm(chosen, axis=1, keepdims=True), 1e-300) if length else chosen
    shards, blocks = max(1, -(-n // index_block)), max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(shards))

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    met = every.select(F.lit(False).alias("asks"), "vec_id", "v", shard.alias("shard"), all_of(blocks).alias("block")).unionAll(
        asked.select(F.lit(True).alias("asks"), "vec_id", "v", all_of(shards).alias("shard"), block.alias("block")))

    def searched(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), dtype=bool)
        ids = table.column("vec_id").to_numpy()
        found = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, length)
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if asks.any() and not asks.all():
            rows = np.flatnonzero(~asks)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            index = Index(ids[rows], found[rows], chosen, min(nearest, len(chosen)))
            for query_id, near, score in index.search(ids[asks], found[asks], share, k):
                for part, value in zip(out, (np.full(len(near), query_id), near, score)):
                    part.append(value)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))

    best = met.groupBy("shard", "block").applyInArrow(searched, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
