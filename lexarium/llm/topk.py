"""Exact top-k inner products by no-random-access aggregation over sorted coordinate lists.

Candidates are dealt into partitions and read in blocks; a block keeps one list per coordinate, of (value, candidate)
sorted by value. For a query all lists are read in step, from the end that its sign favours, to growing depths. What has
been read of a candidate adds up to a partial score; with it go a lower bound (unread coordinates at their lists' worst values) and an
upper bound (unread ones at the lists' frontiers). Candidates, and with them all that no list has shown yet, are left
behind once their upper bound is below the k-th best lower bound or the k-th best score of the blocks before. Reading
stops for a query when few are left or the lists end, and the final scores of those left are resolved.

A group of queries reads together: each stretch of a list adds to the partial scores of all that read it from that end. Queries go to
the tasks in blocks of bounded size; candidates are never repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, written

#: Candidates whose lists are read together, components of the queries that are sent to the tasks at once.
BLOCK, SENT = 1024, 1 << 20
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.5, 0.6, 0.7, 0.85, 1.0)
#: Candidates left that are resolved at once.
LEFT = 128
#: Queries that read the lists of a block together.
TOGETHER = 64


class SortedLists:
    """A block of candidates and the list of each coordinate: values in ascending order and whose they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.whose = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.whose, 1)
        rank = np.empty_like(self.whose)
        np.put_along_axis(rank, self.whose, np.arange(len(ids))[None, :], 1)
        self.rank = rank.T.copy()

    def tops(self, queries: np.ndarray, k: int, owns: list[int], bests: list[list[tuple[int, int]]]) -> None:
        """Brings bests up to date: the k best (-score, id) of each query among those before and the block's candidates but its own."""
        n, width = self.vectors.shape
        going = np.arange(len(queries))
        least = np.array([-best[k - 1][0] if len(best) >= k else -np.inf for best in bests])
        up, down = np.maximum(queries, 0).T.copy(), np.minimum(queries, 0).T.copy()  # coordinates by queries
        partial = np.zeros((n, len(queries)), queries.dtype)
        alive = self.ids[:, None] != np.array(owns, np.int64)[None, :]
        start = 0
        for depth in DEPTHS:
            stop = min(n, max(start + 1, int(depth * n)))
            if start == n:
                break
            for d in range(width):
                if up[d].any():
                    read = self.whose[d, n - stop : n - start]
                    partial[read] += self.values[d, n - stop : n - start, None] * up[d]
                if down[d].any():
                    read = self.whose[d, start:stop]
                    partial[read] += self.values[d, start:stop, None] * down[d]
            start = stop
            from_top, from_bottom = (self.rank < n - stop).astype(queries.dtype), (self.rank >= stop).astype(queries.dtype)  # not read yet

            def bound(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
                """What is read, and the coordinates that aren't at these values."""
                return partial + from_top @ (top[:, None] * up) + from_bottom @ (bottom[:, None] * down)  # noqa: B023

            unknown = np.flatnonzero(np.array([len(bests[g]) < k for g in going]))
            if len(unknown):
                lower = np.where(alive, bound(self.values[:, 0], self.values[:, -1]).astype(np.float64), -np.inf)[:, unknown]
                if n >= k:
                    least[unknown] = np.maximum(least[unknown], np.partition(lower, n - k, axis=0)[n - k])
            alive &= bound(self.values[:, n - stop], self.values[:, stop - 1]) >= least
            left = alive.sum(0)
            done = (left <= LEFT) | (stop == n)
            for j in np.flatnonzero(done):
                g, rows = going[j], np.flatnonzero(alive[:, j])
                scores = self.vectors[rows] @ queries[g]
                found = zip((-scores).astype(np.int64).tolist(), self.ids[rows].tolist(), strict=True)
                bests[g] = sorted([*bests[g], *found])[:k]
            if done.all():
                break
            going, least, up, down, partial, alive = going[~done], least[~done], up[:, ~done], down[:, ~done], partial[:, ~done], alive[:, ~done]


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The kind of number in which sums of products are exact: whole numbers below 2^24 (2^53) in 32-bit (64-bit) floating point, whose sums are faster."""
    most = 2 * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~odd, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _tops(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best candidates of each partition for each query (id, vector) of a block."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        asked = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        ids: list[int] = []
        vectors: list[list[int]] = []

        def read() -> None:
            width = max([0, *map(len, vectors), *(len(v) for _, v in asked)])
            x, q = _matrix(vectors, width), _matrix([v for _, v in asked], width)
            kind = _exact(x, q)
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            block = SortedLists(np.array(ids, np.int64)[order], x.astype(kind)[order])
            for at in range(0, len(asked), TOGETHER):
                part = best[at : at + TOGETHER]
                block.tops(q[at : at + TOGETHER].astype(kind), k, [own for own, _ in asked[at : at + TOGETHER]], part)
                best[at : at + TOGETHER] = part

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= 2 * BLOCK:
                rest = ids[BLOCK:], vectors[BLOCK:]
                ids, vectors = ids[:BLOCK], vectors[:BLOCK]
                read()
                ids, vectors = rest
        if ids:
            read()
        found = [(own, i, -s) for (own, _), top in zip(asked, best, strict=True) for s, i in top]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score (integer inner product of quantised vectors).

    Every row is a candidate but for rows with the query's own id; ties go to the smaller id. Rows whose id is null, or whose vector is null
    or has null or non-finite components, take no part. A shorter vector counts as padded with zeros. A row that repeats
    (id and vector) counts once. Scores must fit 64 bits. An empty table gives no rows; further columns are ignored.
    """
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column), scale).alias("v"), is_query.alias("q")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    rows = written(rows.repartition(tasks, "vec_id").distinct(), "vectors")
    components = rows.filter("q").agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-components // SENT))
    tops: DataFrame | None = None
    for b in range(blocks):
        asked = rows.filter("q") if blocks == 1 else rows.filter(F.col("q") & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b))
        asked = [(r.vec_id, r.v) for r in asked.select("vec_id", "v").collect()]
        found = written(_tops(rows, asked, k), "tops")
        tops = found if tops is None else tops.unionByName(found)
    discard(rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tops.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
