"""Citation graphs: degrees, density, paths, neighbourhoods, PageRank, HITS, clustering. Edges are (src, dst)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose citing vertex (id) is known; parallel ones stay."""
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi")


def most_cited(edges: DataFrame, limit: int = 5, by: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "id").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over distinct edges: one shuffle for both."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def density(edges: DataFrame, vertices: int) -> DataFrame:
    """Distinct edges as a share of all possible ones; 0 for fewer than two vertices."""
    return edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges")).withColumn("density", F.lit(0.0) if vertices < 2 else F.col("edges") / float(vertices * (vertices - 1)))


def clustering(edges: DataFrame) -> DataFrame:
    """Mean over vertices with two cited ones or more of the share of pairs (smaller, larger) joined by an edge in this direction."""
    e = edges.select("src", "dst").distinct()
    pairs = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select("src", (F.col("d") * (F.col("d") - 1) / 2).alias("pairs"))
    # Pairs aren't listed but counted; only edges from a smaller to a larger vertex can close one, and each is met by those that cite its ends.
    rising = e.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    wedges = e.select("src", F.col("dst").alias("a")).join(rising, "a")
    closed = wedges.join(e.select("src", F.col("dst").alias("b")), ["src", "b"], "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("closed"))
    each = pairs.join(closed, "src", "left").select((F.coalesce("closed", F.lit(0)) / F.col("pairs")).alias("share"))
    return each.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("clustering"))


def neighbourhood(edges: DataFrame, start: list[int], hops: int) -> DataFrame:
    """(id, hop) of what can be reached along edges in at most so many hops, each at its least distance."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], "id long, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        step = edges.join(F.broadcast(frontier.select(F.col("id").alias("src"))) if hop == 1 else frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: int, target: int, most: int = 30) -> list[int] | None:
    """A shortest path; of equal ones that whose vertices, from the target back, are least. None if there is none."""
    spark = edges.sparkSession
    if start == target:
        return [start]
    seen = spark.createDataFrame([(start, None)], "id long, parent long")
    frontier = seen
    for hop in range(1, most + 1):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = step.join(seen.select("id"), "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        if not frontier.filter(F.col("id") == target).isEmpty():
            # The target's chain of parents in one query: a join for each hop, over what the hops have reached.
            back = frontier.filter(F.col("id") == target).select(F.col("id").alias("v0"), F.col("parent").alias("v1"))
            for i in range(1, hop):
                back = back.join(seen.select(F.col("id").alias(f"v{i}"), F.col("parent").alias(f"v{i + 1}")), f"v{i}")
            row = back.first()
            return [row[f"v{i}"] for i in range(hop, -1, -1)]
    return None


def kept(df: DataFrame) -> DataFrame:
    """A table written once to the shared folder, as Parquet: packed, unlike a checkpoint's rows, and with its true size. A checkpoint
    hands on the estimate of its plan, which squares where a round joins a table with one made of it."""
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)


class Adjacency:
    """Edges between known vertices as cells, for products with vectors: a round shuffles sums of whole blocks of vertices, no edges.

    Vertices are numbered in order of their ids and dealt into at most BLOCKS blocks, or so many that none holds over WIDEST. A cell
    (sb, db) has the places of the ends of its edges within their blocks; parallel edges count. A vector is a table of (block, values):
    a row for each block. `vertices` has (block, ids, and what else was given of each vertex as an array).
    """

    BLOCKS, NARROWEST, WIDEST, CELL = 64, 14, 20, 1 << 18
    #: Vertices up to which a vector, of 8 bytes for each, is broadcast to the cells; beyond that cells are shuffled to it.
    BROADCAST = 1 << 26

    def __init__(self, edges: DataFrame, vertices: DataFrame):
        ordered = kept(vertices.repartitionByRange("id").sortWithinPartitions("id").withColumn("_m", F.monotonically_increasing_id()))
        part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
        sizes = {r.p: r.n for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, self.n = {}, 0
        for p in sorted(sizes):
            before[p], self.n = self.n, self.n + sizes[p]
        bits = min(self.WIDEST, max(self.NARROWEST, (max(0, self.n - 1) // self.BLOCKS).bit_length()))
        self.size = 1 << bits
        offset = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), part) if before else F.lit(0)
        at = ordered.withColumn("_i", (offset + place).cast("long")).select(*vertices.columns, F.shiftright("_i", bits).cast("int").alias("block"), F.col("_i").bitwiseAND(self.size - 1).cast("int").alias("place"))
        others = [c for c in vertices.columns if c != "id"]
        rows = F.sort_array(F.collect_list(F.struct("place", "id", *others)))
        self.vertices = kept(at.groupBy("block").agg(rows.alias("_r")).select("block", F.col("_r.id").alias("ids"), *[F.col(f"_r.{c}").alias(c) for c in others]))
        ends = edges.select("src", "dst")
        for end, short in (("src", "s"), ("dst", "d")):
            ends = ends.join(at.select(F.col("id").alias(end), F.col("block").alias(f"{short}b"), F.col("place").alias(short)), end).drop(end)
        cells = ends.repartition("db", "sb", F.pmod("s", F.lit(8))).sortWithinPartitions("db", "sb", "d").select("sb", "db", "s", "d")
        most = self.CELL

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
                sb, db, s, d = (np.concatenate(x) for x in zip(*held, strict=True))
                starts = np.flatnonzero(np.concatenate([[True], (sb[1:] != sb[:-1]) | (db[1:] != db[:-1])]))
                offsets = pa.array(np.append(starts, len(s)).astype(np.int32))
                return pa.RecordBatch.from_arrays([pa.array(sb[starts]), pa.array(db[starts]), pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(d))], ["sb", "db", "s", "d"])

            held, n = [], 0
            for batch in batches:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                n += batch.num_rows
                if n >= most:
                    yield packed(held)
                    held, n = [], 0
            if n:
                yield packed(held)

        self.cells = kept(cells.mapInArrow(pack, "sb int, db int, s array<int>, d array<int>"))

    def product(self, vector: DataFrame, back: bool = False) -> DataFrame:
        """(block, values): for each vertex the sum of the vector (block, values) over those that cite it; if back, over those it cites.
        Values have the width of a block; blocks without edges have no row."""
        size = self.size

        def add(batches: Iterator[pa.RecordBatch], values_of) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            out = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(np.concatenate(list(sums.values()))))], ["block", "values"])
            for batch in batches:
                for i, block in enumerate(batch.column(0).to_pylist()):
                    x = values_of(batch, i)
                    sums[block] = sums[block] + x if block in sums else x
                    if len(sums) > 32:
                        yield out()
                        sums.clear()
            if sums:
                yield out()

        def times(batch: pa.RecordBatch, i: int) -> np.ndarray:
            source, target, values = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            return np.bincount(target, weights=values[source], minlength=size)

        def same(batch: pa.RecordBatch, i: int) -> np.ndarray:
            return batch.column(1)[i].values.to_numpy(zero_copy_only=False)

        source, target = ("d", "s") if back else ("s", "d")
        cells = self.cells.select(F.col(f"{source}b").alias("block"), F.col(f"{target}b").alias("_to"), F.col(source).alias("_p"), F.col(target).alias("_q"))
        joined = cells.join(F.broadcast(vector) if self.n <= self.BROADCAST else vector, "block").select("_to", "_p", "_q", "values")
        parts = joined.mapInArrow(lambda batches: add(batches, times), "block int, values array<double>")
        # A block's parts lie in one group of few rows, so that its sums come out once.
        return parts.groupBy("block").applyInArrow(lambda table: pa.Table.from_batches(add(iter(table.to_batches()), same)), "block int, values array<double>")


def _filled(values: str) -> Column:
    """A product's values as far as the block has vertices; zeros where it has no row."""
    return F.coalesce(F.slice(values, F.lit(1), F.size("ids")), F.transform("ids", lambda _: F.lit(0.0)))


def _total(values: Column, of=lambda x: x) -> Column:
    return F.sum(F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x)))


def pagerank(edges: DataFrame, vertices: DataFrame, iterations: int = 50, damping: float = 0.85, dangling: str = "uniform", tolerance: float | None = None) -> DataFrame:
    """(id, rank). Ranks begin at 1 / n; the rank of vertices without outgoing edges is spread over all ('uniform') or lost ('drop').

    Parallel edges count. Each round is a product of the ranks, divided by what a vertex cites, with the edges' cells.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    edges = kept(edges.select("src", "dst"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    graph = Adjacency(edges, vertices.select("id").join(out, "id", "left").select("id", F.coalesce(1 / F.col("out"), F.lit(0.0)).alias("share")))
    ranks = graph.vertices.select("block", F.transform("ids", lambda _: F.lit(1.0 / n)).alias("rank"))
    for _ in range(iterations):
        both = ranks.join(graph.vertices, "block")
        given = graph.product(both.select("block", F.zip_with("rank", "share", lambda r, s: r * s).alias("values")))
        lost = both.agg(_total(F.zip_with("rank", "share", lambda r, s: F.when(s == 0, r).otherwise(0.0))).alias("lost")).first().lost if dangling == "uniform" else 0.0
        following = kept(graph.vertices.join(given, "block", "left").select("block", F.transform(_filled("values"), lambda g: F.lit((1 - damping) / n) + damping * (g + F.lit(lost / n))).alias("rank")))
        moved = None
        if tolerance is not None:
            moved = following.join(ranks.withColumnRenamed("rank", "_before"), "block").agg(F.max(F.array_max(F.zip_with("rank", "_before", lambda a, b: F.abs(a - b))))).first()[0]
        ranks = following
        if moved is not None and moved < tolerance:
            break
    return graph.vertices.join(ranks, "block").select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("rank"))).alias("x")).select("x.id", "x.rank")


def hits(edges: DataFrame, iterations: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(id, hub, authority): both from the old values at once, scaled to unit length; isolated vertices aren't listed."""
    e = kept(edges.select("src", "dst"))
    graph = Adjacency(e, e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    scores = graph.vertices.select("block", *[F.transform("ids", lambda _: F.lit(1.0)).alias(c) for c in ("hub", "authority")])
    for _ in range(iterations):
        authority = graph.product(scores.select("block", F.col("hub").alias("values"))).withColumnRenamed("values", "a")
        hub = graph.product(scores.select("block", F.col("authority").alias("values")), back=True).withColumnRenamed("values", "h")
        raw = kept(graph.vertices.join(scores, "block").join(authority, "block", "left").join(hub, "block", "left").select("block", "hub", "authority", _filled("a").alias("a"), _filled("h").alias("h")))
        square = lambda x: x * x
        norms = raw.agg(F.sqrt(_total(F.col("a"), square)).alias("a"), F.sqrt(_total(F.col("h"), square)).alias("h")).first()
        scaled = lambda c, norm: F.transform(c, lambda x: x / F.lit(norm) if norm else F.lit(0.0))
        new = raw.select("block", "hub", "authority", scaled("h", norms.h).alias("h"), scaled("a", norms.a).alias("a"))
        moved = lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
        change = new.agg(F.greatest(F.max(moved("h", "hub")), F.max(moved("a", "authority")))).first()[0]
        scores = new.select("block", F.col("h").alias("hub"), F.col("a").alias("authority"))
        if change is None or change < tolerance:
            break
    return graph.vertices.join(scores, "block").select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("hub"), F.col("authority"))).alias("x")).select("x.*")


def network(edges: DataFrame, judgments: DataFrame, of: int) -> DataFrame:
    """One hop in both directions: (direction, id, court)."""
    cited = edges.filter(F.col("src") == of).select(F.lit("cited").alias("direction"), F.col("dst").alias("id"))
    citing = edges.filter(F.col("dst") == of).select(F.lit("citing").alias("direction"), F.col("src").alias("id"))
    return cited.unionByName(citing).join(judgments.select("id", "court"), "id", "left")
