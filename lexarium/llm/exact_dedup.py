"""Exact deduplication with a log-structured merge index of digests; DataFrame operations only.

A batch of documents fills memtables (partial aggregates by digest on the map side), which are flushed as one sorted
run of (digest, smallest id, count). A run carries a bitmap filter. Digests of a later batch that pass the filter of an
earlier run are merge-joined with it: hits. Runs of a level are compacted into one run of the next level, which keeps
the smallest identifier of each digest. All texts behind a digest that was hit are verified byte by byte; a digest
shared by different texts falls back to grouping by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, small, text_of, written

#: Bits of a bitmap filter that one row of a run gets.
FILTER_BITS = 16
#: Bits in one row of a filter: what the built-in bitmap functions hold.
BITMAP_BITS = 32768


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """The LSM index: levels of sorted runs (digest, keep_id, n, hit) as Parquet tables in the shared folder."""

    def __init__(self, fanout: int = 2, filter_bytes: int = 8 << 20):
        self.fanout, self.filter_bytes = fanout, filter_bytes
        self.levels: list[list[DataFrame]] = []
        self.filters: list[list[tuple[DataFrame, int] | None]] = []

    def _place(self, bits: int) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1

    def _filter(self, run: DataFrame) -> tuple[DataFrame, int] | None:
        """A bitmap filter of the run, or None where it would be larger than filter_bytes: then the merge join alone decides."""
        rows = run.count()
        bits = max(BITMAP_BITS, -(-rows * FILTER_BITS // BITMAP_BITS) * BITMAP_BITS)
        if bits // 8 > self.filter_bytes:
            return None
        place = self._place(bits)
        bitmap = run.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap"))
        return written(bitmap, "filter"), bits

    def _passes(self, batch: DataFrame, filter_: tuple[DataFrame, int]) -> DataFrame:
        """The batch with _maybe: whether the filter lets the digest pass."""
        bitmap, bits = filter_
        place = self._place(bits)
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        probed = batch.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "_bucket", "left")
        bit = F.getbit(byte, (at % 8).cast("int"))
        return probed.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bitmap")

    def add(self, memtable: DataFrame) -> None:
        """Flushes a batch (digest, keep_id, n): marks the digests that earlier runs hold and appends its sorted run."""
        batch = memtable.select("digest", "keep_id", "n", (F.col("n") > 1).alias("hit"))
        for runs, filters in zip(self.levels, self.filters, strict=True):
            for run, filter_ in zip(runs, filters, strict=True):
                known = run.select("digest", F.lit(True).alias("_known"))
                if filter_ is None:
                    joined = batch.join(known.hint("merge"), "digest", "left")
                else:
                    probed = self._passes(batch, filter_)
                    hits = probed.filter("_maybe").select("digest").join(known.hint("merge"), "digest", "left_semi").withColumn("_known", F.lit(True))
                    joined = probed.drop("_maybe").join(hits.hint("merge"), "digest", "left")
                batch = joined.select("digest", "keep_id", "n", (F.col("hit") | F.coalesce("_known", F.lit(False))).alias("hit"))
        self._append(0, batch)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._append(level + 1, self._merged(self.levels[level]))
            self.levels[level], self.filters[level] = [], []
            level += 1

    def _append(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.filters.append([])
        run = written(run.repartition("digest").sortWithinPartitions("digest"), f"run{level}")
        self.levels[level].append(run)
        self.filters[level].append(self._filter(run))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Compaction: the smallest identifier and the whole count of each digest."""
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.max("hit").alias("hit"))

    def compacted(self) -> DataFrame:
        """One run of everything: (digest, keep_id, n, hit)."""
        runs = [run for level in self.levels for run in level]
        return runs[0] if len(runs) == 1 else written(self._merged(runs).sortWithinPartitions("digest"), "compacted")


def with_groups(rows: DataFrame, groups: DataFrame, key: str, rows_total: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows left-joined with groups (unique by key, with n rows each) where few keys may hold most rows.

    Groups of at least rows_total / broadcast_rows rows are at most broadcast_rows many: they are broadcast. All others
    are too small to weigh on a task and are shuffled.
    """
    if small(groups, broadcast_rows):
        return rows.join(F.broadcast(groups), key, "left")
    least = max(2, rows_total // broadcast_rows)
    columns = [c for c in groups.columns if c != key]
    heavy = groups.filter(F.col("n") >= least).select(key, F.struct(*columns).alias("_heavy"))
    light = groups.filter(F.col("n") < least).select(key, F.struct(*columns).alias("_light"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    found = marked.filter(F.col("_heavy").isNotNull()).withColumn("_group", F.col("_heavy")).drop("_heavy")
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy").join(light, key, "left").withColumnRenamed("_light", "_group")
    both = found.unionByName(rest)
    return both.select(*rows.columns, *[F.col(f"_group.{c}").alias(c) for c in columns])


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    batches: int = 4,
    fanout: int = 2,
    digest: Callable[[Column], Column] = sha256_digest,
    filter_bytes: int = 8 << 20,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of ASCII white space has become one space; null counts as empty.
    keep_id is the smallest id of the group (null ids count only in a group that has no other); kept says that the row
    has that id, so rows that repeat one id are one document and are kept or dropped together. An empty table gives no
    rows. Further columns of docs, whatever their names, are ignored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    text = normalised()
    rows = source.select("doc_id", digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"))
    rows = written(rows, "digests")
    total = rows.count()
    batch = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)).cast("int")
    tables = written(rows.groupBy(batch.alias("batch"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "memtables", ("batch",))
    index = DigestIndex(fanout, filter_bytes)
    for b in range(batches):
        index.add(tables.filter(F.col("batch") == b).select("digest", "keep_id", "n"))
    groups = index.compacted()

    # Byte verification: all texts behind a digest that was hit are the same bytes if the least equals the greatest.
    hits = groups.filter("hit").select("digest", "n")
    texts = source.select("doc_id", text.alias("body")).withColumn("digest", digest(F.col("body")))
    behind = with_groups(texts, hits.withColumn("was_hit", F.lit(True)), "digest", total, broadcast_rows).filter("was_hit")
    clash = written(
        behind.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest")).filter(F.col("least") != F.col("greatest")).select("digest", F.lit(True).alias("clash")),
        "clashes",
    )
    found = with_groups(rows, groups.select("digest", "keep_id", "n"), "digest", total, broadcast_rows)
    if not clash.isEmpty():
        exact = texts.join(clash, "digest").groupBy("digest", F.sha2("body", 256).alias("text_sha256"), "body").agg(F.min("doc_id").alias("exact_id"), F.count(F.lit(1)).alias("exact_n")).drop("body")
        found = found.join(exact, ["digest", "text_sha256"], "left").withColumns({"keep_id": F.when(F.col("exact_n").isNull(), F.col("keep_id")).otherwise(F.col("exact_id")), "n": F.coalesce("exact_n", "n")})
    return found.select(
        F.col("doc_id").alias(id_column), "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
