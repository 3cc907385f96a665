"""Bloom filters as data: bit positions in rows, with the md5 hash family that any engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import court_label, normal_for_membership
from ..functions.numeric import bloom_rate, bloom_size


def positions(item: Column, bits: int, hashes: int) -> Column:
    """The bit positions of an item: the first four bytes of md5(item, seed as four bytes), modulo bits."""
    one = lambda seed: F.conv(F.substring(F.md5(F.concat(F.encode(item, "UTF-8"), F.unhex(F.lit(f"{seed:08x}")))), 1, 8), 16, 10).cast("long") % bits
    return F.array(*[one(i) for i in range(hashes)])


def built(items: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bit) of a filter with all items; repeated and null items do no harm."""
    return items.filter(F.col(column).isNotNull()).select(F.explode(positions(F.col(column), bits, hashes)).alias("bit")).distinct()


#: Bits of one bitmap row, and the bytes up to which a filter is sent to all tasks.
ROW_BITS, SENT_BYTES = 32768, 8 << 20


def probed(items: DataFrame, column: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The distinct items with `maybe`: whether all their bits are set.

    A filter of up to SENT_BYTES goes to all tasks as one map of bitmaps, and items aren't taken apart; a larger one is joined bit by bit.
    """
    distinct = items.filter(F.col(column).isNotNull()).select(column).distinct()
    if bits <= 8 * SENT_BYTES:
        place = F.col("bit") + 1  # the built-in functions count from 1
        rows = filter_.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("v"))
        whole = rows.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_rows"))

        def is_set(bit: Column) -> Column:
            row = F.try_element_at(F.col("_rows"), F.bitmap_bucket_number(bit + 1))
            at = F.bitmap_bit_position(bit + 1)
            byte = F.conv(F.hex(F.substring(row, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))

        return distinct.crossJoin(F.broadcast(whole)).select(column, F.forall(positions(F.col(column), bits, hashes), is_set).alias("maybe"))
    probes = distinct.select(column, F.explode(F.array_distinct(positions(F.col(column), bits, hashes))).alias("bit"))
    found = probes.join(filter_.withColumn("_set", F.lit(1)), "bit", "left")
    return found.groupBy(column).agg((F.count(F.lit(1)) == F.count("_set")).alias("maybe"))


def saved(filter_: DataFrame, path: str, **parameters: float) -> None:
    """Writes a filter (bit) with its parameters as JSON lines; what stands at the path goes."""
    held = filter_.select("bit")
    for name, value in parameters.items():
        held = held.withColumn(name, F.lit(value))
    held.write.mode("overwrite").partitionBy(*parameters).json(path)


def loaded(spark, path: str) -> tuple[DataFrame, dict]:
    """A saved filter (bit) and its parameters."""
    held = spark.read.json(path)
    first = held.drop("bit").first()
    return held.select("bit"), first.asDict() if first else {}


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of both; they must have the same size and hashes."""
    return a.unionByName(b).distinct()


def intersection_estimate(a: DataFrame, b: DataFrame, capacity: tuple[int, int], items: tuple[int, int], bits: int) -> DataFrame:
    """common bits * capacities / (bits * the larger number of items); 0 without common bits."""
    scale = capacity[0] * capacity[1] / (bits * max(1, *items))
    return a.join(b, "bit", "left_semi").agg((F.count(F.lit(1)) * F.lit(float(scale))).alias("estimate"))


def scalable(items: DataFrame, column: str, order: Column, initial: int, growth: int = 2, rate: float = 0.01) -> DataFrame:
    """(slice, bit) in order of arrival: when a slice of initial * growth^i items is full the next one begins.

    Ranks come from counts of range partitions, so that no task sorts all items; the slice of a rank has a closed form, so
    that there are as many slices as the items need.
    """
    cut = items.filter(F.col(column).isNotNull()).select(F.col(column).alias("_item"), order.alias("_order")).repartitionByRange("_order").sortWithinPartitions("_order", "_item")
    cut = cut.select("_item", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias("_i")).checkpoint()
    counts = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    rank = F.col("_i") + F.col("before")
    # Slices before this one hold initial * (growth^slice - 1) / (growth - 1) items.
    ranked = cut.join(F.broadcast(before), "_p").select("_item", F.floor(F.log(float(growth), rank * (growth - 1) / F.lit(float(initial)) + 1) + 1e-12).cast("int").alias("slice"))
    last = ranked.agg(F.max("slice")).first()[0]
    sizes = [bloom_size(initial * growth**i, rate) for i in range((last if last is not None else -1) + 1)]
    if not sizes:
        return ranked.select("slice", F.lit(0).cast("long").alias("bit"))
    of = lambda j: F.element_at(F.array(*[F.lit(s[j]) for s in sizes]), F.col("slice") + 1)
    seeds = F.sequence(F.lit(0), of(1) - 1)
    bit = lambda seed: F.conv(F.substring(F.md5(F.concat(F.encode("_item", "UTF-8"), F.unhex(F.lpad(F.lower(F.hex(seed)), 8, "0")))), 1, 8), 16, 10).cast("long") % of(0)
    return ranked.select("slice", F.explode(F.transform(seeds, bit)).alias("bit")).distinct()


def in_scalable(items: DataFrame, column: str, filter_: DataFrame, initial: int, growth: int = 2, rate: float = 0.01) -> DataFrame:
    """The distinct items with `maybe`: whether any slice of a scalable filter has all their bits."""
    slices = [r.slice for r in filter_.select("slice").distinct().collect()]
    out = items.filter(F.col(column).isNotNull()).select(column).distinct().withColumn("maybe", F.lit(False))
    for i in sorted(slices):
        bits, hashes = bloom_size(initial * growth**i, rate)
        held = probed(items, column, filter_.filter(F.col("slice") == i).select("bit"), bits, hashes).withColumnRenamed("maybe", "_maybe")
        out = out.join(held, column).select(column, (F.col("maybe") | F.col("_maybe")).alias("maybe"))
    return out


def citation_filter(citations: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bit) of the citations in their normal form; what is no citation isn't added."""
    return built(citations.select(normal_for_membership(column).alias("c")), "c", bits, hashes)


def citation_coverage(citations: DataFrame, column: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(court, n): of the citations whose normal form the filter may hold, how many are of each court; repeated ones count each time."""
    normal = citations.select(normal_for_membership(column).alias("c")).filter("c IS NOT NULL")
    held = probed(normal, "c", filter_, bits, hashes).filter("maybe").select("c")
    return normal.join(held, "c", "left_semi").groupBy(court_label("c").alias("court")).agg(F.count(F.lit(1)).alias("n"))


def statistics(capacity: int, rate: float, items: int) -> dict[str, float]:
    bits, hashes = bloom_size(capacity, rate)
    return {"capacity": capacity, "bits": bits, "hashes": hashes, "items": items, "rate": bloom_rate(bits, hashes, items), "bytes": -(-bits // 8)}
