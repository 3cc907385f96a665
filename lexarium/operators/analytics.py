"""Statistics over judgments: counts, trends, courts, panels, histograms, timelines, ranges, time series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """How often each value occurs; nulls are left out; of arrays the elements count."""
    array = df.schema[field].dataType.typeName() == "array"
    values = df.select(F.explode(field).alias("value")) if array else df.select(F.col(field).alias("value"))
    return values.filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def basic_statistics(df: DataFrame, day: str = "judgment_date") -> DataFrame:
    """Count, first and last day, number of courts: one row."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.min(day).alias("earliest"), F.max(day).alias("latest"), F.count_distinct("court").alias("courts"))


def trends(df: DataFrame, *by: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def busiest(counts: DataFrame, key: str = "year") -> DataFrame:
    """The keys with the most and the fewest rows; the smaller key of equals."""
    pick = lambda sign: F.min_by(key, F.struct(sign * F.col("n"), F.col(key)))
    return counts.agg(pick(F.lit(-1)).alias("busiest"), pick(F.lit(1)).alias("quietest"))


def court_comparison(df: DataFrame) -> DataFrame:
    return df.groupBy("court").agg(F.count(F.lit(1)).alias("n"), F.min("judgment_date").alias("earliest"), F.max("judgment_date").alias("latest"), F.avg("word_count").alias("avg_words"), F.max("relevance_score").alias("max_relevance"))


def court_statistics(judgments: DataFrame, bridge_judges: DataFrame, bridge_areas: DataFrame, lo: str, hi: str) -> DataFrame:
    """Per court: judgments, words, relevance, distinct judges and areas. Each side is summed up by judgment or court
    before it is joined, so that no judgment counts more than once."""
    inside = judgments.filter(F.col("judgment_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    base = inside.groupBy("court").agg(F.count(F.lit(1)).alias("n"), F.avg("word_count").alias("avg_words"), F.max("relevance_score").alias("max_relevance"))
    keys = inside.select("id", "court")
    judges = bridge_judges.join(keys, F.col("judgment_id") == F.col("id")).groupBy("court").agg(F.count_distinct("judge_id").alias("judges"))
    areas = bridge_areas.join(keys, F.col("judgment_id") == F.col("id")).groupBy("court").agg(F.count_distinct("area").alias("areas"))
    out = base.join(judges, "court", "left").join(areas, "court", "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("judges", "areas")})


def judge_productivity(judgments: DataFrame, bridge: DataFrame, judges: DataFrame, year: int) -> DataFrame:
    of_year = judgments.filter((F.col("judgment_date") >= F.lit(f"{year}-01-01").cast("date")) & (F.col("judgment_date") < F.lit(f"{year + 1}-01-01").cast("date"))).select("id", "word_count")
    done = bridge.select("judgment_id", "judge_id").distinct().join(of_year, F.col("judgment_id") == F.col("id"))
    counts = done.groupBy("judge_id").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"), F.avg("word_count").alias("avg_words"))
    return counts.join(judges.select("judge_id", "name"), "judge_id")


def area_trends(judgments: DataFrame, bridge_areas: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Area by year and month over the last months of 30 days."""
    inside = judgments.filter(F.col("judgment_date") >= F.date_sub(as_of, months * 30))
    joined = bridge_areas.select("judgment_id", "area").join(inside, F.col("judgment_id") == F.col("id"))
    return joined.groupBy("area", F.year("judgment_date").alias("year"), F.month("judgment_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("relevance_score").alias("avg_relevance"), F.sum("word_count").alias("words"))


def grouped_metrics(judgments: DataFrame, dimension: str, bridges: dict[str, DataFrame]) -> DataFrame:
    """Count, average words and relevance by court, year, area or judge."""
    if dimension not in ("court", "year", "area", "judge"):
        raise ValueError(f"unknown dimension {dimension!r}")
    df = judgments
    if dimension in bridges:
        df = df.join(bridges[dimension], F.col("id") == F.col("judgment_id"))
    key = F.year("judgment_date") if dimension == "year" else F.col({"court": "court", "area": "area", "judge": "judge_id"}[dimension])
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("word_count").alias("avg_words"), F.avg("relevance_score").alias("avg_relevance"))


def monthly(df: DataFrame, group: str, day: str = "judgment_date") -> DataFrame:
    """Rows by group and month on a gapless axis from the group's first to its last month, both included."""
    month = F.trunc(day, "MM")
    counts = df.groupBy(group, month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    axis = counts.groupBy(group).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(group, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return axis.join(counts, [group, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def range_aggregate(df: DataFrame, ranges: DataFrame, day: str, value: str) -> DataFrame:
    """count, sum, avg, min, max of value for each (range_id, lo, hi), both ends included; an empty range has count 0.

    The ranges are the stated queries of the call, few by nature; the day column is summed up by day first, so what meets
    them is at most a row a day.
    """
    daily = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = ranges.join(daily, F.col("_d").between(F.col("lo"), F.col("hi")), "left")
    return joined.groupBy("range_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("_s"), F.lit(0)).alias("total"), F.try_divide(F.sum("_s"), F.sum("_c")).alias("average"), F.min("_lo").alias("least"), F.max("_hi").alias("greatest"))


def timeline(df: DataFrame, buckets: int, day: str = "judgment_date", value: str = "word_count") -> DataFrame:
    """Equal spans of days from first to last: span max(1, days // buckets), the next begins a day after the last one's end, the last ends with the data."""
    daily = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    ends = daily.agg(F.min("_d").alias("a"), F.max("_d").alias("z")).filter("a IS NOT NULL")
    width = F.greatest(F.lit(1), F.floor(F.datediff("z", "a") / buckets)).cast("int")
    spans = ends.select("a", "z", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    spans = spans.select("bucket", F.expr("date_add(a, bucket * (w + 1))").alias("first"), F.expr(f"CASE WHEN bucket = {buckets - 1} THEN z ELSE least(z, date_add(a, bucket * (w + 1) + w)) END").alias("last")).filter("first <= last")
    joined = F.broadcast(spans).join(daily, F.col("_d").between(F.col("first"), F.col("last")), "right").filter("bucket IS NOT NULL")
    counts = joined.groupBy("bucket").agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"))
    return spans.join(counts, "bucket", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "total": F.coalesce("total", F.lit(0).cast("long"))})


def score_histogram(df: DataFrame, score: str = "relevance_score", precision: int = 10) -> DataFrame:
    """Count, average, least and greatest score of each of precision buckets, empty ones with zeros."""
    bucket = F.least(F.lit(precision - 1), F.floor(F.col(score) * precision)).cast("int")
    counts = df.filter(F.col(score).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("average"), F.min(score).alias("least"), F.max(score).alias("greatest"))
    every = df.sparkSession.range(precision).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(counts, "bucket", "left")
    return out.select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("average", "least", "greatest")])


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running sums within a key: the sum of a range is the difference of two of them."""
    return df.withColumn("prefix", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def range_updated(df: DataFrame, updates: DataFrame, place: str, value: str) -> DataFrame:
    """Adds each update's delta to the values whose place is between lo and hi; updates are the stated changes of the call."""
    deltas = df.select(place).distinct().join(F.broadcast(updates), F.col(place).between(F.col("lo"), F.col("hi"))).groupBy(place).agg(F.sum("delta").alias("_delta"))
    return df.join(deltas, place, "left").withColumn(value, F.col(value) + F.coalesce("_delta", F.lit(0))).drop("_delta")


def trend_analysis(series: DataFrame) -> DataFrame:
    """Per metric of (metric, ts, value): least-squares line over days since the first, correlation, deviation, range; metrics of one point are left out."""
    first = F.min("ts").over(Window.partitionBy("metric"))
    x = series.withColumn("_x", F.datediff("ts", first).cast("double")).withColumn("value", F.col("value").cast("double"))
    stats = x.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("value", "_x").alias("slope"), F.regr_intercept("value", "_x").alias("intercept"), F.coalesce(F.corr("_x", "value"), F.lit(0.0)).alias("correlation"),
        F.stddev_pop("value").alias("deviation"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"),
    )
    return stats.filter("n >= 2").withColumn("strength", F.coalesce(F.try_divide("slope", "mean"), F.lit(0.0)))


def seasonal(series: DataFrame, least: int = 12) -> DataFrame:
    """Mean by calendar month of metrics with at least so many points."""
    enough = series.groupBy("metric").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("metric")
    return series.join(enough, "metric", "left_semi").groupBy("metric", F.month("ts").alias("month")).agg(F.avg("value").alias("mean"))


def court_citations(judgments: DataFrame, edges: DataFrame) -> DataFrame:
    """(court, made, received): citations by and of each court's judgments; each side is counted before it is joined."""
    made = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    received = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("r"))
    both = judgments.select("id", "court").join(made, "id", "left").join(received, "id", "left")
    return both.groupBy("court").agg(F.sum(F.coalesce("m", F.lit(0))).alias("made"), F.sum(F.coalesce("r", F.lit(0))).alias("received"))


def group_details(judgments: DataFrame, key: str, bridge_judges: DataFrame, bridge_areas: DataFrame) -> DataFrame:
    """(key, n, avg_words, earliest, latest, judges, areas): range of dates and distinct judges and areas of each group."""
    base = judgments.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("word_count").alias("avg_words"), F.min("judgment_date").alias("earliest"), F.max("judgment_date").alias("latest"))
    keys = judgments.select(F.col("id").alias("judgment_id"), F.col(key).alias("key"))
    judges = bridge_judges.join(keys, "judgment_id").groupBy("key").agg(F.count_distinct("judge_id").alias("judges"))
    areas = bridge_areas.join(keys, "judgment_id").groupBy("key").agg(F.count_distinct("area").alias("areas"))
    out = base.join(judges, "key", "left").join(areas, "key", "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("judges", "areas")})


def judge_panels(bridge: DataFrame) -> DataFrame:
    """(judge_id, n, mean_panel): judgments of each judge and how many judges sat on them on average."""
    sizes = bridge.groupBy("judgment_id").agg(F.count(F.lit(1)).alias("size"))
    return bridge.join(sizes, "judgment_id").groupBy("judge_id").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_panel"))


def monoid(df: DataFrame, key: str, value: Column, zero: Column, merge: Callable[[Column, Column], Column], shares: int = 64) -> DataFrame:
    """(key, folded): values of each key folded by an associative and commutative operation with a neutral element. A key's values
    are folded in shares and these once more, so that no task holds all values of a frequent key; nulls are left out."""
    kept = df.select(key, value.alias("_v")).filter("_v IS NOT NULL").withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(shares)))
    parts = kept.groupBy(key, "_s").agg(F.reduce(F.collect_list("_v"), zero, merge).alias("_v"))
    return parts.groupBy(key).agg(F.reduce(F.collect_list("_v"), zero, merge).alias("folded"))


def measures(df: DataFrame, key: str, measure: str) -> DataFrame:
    """(key, measures): the key's measures in order as one array; a key's rows must fit one row."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(measure)).alias("measures"))


def date_or_default(text: Column, default: str = "2023-01-01 00:00:00") -> Column:
    """An ISO date with time, Z meaning UTC; the default where it can't be read."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), F.lit(default).cast("timestamp"))
