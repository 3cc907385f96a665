"""Tables and views: Parquet sources, the judgment-like views over them, keyed changes and sinks."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that the table of a report may have.
REPORT_ROWS = 10_000
_STRINGS = T.ArrayType(T.StringType())
CASES = T.StructType()
for _name, _type in (("case_name", "string"), ("citation", "string"), ("neutral_citation", "string"), ("judgment_date", "date"), ("court", "string"), ("judges", _STRINGS), ("legal_area", "string"), ("significance", "string")):
    CASES = CASES.add(_name, _type)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data: list[dict], schema: T.StructType) -> DataFrame:
    """Records in memory as a table; missing keys are null, no records give an empty table."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in data], schema)


def appended(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added; columns that either side lacks are null."""
    return df.unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def without(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return df.join(keys.select(*key).distinct(), key, "left_anti")


def updated(df: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE as a projection."""
    return df.withColumns({n: F.when(predicate, v).otherwise(F.col(n)) for n, v in values.items()})


def html_report(title: str, statistics: dict, courts: DataFrame) -> str:
    """A page with basic statistics and a table by court, of one row for each; a table of over REPORT_ROWS rows is an error, not cut."""
    if courts.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = [cells(courts.columns, "th"), *[cells(r, "td") for r in courts.toLocalIterator()]]
    items = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in statistics.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{items}</ul><table>{''.join(body)}</table></body></html>"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judgments."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("judgment_date"), F.col("o_orderpriority").alias("court"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("court_level"), (F.col("o_orderstatus") != "P").alias("published"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("word_count"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("relevance_score"),
    )


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("judge_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def judgment_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each judge of a judgment: roles repeat in the source."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("judgment_id"), F.col("l_suppkey").alias("judge_id")).agg(F.min("l_returnflag").alias("role"))


def judgment_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy(F.col("l_orderkey").alias("judgment_id"), F.col("p_type").alias("area")).agg(F.max(1 - F.col("l_discount")).alias("relevance"))


#: Lines of orders that a partition of the edges' two shuffles is made for: these grow in number with the table, not in size.
EDGE_LINES = 1 << 20


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations: parts of one order, from the larger key to the smaller.

    Lines and pairs are dealt out before they are made distinct: almost all differ, so that hash tables on the near side would only cost memory.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // EDGE_LINES)
    orders = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("_p")).filter(F.size("_p") > 1)
    pairs = orders.select("_p", F.explode("_p").alias("src")).select("src", F.explode(F.filter("_p", lambda p: p < F.col("src"))).alias("dst"))
    return pairs.repartition(2 * parts, "src", "dst").distinct()


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("court"), F.col("source").alias("case_name"))


# The same views for the oracle.
SQL_VIEWS = {
    "judgments": "SELECT o_orderkey AS id, cast(o_orderdate AS date) AS judgment_date, o_orderpriority AS court, cast(substring(o_orderpriority, 1, 1) AS integer) AS court_level, o_orderstatus <> 'P' AS published, cast(floor(o_totalprice / 100) AS integer) AS word_count, least(1.0::double, o_totalprice / 500000) AS relevance_score FROM orders",
    "judges": "SELECT s_suppkey AS judge_id, s_name AS name, s_nationkey AS nation FROM supplier",
    "judgment_judges": "SELECT l_orderkey AS judgment_id, l_suppkey AS judge_id, min(l_returnflag) AS role FROM lineitem GROUP BY 1, 2",
    "judgment_areas": "SELECT l_orderkey AS judgment_id, p_type AS area, max(1 - l_discount) AS relevance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey",
    "corpus": "SELECT doc_id, text, lang AS court, source AS case_name FROM documents",
    "tokens": "SELECT doc_id, court, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '') AS words, text FROM (SELECT doc_id, text, lang AS court FROM documents)",
}


def sql(body: str, *views: str) -> str:
    """An oracle query with the views it uses."""
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in views]
    head = "WITH " + ", ".join(parts) if parts else ""
    return f"{head} {', ' + body[5:] if body.startswith('WITH ') and parts else body}"
