"""Prefix dictionaries: words with frequencies and metadata, completion by prefix, citation templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The templates of neutral citations, and the frequency that each counts with.
TEMPLATES = {"[2023] EWHC": "[2023] EWHC (High Court)", "[2023] EWCA": "[2023] EWCA (Court of Appeal)", "[2023] UKSC": "[2023] UKSC (Supreme Court)", "[2023] UKUT": "[2023] UKUT (Upper Tribunal)", "[2023] EWCOP": "[2023] EWCOP (Court of Protection)"}
TEMPLATE_FREQUENCY = 100


def key_of(word: Column) -> Column:
    return F.lower(F.trim(word))


def inserted(words: DataFrame) -> DataFrame:
    """(word, frequency, metadata) of insertions (seq, word, frequency, metadata map): frequencies add up, and of metadata
    the value inserted last holds for each name. Null and blank words are left out; a word without metadata has none."""
    keyed = words.select(key_of(F.col("word")).alias("word"), "seq", "frequency", "metadata").filter("word <> ''")
    counts = keyed.groupBy("word").agg(F.sum("frequency").alias("frequency"))
    named = keyed.select("word", "seq", F.explode("metadata").alias("name", "value")).groupBy("word", "name").agg(F.max_by("value", "seq").alias("value"))
    maps = named.groupBy("word").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    return counts.join(maps, "word", "left")


def found(trie: DataFrame, word: str) -> DataFrame:
    """The entry of a word, if there is one."""
    return trie.filter(F.col("word") == word.strip().lower())


def completed(trie: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The most frequent words with the prefix; ties in order of words."""
    return trie.filter(F.col("word").startswith(prefix.strip().lower())).orderBy(F.col("frequency").desc(), "word").limit(limit)


def templates(spark: SparkSession, partial: str) -> DataFrame:
    """(word, description, frequency) of the citation templates that begin with what is typed, in any case."""
    rows = [(word, text, TEMPLATE_FREQUENCY) for word, text in TEMPLATES.items()]
    every = spark.createDataFrame(rows, "word string, description string, frequency int")
    return every.filter(F.lower("word").startswith(partial.strip().lower())).select(F.upper("word").alias("word"), "description", "frequency")


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose value begins with the prefix, case counting, in order."""
    return df.filter(F.col(column).startswith(prefix)).orderBy(column)
