"""The corpus pipeline: language ID, line dedup, near-duplicate removal, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's result as
Parquet in the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import langid
from lexarium.llm._shared import row_keys, small, written
from lexarium.llm.line_dedup import line_dedup
from lexarium.llm.ngram_join import ngram_components
from lexarium.llm.packing import best_fit_packing, token_pieces
from lexarium.llm.pii import disclosing_terms, find_pii
from lexarium.llm.queries import remainder, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a determinable language (null or without a letter); others carry the predicted language in lang,
    or keep theirs where no row has a label to learn from."""
    coder = langid.train(docs.filter(remainder() != 2))
    found = langid.identify(docs, coder).filter(~F.col("lang_pred").eqNullSafe(langid.UNDETERMINED))
    return found.withColumn("lang", F.coalesce("lang_pred", "lang")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in ten documents or more out of all. Of exact copies that would be left without words, the one with
    the smallest id stays whole."""
    return _counted(line_dedup(docs.select(*COLUMNS), keep_copy=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each group that five-word shingles link at a similarity of 0.8 or more.

    Rows go, not ids: another text of a dropped row's id stays. Of rows that repeat id and text one stays; texts without a word all stay.
    """
    found = written(ngram_components(docs, n=5, similarity=(80, 100), with_rows=True).select("n_shingles", "kept", "row1", "row2"), "near-duplicates")
    gone = found.filter("NOT kept").select("row1", "row2").distinct()
    again = found.filter("kept AND n_shingles > 0").groupBy("row1", "row2").count().filter("count > 1").select("row1", "row2")
    # Few dropped rows are broadcast, so that no text is shuffled; beyond that Spark joins by shuffling.
    near = lambda keys: F.broadcast(keys) if small(keys) else keys
    rest = docs.select(*COLUMNS, *[k.alias(n) for k, n in zip(row_keys(), ("row1", "row2"), strict=True)]).join(near(gone), ["row1", "row2"], "left_anti")
    if again.isEmpty():
        return rest.select(*COLUMNS)
    again = near(again)
    once = rest.join(again, ["row1", "row2"], "left_semi").groupBy("row1", "row2").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rest.join(again, ["row1", "row2"], "left_anti").select(*COLUMNS).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that reveal it by their kinds."""
    return _counted(find_pii(docs.select(*COLUMNS), disclosing_terms(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences of at most 2048."""
    return best_fit_packing(token_pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", packing)]

#: Trained classifiers, hashed packing and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
