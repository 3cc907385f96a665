"""The queries of this subpackage with production parameters, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .exact_dedup import exact_dedup
from .html_extract import extract_text
from . import langid, toxicity
from .line_dedup import line_dedup
from .ngram_join import ngram_components
from .packing import best_fit_packing, token_pieces
from .pii import KINDS, disclosing_terms, find_pii
from .topk import exact_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def remainder() -> Column:
    """crc32 of the decimal id, modulo 4: 2 is held out. Rows without an id aren't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0).cast("long"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coder = langid.train(docs.filter(remainder() != 2))
    return langid.identify(docs.select("doc_id", "text"), coder).select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, disclosing_terms(docs), with_text=False)
    base = F.filter("pii", lambda x: x["kind"] != "term")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.filter(remainder() != 2), _table(spark, sf_dir, "labels").filter(remainder() != 2))
    return toxicity.score_toxicity(docs, model).select("doc_id", (remainder() == 2).alias("held_out"), "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_pii": op5_pii,
        "op6_ngram_join": op6_ngram_join,
        "op7_toxicity": op7_toxicity,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_packing": op9_packing,
        "op10_html_extraction": op10_html_extraction,
    }


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS nr FROM numbered),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY r
"""

_OP4 = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])) AS bigint) AS score
      FROM t q JOIN t c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8 = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op4_exact_top_k": _OP4, "op8_exact_dedup": _OP8}
