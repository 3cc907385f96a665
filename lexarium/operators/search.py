"""Full-text index and ranking: postings, boolean and phrase search, TF-IDF, BM25, composite scores, filtered pages.

Functions take documents (doc_id, text) or an Index of them, which is written once and then read by term.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.citations import SEARCH_WEIGHTS, looked_up


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): places count all tokens; stop words and short terms have none of their own."""
    stop = F.array(*map(F.lit, X.STOP_WORDS))
    words = docs.select("doc_id", F.posexplode(X.tokens("text")).alias("pos", "term"))
    return words.filter((F.length("term") > 2) & ~F.array_contains(stop, F.col("term")))


def row_postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, positions) of each row of the documents by itself: a row's words never leave its task, so nothing is shuffled."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pc.list_value_length(batch.column("words")).fill_null(0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // WORDS)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            words = batch.column("words")
            known = words.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(known, pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False), 0)
            row = np.repeat(np.arange(len(words)), sizes)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            coded = words.flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            kept = pc.and_(pc.greater(pc.utf8_length(terms), 2), pc.invert(pc.is_in(terms, pa.array(X.STOP_WORDS, terms.type)))).to_numpy(zero_copy_only=False)
            use = np.flatnonzero(kept[code]) if len(code) else np.empty(0, np.int64)
            order = use[np.lexsort((place[use], code[use], row[use]))]
            row, code, place = row[order], code[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.empty(0, np.int64)
            for at in range(0, len(starts), POSTINGS):
                some = starts[at : at + POSTINGS]
                end = starts[at + POSTINGS] if at + POSTINGS < len(starts) else len(row)
                places = pa.ListArray.from_arrays(pa.array((np.append(some, end) - some[0]).astype(np.int32)), pa.array(place[some[0] : end]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[some])), terms.take(pa.array(code[some])), places], ["doc_id", "term", "positions"])

    return docs.select("doc_id", X.tokens("text").alias("words")).mapInArrow(gather, f"doc_id {id_type}, term string, positions array<int>")


def ids_repeat(docs: DataFrame) -> bool:
    """Whether a document has more than one row, so that its words lie in more than one place."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions)."""
    return positions(docs).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


#: Postings that a worker hands on at a time, and words after which it takes no more rows at once.
POSTINGS, WORDS = 1 << 16, 1 << 20


class Index:
    """Postings of documents as a table partitioned by a hash of the term and sorted by term, and the documents' lengths.

    A query reads the partitions of its terms only, and of those the row groups that may hold them.
    """

    PARTS = 64

    def __init__(self, docs: DataFrame, folder: str | None = None):
        spark = docs.sparkSession
        self.folder = f"{folder or spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
        found = postings(docs) if ids_repeat(docs) else row_postings(docs).select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")
        tables = {"postings": found.withColumn("part", self._part(F.col("term"))).repartition("part").sortWithinPartitions("part", "term", "doc_id"), "lengths": lengths(docs)}
        tables["postings"].write.partitionBy("part").parquet(f"{self.folder}/postings")
        tables["lengths"].write.parquet(f"{self.folder}/lengths")
        self.postings = spark.read.parquet(f"{self.folder}/postings")
        self.lengths = spark.read.parquet(f"{self.folder}/lengths")
        frequencies = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")).withColumn("part", self._part(F.col("term")))
        frequencies.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.folder}/terms")
        self.terms = spark.read.parquet(f"{self.folder}/terms")
        self.totals = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))

    @classmethod
    def _part(cls, term: Column) -> Column:
        return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(cls.PARTS)).cast("int")

    def of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms; the partitions are literals, so that others aren't listed."""
        import zlib

        parts = sorted({zlib.crc32(t.encode()) % self.PARTS for t in terms})
        return table.filter(F.col("part").isin(parts) & F.col("term").isin(terms)).drop("part")


def term_counts(docs: DataFrame | Index, terms: list[str] | None = None, words: Column | None = None) -> DataFrame:
    """(doc_id, term, tf), of the stated terms only if there are any: the filter stands before the shuffle."""
    if isinstance(docs, Index):
        return (docs.postings if terms is None else docs.of(docs.postings, terms)).select("doc_id", "term", "tf")
    found = docs.select("doc_id", F.explode(X.index_terms("text") if words is None else words).alias("term"))
    if terms is not None:
        found = found.filter(F.col("term").isin(terms))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame | Index) -> DataFrame:
    """(doc_id, length): words between white space."""
    return docs.lengths if isinstance(docs, Index) else docs.select("doc_id", F.size(X.space_tokens("text")).alias("length"))


def _query(docs: DataFrame | Index, terms: list[str]) -> DataFrame:
    """(term, times) of a query: a repeated term counts as often."""
    spark = (docs.lengths if isinstance(docs, Index) else docs).sparkSession
    return spark.createDataFrame([(t, float(terms.count(t))) for t in sorted(set(terms))], "term string, times double")


def _scored(docs: DataFrame | Index, terms: list[str], words: Column | None = None) -> DataFrame:
    """(doc_id, term, tf, df, times, length, n, average): all that term-wise scores need; only hits are shuffled."""
    counts = term_counts(docs, sorted(set(terms)), words)
    query = _query(docs, terms).join(document_frequency(counts), "term")
    totals = docs.totals if isinstance(docs, Index) else lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    return counts.join(F.broadcast(query), "term").join(lengths(docs), "doc_id").crossJoin(F.broadcast(totals))


def tfidf(docs: DataFrame | Index, terms: list[str], smooth: bool = False) -> DataFrame:
    """(doc_id, score): sum of tf / length * ln(N / df), or ln(N / (1 + df)) if smooth, which may be negative."""
    idf = F.ln(F.col("n") / (F.col("df") + (1 if smooth else 0)))
    return _scored(docs, terms, X.space_tokens("text") if smooth else None).groupBy("doc_id").agg(F.sum(F.col("times") * F.try_divide("tf", "length") * idf).alias("score"))


def bm25(docs: DataFrame | Index, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) with idf = ln((N - df + 0.5) / (df + 0.5)), negative for terms in over half of all documents."""
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return _scored(docs, terms).groupBy("doc_id").agg(F.sum(F.col("times") * idf * weight).alias("score"))


def search(docs: DataFrame, query: list[str], limit: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """The best documents by TF-IDF times their court's weight, with a snippet; ties by id."""
    top = tfidf(docs, query).join(docs.select("doc_id", "court"), "doc_id").withColumn("score", F.col("score") * looked_up("court", weights or SEARCH_WEIGHTS, 1.0))
    best = top.orderBy(F.col("score").desc(), "doc_id").limit(limit)
    return best.join(docs.select("doc_id", X.snippet("text", query).alias("snippet")), "doc_id")


def boolean_text(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id) of `a AND b ..`, `a OR b ..` or `a NOT b`: AND is looked for first, then OR, then NOT; operators don't mix."""
    for operator in (" AND ", " OR ", " NOT "):
        if operator in query:
            parts = [p.strip().lower() for p in query.split(operator)]
            break
    else:
        operator, parts = " OR ", [query.lower()]
    held = docs.select("doc_id", F.array_distinct(X.index_terms("text")).alias("_t"))
    has = [F.array_contains("_t", p) for p in parts]
    if operator == " NOT ":
        return held.filter(has[0] & ~has[1]).select("doc_id") if len(parts) == 2 else held.filter(F.lit(False)).select("doc_id")
    found = has[0]
    for h in has[1:]:
        found = found & h if operator == " AND " else found | h
    return held.filter(found).select("doc_id")


def phrase(docs: DataFrame | Index, words: list[str]) -> DataFrame:
    """(doc_id) in which the words follow one another. Stop words are left out of the phrase while their places in texts
    stay, and words of up to two letters and repeated words never match."""
    terms = [w.lower() for w in words if w.lower() not in X.STOP_WORDS]
    if not terms or any(len(t) <= 2 for t in terms) or len(set(terms)) < len(terms):
        return lengths(docs).filter(F.lit(False)).select("doc_id")
    offset = F.array_position(F.array(*map(F.lit, terms)), F.col("term")) - 1
    places = docs.of(docs.postings, terms).select("doc_id", "term", F.explode("positions").alias("pos")) if isinstance(docs, Index) else positions(docs).filter(F.col("term").isin(terms))
    hits = places.select("doc_id", (F.col("pos") - offset).alias("start"))
    return hits.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(terms)).select("doc_id").distinct()


def proximity(docs: DataFrame, a: str, b: str, within: int) -> DataFrame:
    """(doc_id) in which the two terms stand at most so many places apart."""
    places = lambda t: F.transform(F.filter(F.transform(X.tokens("text"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] == t), lambda x: x["i"])
    near = F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= within))
    return docs.filter(near).select("doc_id")


def suggestions(docs: DataFrame | Index, prefix: str, limit: int = 10) -> DataFrame:
    """(term, df) of the most frequent terms with the prefix."""
    if isinstance(docs, Index):
        return docs.terms.filter(F.col("term").startswith(prefix.lower())).select("term", "df").orderBy(F.col("df").desc(), "term").limit(limit)
    terms = docs.select(F.explode(F.array_distinct(F.filter(X.index_terms("text"), lambda w: w.startswith(prefix.lower())))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "term").limit(limit)


def term_statistics(docs: DataFrame | Index, terms: list[str]) -> DataFrame:
    """Per term: df, total and average tf, idf = ln(N / df)."""
    if isinstance(docs, Index):
        counts, total = docs.of(docs.terms, terms), docs.totals.select("n")
    else:
        counts, total = term_counts(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")), docs.agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("term", "df", "total_tf", (F.col("total_tf") / F.col("df")).alias("average_tf"), F.ln(F.col("n") / F.col("df")).alias("idf"))


def index_statistics(docs: DataFrame | Index, top: int = 10) -> DataFrame:
    """Documents, vocabulary, average length in words and the terms of the most documents: one row."""
    if isinstance(docs, Index):
        frequencies, totals = docs.terms, docs.totals
    else:
        frequencies = docs.select(F.explode(F.array_distinct(X.index_terms("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        totals = lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    vocabulary = frequencies.agg(F.count(F.lit(1)).alias("vocabulary"))
    best = frequencies.orderBy(F.col("df").desc(), "term").limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("k"), "term"))), lambda x: x["term"]).alias("top_terms"))
    return totals.select(F.col("n").alias("documents"), F.col("average").alias("average_length")).crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(best))


def multi_field(docs: DataFrame, terms: list[str], fields: dict[str, float]) -> DataFrame:
    """(doc_id, score): the best of the fields' BM25 scores times their boosts."""
    out = None
    for field, boost in fields.items():
        found = bm25(docs.select("doc_id", F.col(field).alias("text")), terms).select("doc_id", (F.col("score") * boost).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id").agg(F.max("score").alias("score"))


def matched(docs: DataFrame, terms: list[str], fields: dict[str, float], courts: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The documents (with score) that hold a term in one of the fields and pass the filters on court and date, either bound of which
    may be missing; documents without a date fail only where there is a bound. Scores are those of the whole corpus."""
    inside = docs
    if courts:
        inside = inside.filter(F.col("court").isin(courts))
    for bound, compare in ((since, lambda b: F.col("date") >= b), (until, lambda b: F.col("date") <= b)):
        if bound is not None:
            inside = inside.filter(compare(F.lit(bound).cast("date")))
    return inside.join(multi_field(docs, terms, fields), "doc_id")


def page(matches: DataFrame, terms: list[str], size: int = 10, start: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, score, highlight) of one page of matches, best first, ties by id; the first term is marked in the text's snippet."""
    best = matches.orderBy(F.col("score").desc(), "doc_id").offset(start).limit(size)
    return best.select("doc_id", "score", X.highlight(X.snippet(text, terms), terms[0]).alias("highlight"))


def facets(matches: DataFrame) -> DataFrame:
    """(facet, value, n) over all matches, not a page of them: courts, and years of the date."""
    pairs = F.array(F.struct(F.lit("court").alias("facet"), F.col("court").alias("value")), F.struct(F.lit("year").alias("facet"), F.year("date").cast("string").alias("value")))
    return matches.select(F.explode(pairs).alias("x")).select("x.*").filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def field_rank(docs: DataFrame, terms: list[str], weights: dict[str, float], least: float = 0.5, relevance: str = "relevance") -> DataFrame:
    """(doc_id, rank, relevance): the weights of the fields that hold a term, summed over terms, of documents of at least so much relevance."""
    rank = F.lit(0.0)
    for field, weight in weights.items():
        words = X.tokens(F.coalesce(F.col(field), F.lit("")))
        rank = rank + F.size(F.array_intersect(F.array(*map(F.lit, sorted(set(terms)))), words)) * F.lit(weight)
    ranked = docs.filter(F.col(relevance) >= least).select("doc_id", rank.alias("rank"), relevance)
    return ranked.filter("rank > 0")


def relevance(docs: DataFrame, terms: list[str], boost: Column, as_of: Column) -> DataFrame:
    """(doc_id, score) of documents (doc_id, text, date, cited) by cosine with the query, which counts as one more document of
    the corpus, times a court's boost, 1 + 0.2 exp(-days / 365) and 1 + 0.1 ln(1 + citations); a missing date gives no bonus."""
    query = docs.sparkSession.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, _q int")
    words = X.index_terms("text", X.VECTOR_STOP_WORDS)
    if ids_repeat(docs):
        counts = term_counts(docs, words=words)
        frequency = document_frequency(counts)
    else:
        # Frequencies need all documents; norms only those that hold a term of the query, and their words stay in their tasks.
        frequency = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        extra = sorted(set(X.VECTOR_STOP_WORDS) - set(X.STOP_WORDS))
        holders = docs.filter(F.arrays_overlap(words, F.array(*map(F.lit, sorted(set(terms))))))
        counts = row_postings(holders).filter(~F.col("term").isin(extra)).select("doc_id", "term", F.size("positions").alias("tf"))
    df = frequency.join(F.broadcast(query), "term", "full").select("term", "_q", (F.coalesce("df", F.lit(0)) + F.when(F.col("_q").isNotNull(), 1).otherwise(0)).alias("df"))
    total = docs.agg((F.count(F.lit(1)) + 1).alias("n"))
    weighted = df.crossJoin(F.broadcast(total)).withColumn("idf", F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    own = weighted.filter("_q IS NOT NULL").agg(F.sqrt(F.sum(F.pow(F.col("_q") * F.col("idf"), 2))).alias("_norm"))
    sums = counts.join(weighted, "term").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"), F.sum(F.col("tf") * F.col("_q") * F.col("idf") * F.col("idf")).alias("dot"))
    cosine = sums.filter("dot IS NOT NULL").crossJoin(F.broadcast(own)).select("doc_id", (F.col("dot") / F.col("norm") / F.col("_norm")).alias("cosine"))
    recent = 1 + F.coalesce(0.2 * F.exp(-F.datediff(as_of, F.col("date")) / 365), F.lit(0.0))
    return docs.join(cosine, "doc_id").select("doc_id", (F.col("cosine") * boost * recent * (1 + 0.1 * F.log1p(F.col("cited")))).alias("score"))


def combined(factors: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, score) of a table with a column for each factor: the weighted mean of those named, missing values counting as 0."""
    total = sum(weights.values())
    return factors.select("doc_id", sum((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * F.lit(w / total) for k, w in weights.items()), F.lit(0.0)).alias("score"))


def vectors(docs: DataFrame | Index, terms: int | None = None) -> DataFrame:
    """(doc_id, term, weight): unit-length TF-IDF with idf = ln((1 + N) / (1 + df)) + 1; of the corpus's `terms` most frequent terms only, if set."""
    if isinstance(docs, Index):
        extra = sorted(set(X.VECTOR_STOP_WORDS) - set(X.STOP_WORDS))
        counts, total = term_counts(docs).filter(~F.col("term").isin(extra)), docs.totals.select("n")
        frequency = docs.terms.filter(~F.col("term").isin(extra)).select("term", "df", "total_tf")
    else:
        counts, total = term_counts(docs, words=X.index_terms("text", X.VECTOR_STOP_WORDS)), docs.agg(F.count(F.lit(1)).alias("n"))
        frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    if terms is not None:
        frequency = frequency.orderBy(F.col("total_tf").desc(), "term").limit(terms)
    idf = frequency.crossJoin(F.broadcast(total)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Digits to which similarities are equal: copies tie, though the last bits of their sums hang on the order of addition.
TIES = 12


def similar(vectors_: DataFrame, target: int, limit: int = 5) -> DataFrame:
    """(doc_id, similarity): the documents nearest to one of them by cosine, through the terms they share with it; ties by id."""
    own = vectors_.filter(F.col("doc_id") == target).select("term", F.col("weight").alias("_w"))
    found = vectors_.filter(F.col("doc_id") != target).join(F.broadcast(own), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("_w")).alias("similarity"))
    return found.orderBy(F.round("similarity", TIES).desc(), "doc_id").limit(limit)


def similar_to(docs: DataFrame | Index, target: int, limit: int = 5) -> DataFrame:
    """What similar(vectors(docs), target) gives, with one pass over the postings: dot products and norms add up together per document."""
    extra = sorted(set(X.VECTOR_STOP_WORDS) - set(X.STOP_WORDS))
    if isinstance(docs, Index):
        counts, frequency, total = term_counts(docs), docs.terms.select("term", "df"), docs.totals.select("n")
    else:
        counts, total = term_counts(docs), docs.agg(F.count(F.lit(1)).alias("n"))
        frequency = document_frequency(counts)
    own = counts.filter((F.col("doc_id") == target) & ~F.col("term").isin(extra)).select("term", F.col("tf").alias("_tf"))
    idf = frequency.filter(~F.col("term").isin(extra)).crossJoin(F.broadcast(total)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    known = idf.join(F.broadcast(own), "term", "left")  # a document's terms are few
    sums = counts.join(known, "term").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"), F.sum(F.col("tf") * F.col("_tf") * F.pow("idf", F.lit(2))).alias("dot"))
    length = known.filter("_tf IS NOT NULL").agg(F.sqrt(F.sum(F.pow(F.col("_tf") * F.col("idf"), 2))).alias("_norm"))
    found = sums.filter((F.col("doc_id") != target) & F.col("dot").isNotNull()).crossJoin(F.broadcast(length))
    return found.select("doc_id", (F.col("dot") / F.col("norm") / F.col("_norm")).alias("similarity")).orderBy(F.round("similarity", TIES).desc(), "doc_id").limit(limit)


def pairwise(vectors_: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of documents that share a term, by cosine; all other pairs have 0. Found through
    the shared terms: meant for collections whose terms are rare, since a term in n documents gives n * (n - 1) / 2 rows."""
    a, b = vectors_.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("_a")), vectors_.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("_b"))
    return a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("similarity"))


def composite(bm25_: Column, authority: Column, temporal: Column, name_match: Column) -> Column:
    """0.5 text, 0.3 authority, 0.2 age; three tenths more where the query stands in the case name."""
    return (0.5 * bm25_ + 0.3 * authority + 0.2 * temporal) * F.when(name_match, 1.3).otherwise(1.0)


def precedent_strength(level: Column, own_level: Column, similarity: Column, recency: Column, cited: Column) -> Column:
    """0.4 rank (halved below the own court), 0.3 similarity, 0.2 recency, 0.1 citations."""
    rank = level / 5 * F.when(level < own_level, 0.5).otherwise(1.0)
    return 0.4 * rank + 0.3 * similarity + 0.2 * recency + 0.1 * F.least(F.lit(1.0), F.log1p(cited) / F.ln(F.lit(100.0)))


def jaccard_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, jaccard) of all pairs of (doc_id, text) and (item_id, text) that share a token, found through the
    shared tokens; ids are unique. Null texts have no tokens."""

    def sets(df: DataFrame, key: str, size: str) -> DataFrame:
        # The size comes before the explosion, so that its rows carry no array; the outer form keeps Spark from taking the tokens twice.
        words = df.select(key, F.array_distinct(X.tokens("text")).alias("_w")).select(key, F.size("_w").alias(size), "_w")
        return words.select(key, size, F.explode_outer("_w").alias("_t")).filter("_t IS NOT NULL")

    shared = sets(docs, "doc_id", "_a").join(sets(items, "item_id", "_b"), "_t").groupBy("doc_id", "item_id", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    return shared.select("doc_id", "item_id", F.round(F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n")), 6).alias("jaccard"))
