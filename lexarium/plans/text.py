"""Queries over texts, vectors, graphs, sketches, markup and caches; each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import numeric as N
from ..functions import text as X
from ..operators import documents as D
from ..operators import extract as E
from ..operators import graph as G
from ..operators import linked as L
from ..operators import nlp as P
from ..operators import search as S
from ..operators import sketch as B
from ..sources import tables as T
from ..sources.tables import sql
from ..streaming import cache as K

TERMS = ["anea", "erin", "ther"]
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_INDEX = f"WITH words AS (SELECT doc_id, court, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tokens), terms AS (SELECT * FROM words WHERE length(term) > 2 AND term NOT IN ({_STOP})), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), len AS (SELECT doc_id, court, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS length FROM tokens), n AS (SELECT count(*) AS n, avg(length) AS average FROM len)"
_IN = "('anea', 'erin', 'ther')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return register


def _r(column, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# Index and search

_INDEXES: dict[tuple, S.Index] = {}


def _index(spark, d):
    """The index of the documents, written once for each state of the table; without a shared folder the documents themselves."""
    docs = T.corpus(spark, d)
    if not spark.sparkContext.getCheckpointDir():
        return docs
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, str(status.getPath()), status.getModificationTime(), status.getLen())
    if key not in _INDEXES:
        _INDEXES[key] = S.Index(docs)
    return _INDEXES[key]


@query(f"{_INDEX} SELECT term, doc_id, tf, (SELECT string_agg(cast(t.pos AS varchar), ',' ORDER BY t.pos) FROM terms t WHERE t.term = tf.term AND t.doc_id = tf.doc_id) AS positions FROM tf WHERE term IN {_IN}", "tokens")
def postings(spark, d):
    index = _index(spark, d)
    found = index.of(index.postings, TERMS) if isinstance(index, S.Index) else S.postings(index).filter(F.col("term").isin(TERMS))
    return found.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"{_INDEX} SELECT doc_id, round(sum(tf * 1.0 / length * ln(n / df)), 9) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), n WHERE term IN {_IN} GROUP BY 1", "tokens")
def tfidf_search(spark, d):
    return S.tfidf(_index(spark, d), TERMS).select("doc_id", _r("score", 9))


@query(
    f"""{_INDEX}, s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), n WHERE term IN {_IN} GROUP BY 1)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""",
    "tokens",
)
def bm25_search(spark, d):
    return S.bm25(_index(spark, d), TERMS).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", _r("score"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM tokens), t AS (SELECT doc_id, unnest(w) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM w) SELECT doc_id, round(sum(tf * 1.0 / len(w.w) * ln(n / (1.0 + df))), 9) AS score FROM tf JOIN df USING (term) JOIN w USING (doc_id), n WHERE term IN ('anea', 'erin', 'ther') GROUP BY 1", "tokens")
def tfidf_scorer(spark, d):
    return S.tfidf(T.corpus(spark, d), TERMS, smooth=True).select("doc_id", _r("score", 9))


for _name, _q, _sql in (
    ("boolean_and", "anea AND erin", "list_contains(w, 'anea') AND list_contains(w, 'erin')"),
    ("boolean_or", "anea OR thon", "list_contains(w, 'anea') OR list_contains(w, 'thon')"),
    ("boolean_not", "anea NOT erin", "list_contains(w, 'anea') AND NOT list_contains(w, 'erin')"),
):

    def _run(spark, d, q=_q):
        return S.boolean_text(T.corpus(spark, d), q)

    _run.__name__ = _name
    query(f"SELECT doc_id FROM (SELECT doc_id, words AS w FROM tokens) WHERE {_sql}", "tokens")(_run)


@query(f"{_INDEX} SELECT DISTINCT a.doc_id FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN terms c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'anea' AND b.term = 'eriner' AND c.term = 'thanea'", "tokens")
def phrase(spark, d):
    return S.phrase(_index(spark, d), ["anea", "eriner", "thanea"])


@query("WITH w AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tokens) SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 5 WHERE a.term = 'anea' AND b.term = 'erin'", "tokens")
def proximity(spark, d):
    return S.proximity(T.corpus(spark, d), "anea", "erin", 5)


@query(f"{_INDEX} SELECT term, df FROM df WHERE starts_with(term, 'an') ORDER BY df DESC, term LIMIT 10", "tokens")
def suggest(spark, d):
    return S.suggestions(_index(spark, d), "an")


@query(f"{_INDEX} SELECT term, df, (SELECT cast(sum(tf) AS bigint) FROM tf t WHERE t.term = df.term) AS total_tf, round((SELECT sum(tf) FROM tf t WHERE t.term = df.term) / df, 6) AS average_tf, round(ln(n / df), 6) AS idf FROM df, n WHERE term IN {_IN}", "tokens")
def term_stats(spark, d):
    return S.term_statistics(_index(spark, d), TERMS).select("term", "df", "total_tf", _r("average_tf"), _r("idf"))


@query(f"{_INDEX} SELECT n AS documents, round(average, 6) AS average_length, (SELECT count(*) FROM df) AS vocabulary, (SELECT string_agg(term, ' ' ORDER BY df DESC, term) FROM (SELECT term, df FROM df ORDER BY df DESC, term LIMIT 10)) AS top_terms FROM n", "tokens")
def index_stats(spark, d):
    return S.index_statistics(_index(spark, d)).select("documents", _r("average_length"), "vocabulary", F.array_join("top_terms", " ").alias("top_terms"))


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'anea') > 0 THEN trim(substring(text, cast(greatest(1, strpos(lower(text), 'anea') - 50) AS integer), cast(strpos(lower(text), 'anea') + 200 - greatest(1, strpos(lower(text), 'anea') - 50) AS integer))) ELSE trim(substring(text, 1, 200)) END AS snippet FROM documents")
def snippets(spark, d):
    return T.corpus(spark, d).select("doc_id", X.snippet("text", ["anea"]).alias("snippet"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(words) AS w FROM tokens), b AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM benchmark),
    x AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t), y AS (SELECT item_id, len(w) AS m, unnest(w) AS term FROM b)
    SELECT doc_id, item_id, round(count(*) / (any_value(n) + any_value(m) - count(*)), 6) AS jaccard FROM x JOIN y USING (term) GROUP BY 1, 2""",
    "tokens",
)
def jaccard_pairs(spark, d):
    """Token-set Jaccard of all documents and items that share a token; all others have 0."""
    return S.jaccard_join(T.corpus(spark, d).select("doc_id", "text"), T.table(spark, d, "benchmark").select("item_id", "text"))


_VECTORS = _INDEX.replace(_STOP, _STOP + ", 'this', 'that', 'these', 'those'") + ", raw AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n), nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), v AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN nrm USING (doc_id))"


@query(f"{_VECTORS} SELECT b.doc_id, round(sum(a.weight * b.weight), 6) AS similarity FROM v a JOIN v b ON a.term = b.term AND a.doc_id = 1 AND b.doc_id <> 1 GROUP BY 1 ORDER BY sum(a.weight * b.weight) DESC, b.doc_id LIMIT 5", "tokens")
def similar_documents(spark, d):
    return S.similar_to(_index(spark, d), 1).select("doc_id", _r("similarity"))


# Vectors


def _target(spark, d):
    return T.table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("_t"), F.col("label").alias("_l"))


_PAIR = "FROM embeddings e, (SELECT embedding AS t, label AS l FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0"
_DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: cast({} AS double) * {}))"


@query(f"SELECT vec_id, round({_DOT.format('embedding[i]', 't[i]')} / sqrt({_DOT.format('embedding[i]', 'embedding[i]')}) / sqrt({_DOT.format('t[i]', 't[i]')}), 6) AS similarity, label = l AS same_label {_PAIR} ORDER BY {_DOT.format('embedding[i]', 't[i]')} / sqrt({_DOT.format('embedding[i]', 'embedding[i]')}) DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    pairs = T.table(spark, d, "embeddings").filter("vec_id <> 0").crossJoin(F.broadcast(_target(spark, d)))
    return pairs.select("vec_id", N.cosine("embedding", "_t").alias("similarity"), (F.col("label") == F.col("_l")).alias("same_label")).orderBy(F.col("similarity").desc(), "vec_id").limit(10).select("vec_id", _r("similarity"), "same_label")


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (cast(embedding[i] AS double) - t[i]) * (cast(embedding[i] AS double) - t[i])))), 6) AS distance {_PAIR} ORDER BY list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (cast(embedding[i] AS double) - t[i]) * (cast(embedding[i] AS double) - t[i]))), vec_id LIMIT 10")
def euclidean_topk(spark, d):
    pairs = T.table(spark, d, "embeddings").filter("vec_id <> 0").crossJoin(F.broadcast(_target(spark, d)))
    return pairs.select("vec_id", N.euclidean("embedding", "_t").alias("distance")).orderBy("distance", "vec_id").limit(10).select("vec_id", _r("distance"))


@query("SELECT id, round(exp(-0.1 * (date '2001-08-01' - judgment_date) / 365.25) * CASE WHEN word_count > 50 THEN 1.5 ELSE 1 END, 6) AS age, round(exp(-ln(2) / 365 * greatest(0, date '2001-08-01' - judgment_date)), 9) AS half, round(CASE WHEN judgment_date >= date '2001-08-01' THEN 1 ELSE greatest(0, 1 - (date '2001-08-01' - judgment_date) / 3650.0) END, 6) AS linear, round(CASE WHEN judgment_date >= date '2001-08-01' THEN 1 ELSE 1 / (1 + ln(1 + (date '2001-08-01' - judgment_date) / 365.0)) END, 6) AS logarithmic FROM judgments", "judgments")
def decays(spark, d):
    day, as_of = "judgment_date", F.lit("2001-08-01").cast("date")
    return T.judgments(spark, d).select("id", F.round(N.age_decay(day, as_of, "word_count"), 6).alias("age"), F.round(N.half_life(day, as_of), 9).alias("half"), F.round(N.decay(day, as_of, "linear", 3650.0), 6).alias("linear"), F.round(N.decay(day, as_of, "logarithmic"), 6).alias("logarithmic"))


# Graphs


@query("WITH x AS (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) SELECT id, cast(sum(i) AS bigint) AS in_degree, cast(sum(o) AS bigint) AS out_degree FROM x GROUP BY 1", "edges")
def degrees(spark, d):
    return G.degrees(T.edges(spark, d))


@query("SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, id LIMIT 5", "edges")
def most_cited(spark, d):
    return G.most_cited(T.edges(spark, d))


@query("SELECT count(*) AS edges, round(count(*) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1.0)), 9) AS density FROM edges", "edges")
def density(spark, d):
    return G.density(T.edges(spark, d), T.table(spark, d, "part").count()).select("edges", _r("density", 9))


@query("WITH p AS (SELECT a.src, a.dst AS a, b.dst AS b FROM edges a JOIN edges b ON a.src = b.src AND a.dst < b.dst), s AS (SELECT p.src, avg(CASE WHEN e.src IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM p LEFT JOIN edges e ON e.src = p.a AND e.dst = p.b GROUP BY 1) SELECT round(coalesce(avg(share), 0), 9) AS clustering FROM s", "edges")
def clustering(spark, d):
    return G.clustering(T.edges(spark, d)).select(_r("clustering", 9))


@query("WITH h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 1000), h2 AS (SELECT DISTINCT dst AS id FROM edges JOIN h1 ON src = h1.id EXCEPT (SELECT id FROM h1)) SELECT cast(1000 AS bigint) AS id, 0::bigint AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 1000", "edges")
def k_hop(spark, d):
    return G.neighbourhood(T.edges(spark, d), [1000], 2).select("id", F.col("hop").cast("long").alias("hop"))


@query("SELECT x.direction, x.id, j.court FROM (SELECT 'cited' AS direction, dst AS id FROM edges WHERE src = 1000 UNION ALL SELECT 'citing', src FROM edges WHERE dst = 1000) x LEFT JOIN judgments j ON j.id = x.id", "edges", "judgments")
def citation_network(spark, d):
    return G.network(T.edges(spark, d), T.judgments(spark, d), 1000).select("direction", "id", "court")


_RANK = "r{0} AS MATERIALIZED (SELECT v.id, 0.15 / c.n + 0.85 * (coalesce(g.given, 0) + l.lost / c.n) AS rank FROM v CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(r.rank), 0) AS lost FROM r{1} r LEFT JOIN o ON o.src = r.id WHERE o.src IS NULL) l LEFT JOIN (SELECT e.dst AS id, sum(r.rank / o.out) AS given FROM edges e JOIN o ON o.src = e.src JOIN r{1} r ON r.id = e.src GROUP BY 1) g ON g.id = v.id)"


@query("WITH v AS (SELECT p_partkey AS id FROM part), c AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS out FROM edges GROUP BY 1), r0 AS (SELECT id, 1.0 / n AS rank FROM v, c), " + ", ".join(_RANK.format(i, i - 1) for i in range(1, 51)) + " SELECT id, round(rank, 10) AS rank FROM r50", "edges")
def pagerank(spark, d):
    return G.pagerank(T.edges(spark, d), T.table(spark, d, "part").select(F.col("p_partkey").alias("id"))).select("id", _r("rank", 10))


@query(None)
def hits(spark, d):
    return G.hits(T.edges(spark, d)).select("id", _r("hub", 8), _r("authority", 8))


# Sketches

_BITS, _HASHES = N.bloom_size(2000, 0.01)
_POSITIONS = "list_transform(range({k}), lambda i: cast('0x' || substring(md5(encode({x}) || unhex(printf('%08x', i))), 1, 8) AS bigint) % {m})"


def _bloom(column: str) -> str:
    return _POSITIONS.format(k=_HASHES, m=_BITS, x=column)


@query(f"WITH b AS (SELECT DISTINCT unnest({_bloom('s_name')}) AS bit FROM supplier), x AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier), p AS (SELECT name, unnest({_bloom('name')}) AS bit FROM x) SELECT name, count(*) = count(b.bit) AS maybe FROM p LEFT JOIN b USING (bit) GROUP BY 1")
def bloom_probe(spark, d):
    bits = B.built(T.table(spark, d, "supplier"), "s_name", _BITS, _HASHES)
    names = T.table(spark, d, "customer").select(F.col("c_name").alias("name")).union(T.table(spark, d, "supplier").select("s_name"))
    return B.probed(names, "name", bits, _BITS, _HASHES)


@query(f"SELECT DISTINCT bit FROM (SELECT unnest({_bloom('s_name')}) AS bit FROM supplier UNION ALL SELECT unnest({_bloom('n_name')}) FROM nation)")
def bloom_union(spark, d):
    a, b = B.built(T.table(spark, d, "supplier"), "s_name", _BITS, _HASHES), B.built(T.table(spark, d, "nation"), "n_name", _BITS, _HASHES)
    return B.union(a, b)


_SLICES = [N.bloom_size(20 * 2**i, 0.01) for i in range(24)]


@query(
    f"""WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier), b AS (SELECT s_name, cast(floor(log2(r / 20.0 + 1) + 1e-12) AS integer) AS slice FROM a),
    p AS (SELECT slice, s_name, {[m for m, _ in _SLICES]}[slice + 1] AS m, unnest(range({[k for _, k in _SLICES]}[slice + 1])) AS seed FROM b)
    SELECT slice, count(DISTINCT cast('0x' || substring(md5(encode(s_name) || unhex(printf('%08x', seed))), 1, 8) AS bigint) % m) AS bits FROM p GROUP BY 1"""
)
def bloom_scalable(spark, d):
    return B.scalable(T.table(spark, d, "supplier"), "s_name", F.col("s_suppkey"), 20).groupBy("slice").agg(F.count(F.lit(1)).alias("bits"))


# Citations and tokens


def _citations(spark, d):
    """Citations made of the orders: some valid, some not."""
    court = F.element_at(F.array(*map(F.lit, [*C.COURT_LABELS, "XXXX"])), (F.col("id") % 7 + 1).cast("int"))
    return T.judgments(spark, d).select("id", F.concat(F.lit("["), (F.year("judgment_date") - F.when(F.col("id") % 5 == 0, 20).otherwise(0)).cast("string"), F.lit("]  "), court, F.lit(" "), F.col("id").cast("string")).alias("citation"))


_CITED = "WITH x AS (SELECT id, year(judgment_date) - CASE WHEN id % 5 = 0 THEN 20 ELSE 0 END AS y, list_extract(['UKSC', 'UKHL', 'EWCA', 'EWHC', 'UKUT', 'EWCOP', 'XXXX'], id % 7 + 1) AS court FROM judgments)"


@query(f"{_CITED} SELECT id, '[' || y || '] ' || court || ' ' || id AS normal, CASE court WHEN 'UKSC' THEN 'Supreme Court' WHEN 'UKHL' THEN 'House of Lords' WHEN 'EWCA' THEN 'Court of Appeal' WHEN 'EWHC' THEN 'High Court' WHEN 'UKUT' THEN 'Upper Tribunal' WHEN 'EWCOP' THEN 'Court of Protection' ELSE 'Other' END AS label, court, cast(CASE WHEN court = 'UKSC' THEN 1 WHEN court = 'EWCA' THEN 2 WHEN court IN ('EWHC', 'EWCOP') THEN 3 WHEN court = 'UKUT' THEN 4 ELSE 99 END AS bigint) AS level, 'https://example.org/' || lower(court) || '/' || y || '/' || id AS uri, 'neutral' AS class FROM x", "judgments")
def citation_functions(spark, d):
    x = _citations(spark, d)
    return x.select("id", C.normal_for_format("citation").alias("normal"), C.court_label("citation").alias("label"), C.court_of("citation").alias("court"), C.court_level(C.court_of("citation")).cast("long").alias("level"), C.citation_uri("citation").alias("uri"), C.citation_class("citation").alias("class"))


@query(f"{_CITED} SELECT id, y >= 1990 AND court <> 'XXXX' AS valid, CASE WHEN court = 'XXXX' THEN '[' || y || ']  XXXX ' || id ELSE '[' || y || '] ' || court || ' ' || id END AS normalized, cast(CASE WHEN court = 'XXXX' OR y < 1990 THEN 1 ELSE 0 END AS bigint) AS n_errors FROM x", "judgments")
def citation_validation(spark, d):
    return _citations(spark, d).select("id", C.validated("citation").alias("v")).select("id", "v.valid", "v.normalized", F.size("v.errors").cast("long").alias("n_errors"))


@query(
    f"""{_CITED}, t AS (SELECT id, '[' || y || ']  ' || court || ' ' || id AS c, y, court FROM x), s AS (SELECT id, 3 AS a, length('In ' || c || ' and ') AS b, length('In ' || c || ' and [1998] 2 AC 500 the case ') AS e, c, y, court FROM t)
    SELECT id, 'neutral' AS kind, c AS text, cast(y AS bigint) AS year, court, NULL AS series, cast(id AS varchar) AS number, NULL AS division, cast(a AS bigint) AS start, cast(a + length(c) AS bigint) AS "end", 0.95::double AS confidence FROM s WHERE court <> 'XXXX'
    UNION ALL SELECT id, 'law_report', '[1998] 2 AC 500', 1998, NULL, 'AC', '500', '2', b, b + 15, 0.9 FROM s UNION ALL SELECT id, 'european', 'case C-127/08 Metock was cited', 2008, 'ECJ', NULL, '127', NULL, e - 5, e + 25, 0.85 FROM s""",
    "judgments",
)
def citation_extraction(spark, d):
    text = F.concat(F.lit("In "), F.col("citation"), F.lit(" and [1998] 2 AC 500 the case C-127/08 Metock was cited."))
    found = _citations(spark, d).select("id", F.explode(E.citations(text)).alias("x")).select("id", "x.*")
    return found.withColumns({n: F.col(n).cast("long") for n in ("year", "start", "end")})


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, cast(len(s) AS bigint) AS n_sentences, sha256(coalesce(array_to_string(s, chr(10)), '')) AS sentences_sha256 FROM s")
def sentence_split(spark, d):
    """All sentences, as their number and a hash."""
    found = F.coalesce(X.sentences("text"), F.array().cast("array<string>"))
    return T.corpus(spark, d).select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.sha2(F.array_join(found, "\n"), 256).alias("sentences_sha256"))


@query(None)
def token_types(spark, d):
    return P.token_types(T.corpus(spark, d))


@query(None)
def parse_phrases(spark, d):
    return P.phrases(T.corpus(spark, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


# Markup, records, caches


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT page_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')), 1, 5000) AS text FROM pages")
def html_plain_text(spark, d):
    return T.table(spark, d, "pages").select("page_id", D.plain_text("html").alias("text"))


@query(None)
def dom_nodes(spark, d):
    return D.html_elements(T.table(spark, d, "pages")).groupBy("tag", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_field(spark, d):
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _cases(spark, d):
    """Judgments as case records."""
    x = _citations(spark, d)
    code = C.court_of("citation")
    return x.select(
        F.concat(F.lit("https://example.org/case/"), F.col("id").cast("string")).alias("uri"), F.concat(F.lit("Case "), F.col("id").cast("string")).alias("name"), C.normal_for_format("citation").alias("neutral_citation"), code.alias("court"), C.court_label("citation").alias("court_name"),
        F.lit("1999-01-02").alias("judgment_date"), F.array(F.lit("A"), F.lit("B")).alias("judges"), F.array(F.lit("Data Law")).alias("keywords"), F.create_map(F.lit("claimant"), F.lit("X")).alias("parties"),
        F.array(F.struct(F.col("citation"), F.lit(3).alias("paragraph"))).alias("citations"), F.array(F.struct(F.lit("An Act").alias("title"), F.lit("/x").alias("href"), F.array(F.lit("1")).alias("sections"))).alias("legislation_references"),
    )


_LABEL = "CASE court WHEN 'UKSC' THEN 'Supreme Court' WHEN 'UKHL' THEN 'House of Lords' WHEN 'EWCA' THEN 'Court of Appeal' WHEN 'EWHC' THEN 'High Court' WHEN 'UKUT' THEN 'Upper Tribunal' WHEN 'EWCOP' THEN 'Court of Protection' ELSE 'Other' END"
_LEVEL = "CASE WHEN court = 'UKSC' THEN 1 WHEN court = 'EWCA' THEN 2 WHEN court IN ('EWHC', 'EWCOP') THEN 3 WHEN court = 'UKUT' THEN 4 ELSE 99 END"
_CASES = _CITED + f", k AS (SELECT id, 'https://example.org/case/' || id AS uri, '[' || y || ']  ' || court || ' ' || id AS cited, '[' || y || '] ' || court || ' ' || id AS normal, y, court, {_LABEL} AS label, {_LEVEL} AS level, court IN ('UKSC', 'EWCA', 'EWHC', 'EWCOP', 'UKUT') AS valid FROM x)"


@query(
    f"""{_CASES} SELECT uri, valid, CASE WHEN valid THEN '' ELSE 'Invalid court code: ' || court END AS errors,
    '{{"citations":[{{"citation":"' || cited || '","normalized":"' || normal || '","paragraph":3,"type":"neutral"}}],"court":{{"code":"' || court || '","level":' || level || ',"name":"' || label || '"}},"judges":["A","B"],"judgment_date":"1999-01-02","keywords":["Data Law"],'
    || '"legislation_references":[{{"title":"An Act","href":"/x","sections":["1"]}}],"name":"Case ' || id || '","neutral_citation":"' || normal || '","parties":{{"claimant":"X"}},"uri":"' || uri || '"}}' AS json FROM k""",
    "judgments",
)
def case_json(spark, d):
    return L.to_json(_cases(spark, d)).select("uri", "valid", F.array_join("errors", ",").alias("errors"), "json")


@query(
    f"""{_CASES} SELECT uri, '{{"@context":"https://schema.org","@id":"' || uri || '","@type":"LegalDocument","name":"Case ' || id || '","identifier":"' || normal || '","datePublished":"1999-01-02","publisher":{{"@id":"https://example.org/court/' || lower(court) || '","@type":"Organization","name":"' || label
    || '"}},"author":[{{"@id":"' || uri || '#judge-1","@type":"Person","name":"A"}},{{"@id":"' || uri || '#judge-2","@type":"Person","name":"B"}}],"citation":[{{"@id":"https://example.org/' || lower(court) || '/' || y || '/' || id || '","@type":"LegalDocument","name":"' || cited || '"}}],"about":[{{"@id":"https://example.org/subject/data-law","name":"Data Law"}}]}}' AS json_ld FROM k""",
    "judgments",
)
def case_json_ld(spark, d):
    return L.to_json_ld(_cases(spark, d))


@query(f"{_CASES} SELECT uri, '<case><uri>' || uri || '</uri><name>Case ' || id || '</name><neutral_citation>' || normal || '</neutral_citation><court>' || court || '</court><judgment_date>1999-01-02</judgment_date></case>' AS xml FROM k", "judgments")
def case_xml(spark, d):
    return L.to_xml(_cases(spark, d))


_NODE = "'_:' || substring(md5(uri || '#judge' || {}), 1, 12)"
_TRIPLES = f"""{_CASES}, t AS (SELECT uri AS s, 'rdf:type' AS p, unnest(['legal:Judgment', 'schema:LegalDocument']) AS o, 'uri' AS datatype FROM k UNION ALL SELECT uri, 'dct:title', 'Case ' || id, 'string' FROM k UNION ALL SELECT uri, 'dct:identifier', normal, 'string' FROM k
    UNION ALL SELECT uri, 'dct:issued', '1999-01-02', 'date' FROM k UNION ALL SELECT uri, 'dct:publisher', 'https://example.org/court/' || lower(court), 'uri' FROM k UNION ALL SELECT 'https://example.org/court/' || lower(court), 'rdf:type', 'legal:Court', 'uri' FROM k
    UNION ALL SELECT 'https://example.org/court/' || lower(court), 'rdfs:label', label, 'string' FROM k UNION ALL SELECT uri, 'legal:judge', {_NODE.format('n')}, 'bnode' FROM k, (VALUES (0), (1)) j(n) UNION ALL SELECT {_NODE.format('n')}, 'rdf:type', 'foaf:Person', 'uri' FROM k, (VALUES (0), (1)) j(n)
    UNION ALL SELECT {_NODE.format('n')}, 'foaf:name', name, 'string' FROM k, (VALUES (0, 'A'), (1, 'B')) j(n, name) UNION ALL SELECT uri, 'legal:cites', 'https://example.org/' || lower(court) || '/' || y || '/' || id, 'uri' FROM k UNION ALL SELECT uri, 'legal:citesAtParagraph', '3', 'integer' FROM k)"""


@query(f"{_TRIPLES} SELECT DISTINCT * FROM t", "judgments")
def case_triples(spark, d):
    return L.to_triples(_cases(spark, d))


@query(f"{_TRIPLES} SELECT DISTINCT * FROM t UNION SELECT o, 'legal:citationCount', cast(count(*) AS varchar), 'integer' FROM (SELECT DISTINCT s, o FROM t WHERE p = 'legal:cites') GROUP BY 1", "judgments")
def citation_counts(spark, d):
    return L.citation_counts(L.to_triples(_cases(spark, d)))


@query("WITH t AS (SELECT 'https://example.org/case/' || id AS c FROM judgments WHERE id % 7 = 0) SELECT c AS case, 'Case ' || substring(c, 26) AS name FROM t", "judgments")
def graph_pattern(spark, d):
    return L.sparql(L.to_triples(_cases(spark, d)), 'SELECT ?case ?name WHERE { ?case dct:publisher <https://example.org/court/uksc> . ?case dct:title ?name }')


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, user_id AS key FROM events), p AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS previous, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS next FROM a)
    SELECT seq, key, previous IS NOT NULL AND (SELECT count(*) FROM p q WHERE q.seq > p.previous AND q.seq < p.seq AND (q.next IS NULL OR q.next > p.seq)) < 50 AS hit FROM p"""
)
def lru_hits(spark, d):
    return K.reuse_hits(T.table(spark, d, "events"), 50, key="user_id").select(F.col("seq").cast("long").alias("seq"), "key", "hit")


def _replayed(spark, d):
    log = T.table(spark, d, "events").select(F.col("event_type").alias("cache_id"), F.col("event_id").alias("seq"), F.col("ts"), F.when(F.col("event_id") % 3 == 0, "put").otherwise("get").alias("op"), F.col("user_id").cast("string").alias("key"), F.lit(None).cast("int").alias("ttl_seconds"))
    return K.replay(log, 40)


_REPLAY = """WITH RECURSIVE log AS (SELECT event_type AS cache_id, event_id AS seq, epoch(ts) AS t, event_id % 3 = 0 AS put, cast(user_id AS varchar) AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    r AS (SELECT cache_id, 0::bigint AS i, 0::bigint AS seq, []::STRUCT(k VARCHAR, c DOUBLE)[] AS s, NULL::varchar AS op, NULL::varchar AS key, NULL::boolean AS hit, NULL::varchar AS evicted, false AS expired FROM (SELECT DISTINCT cache_id FROM log)
    UNION ALL SELECT cache_id, i, seq, CASE WHEN put THEN list_append(CASE WHEN len(rest) >= 40 THEN rest[2:] ELSE rest END, {'k': key, 'c': t}) WHEN hit THEN list_append(rest, {'k': key, 'c': c}) ELSE rest END, CASE WHEN put THEN 'put' ELSE 'get' END, key, CASE WHEN put THEN NULL ELSE hit END, CASE WHEN put AND len(rest) >= 40 THEN rest[1].k END, NOT put AND c IS NOT NULL AND NOT hit
    FROM (SELECT *, c IS NOT NULL AND t - c <= 3600 AS hit FROM (SELECT l.*, list_filter(r.s, lambda x: x.k <> l.key) AS rest, list_filter(r.s, lambda x: x.k = l.key)[1].c AS c FROM r JOIN log l ON l.cache_id = r.cache_id AND l.i = r.i + 1)))"""


@query(f"{_REPLAY} SELECT cache_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE op = 'get' AND NOT hit) AS misses, count(evicted) AS evictions, round(count(*) FILTER (WHERE hit) / greatest(1, count(*) FILTER (WHERE op = 'get')), 6) AS rate FROM r WHERE i > 0 GROUP BY 1")
def cache_replay(spark, d):
    return K.statistics(_replayed(spark, d)).select("cache_id", "hits", "misses", "evictions", _r("rate"))


@query(f"{_REPLAY}, last AS (SELECT cache_id, max(i) AS i FROM r GROUP BY 1), held AS (SELECT cache_id, unnest(list_transform(s, lambda x: x.k)) AS key FROM r JOIN last USING (cache_id, i)), p AS (SELECT cache_id, key, max(seq) AS seq FROM r WHERE op = 'put' GROUP BY 1, 2) SELECT h.cache_id, h.key, (SELECT count(*) FROM r WHERE r.cache_id = h.cache_id AND r.key = h.key AND r.hit AND r.seq > p.seq) AS access_count FROM held h JOIN p USING (cache_id, key) ORDER BY access_count DESC, h.cache_id, h.key LIMIT 10")
def cache_ranking(spark, d):
    return K.ranking(_replayed(spark, d))
