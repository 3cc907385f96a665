"""Queries over dictionaries, filtered search, ranking, citation types and caches of the archive; each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import numeric as N
from ..operators import analytics as A
from ..operators import documents as D
from ..operators import relational as R
from ..operators import search as S
from ..operators import sketch as B
from ..operators import tries as I
from ..sources import tables as T
from ..sources.tables import sql
from ..streaming import cache as K
from .text import _CITED, _INDEX, _VECTORS, _bloom, _citations, _index, TERMS

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


# Dictionaries


def _words(spark, d):
    """Words of part names, as often as the part is large, with the brand and type of the part."""
    parts = T.table(spark, d, "part")
    return parts.select(F.col("p_partkey").alias("seq"), F.explode(F.split(F.concat(F.lit(" "), F.initcap("p_name"), F.lit("| "), F.col("p_brand")), r"\|| ")).alias("word"), F.col("p_size").alias("frequency"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("metadata"))


_TRIE = "WITH w AS (SELECT p_partkey AS seq, lower(trim(unnest(string_split(p_name || ' ' || p_brand, ' ')))) AS word, p_size AS f, p_brand, p_type FROM part), t AS (SELECT word, cast(sum(f) AS bigint) AS frequency, arg_max(p_brand, seq) AS brand, arg_max(p_type, seq) AS type FROM w WHERE word <> '' GROUP BY 1)"


def _entries(df):
    return df.select("word", "frequency", F.col("metadata")["brand"].alias("brand"), F.col("metadata")["type"].alias("type"))


@query(f"{_TRIE} SELECT * FROM t")
def trie_insert(spark, d):
    return _entries(I.inserted(_words(spark, d)))


@query(f"{_TRIE} SELECT * FROM t WHERE word = 'widget'")
def trie_search(spark, d):
    return _entries(I.found(I.inserted(_words(spark, d)), " Widget "))


@query(f"{_TRIE} SELECT * FROM t WHERE starts_with(word, 'brand#1') ORDER BY frequency DESC, word LIMIT 5")
def trie_autocomplete(spark, d):
    return _entries(I.completed(I.inserted(_words(spark, d)), "Brand#1", 5))


@query("SELECT '[2023] EWHC' AS word, '[2023] EWHC (High Court)' AS description, 100 AS frequency UNION ALL SELECT '[2023] EWCA', '[2023] EWCA (Court of Appeal)', 100 UNION ALL SELECT '[2023] EWCOP', '[2023] EWCOP (Court of Protection)', 100")
def citation_templates(spark, d):
    return I.templates(spark, " [2023] ew")


@query(f"{_CITED} SELECT id, '[' || y || '] ' || court || ' ' || id AS citation FROM x WHERE starts_with('[' || y || '] ' || court || ' ' || id, '[1997] UKSC 1')", "judgments")
def citation_prefix(spark, d):
    return I.with_prefix(_citations(spark, d).select("id", C.normal_for_format("citation").alias("citation")), "citation", "[1997] UKSC 1")


# Filtered search with facets and pages


def _dated(spark, d):
    """Documents with a date, and with how often they are cited."""
    return T.corpus(spark, d).withColumns({"date": F.make_date((F.lit(1990) + F.col("doc_id") % 30).cast("int"), F.lit(1), F.lit(1)), "cited": (F.col("doc_id") * 7 % 100).cast("int")})


FIELDS = {"case_name": 3.0, "text": 1.0}
SOUGHT = ["anea", "src7"]


def _field(name: str) -> str:
    """CTEs of the BM25 scores of one field."""
    words = f"list_filter(string_split(trim(regexp_replace(lower({name}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"
    p = name[0]
    return (
        f"{p}w AS (SELECT doc_id, unnest({words}) AS term FROM dated), {p}tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}w WHERE term IN ('anea', 'src7') GROUP BY 1, 2), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),"
        f"{p}len AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower({name}), '\\s+'), lambda w: w <> '')) AS length FROM dated), {p}n AS (SELECT count(*) AS n, avg(length) AS average FROM {p}len),"
        f"{p}s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS score FROM {p}tf JOIN {p}df USING (term) JOIN {p}len USING (doc_id), {p}n GROUP BY 1)"
    )


_MATCHED = f"WITH dated AS (SELECT doc_id, text, court, case_name, make_date(cast(1990 + doc_id % 30 AS integer), 1, 1) AS date FROM corpus), {_field('case_name')}, {_field('text')}, b AS (SELECT doc_id, max(score) AS score FROM (SELECT doc_id, 3 * score AS score FROM cs UNION ALL SELECT * FROM ts) GROUP BY 1), m AS (SELECT dated.*, score FROM dated JOIN b USING (doc_id) WHERE court IN ('en', 'fr') AND date >= date '1995-01-01' AND date <= date '2015-12-31')"
_AROUND = "substring(text, cast(greatest(1, strpos(lower(text), 'anea') - 50) AS integer), cast(strpos(lower(text), 'anea') + 200 - greatest(1, strpos(lower(text), 'anea') - 50) AS integer))"


def _matches(spark, d):
    return S.matched(_dated(spark, d), SOUGHT, FIELDS, courts=["en", "fr"], since="1995-01-01", until="2015-12-31")


@query(f"{_MATCHED} SELECT doc_id, round(score, 6) AS score FROM m", "corpus")
def search_filtered(spark, d):
    return _matches(spark, d).select("doc_id", _r("score"))


@query(f"{_MATCHED} SELECT 'court' AS facet, court AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'year', cast(year(date) AS varchar), count(*) FROM m GROUP BY 2", "corpus")
def search_facets(spark, d):
    return S.facets(_matches(spark, d))


@query(f"{_MATCHED} SELECT doc_id, round(score, 6) AS score, regexp_replace(trim(CASE WHEN strpos(lower(text), 'anea') > 0 THEN {_AROUND} WHEN strpos(lower(text), 'src7') > 0 THEN {_AROUND.replace('anea', 'src7')} ELSE substring(text, 1, 200) END), '(?i)(anea)', '<em>\\1</em>', 'g') AS highlight FROM m ORDER BY m.score DESC, doc_id LIMIT 10 OFFSET 5", "corpus")
def search_page(spark, d):
    return S.page(_matches(spark, d), SOUGHT, size=10, start=5).select("doc_id", _r("score"), "highlight")


# Ranking


@query(
    """WITH x AS (SELECT doc_id, court, case_name, text, (doc_id % 10) / 10.0 AS relevance FROM corpus), w AS (SELECT doc_id, relevance, lower(case_name) AS name, court, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM x WHERE relevance >= 0.5),
    r AS (SELECT doc_id, relevance, 1.0 * (name IN ('anea', 'src7'))::int + 0.4 * (court IN ('anea', 'src7'))::int + 0.1 * (list_contains(words, 'anea')::int + list_contains(words, 'src7')::int) AS rank FROM w)
    SELECT doc_id, cast(round(rank, 6) AS double) AS rank, cast(relevance AS double) AS relevance FROM r WHERE rank > 0 ORDER BY r.rank DESC, r.relevance DESC, doc_id LIMIT 20""",
    "corpus",
)
def field_rank(spark, d):
    docs = T.corpus(spark, d).withColumn("relevance", (F.col("doc_id") % 10) / 10)
    found = S.field_rank(docs, SOUGHT, {"case_name": 1.0, "court": 0.4, "text": 0.1}).withColumn("rank", F.round("rank", 6))
    return found.orderBy(F.col("rank").desc(), F.col("relevance").desc(), "doc_id").limit(20)


_BOOST = "CASE court WHEN 'en' THEN 1.5 WHEN 'fr' THEN 1.3 WHEN 'de' THEN 1.2 ELSE 1.0 END"


@query(
    _INDEX.replace("('the'", "('the'").replace("term NOT IN (", "term NOT IN ('this', 'that', 'these', 'those', ")
    + f""", total AS (SELECT count(*) + 1.0 AS n FROM tokens), idf AS (SELECT term, ln((1 + total.n) / (1.0 + df + (term IN ('anea', 'erin'))::int)) + 1 AS idf, (term IN ('anea', 'erin'))::int AS q FROM df, total),
    own AS (SELECT sqrt(sum(idf * idf)) AS norm FROM idf WHERE q = 1), s AS (SELECT doc_id, sum(tf * idf * idf * q) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY 1)
    SELECT doc_id, round(dot / s.norm / own.norm * {_BOOST} * (1 + 0.2 * exp(-(date '2020-01-01' - make_date(cast(1990 + doc_id % 30 AS integer), 1, 1)) / 365.0)) * (1 + 0.1 * ln(1 + doc_id * 7 % 100)), 6) AS score FROM s JOIN (SELECT doc_id, court FROM tokens) USING (doc_id), own WHERE dot > 0""",
    "tokens",
)
def search_relevance(spark, d):
    boost = F.when(F.col("court") == "en", 1.5).when(F.col("court") == "fr", 1.3).when(F.col("court") == "de", 1.2).otherwise(1.0)
    return S.relevance(_dated(spark, d), ["anea", "erin"], boost, F.lit("2020-01-01").cast("date")).select("doc_id", _r("score"))


_BM25 = f"{_INDEX}, bm AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS bm25 FROM tf JOIN df USING (term) JOIN len USING (doc_id), n WHERE term IN ('anea', 'erin', 'ther') GROUP BY 1), f AS (SELECT doc_id, bm25, 1 + 0.1 * ln(1 + doc_id * 7 % 100) AS authority, exp(-ln(2) / 365 * (date '2020-01-01' - make_date(cast(1990 + doc_id % 30 AS integer), 1, 1))) AS temporal, doc_id % 20 = 7 AS named FROM bm)"


def _factors(spark, d):
    """Text score, authority and age of the documents that hold a term."""
    docs = _dated(spark, d)
    return S.bm25(_index(spark, d), TERMS).select("doc_id", F.col("score").alias("bm25")).join(docs.select("doc_id", N.authority(F.lit(""), "cited").alias("authority"), N.half_life("date", F.lit("2020-01-01").cast("date")).alias("temporal"), (F.col("doc_id") % 20 == 7).alias("named")), "doc_id")


@query(f"{_BM25} SELECT doc_id, round(bm25, 6) AS bm25, round(authority, 6) AS authority, round(temporal, 6) AS temporal, round((0.5 * bm25 + 0.3 * authority + 0.2 * temporal) * CASE WHEN named THEN 1.3 ELSE 1 END, 6) AS score FROM f ORDER BY (0.5 * f.bm25 + 0.3 * f.authority + 0.2 * f.temporal) * CASE WHEN named THEN 1.3 ELSE 1 END DESC, doc_id LIMIT 20", "tokens")
def composite_rank(spark, d):
    scored = _factors(spark, d).withColumn("score", S.composite(F.col("bm25"), F.col("authority"), F.col("temporal"), F.col("named")))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", *[_r(c) for c in ("bm25", "authority", "temporal", "score")])


@query(f"{_BM25} SELECT doc_id, round((0.4 * bm25 + 0.3 * authority + 0.2 * temporal) / 0.9, 6) AS score FROM f ORDER BY (0.4 * f.bm25 + 0.3 * f.authority + 0.2 * f.temporal) / 0.9 DESC, doc_id LIMIT 20", "tokens")
def multi_criteria_rank(spark, d):
    """Without a document of reference the fourth criterion is left out and the weights of the others add up to 1."""
    return S.combined(_factors(spark, d), {"bm25": 0.4, "authority": 0.3, "temporal": 0.2}).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", _r("score"))


@query("SELECT id, cast(round(0.4 * (court_level / 5.0 * CASE WHEN court_level < 3 THEN 0.5 ELSE 1 END) + 0.3 * relevance_score + 0.2 * exp(-ln(2) / 365 * greatest(0, date '2001-08-01' - judgment_date)) + 0.1 * least(1, ln(1 + word_count) / ln(100)), 6) AS double) AS strength FROM judgments", "judgments")
def precedent_strength(spark, d):
    as_of = F.lit("2001-08-01").cast("date")
    strength = S.precedent_strength(F.col("court_level"), F.lit(3), F.col("relevance_score"), N.half_life("judgment_date", as_of), F.col("word_count"))
    return T.judgments(spark, d).select("id", F.round(strength, 6).alias("strength"))


@query("SELECT id, round(CASE WHEN id % 3 = 0 THEN 2.0 WHEN id % 3 = 1 THEN 1.4 ELSE 1.0 END * (1 + 0.1 * ln(1 + word_count)), 6) AS authority FROM judgments", "judgments")
def authority_scores(spark, d):
    court = F.element_at(F.array(F.lit("UKSC"), F.lit("EWHC"), F.lit("XXXX")), (F.col("id") % 3 + 1).cast("int"))
    return T.judgments(spark, d).select("id", F.round(N.authority(court, "word_count"), 6).alias("authority"))


_ITEMS = _VECTORS.replace("doc_id", "item_id")


@query(
    """WITH tokens AS (SELECT item_id, '' AS court, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '') AS words, text FROM benchmark), """
    + _ITEMS[5:]
    + " SELECT a.item_id AS a, b.item_id AS b, round(sum(a.weight * b.weight), 6) AS similarity FROM v a JOIN v b ON a.term = b.term AND a.item_id < b.item_id GROUP BY 1, 2"
)
def pairwise_similarity(spark, d):
    items = T.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return S.pairwise(S.vectors(items)).select("a", "b", _r("similarity"))


# Citation types and filters


def _typed(spark, d):
    """Citations of all types, with their year."""
    x = _citations(spark, d).join(T.judgments(spark, d).select("id", F.year("judgment_date").cast("long").alias("year")), "id")
    return x.withColumn("citation", F.when(F.col("id") % 4 == 1, F.concat(F.lit("Case C-"), F.col("id").cast("string"))).when(F.col("id") % 4 == 2, F.lit("(1998) 2 AC 500")).otherwise(F.col("citation")))


@query("SELECT CASE WHEN id % 4 = 1 THEN 'eu_case' WHEN id % 4 = 2 THEN 'law_report' ELSE 'neutral' END AS type, cast(year(judgment_date) AS bigint) AS year, count(*) AS n FROM judgments GROUP BY 1, 2", "judgments")
def citation_types_by_year(spark, d):
    return A.trends(_typed(spark, d), C.citation_class("citation").alias("type"), F.col("year"))


@query("SELECT CASE WHEN id % 4 = 1 THEN 'eu_case' WHEN id % 4 = 2 THEN 'law_report' ELSE 'neutral' END AS value, count(*) AS n FROM judgments GROUP BY 1", "judgments")
def citation_types(spark, d):
    return A.value_counts(_typed(spark, d).select(C.citation_class("citation").alias("type")), "type")


_BITS, _HASHES = N.bloom_size(20_000, 0.01)
_NORMAL = f"{_CITED}, c AS (SELECT id, '[' || y || '] ' || court || ' ' || id AS c, court FROM x), b AS (SELECT DISTINCT unnest({{}}) AS bit FROM c WHERE id % 2 = 0), p AS (SELECT c, court, unnest({{}}) AS bit FROM c), h AS (SELECT c, court, count(*) = count(b.bit) AS maybe FROM p LEFT JOIN b USING (bit) GROUP BY 1, 2)"
_NORMAL = _NORMAL.format(*[_bloom("c").replace(f"% {N.bloom_size(2000, 0.01)[0]}", f"% {_BITS}").replace(f"range({N.bloom_size(2000, 0.01)[1]})", f"range({_HASHES})")] * 2)
_LABELS = "CASE court WHEN 'UKSC' THEN 'Supreme Court' WHEN 'UKHL' THEN 'House of Lords' WHEN 'EWCA' THEN 'Court of Appeal' WHEN 'EWHC' THEN 'High Court' WHEN 'UKUT' THEN 'Upper Tribunal' WHEN 'EWCOP' THEN 'Court of Protection' ELSE 'Other' END"


def _held(spark, d):
    return B.citation_filter(_citations(spark, d).filter("id % 2 = 0"), "citation", _BITS, _HASHES)


@query(f"{_NORMAL} SELECT c, maybe FROM h", "judgments")
def citation_membership(spark, d):
    normal = _citations(spark, d).select(C.normal_for_membership("citation").alias("c"))
    return B.probed(normal, "c", _held(spark, d), _BITS, _HASHES)


@query(f"{_NORMAL} SELECT {_LABELS} AS court, count(*) AS n FROM h WHERE maybe GROUP BY 1", "judgments")
def court_coverage(spark, d):
    return B.citation_coverage(_citations(spark, d), "citation", _held(spark, d), _BITS, _HASHES)


# Metrics


@query(
    """WITH e AS (SELECT src, dst FROM edges), made AS (SELECT src AS id, count(*) AS m FROM e GROUP BY 1), got AS (SELECT dst AS id, count(*) AS g FROM e GROUP BY 1)
    SELECT court, cast(sum(coalesce(m, 0)) AS bigint) AS made, cast(sum(coalesce(g, 0)) AS bigint) AS received FROM judgments LEFT JOIN made USING (id) LEFT JOIN got USING (id) GROUP BY 1""",
    "judgments", "edges",
)
def court_citations(spark, d):
    return A.court_citations(T.judgments(spark, d), T.edges(spark, d))


@query("SELECT court AS key, count(*) AS n, round(avg(word_count), 6) AS avg_words, min(judgment_date) AS earliest, max(judgment_date) AS latest, (SELECT count(DISTINCT judge_id) FROM judgment_judges JOIN judgments j ON judgment_id = j.id WHERE j.court = judgments.court) AS judges, (SELECT count(DISTINCT area) FROM judgment_areas JOIN judgments j ON judgment_id = j.id WHERE j.court = judgments.court) AS areas FROM judgments GROUP BY court", "judgments", "judgment_judges", "judgment_areas")
def group_details(spark, d):
    return A.group_details(T.judgments(spark, d), "court", T.judgment_judges(spark, d), T.judgment_areas(spark, d)).select("key", "n", _r("avg_words"), "earliest", "latest", "judges", "areas")


@query("SELECT judge_id, count(*) AS n, round(avg(size), 6) AS mean_panel FROM judgment_judges JOIN (SELECT judgment_id, count(*) AS size FROM judgment_judges GROUP BY 1) USING (judgment_id) GROUP BY 1", "judgment_judges")
def judge_panels(spark, d):
    return A.judge_panels(T.judgment_judges(spark, d)).select("judge_id", "n", _r("mean_panel"))


@query("SELECT l_suppkey AS id FROM lineitem WHERE false UNION ALL SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '00001') OR contains(lower(n_name), 'an') OR contains(lower(cast(s_suppkey AS varchar)), '77')")
def text_criterion(spark, d):
    s, n = T.table(spark, d, "supplier"), T.table(spark, d, "nation")
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    return joined.filter(R.holds({"s_name": "00001", "n_name": "AN", "s_suppkey": "77"})).select(F.col("s_suppkey").alias("id"))


@query("SELECT event_type AS key, bit_xor(event_id) AS folded FROM events GROUP BY 1")
def custom_aggregate(spark, d):
    return A.monoid(T.table(spark, d, "events"), "event_type", F.col("event_id"), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)).withColumnRenamed("event_type", "key")


@query("SELECT l_orderkey AS key, string_agg(cast(cast(l_quantity AS bigint) AS varchar), ',' ORDER BY l_linenumber, l_quantity) AS measures FROM lineitem GROUP BY 1")
def measures_by_key(spark, d):
    lines = T.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")).alias("m"))
    return A.measures(lines, "l_orderkey", "m").select(F.col("l_orderkey").alias("key"), F.array_join(F.transform("measures", lambda m: m["q"].cast("string")), ",").alias("measures"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN timestamp '2023-01-01' ELSE date_trunc('second', ts) END AS ts FROM events")
def default_dates(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("no date")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return T.table(spark, d, "events").select("event_id", A.date_or_default(text).cast("timestamp_ntz").alias("ts"))


# Caches


@query(f"{_CITED} SELECT id, cast(CASE WHEN id % 2 = 0 THEN 3600 ELSE 3600 + 600 * CASE court WHEN 'UKSC' THEN 10 WHEN 'UKHL' THEN 9 WHEN 'EWCA' THEN 8 WHEN 'EWHC' THEN 7 WHEN 'UKUT' THEN 6 WHEN 'UKFTT' THEN 5 ELSE 1 END END AS bigint) AS ttl FROM x", "judgments")
def cache_ttls(spark, d):
    return _citations(spark, d).select("id", C.cache_ttl(F.when(F.col("id") % 2 == 1, C.court_of("citation"))).cast("long").alias("ttl"))


@query("WITH best AS (SELECT user_id AS key FROM events GROUP BY 1 ORDER BY count(*) DESC, key LIMIT 10) SELECT event_id, CASE WHEN best.key IS NOT NULL AND event_type = 'view' THEN 'cache' ELSE 'made' END AS source, CASE WHEN best.key IS NOT NULL AND event_type = 'view' THEN 'stored ' ELSE 'made ' END || user_id AS content FROM events LEFT JOIN best ON best.key = user_id")
def read_through(spark, d):
    requests = T.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("format"))
    contents = requests.select("key").distinct().select("key", F.lit("view").alias("format"), F.concat(F.lit("stored "), F.col("key").cast("string")).alias("content"))
    return K.read_through(requests, K.warmed(requests, contents, 10), F.concat(F.lit("made "), F.col("key").cast("string"))).select("event_id", "source", "content")


# XML documents


def _documents(spark, d):
    """Judgments as XML documents, each with as many paragraphs as its court's level; one in eleven is not well-formed."""
    j = T.judgments(spark, d)
    paragraphs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("court_level")), lambda i: F.concat(F.lit('<paragraph id="p'), i.cast("string"), F.lit('"><p>Paragraph '), i.cast("string"), F.lit(" of [1998] UKSC 4</p></paragraph>"))), "")
    xml = F.concat(F.lit("<judgment><meta><FRBRWork><FRBRuri>/case/"), F.col("id").cast("string"), F.lit("</FRBRuri><FRBRdate>"), F.col("judgment_date").cast("string"), F.lit("</FRBRdate></FRBRWork><judge>Judge A</judge><judge>Judge B</judge></meta><body>"), paragraphs, F.lit("</body>"), F.when(F.col("id") % 11 == 0, "").otherwise("</judgment>"))
    return j.select(F.col("id").alias("doc_id"), "court_level", xml.alias("xml"))


@query("SELECT id AS doc_id, id % 11 <> 0 AS parse_successful, '/case/' || id AS uri, cast(judgment_date AS varchar) AS date, 'Judge A,Judge B' AS judges, cast(court_level AS bigint) AS paragraphs, 'p' || court_level AS last FROM judgments", "judgments")
def xml_streamed(spark, d):
    found = D.streamed(_documents(spark, d))
    return found.select("doc_id", "parse_successful", "uri", "date", F.array_join("judges", ",").alias("judges"), F.size("paragraphs").cast("long").alias("paragraphs"), F.element_at("paragraphs", -1)["id"].alias("last"))


_TREE = "WITH j AS (SELECT id, court_level AS n, judgment_date AS day FROM judgments WHERE id % 11 <> 0), p AS (SELECT id, unnest(range(1, n + 1)) AS i FROM j)"


@query(
    f"""{_TREE} SELECT id AS doc_id, path, tag, cast(depth AS bigint) AS depth FROM (SELECT id, unnest([{{'path': '0001', 'tag': 'judgment', 'depth': 0}}, {{'path': '0001.0001', 'tag': 'meta', 'depth': 1}}, {{'path': '0001.0001.0001', 'tag': 'FRBRWork', 'depth': 2}}, {{'path': '0001.0001.0001.0001', 'tag': 'FRBRuri', 'depth': 3}},
    {{'path': '0001.0001.0001.0002', 'tag': 'FRBRdate', 'depth': 3}}, {{'path': '0001.0001.0002', 'tag': 'judge', 'depth': 2}}, {{'path': '0001.0001.0003', 'tag': 'judge', 'depth': 2}}, {{'path': '0001.0002', 'tag': 'body', 'depth': 1}}], recursive := true) FROM j)
    UNION ALL SELECT id, printf('0001.0002.%04d', i), 'paragraph', 2 FROM p UNION ALL SELECT id, printf('0001.0002.%04d.0001', i), 'p', 3 FROM p""",
    "judgments",
)
def xml_tree(spark, d):
    return D.xml_nodes(_documents(spark, d)).select("doc_id", "path", "tag", F.col("depth").cast("long").alias("depth"))


@query(f"{_TREE} SELECT id AS doc_id, printf('0001.0002.%04d', i) AS path, 'Paragraph ' || i || ' of [1998] UKSC 4' AS text FROM p", "judgments")
def xml_nodes_by_type(spark, d):
    return D.of_type(D.xml_nodes(_documents(spark, d)), "paragraph").select("doc_id", "path", "text")


@query("SELECT id AS doc_id, CASE WHEN id % 11 = 0 THEN 'not well-formed' END AS error, CASE WHEN id % 11 = 0 THEN 0 ELSE 1 END::bigint AS bodies, CASE WHEN id % 11 = 0 THEN 0 ELSE court_level END::bigint AS paragraphs, CASE WHEN id % 11 <> 0 THEN court_level || ' paragraphs' END AS content FROM judgments", "judgments")
def xml_record(spark, d):
    """The parts of one record: header, sections and their paragraphs."""
    record = D.record(_documents(spark, d)).withColumn("body", F.filter("sections", lambda s: s["type"] == "body"))
    return record.select("doc_id", "header.error", F.size("body").cast("long").alias("bodies"), F.coalesce(F.size(F.get("body", 0)["paragraphs"]), F.lit(0)).cast("long").alias("paragraphs"), F.get("body", 0)["content"].alias("content"))


@query("SELECT id AS doc_id, '' AS errors, '[1998] UKSC 4' AS citations FROM judgments WHERE id % 11 <> 0", "judgments")
def xml_checked(spark, d):
    docs = _documents(spark, d).filter("doc_id % 11 <> 0")
    return docs.select("doc_id", F.array_join(D.structure_errors("xml"), ",").alias("errors"), F.array_join(D.document_citations("xml"), ",").alias("citations"))
