"""Operators on small literals: facts that can be derived by hand, and models in plain Python."""

import datetime
import math
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lexarium.functions import citations as C
from lexarium.functions import numeric as N
from lexarium.functions import text as X
from lexarium.operators import analytics as A
from lexarium.operators import documents as D
from lexarium.operators import extract as E
from lexarium.operators import graph as G
from lexarium.operators import linked as L
from lexarium.operators import nlp as P
from lexarium.operators import relational as R
from lexarium.operators import search as S
from lexarium.operators import sketch as B
from lexarium.sources import tables as T
from lexarium.streaming import cache as K


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_where_applies_all_operators(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert [r.x for r in R.where(df, {"x": {"gte": 3, "lte": 5}}).collect()] == [3, 4, 5]
    assert R.or_where(df, {}).count() == 10
    assert R.projected(df, "x", "nothing").first().nothing is None


def test_empty_attribute_lists_match_nothing(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, t array<string>")
    assert df.filter(R.any_of("t", [])).count() == 0
    assert df.filter(R.all_of("t", [])).count() == 0
    assert [r.i for r in df.filter(~R.any_of("t", ["b"])).collect()] == [1, 2]
    assert df.filter(R.folded([])).count() == 0


def test_undated_rows_need_open_bounds(spark):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 1)), (2, None)], "i int, d date")
    assert df.filter(R.years("d", None, None)).count() == 2
    assert df.filter(R.years("d", 2000, None)).count() == 1


def test_page_totals(spark):
    rows, totals = R.page(spark.range(23), 3, 10, "-id")
    assert [r.id for r in rows.collect()] == [2, 1, 0]
    assert totals == {"total": 23, "pages": 3, "has_next": False, "has_previous": True}


def test_appended_and_report(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string")
    assert sorted(map(tuple, T.appended(a, b).collect()), key=str) == [(1, None), (2, "y")]
    assert "&lt;b&gt;" in T.html_report("<b>", {"n": 1}, a)
    assert T.rows(spark, [{"case_name": "A"}], T.CASES).first().court is None


def test_citation_labels(spark):
    found = one(spark, a=C.court_label(F.lit("[2023] ewca Civ 1")), b=C.court_label(F.lit("")), c=C.court_of(F.lit("[2023] EWCA Civ 892")), d=C.court_code(F.lit("x ukut y")), e=C.cache_ttl(F.lit("UKSC")), f=C.normal_for_membership(F.lit("no digits")), g=C.normal_for_format(F.lit("  [2023 ]UKSC   15 ")))
    assert tuple(found) == ("Court of Appeal", "Unknown", "EWCA", "UKUT", 9600, None, "[2023] UKSC 15")


@pytest.mark.parametrize(
    ("citation", "valid", "normal", "errors"),
    [
        ("[2023] UKSC 15", True, "[2023] UKSC 15", 0),
        ("[2022] EWCA Civ 234", False, "[2022] EWCA Civ 234", 1),
        ("[1932] 1 AC 562", True, "[1932] 1 AC 562", 0),
        ("[2023] uksc 1 (Admin)", False, "[2023] uksc 1 (Admin)", 1),
        ("[1950] UKHL 3", False, "[1950] UKHL 3", 1),
        ("nonsense", False, "nonsense", 1),
    ],
)
def test_validation(spark, citation, valid, normal, errors):
    v = one(spark, v=C.validated(F.lit(citation))).v
    assert (v.valid, v.normalized, len(v.errors)) == (valid, normal, errors)


def test_extraction(spark):
    text = "See [2023] UKSC 15 and [1998] 2 AC 500; Case C-127/08 Metock. R v Smith, section 6 of the Human Rights Act 1998, Lord Reed."
    found = spark.createDataFrame([(text,)], "text string").select(E.citations("text").alias("c"), E.case_names("text").alias("n"), E.statutes("text").alias("s"), E.judges("text").alias("j")).first()
    assert [(x.kind, x.year) for x in found.c] == [("neutral", 2023), ("law_report", 1998), ("european", 2008)]
    assert all(text[x.start : x.end] == x.text for x in found.c)
    assert found.s[0].section == "6" and found.j and found.n
    assert spark.createDataFrame([("a" * 500,)], "t string").select(E.gzip_sizes("t")).first()[0] < 100


def test_tokens_keep_accents(spark):
    found = one(spark, t=X.tokens(F.lit("Le Café, l'été")), i=X.index_terms(F.lit("the café is in a house")), s=X.sentences(F.lit("One. Two! three? Four.")), e=X.tokens(F.lit("")))
    assert found.t == ["le", "café", "l", "été"] and found.i == ["café", "house"] and found.s == ["One.", "Two! three?", "Four."] and found.e == []
    assert X.query_hash(" A ", {"b": 1}) == X.query_hash("a", {"b": 1})


def test_vectors_and_decay(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    found = one(spark, z=N.cosine(a, b), s=N.cosine(a, a), e=N.euclidean(a, F.array(F.lit(1.0))), d=N.decay(F.lit("2020-01-01").cast("date"), F.lit("2020-01-01").cast("date"), "linear"))
    assert found.z == 0 and found.s == 1 and found.e == float("inf") and found.d == 1
    assert N.bloom_size(1000, 0.01) == (9585, 6)


def docs(spark):
    return spark.createDataFrame([(1, "constitutional law and principles of law", "UKSC", "a"), (2, "contract law", "EWHC", "b"), (3, "", "X", "c")], "doc_id int, text string, court string, case_name string")


def test_search(spark):
    assert [r.doc_id for r in S.phrase(docs(spark), ["constitutional", "law"]).collect()] == [1]
    assert S.phrase(docs(spark), ["principles", "of", "law"]).count() == 0  # a stop word leaves a gap
    assert S.phrase(docs(spark), ["law", "law"]).count() == 0
    assert [r.doc_id for r in S.boolean_text(docs(spark), "law NOT contract").collect()] == [1]
    assert S.bm25(docs(spark), ["law"]).filter("score < 0").count() == 2  # in over half of the documents
    assert S.search(docs(spark), ["contract"]).first().doc_id == 2
    assert S.multi_field(docs(spark), ["contract"], {"text": 1.0, "case_name": 3.0}).count() == 1


EDGES = [("a", "b"), ("b", "d"), ("a", "d"), ("c", "d"), ("e", "d")]


def graph(spark):
    ids = {x: i for i, x in enumerate("abcde")}
    return spark.createDataFrame([(ids[a], ids[b]) for a, b in EDGES], "src long, dst long")


def test_graph(spark):
    g = graph(spark)
    assert [tuple(r) for r in G.most_cited(g).collect()] == [(3, 4), (1, 1)]
    assert G.shortest_path(g, 0, 3) == [0, 3]
    assert G.shortest_path(g, 3, 0) is None
    assert {(r.id, r.hop) for r in G.neighbourhood(g, [0], 2).collect()} == {(0, 0), (1, 1), (3, 1)}
    ranks = G.pagerank(g, spark.range(5), iterations=20).collect()
    assert abs(sum(r.rank for r in ranks) - 1) < 1e-9
    assert max(ranks, key=lambda r: r.rank).id == 3
    assert G.known(g, spark.range(1)).count() == 2
    assert G.clustering(g).first().clustering == 1.0
    assert max(G.hits(g, 10).collect(), key=lambda r: r.authority).id == 3


def test_bloom(spark):
    items = spark.createDataFrame([(f"item{i}",) for i in range(200)] + [(None,)], "x string")
    bits, hashes = N.bloom_size(200, 0.01)
    a = B.built(items, "x", bits, hashes)
    assert B.probed(items, "x", a, bits, hashes).filter("NOT maybe").count() == 0  # no false negatives
    other = spark.createDataFrame([(f"other{i}",) for i in range(500)], "x string")
    assert B.probed(other, "x", a, bits, hashes).filter("maybe").count() < 25
    b = B.built(other, "x", bits, hashes)
    assert B.union(a, b).subtract(B.union(b, a)).count() == 0
    assert B.intersection_estimate(a, b, (200, 200), (200, 500), bits).first().estimate > 0
    assert B.statistics(1000, 0.01, 0)["rate"] == 0


def test_ranges(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 6)], "i int, v int")
    updated = A.range_updated(df, spark.createDataFrame([(2, 4, 10)], "lo int, hi int, delta int"), "i", "v")
    assert updated.filter("i BETWEEN 2 AND 4").agg(F.sum("v")).first()[0] == 39
    assert A.score_histogram(df.select((F.col("v") / 5).alias("relevance_score"))).count() == 10
    assert A.timeline(spark.createDataFrame([], "judgment_date date, word_count int"), 3).count() == 0


def test_documents(spark):
    text = '<akomaNtoso><judgment><meta><FRBRWork><FRBRuri value="/u">x</FRBRuri><FRBRdate date="2020-02-03"/></FRBRWork></meta><preface><court>C</court> Lord Reed</preface><body><paragraph id="p1">one two</paragraph><paragraph/></body></judgment></akomaNtoso>'
    df = spark.createDataFrame([(1, text), (2, "<bad"), (3, None)], "doc_id int, xml string")
    m = {r.doc_id: r.m for r in df.select("doc_id", D.metadata("xml").alias("m")).collect()}
    assert m[1].court == "C" and m[1].date == "2020-02-03" and m[1].judges == ["Lord Reed"] and m[1].uri == "/u" and m[2].error and m[3].error
    s = {r.doc_id: r.s for r in df.select("doc_id", D.sections("xml").alias("s")).collect()}
    assert s[1][1].content == "2 paragraphs" and s[1][1].paragraphs[0].word_count == 2 and s[2] == []
    nodes = D.xml_nodes(df).collect()
    assert nodes[0].tag == "akomaNtoso" and {r.doc_id for r in nodes} == {1}
    events = {r.doc_id: r for r in D.streamed(df).collect()}
    assert events[1].parse_successful and len(events[1].paragraphs) == 2 and not events[2].parse_successful
    assert df.filter("doc_id = 1").select(D.structure_errors("xml")).first()[0] == []
    tree = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0)], "node_id int, parent_id int, position int")
    assert [r.node_id for r in D.preorder(tree).orderBy("path").collect()] == [1, 3, 4, 2]
    assert one(spark, x=D.document_citations(F.lit("[2020] UKSC 1 and [2020] UKSC 1, 1999 SLT 5"))).x == ["1999 SLT 5", "[2020] UKSC 1"]


def test_rounds_shuffle_blocks_of_vertices_not_edges(spark, monkeypatch):
    monkeypatch.setattr(G.Adjacency, "NARROWEST", 2)
    monkeypatch.setattr(G.Adjacency, "BLOCKS", 4)
    monkeypatch.setattr(G.Adjacency, "CELL", 16)
    r = random.Random(5)
    ids = [7 * i - 50 for i in range(23)]
    pairs = [(r.choice(ids), r.choice([*ids[:15], 999])) for _ in range(150)] + [(ids[0], ids[1])] * 3 + [(-999, ids[2])]
    edges, vertices = spark.createDataFrame(pairs, "src long, dst long").repartition(3), spark.createDataFrame([(i,) for i in ids], "id long")
    graph = G.Adjacency(edges, vertices)
    assert graph.vertices.count() == 3 and graph.n == 23
    x = dict(zip(ids, range(1, 24), strict=True))
    vector = graph.vertices.select("block", F.transform("ids", lambda i: ((i + 50) / 7 + 1).cast("double")).alias("values"))
    for back in (False, True):
        product = graph.product(vector, back)
        assert "src" not in product._jdf.queryExecution().executedPlan().toString()
        found = {i: v for row in product.join(graph.vertices, "block").collect() for i, v in zip(row.ids, row["values"])}
        for i in ids:
            assert found.get(i, 0.0) == sum(x[d if back else s] for s, d in pairs if (s if back else d) == i and s in x and d in x)
    out, rank = {i: sum(s == i for s, _ in pairs) for i in ids}, dict.fromkeys(ids, 1 / 23)
    for _ in range(2):
        lost = sum(v for i, v in rank.items() if not out[i])
        rank = {i: 0.15 / 23 + 0.85 * (sum(rank[s] / out[s] for s, d in pairs if d == i and s in rank) + lost / 23) for i in ids}
    assert {q.id: round(q["rank"], 12) for q in G.pagerank(edges, vertices, iterations=2).collect()} == {i: round(v, 12) for i, v in rank.items()}


def test_index_is_built_without_a_shuffle_of_words(spark, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 3)
    monkeypatch.setattr(S, "WORDS", 5)
    rows = [(1, "Café the cat, the CAT sat on a mat"), (2, None), (3, ""), (4, "a an the"), (5, "mat " * 9 + "cat"), (6, "été mat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda df: sorted((r.term, r.doc_id, r.tf, list(r.positions)) for r in df.collect())
    want = plain(S.postings(docs))
    assert plain(S.Index(docs).postings) == want and ("cat", 1, 2, [2, 4]) in want
    assert "Exchange" not in S.row_postings(docs)._jdf.queryExecution().executedPlan().toString()
    twice = docs.union(docs.filter("doc_id = 1"))
    assert plain(S.Index(twice).postings) == plain(S.postings(twice)) and ("cat", 1, 4, [2, 2, 4, 4]) in plain(S.Index(twice).postings)


def test_similar_documents_that_tie_come_by_id(spark):
    text = " ".join(f"word{i} " * (i % 5 + 1) for i in range(40))
    docs = spark.createDataFrame([(100, text), (101, "other words here"), *[(i, " ".join([text] * ((7 * i) % 13 + 1))) for i in range(1, 25)]], "doc_id long, text string").repartition(4)
    for found in (S.similar_to(docs, 100), S.similar(S.vectors(docs), 100)):
        assert [(r.doc_id, round(r.similarity, 9)) for r in found.collect()] == [(i, 1.0) for i in range(1, 6)]


def test_relevance_shuffles_words_of_documents_that_hold_a_term_only(spark):
    rows = [(1, "breach of this contract contract"), (2, "no such term"), (3, "contract law of the land"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"date": F.lit(None).cast("date"), "cited": F.lit(0)})
    score = lambda d: {r.doc_id: round(r.score, 12) for r in S.relevance(d, ["contract", "breach"], F.lit(1.0), F.current_date()).collect()}
    found = score(docs)
    idf = {"contract": math.log(6 / 4) + 1, "breach": math.log(6 / 3) + 1, "law": math.log(6 / 2) + 1, "land": math.log(6 / 2) + 1}
    own = math.hypot(idf["contract"], idf["breach"])
    want = {1: (idf["breach"] ** 2 + 2 * idf["contract"] ** 2) / math.hypot(idf["breach"], 2 * idf["contract"]) / own, 3: idf["contract"] ** 2 / math.hypot(idf["contract"], idf["law"], idf["land"]) / own}
    assert found == {k: round(v, 12) for k, v in want.items()}
    assert "MapInArrow" in S.relevance(docs, ["contract"], F.lit(1.0), F.current_date())._jdf.queryExecution().executedPlan().toString()


def test_node_tables_are_whole(spark):
    long = "word " * 40
    text = f'<doc xmlns="u"><judgment>a{"".join(f"<paragraph id=\'p{i}\'>{i}<p>{long}</p> t</paragraph>" for i in range(60))}<!-- c -->b</judgment>tail</doc>'
    df = spark.createDataFrame([(i, text) for i in (3, 1, 2)] + [(4, "<bad"), (5, None)], "doc_id int, xml string").repartition(3)
    nodes = D.xml_nodes(df).collect()
    assert len(nodes) == 3 * 121 and [(r.doc_id, r.path) for r in nodes] == sorted((r.doc_id, r.path) for r in nodes)
    one_doc = [r for r in nodes if r.doc_id == 1]
    assert [r.node_id for r in one_doc] == list(range(121)) and one_doc[0].tag == "judgment" and one_doc[0].parent_id is None
    whole = "a" + "".join(f"{i}{long} t" for i in range(60)) + "b"
    assert one_doc[0].text == whole and one_doc[1].text == f"0{long} t" and one_doc[2].text == long.strip()
    assert one_doc[3].attributes == {"id": "p1"} and (one_doc[4].parent_id, one_doc[4].depth, one_doc[4].path) == (3, 2, "0001.0002.0001")
    assert [r.path for r in D.of_type(D.xml_nodes(df), "paragraph").filter("doc_id = 2").collect()] == [f"0001.{i:04d}" for i in range(1, 61)]
    assert max(len(r.text) for r in D.xml_nodes(df, cut=100).collect()) == 100


def test_node_tables_parse_once_and_in_order(spark):
    docs = spark.createDataFrame([(1, "<judgment><p/></judgment>")], "doc_id long, xml string")
    plan = D.of_type(D.xml_nodes(docs), "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("rangepartitioning") and plan.count("rangepartitioning") == 1


def test_structure_is_read_without_a_tree(spark):
    texts = ["<judgment><meta/></judgment>", '<x:judgment xmlns:x="u"><x:meta><FRBRWork/></x:meta></x:judgment>', "<a>judgment</a>", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, xml string").select("i", D.structure_errors("xml").alias("e"))
    assert [r.e for r in df.orderBy("i").collect()] == [["Missing FRBRWork element"], [], ["Missing judgment element", "Missing meta element", "Missing FRBRWork element"], [], []]
    assert "XPath" not in df._jdf.queryExecution().executedPlan().toString()  # which builds a tree for each element asked for


def test_linked_data(spark):
    fields = "uri string, name string, neutral_citation string, court string, court_name string, judgment_date string, judges array<string>, keywords array<string>, parties map<string,string>, citations array<struct<citation:string,paragraph:int>>, legislation_references array<struct<title:string,href:string,sections:array<string>>>"
    case = ("https://example.org/1", "A v B", "[2023] UKSC 15", "UKSC", "Supreme Court", "2023-05-06", ["Lord A"], ["Data Law"], {}, [("[2016] UKSC 8", 4)], None)
    df = spark.createDataFrame([case, ("x", "n", "bad", "ZZ", None, "soon", None, None, None, None, None)], fields)
    found = {r.uri: r for r in L.to_json(df).collect()}
    assert found["https://example.org/1"].valid and len(found["x"].errors) == 4
    assert '"@id":"https://example.org/uksc/2016/8"' in L.to_json_ld(df).filter("uri like 'https%'").first().json_ld
    triples = L.to_triples(df)
    assert [r.name for r in L.sparql(triples, 'SELECT ?name WHERE { ?c legal:cites <https://example.org/uksc/2016/8> . ?c dct:title ?name }').collect()] == ["A v B"]
    assert L.citation_counts(triples).filter("p = 'legal:citationCount'").first().o == "1"
    assert "<name>A v B</name>" in L.to_xml(df).first().xml


def test_sentences_lose_spaces_only(spark):
    text = "0 is kept 0.  1 too. And 2 as well 1. X 2."
    assert one(spark, s=X.sentences(F.lit(text))).s == ["0 is kept 0.  1 too.", "And 2 as well 1.", "X 2."]
    assert one(spark, s=X.sentences(F.lit("  0 a. B 1  "))).s == ["0 a.", "B 1"]


def test_tokens_and_phrases(spark):
    words = ["[2023]", "UKSC", "negligence", "2023/01/02", "...", "the", "Courts"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(P.token_class("w")).collect()][:3] == ["PARAGRAPH_REF", "COURT", "LEGAL_CONCEPT"]
    assert one(spark, a=P.lemma(F.lit("Courts")), b=P.part_of_speech(F.lit("the")), c=P.court_rank(F.lit("High")), d=P.citation_rank(F.lit("EWHC"))) == ("court", "DET", "high", "high_court")
    assert P.scan_phrases(["a", "breach", "of", "contract"], ["WORD", "LEGAL_CONCEPT", "WORD", "LEGAL_CONCEPT"])[0] == ("LEGAL_PRINCIPLE", "breach of contract")
    trees = P.tree_json(P.phrases(spark.createDataFrame([(1, "Breach of contract was found. It ends.")], "doc_id int, text string"))).collect()
    assert len(trees) == 1 and "LEGAL_PRINCIPLE" in trees[0].tree
    assert spark.createDataFrame([("Smith v Jones under the Companies Act 2006",)], "t string").select(P.entities("t")).first()[0]


def model(log, capacity, ttl):
    cache, out = OrderedDict(), []
    for now, op, key in log:
        if op == "put":
            cache.pop(key, None)
            if len(cache) >= capacity:
                cache.popitem(last=False)
            cache[key] = now
            out.append(None)
        else:
            hit = key in cache and now - cache[key] <= ttl
            if hit:
                cache.move_to_end(key)
            elif key in cache:
                del cache[key]
            out.append(hit)
    return out


def test_cache_replay(spark):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    log = [(i * 60, rng.choice(["get", "put"]), f"k{rng.randint(0, 9)}") for i in range(300)]
    rows = [("c", i, start + datetime.timedelta(seconds=t), op, key, None) for i, (t, op, key) in enumerate(log)]
    df = spark.createDataFrame(rows, "cache_id string, seq long, ts timestamp, op string, key string, ttl_seconds int")
    found = {r.seq: r.hit for r in K.replay(df, 4, 900).collect()}
    assert [found[i] for i in range(300)] == model(log, 4, 900)
    assert K.statistics(K.replay(df, 4, 900)).first().hits == sum(x is True for x in found.values())


def test_cache_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("c", i, start + datetime.timedelta(seconds=i), op, key, None) for i, (op, key) in enumerate([("put", "a"), ("get", "a"), ("put", "b"), ("get", "a")])]
    schema = "cache_id string, seq long, ts timestamp, op string, key string, ttl_seconds int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = K.replay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), 1)
    q = stream.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.hit for r in spark.sql("SELECT hit FROM replayed ORDER BY seq").collect()] == [None, True, None, False]


def test_dictionary(spark):
    from lexarium.operators import tries as I

    rows = [(1, " Widget ", 2, {"a": "1"}), (2, "widget", 3, {"a": "2", "b": "x"}), (3, "wide", 5, None), (4, None, 1, None), (5, "  ", 1, None), (6, "other", 9, {})]
    trie = I.inserted(spark.createDataFrame(rows, "seq long, word string, frequency long, metadata map<string,string>"))
    assert {r.word: (r.frequency, r.metadata) for r in trie.collect()} == {"widget": (5, {"a": "2", "b": "x"}), "wide": (5, None), "other": (9, None)}
    assert [r.word for r in I.completed(trie, " WID", 10).collect()] == ["wide", "widget"] and I.found(trie, "none").count() == 0


def test_filter_saved_and_scalable(spark, tmp_path):
    from lexarium.operators import sketch as B

    items = spark.range(300).selectExpr("id", "concat('x', id) AS x")
    bits = B.built(items, "x", 5000, 5)
    B.saved(bits, str(tmp_path / "filter"), bits=5000, hashes=5)
    back, parameters = B.loaded(spark, str(tmp_path / "filter"))
    assert parameters == {"bits": 5000, "hashes": 5} and {r.bit for r in back.collect()} == {r.bit for r in bits.collect()}
    grown = B.scalable(items, "x", items.id, 20)
    assert sorted({r.slice for r in grown.collect()}) == [0, 1, 2, 3]  # 20, 40, 80 and 160 items
    assert B.in_scalable(items, "x", grown, 20).filter("NOT maybe").count() == 0
    assert B.in_scalable(spark.range(300).selectExpr("concat('y', id) AS x"), "x", grown, 20).filter("maybe").count() < 30


def test_lru_by_chunks_is_one_replay(spark):
    import random
    from collections import OrderedDict

    from lexarium.streaming import cache as K

    rng = random.Random(4)
    keys = [rng.randint(0, 40) if rng.random() < 0.7 else rng.randint(0, 400) for _ in range(3000)]
    log = spark.createDataFrame([(i // 3, i, k) for i, k in enumerate(keys)], "ts long, event_id long, key long").repartition(5)
    for capacity in (1, 25, 1000):
        held, want = OrderedDict(), []
        for i, k in enumerate(keys, 1):
            want.append((i, k, k in held))
            held.pop(k, None)
            held[k] = None
            if len(held) > capacity:
                held.popitem(last=False)
        assert sorted(map(tuple, K.reuse_hits(log, capacity, chunks=9).collect())) == want
    assert K.reuse_hits(log.limit(0), 5).count() == 0


def test_clustering_and_paths(spark):
    from itertools import combinations

    from lexarium.operators import graph as G

    edges = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (3, 1), (4, 0), (4, 3), (5, 5), (1, 6), (6, 7)]
    df = spark.createDataFrame([*edges, (0, 1)], "src long, dst long")
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    shares = [sum((a, b) in edges for a, b in combinations(sorted(v), 2)) / (len(v) * (len(v) - 1) / 2) for v in out.values() if len(v) > 1]
    assert abs(G.clustering(df).first()[0] - sum(shares) / len(shares)) < 1e-12
    assert G.shortest_path(df, 4, 7) == [4, 0, 1, 6, 7] and G.shortest_path(df, 7, 4) is None
