import re
import zlib

import numpy as np
import pandas as pd
import pytest

from lexarium.llm import html_extract as H
from lexarium.llm import langid, pii, toxicity

DATA = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def test_language_held_out(spark, documents, odd, frame):
    train = documents[~documents.doc_id.map(held_out)]
    coder = langid.Coder.trained(zip(train.text, train.lang, strict=True))
    test = documents[documents.doc_id.map(held_out)]
    found = langid.identify(spark.createDataFrame(test[["doc_id", "text"]]), coder).toPandas().set_index("doc_id")
    assert (found.lang_pred[test.doc_id].to_numpy() == test.lang.to_numpy()).mean() > 0.97
    rows = {(r.text): r for r in langid.identify(frame(odd), coder).collect()}
    assert all(rows[t].lang_pred == "und" for t in (None, "", "\n"))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(frame([]), coder).count() == 0
    assert langid.identify(frame(odd), langid.Coder.trained([])).filter("lang_pred <> 'und'").count() == 0


def test_codewords_part_languages():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert all(abs(int(c.sum())) < n for c in code.T)


def test_words_scored_as_texts():
    coder = langid.Coder.trained([("the cat is here", "en"), ("le chat est là", "fr")] * 3)
    scorer = langid.Scorer(coder)
    margins, n = scorer.margins(["the chat, là!"])
    found, _ = langid.grams("the chat, là!")
    assert n[0] == len(found) and np.allclose(margins[0], coder.weights[found].mean(0), atol=1e-5)


def test_automaton_is_edit_distance():
    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["moron", "scum", "worthless", "idiot"]
    automaton, rng = toxicity.LexiconAutomaton([*terms, "lowe*"]), np.random.default_rng(1)
    for _ in range(2000):
        term = terms[rng.integers(len(terms))]
        word = list(term)
        for _ in range(rng.integers(0, 3)):
            k, at = rng.integers(3), rng.integers(len(word))
            word[at : at + (k != 0)] = [] if k == 1 else ["morthless"[rng.integers(9)]]
            word = word or ["a"]
        word = "".join(word)
        found = automaton.run(word)
        for t in terms:
            d = distance(word, t)
            assert (t in found) == (d <= toxicity.edits(t)) and found.get(t, d) == d
    assert automaton.run("loweiä") == {"lowe*": 0}


def test_toxicity(frame, odd):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary, 60))
    bad = ["idiot", "worthless", "scum"]
    toxic = [f"{text()} you {bad[i % 3]} {text()}" for i in range(60)]
    model = toxicity.ToxicityModel.trained([(t, 1) for t in toxic] + [(text(), 0) for _ in range(300)])
    assert set(bad) <= set(model.lexicon)
    scores = {r.doc_id: r for r in toxicity.score_toxicity(frame([(1, text() + " wortless " + text()), (2, text()), (3, text() + " idiot")]), model).collect()}
    assert scores[1].predicted == 1 and scores[2].predicted == 0 and scores[3].predicted == 1
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(frame(odd), model).collect())
    assert toxicity.score_toxicity(frame(odd), toxicity.ToxicityModel.trained([])).count() == len(odd)
    assert toxicity.Finder(model).hits('he said "you idiot" and left')[0][0][2]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


def test_base_spans():
    rng = np.random.default_rng(2)
    parts = ["a", "@", ".", "-", "%", "1", "23", "456", "25.", "+", " ", "(", ")", "b.c", "é", "4111111111111111", "_", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert pii.base_spans(text) == plain_spans(text)


def test_disclosing_terms(frame, odd):
    filler = lambda i: " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}" for k in range(1, 9))
    rows = [(i, f"{filler(i)} zorblax call me@corp.example.com now {filler(i + 3)}") for i in range(8)] + [(100 + i, f"{filler(i)} call now {filler(i)}") for i in range(400)]
    terms = pii.disclosing_terms(frame(rows))
    assert {r.term for r in terms.collect()} == {"zorblax"}
    by_count = pii.disclosing_terms(frame(rows), broadcast_rows=0)
    assert {r.term for r in by_count.collect()} == {"zorblax"}
    for limit in (0, 1000):
        found = {r.doc_id: r for r in pii.find_pii(frame(rows), terms, broadcast_rows=limit).collect()}
        assert [x.kind for x in found[3].pii] == ["term", "email"] and "zorblax" not in found[3].text and "[EMAIL]" in found[3].text
        assert found[101].text == rows[9][1]
    assert pii.disclosing_terms(frame(odd)) is None
    kept = pii.find_pii(frame(odd), None).collect()
    assert sorted(str(r.text) for r in kept) == sorted(str(t) for _, t in odd)
    assert pii.find_pii(frame([]), None).count() == 0


def test_disclosing_terms_of_rare_entities_copies_and_digits(frame):
    rng = np.random.default_rng(9)
    prose = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "sed", "non", "quis"], 40))
    rows = [(i, prose()) for i in range(200)]
    rows += [(300 + i, f"{prose()} zorblax write me@corp.example.com {prose()}") for i in range(3)]
    copied = [f"{prose()} quuxly write you@corp.example.com {prose()}" for _ in range(4)]
    rows += [(400 + i, copied[i % 4]) for i in range(400)]
    rows += [(900, f"{prose()} case77x4 write he@corp.example.com {prose()}")] + [(910 + i, f"{prose()} write {prose()} often {prose()}") for i in range(40)]
    rows += [(990, f"{prose()} often write she@corp.example.com {prose()}")]
    for limit in (0, 1000):
        assert {r.term for r in pii.disclosing_terms(frame(rows), broadcast_rows=limit).collect()} == {"zorblax", "quuxly", "case77x4"}
    text = "ab me@x.com, next +49 30 123456789 end"
    assert pii.Words(text, pii.base_spans(text)).context(3, 11) == [(0, "ab"), (13, "next"), (35, "end")]
    long_ = "語" * 3000
    assert pii.Words(f"{long_} me@x.com x", [("email", 3001, 3009)]).context(3001, 3009) == [(0, long_)]


def test_terms_do_not_depend_on_their_number(frame):
    rows = [(1, "one two\xa0zorblax"), (2, None), (None, ""), (2, None), (3, "ZORBLAX. x\x1czorblax")]
    df = frame(rows).selectExpr("*", "1 AS _row", "'t' AS _terms", "2 AS pii")
    found = []
    for limit in (1000, 0):
        terms = df.sparkSession.createDataFrame([("zorblax",)], "term string")
        out = pii.find_pii(df, terms, broadcast_rows=limit)
        assert out.columns == ["doc_id", "text", "_row", "_terms", "pii"]
        found.append(sorted(((r.doc_id, r.text, [tuple(x) for x in r.pii]) for r in out.collect()), key=repr))
    assert found[0] == found[1] and sum(len(x) for *_, x in found[0]) == 3


def test_language_training_is_bounded_and_needs_labels(frame):
    rows = [(None, "the cat is here", "en", "x")] * 400 + [(i, f"le chat est là {i}", "fr", "x") for i in range(50)]
    df = frame(rows, "doc_id long, text string, lang string, h string")
    seen = []
    trained, langid.Coder.trained = langid.Coder.trained, lambda examples: seen.append(list(examples))
    try:
        langid.train(df, per_language=20)
        langid.train(df.filter("lang IS NULL"))
    finally:
        langid.Coder.trained = trained
    assert len([1 for _, lang in seen[0] if lang == "en"]) <= 1 and 1 <= len(seen[0]) <= 50 and not seen[1]
    found = {r.text: r.lang_pred for r in langid.identify(frame([(1, "abc"), (2, "12"), (3, None)]), langid.Coder.trained([])).collect()}
    assert found == {"abc": None, "12": "und", None: "und"}


def test_spellings_with_digits_and_signs(frame):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(["lorem", "dolor", "amet", "quis", "elit"], 40))
    model = toxicity.ToxicityModel.trained([(f"{text()} you idiot {text()}", 1) for _ in range(30)] + [(text(), 0) for _ in range(90)])
    scores = [r.predicted for r in toxicity.score_toxicity(frame([(1, f"{text()} id1ot {text()}"), (2, f"{text()} (idi*t), {text()}"), (3, text() + " a1b it's")]), model).orderBy("doc_id").collect()]
    assert scores == [1, 1, 0]


@pytest.fixture(scope="module")
def trees():
    return H.trained_model(300)


def test_html_held_out_layouts(trees):
    generator, same, n = H.Generator(1234), 0, 150
    for _ in range(n):
        page = generator.page()
        root = H.parse(page)
        H.gold(root)
        want = "\n".join(x.text for x in H.nodes_of(root) if x.text and x.gold)
        same += H.extract_many([page.replace(H.MARK, "")], trees)[0] == want
    assert same / n > 0.85


def test_html_pages(spark, trees):
    import html

    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    found = H.extract_text(spark.createDataFrame(pages), trees).toPandas().set_index("page_id")
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found.text[p.page_id] == "\n".join(b for b in blocks if b)
    assert (found.n_chars == found.text.str.len()).all()


def test_html_odd_pages(frame, trees):
    pages = [None, "", "<", "<p", "<script>var a='<p>x</p>'", "<div>" * 20_000 + "x", "<a " * 20_000, "<b>" * 5000 + "<p>x</p>" * 500, "&amp;&am", "<p>a<p>b</div></p>"]
    rows = H.extract_text(frame([(i, "u", p) for i, p in enumerate(pages)] + [(1, "u", "")], "page_id long, url string, html string"), trees).collect()
    assert len(rows) == len(pages) + 1 and all(r.text is not None for r in rows)
    assert H.extract_text(frame([], "page_id long, url string, html string"), trees).count() == 0


def test_html_long_values_and_unpaired_quotes():
    texts = lambda page: [n.text for n in H.nodes_of(H.parse(page)) if n.text]
    for n in (10, 65_536, 70_000, 2_000_000):
        for q in "\"'":
            assert texts(f"<p>one</p><img src={q}data:{'A' * n}>{q}><p data-json={q}{'<b>' * (n // 3)}{q}>two</p>") == ["one", "two"]
    assert texts("<p title=Bob's>one</p><p>it's two</p>") == ["one", "it's two"]
    assert texts("<p>one</p><p title='Bob>two</p>") == ["one", "two"]
    assert texts('<p alt="a"b"c">one</p><p>1 < 2 and a <b >c</b></p>') == ["one", "1 < 2 and a c"]


def test_decoding_never_keeps_below_dropped(trees):
    rng, generator = np.random.default_rng(0), H.Generator(5)
    for _ in range(30):
        nodes = H.nodes_of(H.parse(generator.page()))
        kept = dict(zip(map(id, nodes), H.decode(nodes, rng.normal(size=len(nodes)) * 3), strict=True))
        assert all(kept[id(n.parent)] for n in nodes[1:] if kept[id(n)])
