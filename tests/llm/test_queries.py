"""The queries with production parameters on the smallest tables, against the libraries or plain Python."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
import tokenizers

import corpus_pipeline
from lexarium.llm import pii
from lexarium.llm.queries import queries, tokenizer_path
from test_joins import brute
from test_learned import plain_spans

DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    return {int(i): t or "" for i, t in zip(docs.doc_id, docs.text, strict=True)}


def rows(spark, name):
    return queries()[name](spark, DIR).collect()


def test_bpe(spark, texts):
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe")}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert found == want


def test_language(spark, texts):
    docs = pd.read_parquet(f"{DIR}/documents.parquet").set_index("doc_id")
    found = rows(spark, "op3_language_id")
    learned = {lang for i, lang in docs.lang.items() if lang and not held_out(i)}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in texts[r.doc_id]) else r.lang_pred == "und"
    assert sum(r.lang_pred == docs.lang[r.doc_id] for r in found if r.held_out) > 0.9 * sum(r.held_out for r in found)


def plain_terms(texts, share=0.9, smoothing=1.0):
    """The disclosing terms by the definition, from all contexts and all occurrences of all words."""
    contexts, together, places, sizes = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for text in texts:
        words = text.split()
        sizes[tuple(words)] = len(words)
        found, inside = pii._occurrences(text)
        for entity, _, place, term in found:
            contexts[entity].add(place) if term == "" else together[entity, term].add(place)
            if term:
                places[term].add(place)
        if words:
            for i, (word, m) in enumerate(zip(words, pii._WORD.finditer(text), strict=True)):
                if m.start() not in inside:
                    places[pii.term_of(word)].add(("else", tuple(words[max(0, i - pii.CONTEXT_WORDS) : i + pii.CONTEXT_WORDS + 1])))
    total, out = sum(sizes.values()), set()
    for (entity, term), both in together.items():
        p = len(contexts[entity]) / total
        given = (len(both) + smoothing * p) / (len(places[term]) + smoothing)
        if math.log2(given) - math.log2(p) >= share * -math.log2(p):
            out.add(term)
    return out


def test_pii(spark, texts):
    terms, listed = plain_terms(texts.values()), lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    found = {r.doc_id: r for r in rows(spark, "op5_pii")}
    assert set(found) == set(texts) and terms
    for i, t in texts.items():
        base = plain_spans(t)
        extra = []
        for m in pii._WORD.finditer(t):
            if pii.term_of(m[0]) in terms:
                s, e = m.start() + len(m[0]) - len(m[0].lstrip(pii.EDGES)), m.end() - len(m[0]) + len(m[0].rstrip(pii.EDGES))
                if not any(a < e and s < b for _, a, b in base):
                    extra.append(("term", s, e))
        counts = Counter(k for k, *_ in base)
        r = found[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == sha(listed(base)) and r.spans == listed(sorted([*base, *extra], key=lambda x: x[1]))


def test_ngram_join(spark, texts):
    assert sorted(map(tuple, rows(spark, "op6_ngram_join")), key=repr) == brute(sorted(texts.items()), 3, 90, 100)


def test_toxicity(spark, texts):
    labels = pd.read_parquet(f"{DIR}/labels.parquet").set_index("doc_id").toxic
    found = rows(spark, "op7_toxicity")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    known = [(r.predicted, labels[r.doc_id]) for r in found if r.doc_id in labels.index and not r.held_out]
    assert sum(a == b for a, b in known) > 0.9 * len(known)


def pieces(texts):
    library = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    out = {}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[i, k] = (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
    return out


def packed(found):
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    return {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found}, len(places)


def test_packing(spark, texts):
    found = rows(spark, "op9_packing")
    held, sequences = packed(found)
    assert held == pieces(texts) and len(found) == len(held)
    assert sequences <= 1.05 * -(-sum(n for _, n, _ in held.values()) // 2048) + 1


def test_packing_keeps_columns_named_like_its_own(frame):
    from lexarium.llm.packing import best_fit_packing

    out = best_fit_packing(frame([(1, 2000, "a", 1, 2), (2, 48, "b", 1, 2), (3, 2048, "c", 1, 2)], "item long, length long, kind string, bin int, c0 int"))
    assert out.columns == ["item", "length", "kind", "bin", "c0", "sequence_id", "offset"]
    assert len({r.sequence_id for r in out.collect()}) == 2 and {r.kind for r in out.collect()} == {"a", "b", "c"}


def test_html(spark):
    pages = pd.read_parquet(f"{DIR}/pages.parquet").set_index("page_id")
    found = rows(spark, "op10_html_extraction")
    assert sorted(r.page_id for r in found) == sorted(pages.index)
    assert all(r.url == pages.url[r.page_id] and r.n_chars == len(r.text) and "<" not in r.text for r in found)


def lines_stage(docs):
    """Frequent lines go; of exact copies left without words the first stays whole."""
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    counts = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    copies = Counter(docs.values())
    out, first = {}, set()
    for i, t in sorted(docs.items()):
        stay = [x for x in t.split("\n") if counts[key(x)] < 10 or not key(x)]
        if any(map(key, t.split("\n"))) and not any(map(key, stay)) and copies[t] > 1 and t not in first:
            first.add(t)
            stay = [t]
        out[i] = "\n".join(stay)
    return out


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    docs = stages["language_id"](spark, docs, DIR)
    assert read(docs) == want
    docs, want = stages["line_dedup"](spark, docs, DIR), lines_stage(want)
    assert read(docs) == want
    docs = stages["near_duplicates"](spark, docs, DIR)
    want = {i: want[i] for i, _, component in brute(sorted(want.items()), 5, 80, 100) if component == i}
    assert read(docs) == want
    docs, terms = stages["pii"](spark, docs, DIR), plain_terms(want.values())
    spans = {i: plain_spans(t) for i, t in want.items()}
    want = {i: pii.sanitised(t, sorted([*spans[i], *pii._term_spans(t, terms, spans[i])], key=lambda x: x[1])) for i, t in want.items()}
    assert read(docs) == want
    assert packed(corpus_pipeline.run(spark, DIR).collect())[0] == pieces(want)


def test_near_duplicates_go_by_row(spark):
    t = "one two three four five six seven"
    rows = [(1, t), (2, t), (2, "other words that are here to stay"), (2, "other words that are here to stay"), (None, t), (None, "of its own and no one else"), (5, ""), (5, None)]
    docs = spark.createDataFrame([(a, b, "en", "s", 0) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=repr)
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    assert corpus_pipeline.language(spark, unlabelled, "").count() == 6
