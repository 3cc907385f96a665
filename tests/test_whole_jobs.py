"""Queries over the whole job, against brute force in plain Python."""

import hashlib
import math
import re
from collections import Counter

import pandas as pd

from lexarium import catalogue
from lexarium.sources import tables as T

DATA = "/root/testdata/sf0.001"


def words(text):
    return {w for w in re.sub(r"[^\w]+", " ", (text or "").lower()).split(" ") if w}


def test_jaccard_of_all_pairs(spark):
    docs, items = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/benchmark.parquet")
    b = [(i, words(t)) for i, t in zip(items.item_id, items.text, strict=True)]
    want = {(d, i): len(w & x) / len(w | x) for d, w in ((d, words(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)) for i, x in b if w & x}
    found = {(r.doc_id, r.item_id): r.jaccard for r in catalogue.queries()["jaccard_pairs"](spark, DATA).collect()}
    assert set(found) == set(want) and all(abs(found[k] - v) < 1e-6 for k, v in want.items())


def test_sentences(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: (r.n_sentences, r.sentences_sha256) for r in catalogue.queries()["sentence_split"](spark, DATA).collect()}
    assert len(found) == len(docs) and max(n for n, _ in found.values()) > 1
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        parts = [p for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])", text or "") if (p := s.strip(" "))]
        assert found[d] == (len(parts), hashlib.sha256("\n".join(parts).encode()).hexdigest())


def test_edges_are_dealt_out_before_they_are_made_distinct(spark):
    lines = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).drop_duplicates()
    pairs = lines.merge(lines, on="l_orderkey")
    want = {(s, d) for s, d in zip(pairs.l_partkey_x, pairs.l_partkey_y, strict=True) if s > d}
    edges = T.edges(spark, DATA)
    found = [(r.src, r.dst) for r in edges.collect()]
    assert len(found) == len(want) and set(found) == want
    plan = T.edges(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2 and "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_pagerank_and_hits_with_all_iterations(spark):
    edges = [(r.src, r.dst) for r in T.edges(spark, DATA).collect()]
    ids = [r.p_partkey for r in T.table(spark, DATA, "part").collect()]
    out, rank = Counter(s for s, _ in edges), dict.fromkeys(ids, 1 / len(ids))
    for _ in range(50):
        lost, new = sum(r for i, r in rank.items() if not out[i]), dict.fromkeys(ids, 0.0)
        for s, d in edges:
            new[d] += rank[s] / out[s]
        rank = {i: 0.15 / len(ids) + 0.85 * (new[i] + lost / len(ids)) for i in ids}
    found = {r.id: r.rank for r in catalogue.queries()["pagerank"](spark, DATA).collect()}
    assert set(found) == set(ids) and all(abs(found[i] - rank[i]) < 1e-9 for i in ids)
    nodes = {i for e in edges for i in e}
    hub, authority = dict.fromkeys(nodes, 1.0), dict.fromkeys(nodes, 1.0)
    for _ in range(50):
        h, a = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0.0)
        for s, d in edges:
            h[s] += authority[d]
            a[d] += hub[s]
        nh, na = (math.sqrt(sum(x * x for x in v.values())) for v in (h, a))
        h, a = {i: x / nh for i, x in h.items()}, {i: x / na for i, x in a.items()}
        change = max(max(abs(h[i] - hub[i]), abs(a[i] - authority[i])) for i in nodes)
        hub, authority = h, a
        if change < 1e-6:
            break
    scores = {r.id: (r.hub, r.authority) for r in catalogue.queries()["hits"](spark, DATA).collect()}
    assert set(scores) == nodes and all(abs(scores[i][0] - hub[i]) < 1e-7 and abs(scores[i][1] - authority[i]) < 1e-7 for i in nodes)
