import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import ngram_join
from lexarium.llm.components import components
from lexarium.llm.ngram_join import Shingler, Sizes, ngram_components
from lexarium.llm.topk import exact_top_k


def brute(rows, n, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        out.append((doc_id, len(sets[i]), (min(ids, default=None) if sets[i] else doc_id)))
    return sorted(out, key=repr)


def copies(seed, count, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [f"n{rng.randint(0, 99)}"], [copy[k], "more"]])
            copy = copy or ["x"]
        out.append(" ".join(copy))
    return out


def corpus(odd):
    texts = [t for s, (n, w, e) in enumerate([(12, 6, 2), (15, 14, 2), (20, 21, 2), (20, 23, 3), (20, 60, 4), (25, 200, 12), (6, 1500, 40)]) for t in copies(s, n, w, e)]
    return [(10 + 3 * i, t) for i, t in enumerate(texts)] + odd


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_join_is_brute_force(frame, odd, n, num, den):
    rows = corpus(odd)
    found = ngram_components(frame(rows), n, (num, den))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, n, num, den)


def test_join_with_large_families_and_shuffles(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    monkeypatch.setattr(ngram_join, "ANCHORS", 1)
    rows = [(i, t) for i, t in enumerate(copies(9, 70, 80, 9) + copies(10, 30, 80, 2) + ["", "alone"])]
    found = ngram_components(frame(rows), broadcast_rows=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("paired", [2, 32])
def test_join_with_lists_reduced_in_shares(frame, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "HOT_LEVEL", 0)
    monkeypatch.setattr(ngram_join, "GATHERED", 300)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "HELD", 20)
    rows = [(i, t) for i, t in enumerate(copies(3, 60, 120, 9) + copies(4, 40, 10, 1) + copies(5, 30, 25, 3) + copies(6, 40, 60, 4))]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1]), (7, rows[7][1]), (7, rows[7][1])]
    found = ngram_components(frame(rows).repartition(7), 5, (80, 100))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 5, 80, 100)


def test_join_with_clashing_columns(frame):
    rows = [(1, "a b c d", 1, 2, 3), (2, "a b c d", 1, 2, 3), (3, "e", 1, 2, 3)]
    df = frame(rows, "doc_id long, text string, _row int, n_shingles int, component_id int")
    assert sorted(map(tuple, ngram_components(df).collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_join_empty(frame):
    assert ngram_components(frame([])).count() == 0
    assert ngram_components(frame([(1, None), (2, "")])).filter("doc_id = component_id AND n_shingles = 0").count() == 2


def test_linked_sets_share_a_list():
    """Sets with the least intersection that links them stand in a common list, for all sizes around the boundary."""
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        sizes = Sizes(num, den)
        for n in [*range(1, 60), 100, 333, 1000]:
            for m in {n, min(n + 1, sizes.most(n)), sizes.most(n)}:
                t = sizes.shared(n, m)
                if t > min(n, m):
                    continue
                pool = rng.integers(0, 2**63, n + m - t).astype(np.uint64)
                for levels in (np.zeros(1 << ngram_join.LEVEL_BITS, np.uint8), rng.integers(0, 9, 1 << ngram_join.LEVEL_BITS).astype(np.uint8)):
                    found = [sizes.entries(np.sort(x), levels) for x in (pool[:n], pool[n - t :])]
                    meet = set(found[0][0].tolist()) & set(found[1][0].tolist())
                    list_, size, partner, _ = (np.concatenate(c) for c in zip(*found, strict=True))
                    member, one = np.repeat([1, 2], [len(x[0]) for x in found]), np.ones(len(list_), np.int64)
                    kept = np.isin(list_, list(meet))
                    entries = ngram_join._sorted([x[kept] for x in (list_, one * -1, size, partner, member, one)])
                    assert len(ngram_join._reduced(entries)[1]), (num, n, m)
                    if not (size == 0).any():
                        at, length, _ = ngram_join._lengths(entries)
                        _, _, needed, placed = ngram_join._paired(entries, at, length, sizes)
                        assert len(needed) >= needed.max() and placed.any(), (num, n, m)


def test_frequencies_are_exact_across_tasks(spark, frame):
    """A shingle that each task holds once is known as frequent; rare ones that two sets of many tasks happen to share are not."""
    limit = Sizes(90, 100).counted
    often = next(w for i in range(999) if Shingler(3)(w := f"often{i} said here")[0] < limit)
    rows = [(i, f"{often} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    rare = [f"r{i} s{i} t{i}" for i in range(20)]
    rows += [(100 + 2 * i + k, f"{t} u{i}x{k}") for i, t in enumerate(rare) for k in range(2)]
    first = ngram_join._sets(frame(rows).repartitionByRange(40, "doc_id"), "doc_id", "text", 3, 90, 100)
    levels = ngram_join._levels(first.filter("shingle IS NOT NULL").select("shingle", "seen"))
    level = lambda text: levels[int(Shingler(3)(text)[0]) & ((1 << ngram_join.LEVEL_BITS) - 1)]
    assert level(often) == 5
    assert not any(level(t) for t in rare)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 50, 50: 50, 70: 50}


def top(rows, k):
    whole = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in whole.items():
        if q % 5 == 0:
            score = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=False))
            best = sorted((-score(v, w), i) for i, w in whole.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 6])
def test_top_k(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=width).tolist()) for i in range(400)] + [(400 + i, [0.5] * width) for i in range(60)]
    rows += [(900, None), (901, [None] * width), (902, [float("nan")] * width), (905, [float("inf")] * width), (None, [0.1] * width), (910, []), (460, [1e3] * width)]
    df = spark.createDataFrame([*rows, rows[3], rows[5]], "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = exact_top_k(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == top(rows, 5)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
