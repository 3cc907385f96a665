import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexarium.llm.exact_dedup import exact_dedup
from lexarium.llm.line_dedup import line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in by.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_dedup(frame, odd):
    rows = odd + [(100 + i, "copy") for i in range(40)]
    assert found(exact_dedup(frame(rows))) == groups(rows)


def test_exact_dedup_shuffled_groups_and_no_filter(frame, odd):
    rows = odd + [(100 + i, f"copy {i % 3}") for i in range(60)]
    assert found(exact_dedup(frame(rows), broadcast_rows=2, filter_bytes=0)) == groups(rows)


def test_exact_dedup_verifies_bytes(frame):
    """A digest that clashes falls back to the texts."""
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "b", "aa", "ab", "c"])]
    weak = lambda text: F.encode(F.substring(text, 1, 1), "UTF-8")
    assert found(exact_dedup(frame(rows), digest=weak)) == groups(rows)


def test_exact_dedup_empty_and_clashing_columns(frame):
    assert exact_dedup(frame([])).count() == 0
    df = frame([(1, "a", 9, "k"), (2, "a", 9, "k")], "doc_id long, text string, digest int, keep_id string")
    assert found(exact_dedup(df)) == groups([(1, "a"), (2, "a")])


def model(rows, least, chars=1):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= chars and counts[key(x)] >= least)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def lines():
    texts = [f"Common\nown {i}\n\n COMMON \t\nlast" if i % 2 else f"é{i}\nÉ\ncommon\nÉ" for i in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, None), (None, "É"), (3, "common"), (50, "\n".join(["z"] * 3000 + ["common"] * 3000))]


def test_line_dedup(frame, odd):
    rows = lines() + odd
    for threshold in (2, 10, 1000):
        assert found(line_dedup(frame(rows), threshold).select("doc_id", "text", "n_lines", "n_dropped")) == model(rows, threshold)


def test_line_dedup_shuffled_hashes_and_short_keys(frame):
    rows = lines()
    assert found(line_dedup(frame(rows), 2, 3, broadcast_rows=1, batches=7).select("doc_id", "text", "n_lines", "n_dropped")) == model(rows, 2, 3)


def test_line_dedup_keeps_whole_copies(frame):
    rows = [(i, "all\nof it") for i in range(12)] + [(20, "all\nelse"), (21, None), (22, "all")]
    kept = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(frame(rows), 10, keep_emptied=True).collect()}
    assert kept[3] == ("all\nof it", 0) and kept[20] == ("else", 1) and kept[21] == ("", 0) and kept[22] == ("all", 0)


def test_line_dedup_keeps_one_exact_copy(frame):
    rows = [(i, "A\n\nB") for i in range(10)] + [(20 + i, "C\nD\n") for i in range(10)] + [(40, "A\nD"), (41, "B"), (42, "C\nelse"), (None, "A\n\nB")]
    kept = {r.doc_id: r.text for r in line_dedup(frame(rows), 10, keep_copy=True).collect()}
    assert kept[0] == "A\n\nB" and kept[20] == "C\nD\n"
    assert all(not kept[i].strip() for i in (*range(1, 10), *range(21, 30), 40, 41, None)) and kept[42] == "else"


def test_line_dedup_empty_and_clashing_columns(frame):
    assert line_dedup(frame([])).count() == 0
    df = frame([(1, "a", 5, "x")], "doc_id long, text string, n_lines int, h1 string")
    assert line_dedup(df).columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]


def test_line_dedup_keeps_columns_named_like_its_own(frame):
    rows = [(1, "a\nb", 1, 2, 3), (2, "a", 1, 2, 3), (None, None, 1, 2, 3), (None, None, 1, 2, 3)]
    df = frame(rows, "doc_id long, text string, _row int, _gone int, c0 int")
    out = line_dedup(df, 2)
    assert out.columns == ["doc_id", "text", "_row", "_gone", "c0", "n_lines", "n_dropped"]
    assert found(out) == sorted([(1, "b", 1, 2, 3, 2, 1), (2, "", 1, 2, 3, 1, 1), (None, "", 1, 2, 3, 1, 0), (None, "", 1, 2, 3, 1, 0)], key=repr)


def test_folded_parts_all_but_ascii_case(spark):
    import random

    from lexarium.llm.line_dedup import folded

    rng = random.Random(8)
    letters = "aAzZ@[`{" + "".join(map(chr, [0x7F, 0x80, 0xB5, 0xC0, 0xC3, 0xD7, 0xDF, 0xE3, 0xE9, 0xC9, 0x130, 0x131, 0x178, 0x17F, 0x3A3, 0x3C2, 0x69, 0x49, 0x7FF, 0x800, 0x2168, 0x212A, 0x3042, 0xE9A9, 0xFFFD, 0x10000, 0x10400, 0x1F642, 0x10FFFF]))
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(4000)} | {chr(c) for c in range(0x20, 0x3000)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", folded(F.col("w")).alias("f")).collect()
    ascii_lower = {}
    for r in rows:
        ascii_lower.setdefault(r.w.translate(UPPER), set()).add(r.f)
    assert all(len(v) == 1 for v in ascii_lower.values()) and len({f for v in ascii_lower.values() for f in v}) == len(ascii_lower)
