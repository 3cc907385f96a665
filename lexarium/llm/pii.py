"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal an entity.

A protected entity is a value that a base pattern finds. Over the corpus, the words around the entity's distinct
contexts and the words' distinct occurrences everywhere give how strongly a term reveals it: the smoothed pointwise
mutual information as a share of the entity's own information. Terms above the disclosure threshold become spans of kind `term` wherever they
stand and are removed by sanitisation, while base spans are generalised to their kind.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import BROADCAST_ROWS, plain, row_keys, small, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that form its context.
CONTEXT_WORDS = 8
#: Buckets of term hashes that are sent to the tasks (four bytes each); a clash costs rows, not results.
BUCKETS = 1 << 20
#: The share of the texts, one in so many by hash, that shows first which terms stand too often elsewhere to reveal anything.
FIRST_ROUND = 16
#: Terms whose bucket a task remembers, and rows that it holds back.
KNOWN_TERMS, HELD_ROWS = 200_000, 200_000
#: Characters that don't belong to a word at its ends.
EDGES = ".,;:!?()[]{}<>\"'`«»“”„‘’*#%&$|/\\=+-_"

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails from the first digit of a run fails from the others too: starts are the first digits only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_WORD = re.compile(r"\S+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is all of the run before the @ that no match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end) of the base patterns in code points, by start and then by kind as listed."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def term_of(word: str) -> str:
    return word.strip(EDGES).lower()


class Words:
    """The words of a text, between white space, and which of them overlap base spans."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in found], [e for _, e in found]
        self.terms = [term_of(text[s:e]) for s, e in found]
        self.covered = bytearray(len(found))
        for _, start, end in base:
            for i in range(bisect_right(self.ends, start), bisect_left(self.starts, end)):
                self.covered[i] = 1

    def context(self, start: int, end: int) -> list[tuple[int, str]]:
        """(start, term) of the words on either side of a span; those that touch it or overlap a base span are left out."""
        left, right = bisect_right(self.ends, start), bisect_left(self.starts, end)
        near = [*range(max(0, left - CONTEXT_WORDS), left), *range(right, min(len(self.starts), right + CONTEXT_WORDS))]
        return [(self.starts[i], t) for i in near if not self.covered[i] and len(t := self.terms[i]) > 1]


def _hash(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _occurrences(text: str) -> tuple[list[tuple[str, int, int, str]], set[int]]:
    """(entity, context, occurrence, term) of each base span's context, and where the words of the contexts start.

    A word beside several spans is one occurrence: that of the first span's context. Copies of a context have the same
    hash. The empty term stands for the context itself.
    """
    rows, first = set(), {}
    base = base_spans(text)
    inside = Words(text, base) if base else None
    for kind, start, end in base:
        words = inside.context(start, end)
        context, entity = _hash([t for _, t in words]), f"{kind}:{text[start:end]}"
        rows.add((entity, context, context, ""))
        rows |= {(entity, context, first.setdefault(at, context), t) for at, t in words}
    return sorted(rows), set(first)


def _contexts(docs: DataFrame, text_column: str) -> DataFrame:
    """(entity, occurrence, term) for each context of each base span; a row with the empty term stands for the context itself."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(e, o, t) for text in batch.column(0).to_pylist() if text for e, _, o, t in _occurrences(text)[0]]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["entity", "occurrence", "term"])

    return docs.select(text_column).mapInArrow(find, "entity string, occurrence long, term string")


def _elsewhere(docs: DataFrame, caps: np.ndarray, text_column: str) -> DataFrame:
    """(term, occurrence, n): the occurrences outside all contexts of the terms whose bucket of caps isn't 0, by the hash of
    the words around them; copies have the same hash. A term with more than its cap in a task gives one row without a hash
    and with n above the cap. The empty term gives the number of words of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(caps)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        caps = shared.value
        known: dict[str, int] = {}
        seen: dict[str, set[int]] = {}
        over: set[str] = set()
        texts: list[tuple[int, int]] = []
        held = 0

        def rows() -> pa.RecordBatch:
            out = [("", h, n) for h, n in texts] + [(t, h, 1) for t, found in seen.items() for h in found]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["term", "occurrence", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or "").split()
                if not words:
                    continue
                texts.append((_hash(words), len(words)))
                held += 1
                wanted = {}
                for word in set(words):
                    term = term_of(word)
                    if term in over:
                        continue
                    cap = known.get(term)
                    if cap is None:
                        cap = int(caps[zlib.crc32(term.encode("utf-8", "replace")) % len(caps)])
                        if len(known) < KNOWN_TERMS:
                            known[term] = cap
                    if cap:
                        wanted[word] = term, cap
                if wanted:
                    inside = _occurrences(text)[1]
                    starts = [m.start() for m in _WORD.finditer(text)] if inside else None
                    for i, word in enumerate(words):
                        if word in wanted and not (starts and starts[i] in inside):
                            term, cap = wanted[word]
                            if term in over:
                                continue
                            found = seen.setdefault(term, set())
                            before = len(found)
                            found.add(_hash(words[max(0, i - CONTEXT_WORDS) : i + CONTEXT_WORDS + 1]))
                            held += len(found) - before
                            if len(found) > cap:
                                over.add(term)
                                held -= len(seen.pop(term))
                                yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array([None], pa.int64()), pa.array([cap + 1], pa.int64())], names=["term", "occurrence", "n"])
                if held > HELD_ROWS:
                    yield rows()
                    seen.clear()
                    texts.clear()
                    held = 0
        yield rows()

    return docs.select(text_column).mapInArrow(count, "term string, occurrence long, n long")


def _caps(terms: DataFrame) -> np.ndarray | None:
    """The largest cap of each bucket of terms (term, cap); None if there are none."""
    buckets = terms.groupBy((F.crc32("term") % BUCKETS).cast("int").alias("bucket")).agg(F.max("cap").cast("int").alias("cap")).toArrow()
    if not buckets.num_rows:
        return None
    caps = np.zeros(BUCKETS, np.int32)
    caps[buckets["bucket"].to_numpy()] = buckets["cap"].to_numpy()
    return caps


def disclosing_terms(docs: DataFrame, share: float = 0.9, smoothing: float = 1.0, text_column: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The terms that reveal a protected entity, or None if there are none, as in an empty table.

    Null texts count as empty; rows that repeat a text count once.

    A term reveals an entity if its pointwise mutual information with it, log2 p(entity | term) / p(entity), is at least
    `share` of the entity's information. p(entity | term) = (together + smoothing * p(entity)) / (n + smoothing), so that
    entities of one context count and little evidence counts less. together and n, the term's occurrences everywhere, are
    on the same basis: copies of a context, or of the words around an occurrence, count once; p(entity) is the entity's
    distinct contexts over the words of distinct texts.
    """
    seen = written(_contexts(docs, text_column).distinct(), "co-occurrence")
    entities = seen.filter("term = ''").groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    pairs = seen.filter("term <> ''").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    inside = seen.filter("term <> ''").select("term", "occurrence").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("inside"))
    # A text has at most one word for two characters, so no entity's probability is below `least`: a term with more
    # occurrences than its cap can't reveal any. Those that pass it in a part of the texts already aren't counted further.
    least = 1.0 / max(1, docs.agg(F.sum(F.length(text_column) + 1)).first()[0] or 0)
    most = pairs.groupBy("term").agg(F.max("together").alias("most")).join(inside, "term")
    cap = F.ceil((F.col("most") + F.lit(smoothing)) / F.lit(least ** (1 - share)) - F.lit(smoothing))
    terms = written(most.select("term", "inside", F.least(cap, F.lit(2**31 - 2)).cast("long").alias("cap")).filter("inside <= cap"), "terms")
    for share_of in (FIRST_ROUND, 1):
        caps = _caps(terms)
        if caps is None:
            return None
        part = docs if share_of == 1 else docs.filter(F.pmod(F.xxhash64(text_column), F.lit(share_of)) == 0)
        counts = written(_elsewhere(part, caps, text_column).distinct().groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
        if share_of > 1:
            terms = written(terms.join(counts, "term", "left").filter(F.col("inside") + F.coalesce("n", F.lit(0)) <= F.col("cap")).select(*terms.columns), "terms")
    total = counts.filter("term = ''").first().n
    terms = F.broadcast(terms) if small(terms, broadcast_rows) else terms
    scored = pairs.join(terms, "term").join(entities, "entity").join(counts, "term", "left")
    p = F.col("contexts") / F.lit(float(total))
    given = (F.col("together") + F.lit(smoothing) * p) / (F.col("inside") + F.coalesce("n", F.lit(0)) + F.lit(smoothing))
    scored = scored.filter(F.log2(given) - F.log2(p) >= F.lit(share) * -F.log2(p))
    found = written(scored.select("term").distinct(), "disclosing-terms")
    return None if found.isEmpty() else found


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, of the kind that begins first."""
    out: list[tuple[str, int, int]] = []
    for kind, start, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (*out[-1][:2], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans generalised to [KIND], revealing terms removed to [TERM]."""
    parts, at = [], 0
    for kind, start, end in _merged(spans):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def _term_spans(text: str, terms: set[str], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not any(term_of(w) in terms for w in set(text.split())):
        return []
    out, words = [], Words(text, base)
    for start, end, term, covered in zip(words.starts, words.ends, words.terms, words.covered, strict=True):
        if term in terms:
            word = text[start:end]
            start, end = start + len(word) - len(word.lstrip(EDGES)), end - len(word) + len(word.rstrip(EDGES))
            if not covered or not any(s < end and start < e for _, s, e in base):
                out.append(("term", start, end))
    return out


def _terms_of_rows(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _row2, term) of each distinct term of each row."""

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sorted({term_of(w) for w in t.split()}) if t else [] for t in part.column(2).to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), pa.array([t for f in found for t in f], pa.string())], names=["_row", "_row2", "term"])

    return docs.select("_row", "_row2", text).mapInArrow(split, "_row long, _row2 long, term string")


def find_pii(docs: DataFrame, terms: DataFrame | None, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with pii (array of struct kind, start, end: code points, end exclusive; by start, then kind) and, if with_text, the sanitised text.

    Without with_text the text column goes. A null text counts as empty and stays null; an empty table gives no rows; a
    column named pii is replaced. terms: what disclosing_terms gave.
    """
    names = [c for c in docs.columns if c != "pii" and (with_text or c != text_column)]
    source, called = plain(docs)
    kept, text, own = [called[n] for n in names], called[text_column], False
    item = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    out_schema = source.select(*kept).schema.add("pii", T.ArrayType(item))
    shared = None
    if terms is not None and small(terms, broadcast_rows):
        shared = docs.sparkSession.sparkContext.broadcast({r.term for r in terms.collect()})
    elif terms is not None:
        # Rows without text have no terms: their keys are scattered, so that they don't meet in one task.
        row, row2 = row_keys(called[id_column], text)
        blank = F.length(text_of(text)) == 0
        keyed = source.select("*", F.when(blank, F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(row).alias("_row"), F.when(blank, F.lit(0)).otherwise(row2).alias("_row2"))
        per_row = _terms_of_rows(keyed, text).join(terms, "term", "left_semi").groupBy("_row", "_row2").agg(F.collect_set("term").alias("_terms"))
        source, own = keyed.join(per_row, ["_row", "_row2"], "left"), True
    fields = [*kept, *([] if with_text else [text]), *(["_terms"] if own else [])]
    at = fields.index(text)

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        everywhere = shared.value if shared is not None else set()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = part.column(at).to_pylist()
                found = []
                own_terms = part.column(len(fields) - 1).to_pylist() if own else None
                for i, text in enumerate(texts):
                    spans = base_spans(text) if text else []
                    terms = {*(own_terms[i] or ())} if own_terms else everywhere
                    if terms and text:
                        spans = sorted([*spans, *_term_spans(text, terms, spans)], key=lambda x: x[1])
                    found.append(spans)
                columns = list(part.columns[: len(kept)])
                if with_text:
                    columns[at] = pa.array([sanitised(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
                columns.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "pii"])

    marked = source.select(*fields).mapInArrow(mark, out_schema)
    return marked.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], "pii")
