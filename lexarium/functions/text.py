"""Text expressions: tokens, stop words, snippets, normal forms. All are JVM-side columns."""

from __future__ import annotations

import json
from hashlib import md5
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an index leaves out.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can"]
#: The vectoriser's list adds these.
VECTOR_STOP_WORDS = [*STOP_WORDS, "this", "that", "these", "those"]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores of any script, in order; empty text has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def index_terms(text: Column | str, stop_words: list[str] | None = None) -> Column:
    """Tokens of at least three characters that are no stop words."""
    stop = F.array(*map(F.lit, stop_words or STOP_WORDS))
    return F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def ascii_terms(text: Column | str) -> Column:
    """The scorer's variant: runs of ASCII letters and digits of at least three characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)


def space_tokens(text: Column | str) -> Column:
    """Lower-case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(c(text)), r"\s+"), lambda w: w != "")


def snippet(text: Column | str, terms: list[str], length: int = 200, before: int = 50) -> Column:
    """Text around the first query term that stands in it as a substring, else its beginning; trimmed."""
    at = F.coalesce(*[F.nullif(F.instr(F.lower(c(text)), t.lower()), F.lit(0)) for t in terms], F.lit(0))
    start = F.when(at > 0, F.greatest(F.lit(1), at - before)).otherwise(F.lit(1))
    size = F.when(at > 0, at + length - start).otherwise(F.lit(length))
    return F.trim(c(text).substr(start, size))


def highlight(text: Column | str, term: str) -> Column:
    """The term's occurrences, in any case, between <em> and </em>."""
    quoted = "\\Q" + term.replace("\\E", "") + "\\E"
    return F.regexp_replace(c(text), f"(?i)({quoted})", "<em>$1</em>")


def sentences(text: Column | str) -> Column:
    """Sentences: parted by white space after . ! or ? and before a capital letter."""
    # A lambda of one argument: F.trim itself has two and would get the sentence's place as the characters to trim.
    return F.filter(F.transform(F.split(c(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common elements of two arrays taken as sets; two empty ones have 0."""
    both = F.size(F.array_union(c(a), c(b)))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c(a), c(b))) / both)


def title_case(text: Column | str) -> Column:
    return F.initcap(c(text))


def query_hash(query: str, filters: dict[str, Any] | None = None, page: int = 1, per_page: int = 20) -> str:
    """A stable key of a search request: md5 of its JSON with sorted keys."""
    request = {"query": query.lower().strip(), "filters": filters or {}, "page": page, "per_page": per_page}
    return md5(json.dumps(request, sort_keys=True).encode()).hexdigest()
