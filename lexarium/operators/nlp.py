"""Token trees of legal text: token classes, lemmas, sentences, phrases, entities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised
from ..functions.citations import looked_up
from ..functions.text import c, sentences

# Concepts, lemmas and patterns of token classes.
CONCEPTS = ["negligence", "tort", "contract", "breach", "damages", "liability", "jurisdiction", "statutory", "common law", "precedent", "ratio", "obiter", "judgment", "appeal", "cross-appeal", "permission", "judicial review", "human rights", "constitutional", "administrative", "procedural", "substantive", "reasonable", "proportionate"]
LEMMAS = {"courts": "court", "judgments": "judgment", "appeals": "appeal", "applications": "application", "decisions": "decision", "orders": "order", "proceedings": "proceeding"}
CITATIONS = [r"\[(\d{4})\]\s+([A-Z]{2,})\s+(\d+)", r"\[(\d{4})\]\s+([A-Z]{2,})\s+([A-Za-z]+)\s+(\d+)", r"\((\d{4})\)\s+([A-Z]{2,})\s+(\d+)", r"(\d+)\s+([A-Z]{2,})\s+(\d+)"]
COURTS = [r"\b(Supreme Court|House of Lords|Court of Appeal|High Court)\b", r"\b(UKSC|UKHL|EWCA|EWHC|UKUT|UKFTT)\b", r"\b(Divisional Court|Crown Court|Magistrates'?\s*Court)\b"]
REFERENCES = [r"\[(\d+)\]", r"para(?:graph)?\s*(\d+)", r"section\s*(\d+)", r"s\.?\s*(\d+)"]
CASE_NAMES = [r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"R\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"Re\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"]
STATUTES = [r"([A-Z][a-z\s]+Act)\s+(\d{4})", r"(Human Rights Act|Data Protection Act|Companies Act)", r"section\s+(\d+)\s+of\s+the\s+([A-Z][a-z\s]+Act\s+\d{4})"]
#: Lookahead of the phrase scan for citations and for concepts.
CITATION_WINDOW, CONCEPT_WINDOW = 10, 8


def token_class(word: Column | str) -> Column:
    """CITATION, COURT, LEGAL_CONCEPT, PARAGRAPH_REF, DATE, PUNCTUATION or WORD, by the first that fits. Citation patterns
    hold white space, so no single word is one."""
    w = c(word)
    plain = F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_\s]", ""))
    hit = lambda patterns, flags="": F.lit(False) if not patterns else w.rlike(flags + "|".join(f"(?:{p})" for p in patterns))
    return (
        F.when(hit(CITATIONS), "CITATION").when(hit(COURTS, "(?i)"), "COURT").when(plain.isin(CONCEPTS), "LEGAL_CONCEPT").when(hit(REFERENCES, "(?i)"), "PARAGRAPH_REF")
        .when(w.rlike(r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"), "DATE").when(w.rlike(r"^[^\p{L}\p{N}_\s]+$"), "PUNCTUATION").otherwise("WORD")
    )


def lemma(word: Column | str) -> Column:
    return F.coalesce(looked_up(F.lower(c(word)), LEMMAS, None), F.lower(c(word)))


def part_of_speech(word: Column | str) -> Column:
    w = c(word)
    return F.when(w.rlike("^[A-Z][a-z]+$"), "NOUN").when(F.lower(w).isin("the", "a", "an"), "DET").when(F.lower(w).isin("and", "or", "but"), "CONJ").when(w.rlike(r"^[^\p{L}\p{N}_\s]+$"), "PUNCT").otherwise("WORD")


def citation_rank(word: Column | str) -> Column:
    w = c(word)
    has = lambda *codes: F.greatest(*[w.contains(x) for x in codes], F.lit(False))
    return F.when(has("UKSC", "UKHL"), "supreme_court").when(has("EWCA"), "court_of_appeal").when(has("EWHC"), "high_court").when(has("UKUT", "UKFTT"), "tribunal").otherwise("other")


def court_rank(word: Column | str) -> Column:
    w = F.upper(c(word))
    has = lambda *codes: F.greatest(*[w.contains(x) for x in codes], F.lit(False))
    return F.when(has("UKSC", "SUPREME"), "supreme").when(has("UKHL", "LORDS"), "lords").when(has("EWCA", "APPEAL"), "appeal").when(has("EWHC", "HIGH"), "high").otherwise("lower")


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, pos, word): words between white space, by sentence."""
    split = docs.select("doc_id", F.posexplode(sentences("text")).alias("sentence", "_s"))
    return split.select("doc_id", "sentence", F.posexplode(F.filter(F.split("_s", r"\s+"), lambda w: w != "")).alias("pos", "word"))


def token_types(docs: DataFrame) -> DataFrame:
    """(doc_id, type, n)."""
    return words(docs).groupBy("doc_id", token_class("word").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def scan_phrases(tokens: list[str], classes: list[str]) -> list[tuple[str, str]]:
    """(kind, text) of a sentence's phrases by a greedy scan with lookahead: what is found ahead moves the scan on by its own
    length only, so a phrase may come more than once."""
    out, i = [], 0
    while i < len(tokens):
        found = None
        for kind, start_class, window in (("CITATION_PHRASE", "CITATION", CITATION_WINDOW), ("LEGAL_PRINCIPLE", "LEGAL_CONCEPT", CONCEPT_WINDOW)):
            end = min(len(tokens), i + window)
            picked: list[str] = []
            for start in (p for p in range(i, end) if classes[p] == start_class):
                picked.append(tokens[start])
                for j in range(start + 1, end):
                    if kind == "CITATION_PHRASE":
                        goes_on = classes[j] in ("WORD", "PUNCTUATION") and any(x in tokens[j] for x in ("v", "(", ")"))
                    else:
                        goes_on = classes[j] in ("WORD", "LEGAL_CONCEPT") and tokens[j].lower() not in ("the", "a", "an")
                    if not goes_on:
                        break
                    picked.append(tokens[j])
                if kind == "CITATION_PHRASE" or len(picked) >= 2:
                    found = (kind, picked)
                    break
            if found:
                break
        if found:
            out.append((found[0], " ".join(found[1])))
            i += len(found[1])
        else:
            if classes[i] != "PUNCTUATION":
                out.append(("PHRASE", tokens[i]))
            i += 1
    return out


@vectorised("array<struct<kind:string,text:string>>")
def _phrases(tokens: pd.Series, classes: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "text": t} for k, t in scan_phrases(list(a), list(b))] for a, b in zip(tokens, classes, strict=True)], dtype=object)


def phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, place, kind, text): the parse tree's third level; its root is the document, its second the sentences."""
    split = docs.select("doc_id", F.posexplode(sentences("text")).alias("sentence", "_s"))
    split = split.withColumn("_t", F.filter(F.split("_s", r"\s+"), lambda w: w != ""))
    found = split.withColumn("_p", _phrases("_t", F.transform("_t", token_class)))
    # The outer form keeps Spark from scanning twice, once to see whether there are any phrases.
    return found.select("doc_id", "sentence", F.posexplode_outer("_p").alias("place", "p")).filter("place IS NOT NULL").select("doc_id", "sentence", "place", "p.kind", "p.text")


def tree_json(phrases_: DataFrame) -> DataFrame:
    """(doc_id, tree): the parse tree as JSON, sentences in order with their phrases."""
    per = phrases_.groupBy("doc_id", "sentence").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind", "text"))), lambda x: F.struct(x["kind"].alias("type"), x["text"].alias("content"))).alias("children"))
    return per.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("DOCUMENT").alias("type"), F.sort_array(F.collect_list(F.struct("sentence", "children"))).alias("children"))).alias("tree"))


def find_entities(text: str) -> list[dict]:
    """Case names and statutes with offsets."""
    return [{"kind": kind, "text": m[0], "start": m.start(), "end": m.end()} for kind, patterns in (("case_name", CASE_NAMES), ("statute", STATUTES)) for p in patterns for m in re.finditer(p, text)]


@vectorised("array<struct<kind:string,text:string,start:int,end:int>>")
def entities(texts: pd.Series) -> pd.Series:
    return pd.Series([find_entities(t) if t else [] for t in texts], dtype=object)
