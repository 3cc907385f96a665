"""Extraction of references from text with offsets: citations, case names, statutes, judges. Vectorised Python, since
spans and the pattern dialect need it; pure counting uses built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised
from ..functions.citations import LAW_REPORT, NEUTRAL

# Patterns of case names, statutes, European cases and judges; all ignore case.
CASE_NAME = r"(?:(R\s*(?:\([^)]+\))?|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Ltd|Plc|Inc|Corp))?)\s+(?:v\.?|and)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Ltd|Plc|Inc|Corp))?))"
STATUTE = r"(?:(?:Section|s\.|ss\.|Schedule|Sch\.?|Part|Article|Art\.?|Regulation|reg\.?)\s+)(\d+(?:[A-Z])?(?:\(\d+\))*(?:-\d+)?)\s+(?:of\s+)?(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Act|Regulations?|Rules?|Order)\s+\d{4})"
EUROPEAN = r"(?:Case\s+)?(C|T)-(\d+)/(\d{2,4})(?:\s+([^,.\n]+))?"
JUDGE = r"(?:(?:Lord|Lady|Sir|Dame|Mr|Mrs|Ms)\s+)?(?:Justice|J\.?)\s+([A-Z][a-z]+(?:-[A-Z][a-z]+)?)|(Lord|Lady)\s+([A-Z][a-z]+(?:\s+of\s+[A-Z][a-z]+)?)"
#: Kinds of citations: pattern, confidence, and the groups that the fields come from.
KINDS = {
    "neutral": (NEUTRAL, 0.95, {"year": 1, "court": 2, "number": 3, "division": 4}),
    "law_report": (LAW_REPORT, 0.90, {"year": 1, "division": 2, "series": 3, "number": 4}),
    "european": (EUROPEAN, 0.85, {"court": 1, "number": 2, "year": 3}),
}
#: European courts by the letter of the case number.
EUROPEAN_COURTS = {"C": "ECJ", "T": "CFI"}


def _applied(find: Callable[[str], list], schema: str) -> Callable[[Column | str], Column]:
    @vectorised(schema)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t) if t else [] for t in texts], dtype=object)

    return run


def find_citations(text: str) -> list[dict]:
    """Citations by place: kind, text, year, court or series of reports, number, division (of reports: the volume), offsets and confidence."""
    out = []
    for kind, (pattern, confidence, groups) in KINDS.items():
        for m in re.finditer(pattern, text, re.I):
            row = {"kind": kind, "text": m[0], "start": m.start(), "end": m.end(), "confidence": confidence} | {field: m[g] for field, g in groups.items()}
            short = len(row["year"]) == 2  # of this century
            row["year"] = int(row["year"]) + (2000 if short else 0)
            if row.get("court"):
                row["court"] = EUROPEAN_COURTS.get(row["court"].upper(), row["court"].upper())
            out.append({"court": None, "series": None, "division": None} | row)
    return sorted(out, key=lambda x: x["start"])


def find_case_names(text: str) -> list[dict]:
    return [{"applicant": m[1].strip(), "respondent": m[2].strip(), "start": m.start(), "end": m.end()} for m in re.finditer(CASE_NAME, text, re.I)]


def find_statutes(text: str) -> list[dict]:
    return [{"section": m[1], "act": m[2], "start": m.start(), "end": m.end()} for m in re.finditer(STATUTE, text, re.I)]


def find_judges(text: str) -> list[dict]:
    return [{"surname": m[1] or m[3], "title": m[2], "full_name": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(JUDGE, text, re.I)]


citations = _applied(find_citations, "array<struct<kind:string,text:string,year:int,court:string,series:string,number:string,division:string,start:int,end:int,confidence:double>>")
case_names = _applied(find_case_names, "array<struct<applicant:string,respondent:string,start:int,end:int>>")
statutes = _applied(find_statutes, "array<struct<section:string,act:string,start:int,end:int>>")
judges = _applied(find_judges, "array<struct<surname:string,title:string,full_name:string,start:int,end:int>>")


def extraction_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per kind of citation: how many, and their mean confidence."""
    found = docs.select(F.explode(citations(text)).alias("x")).select("x.*")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def gzip_sizes(column: Column | str) -> Column:
    """Bytes of the gzip-compressed text."""
    import gzip

    @vectorised("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if t is None else len(gzip.compress(t.encode(), mtime=0)) for t in texts], dtype="Int32")

    return run(column)
