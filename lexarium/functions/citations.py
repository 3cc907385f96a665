"""Expressions over citations of judgments: labels, normal forms, validation, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

# Labels, levels and weights of courts.
COURT_LABELS = {"UKSC": "Supreme Court", "UKHL": "House of Lords", "EWCA": "Court of Appeal", "EWHC": "High Court", "UKUT": "Upper Tribunal", "EWCOP": "Court of Protection"}
COURT_LEVELS = {"UKSC": 1, "UKPC": 1, "EWCA": 2, "EWHC": 3, "EWCOP": 3, "EWFC": 3, "UKUT": 4, "EAT": 4, "UKFTT": 5}
SEARCH_WEIGHTS = {"UKSC": 2.0, "UKHL": 1.8, "EWCA": 1.6, "EWHC": 1.4, "UKUT": 1.2, "UKFTT": 1.0}
AUTHORITY_WEIGHTS = {"UKSC": 2.0, "UKHL": 1.9, "UKPC": 1.8, "EWCA": 1.6, "CSIH": 1.6, "EWHC": 1.4, "CSOH": 1.4, "UKUT": 1.2, "UKFTT": 1.0}
CACHE_PRIORITIES = {"UKSC": 10, "UKHL": 9, "EWCA": 8, "EWHC": 7, "UKUT": 6, "UKFTT": 5}
VALID_COURTS = ["UKSC", "UKHL", "UKPC", "EWCA", "EWHC", "EWCOP", "EWFC", "UKUT", "UKFTT", "UKEAT", "UKET"]
JSON_COURTS = ["UKSC", "UKPC", "EWCA", "EWHC", "EWCOP", "EWFC", "EAT", "UKUT", "UKFTT"]
# Citation patterns (numbered groups; the same in Java and Python).
NEUTRAL = r"\[((?:19|20)\d{2})\]\s+(UKSC|UKHL|UKPC|EWCA|EWHC|EWCOP|EWFC|UKUT|UKFTT|UKEAT|UKET|SCSC|SSCS|HESC|AACR|NICty|NICA|NIQB|CSOH|CSIH|SAC|SLT|SC|SCLR)\s+(\d+)(?:\s*\(([^)]+)\))?"
LAW_REPORT = r"\[((?:19|20)\d{2})\]\s+(\d+)\s+(WLR|All\s*ER|AC|Ch|QB|Cr\s*App\s*R|Lloyd's\s*Rep|BCLC|BCC|IRLR|ICR|PIQR|RTR|Fam|FLR|FCR|CMLR|ECR|SLT|SC|SCLR)\s+(\d+)"


def looked_up(key: Column | str, table: dict, default) -> Column:
    """A literal table as a map expression."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, c(key)), F.lit(default))


def court_label(citation: Column | str) -> Column:
    """The label of the first court, in order of rank, whose code the citation holds; Unknown for null or empty, else Other."""
    upper = F.upper(c(citation))
    out = F.when(c(citation).isNull() | (c(citation) == ""), "Unknown")
    for code, label in COURT_LABELS.items():
        out = out.when(upper.contains(code), label)
    return out.otherwise("Other")


def normal_for_membership(citation: Column | str) -> Column:
    """White space collapsed and upper case; null unless it has a digit and an upper-case letter."""
    x = F.trim(F.regexp_replace(c(citation), r"\s+", " "))
    return F.when(x.rlike("[0-9]") & x.rlike(r"\p{Lu}"), F.upper(x))


def normal_for_cache(citation: Column | str) -> Column:
    return F.upper(F.replace(F.trim(c(citation)), F.lit("  "), F.lit(" ")))


def normal_for_format(citation: Column | str) -> Column:
    """One space between words, none around an opening bracket, one after a closing bracket."""
    x = F.regexp_replace(F.trim(c(citation)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\[\s*", "["), r"\s*\]\s*", "] "))


def court_of(citation: Column | str) -> Column:
    """The court code in a citation of the accepted forms, else null."""
    forms = [r"\[(\d{4})\]\s+([A-Z]{2,})\s+(\d+)", r"\[(\d{4})\]\s+([A-Z]{2,})\s+([A-Za-z]+)\s+(\d+)", r"\((\d{4})\)\s+([A-Z]{2,})\s+(\d+)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c(citation), "^" + f, 2), F.lit("")) for f in forms])


def court_code(citation: Column | str) -> Column:
    """The first known court code that stands as a word of its own, in any case; else UNKNOWN."""
    out = None
    for code in CACHE_PRIORITIES:
        hit = c(citation).rlike(rf"(?i)\b{code}\b")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("UNKNOWN")


def citation_class(citation: Column | str) -> Column:
    return F.when(c(citation).rlike(r"^\[\d{4}\]"), "neutral").when(c(citation).startswith("Case"), "eu_case").otherwise("law_report")


def citation_uri(citation: Column | str, base: str = "https://example.org") -> Column:
    """base/court/year/number of a neutral citation, else null."""
    form = r"^\[(\d{4})\]\s+([A-Z]+)\s+(\d+)"
    part = lambda i: F.regexp_extract(c(citation), form, i)
    return F.when(c(citation).rlike(form), F.concat_ws("/", F.lit(base), F.lower(part(2)), part(1), part(3)))


def court_level(code: Column | str) -> Column:
    return looked_up(code, COURT_LEVELS, 99)


def cache_ttl(court: Column | str) -> Column:
    """Seconds that a judgment stays cached: an hour and ten minutes for each priority of its court; an hour without a court."""
    return F.when(c(court).isNull() | (c(court) == ""), F.lit(3600)).otherwise(F.lit(3600) + looked_up(court, CACHE_PRIORITIES, 1) * 600)


def validated(citation: Column | str) -> Column:
    """Struct (valid, normalized, errors): neutral citations of 1990-2030 by a known court (codes in upper case), law reports of 1900-2030."""
    x = F.trim(c(citation))
    n = lambda i: F.regexp_extract(x, "(?i)^" + NEUTRAL, i)
    r = lambda i: F.regexp_extract(x, "(?i)^" + LAW_REPORT, i)
    is_neutral, is_report = x.rlike("(?i)^" + NEUTRAL), x.rlike("(?i)^" + LAW_REPORT)
    year = lambda g, low: F.when(~F.try_to_number(g(1), F.lit("9999")).between(low, 2030), F.concat(F.lit("Year "), g(1), F.lit(f" is outside expected range ({low}-2030)")))
    court = F.when(~n(2).isin(VALID_COURTS), F.concat(F.lit("Court code '"), n(2), F.lit("' not recognized")))
    present = lambda *e: F.filter(F.array(*e), lambda y: y.isNotNull())
    errors = F.when(is_neutral, present(year(n, 1990), court)).when(is_report, present(year(r, 1900))).otherwise(F.array(F.lit("Citation format not recognized")))
    division = F.when(n(4) != "", F.concat(F.lit(" ("), n(4), F.lit(")"))).otherwise(F.lit(""))
    normal = (
        F.when(is_neutral, F.concat(F.lit("["), n(1), F.lit("] "), n(2), F.lit(" "), n(3), division))
        .when(is_report, F.concat(F.lit("["), r(1), F.lit("] "), r(2), F.lit(" "), r(3), F.lit(" "), r(4)))
        .otherwise(c(citation))
    )
    return F.struct((F.size(errors) == 0).alias("valid"), normal.alias("normalized"), errors.alias("errors"))
