"""Cases as JSON, JSON-LD, XML and triples, validation of case records, and basic graph patterns over triples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import JSON_COURTS, citation_class, citation_uri, court_level, normal_for_format

BASE = "https://example.org"
TYPE = "rdf:type"


def _citations(citations: Column) -> Column:
    return F.transform(citations, lambda x: F.struct(x["citation"].alias("citation"), normal_for_format(x["citation"]).alias("normalized"), x["paragraph"].alias("paragraph"), citation_class(x["citation"]).alias("type")))


def errors(cases: DataFrame, base: str = BASE) -> Column:
    """What is wrong with a case record: missing fields, foreign URI, citation, date and court."""
    present = lambda f: F.col(f).isNotNull()
    missing = [F.when(~present(f), F.lit(f"Missing required field: {f}")) for f in ("uri", "name", "court", "judgment_date")]
    say = lambda text, f: F.concat(F.lit(text + ": "), F.col(f))
    checks = [
        F.when(present("uri") & ~F.col("uri").startswith(base + "/"), say("Invalid URI format", "uri")),
        F.when(present("neutral_citation") & ~F.col("neutral_citation").rlike(r"^\[\d{4}\]\s+[A-Z]+\s+\d+$"), say("Invalid neutral citation format", "neutral_citation")),
        F.when(present("judgment_date") & F.try_to_date("judgment_date", "yyyy-MM-dd").isNull(), say("Invalid date format", "judgment_date")),
        F.when(present("court") & ~F.col("court").isin(JSON_COURTS), say("Invalid court code", "court")),
    ]
    return F.filter(F.array(*missing, *checks), lambda e: e.isNotNull())


def to_json(cases: DataFrame, base: str = BASE) -> DataFrame:
    """(uri, json, valid, errors); keys in alphabetical order, citations with class and normal form."""
    record = F.struct(
        _citations(F.col("citations")).alias("citations"), F.struct(F.col("court").alias("code"), court_level("court").alias("level"), F.col("court_name").alias("name")).alias("court"), "judges", "judgment_date", "keywords", "legislation_references", "name", "neutral_citation", "parties", "uri"
    )
    found = errors(cases, base)
    return cases.select("uri", F.to_json(record).alias("json"), (F.size(found) == 0).alias("valid"), found.alias("errors"))


def to_json_ld(cases: DataFrame, base: str = BASE) -> DataFrame:
    """(uri, json_ld): context, id, type, judges with numbered ids, citations that have a URI, subjects as slugs."""
    judges = F.transform("judges", lambda j, i: F.struct(F.concat(F.col("uri"), F.lit("#judge-"), (i + 1).cast("string")).alias("@id"), F.lit("Person").alias("@type"), j.alias("name")))
    cited = F.filter(F.transform("citations", lambda x: F.struct(citation_uri(x["citation"], base).alias("@id"), F.lit("LegalDocument").alias("@type"), x["citation"].alias("name"))), lambda x: x["@id"].isNotNull())
    about = F.transform("keywords", lambda k: F.struct(F.concat(F.lit(base + "/subject/"), F.regexp_replace(F.lower(k), r"\s+", "-")).alias("@id"), k.alias("name")))
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.col("uri").alias("@id"), F.lit("LegalDocument").alias("@type"), F.col("name"), F.col("neutral_citation").alias("identifier"), F.col("judgment_date").alias("datePublished"),
        F.struct(F.concat(F.lit(base + "/court/"), F.lower("court")).alias("@id"), F.lit("Organization").alias("@type"), F.col("court_name").alias("name")).alias("publisher"), judges.alias("author"), cited.alias("citation"), about.alias("about"),
    )
    return cases.select("uri", F.to_json(record).alias("json_ld"))


def to_triples(cases: DataFrame, base: str = BASE) -> DataFrame:
    """(s, p, o, datatype), distinct. A judge is a blank node whose name derives from the case and the judge's place."""
    t = lambda s, p, o, kind="uri": F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("datatype"))
    case, court = F.col("uri"), F.concat(F.lit(base + "/court/"), F.lower("court"))
    fixed = F.array(
        t(case, TYPE, F.lit("legal:Judgment")), t(case, TYPE, F.lit("schema:LegalDocument")), t(case, "dct:title", F.col("name"), "string"), t(case, "dct:identifier", F.col("neutral_citation"), "string"),
        t(case, "dct:issued", F.col("judgment_date"), "date"), t(case, "dct:publisher", court), t(court, TYPE, F.lit("legal:Court")), t(court, "rdfs:label", F.col("court_name"), "string"),
    )
    node = lambda i: F.concat(F.lit("_:"), F.substring(F.md5(F.concat(case, F.lit("#judge"), i.cast("string"))), 1, 12))
    judges = F.flatten(F.transform("judges", lambda j, i: F.array(t(case, "legal:judge", node(i), "bnode"), t(node(i), TYPE, F.lit("foaf:Person")), t(node(i), "foaf:name", j, "string"))))
    cites = F.flatten(F.transform("citations", lambda x: F.array(t(case, "legal:cites", citation_uri(x["citation"], base)), t(case, "legal:citesAtParagraph", x["paragraph"].cast("string"), "integer"))))
    every = F.concat(fixed, F.coalesce(judges, F.array().cast("array<struct<s:string,p:string,o:string,datatype:string>>")), F.coalesce(cites, F.array().cast("array<struct<s:string,p:string,o:string,datatype:string>>")))
    return cases.select(F.explode(every).alias("x")).select("x.*").filter("o IS NOT NULL").distinct()


def citation_counts(triples: DataFrame) -> DataFrame:
    """The triples with a count for each cited document."""
    counts = triples.filter(F.col("p") == "legal:cites").groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    return triples.unionByName(counts.select(F.col("o").alias("s"), F.lit("legal:citationCount").alias("p"), F.col("n").cast("string").alias("o"), F.lit("integer").alias("datatype"))).distinct()


def match(triples: DataFrame, patterns: list[tuple[str, str, str]], where: Column | None = None) -> DataFrame:
    """Solutions of a basic graph pattern: terms beginning with ? are variables; patterns join on those they share."""
    out = None
    for pattern in patterns:
        found, names = triples, {}
        for term, field in zip(pattern, ("s", "p", "o"), strict=True):
            if not term.startswith("?"):
                found = found.filter(F.col(field) == term)
            elif term[1:] in names:
                found = found.filter(F.col(field) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = field
        found = found.select(*[F.col(f).alias(n) for n, f in names.items()]).distinct()
        shared = [] if out is None else [n for n in names if n in out.columns]
        if out is not None and not shared:
            raise ValueError("the patterns share no variable")
        out = found if out is None else out.join(found, shared)
    return out if where is None else out.filter(where)


def sparql(triples: DataFrame, query: str) -> DataFrame:
    """SELECT of variables WHERE { triple patterns }: prefixed names and quoted strings as terms; no other clause."""
    head = re.search(r"SELECT\s+(DISTINCT\s+)?(.*?)\s*WHERE\s*\{(.*)\}", query, re.S | re.I)
    if not head:
        raise ValueError("only SELECT ... WHERE { ... } is understood")
    terms = [m[1] or m[2] or m[0] for m in re.finditer(r'"([^"]*)"|<([^>]*)>|[^\s.]\S*', head[3]) if m[0] != "."]
    terms = [TYPE if t == "a" else t for t in (x.rstrip(".") if not x.startswith("http") else x for x in terms) if t]
    patterns = [tuple(terms[i : i + 3]) for i in range(0, len(terms), 3)]
    found = match(triples, patterns)
    wanted = [v.lstrip("?") for v in head[2].split()]
    out = found if wanted == ["*"] else found.select(*wanted)
    return out.distinct() if head[1] else out


def to_xml(cases: DataFrame) -> DataFrame:
    """(uri, xml): a flat case element with the scalar fields."""
    safe = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    fields = ["uri", "name", "neutral_citation", "court", "judgment_date"]
    return cases.select("uri", F.concat(F.lit("<case>"), *[F.concat(F.lit(f"<{f}>"), safe(F.col(f)), F.lit(f"</{f}>")) for f in fields], F.lit("</case>")).alias("xml"))
