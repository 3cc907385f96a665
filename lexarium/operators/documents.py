"""XML and HTML documents: metadata, sections, node tables, plain text, structure checks, streaming events, hierarchies."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import xml.parsers.expat
import xml.sax
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised
from ..functions.text import c

# Citations looked for in documents, and judges named in a preface.
DOCUMENT_CITATIONS = [
    r"\[(?:19|20)\d{2}\]\s+(?:UKSC|UKHL|EWCA|EWHC|UKUT|UKFTT)\s+\d+",
    r"\[(?:19|20)\d{2}\]\s+\d+\s+(?:WLR|All ER|AC|Ch|QB|Cr App R)",
    r"(?:19|20)\d{2}\s+(?:SLT|SC|SCLR)\s+\d+",
]
PREFACE_JUDGE = r"(?:Lord|Lady|Mr Justice|Mrs Justice|Sir|Dame)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
#: Paragraphs and characters of one that a section lists.
PARAGRAPHS, CUT = 20, 500


def _parsed(text: str | None) -> ET.Element | None:
    try:
        root = ET.fromstring(text) if text else None
    except ET.ParseError:
        return None
    if root is not None:
        for e in root.iter():
            if "}" in e.tag:
                e.tag = e.tag.rpartition("}")[2]
    return root


def _text(e: ET.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def metadata_of(root: ET.Element) -> dict:
    first = lambda tag: next(root.iter(tag), None)
    every = lambda tag: [t for e in root.iter(tag) if (t := _text(e))]
    or_default = lambda e, default: default if e is None else _text(e)
    citation = or_default(first("neutralCitation"), "Unknown")
    date, uri, preface = first("FRBRdate"), first("FRBRuri"), first("preface")
    judges = every("judge") or (re.findall(PREFACE_JUDGE, _text(preface))[:5] if preface is not None else [])
    return {
        "neutral_citation": citation, "court": or_default(first("court"), "Unknown Court"), "date": (date.get("date") if date is not None else None) or "2023-01-01", "judges": judges,
        "case_name": or_default(first("docTitle"), "Unknown Case"), "uri": (uri.get("value") if uri is not None else None) or "/judgment/" + citation.replace(" ", "_"), "keywords": every("keyword"),
    }


def sections_of(root: ET.Element) -> list[dict]:
    out = []
    for kind, title in (("preface", "Document Header"), ("body", "Judgment Body"), ("conclusions", "Conclusions")):
        e = next(root.iter(kind), None)
        if e is None:
            continue
        paragraphs, content = [], _text(e)
        if kind == "body":
            found = list(e.iter("paragraph"))
            content = f"{len(found)} paragraphs"
            for i, p in enumerate(found[:PARAGRAPHS], 1):
                if t := _text(p):
                    paragraphs.append({"paragraph_id": f"para_{i}", "content": t[:CUT] + "..." * (len(t) > CUT), "word_count": len(t.split())})
        out.append({"type": kind, "title": title, "content": content, "paragraphs": paragraphs})
    return out


@vectorised("error string, neutral_citation string, court string, date string, judges array<string>, case_name string, uri string, keywords array<string>")
def metadata(xml_text: pd.Series) -> pd.DataFrame:
    """The header of a document, or what was wrong with it."""
    columns = ["error", "neutral_citation", "court", "date", "judges", "case_name", "uri", "keywords"]
    parsed = [_parsed(t) for t in xml_text]
    return pd.DataFrame([dict.fromkeys(columns) | ({"error": "not well-formed"} if r is None else metadata_of(r)) for r in parsed], columns=columns, dtype=object)


@vectorised("array<struct<type:string,title:string,content:string,paragraphs:array<struct<paragraph_id:string,content:string,word_count:int>>>>")
def sections(xml_text: pd.Series) -> pd.Series:
    return pd.Series([[] if (r := _parsed(t)) is None else sections_of(r) for t in xml_text], dtype=object)


#: Nodes and characters of their texts that a batch of a node table holds at most, but for a single node's.
BATCH_NODES, BATCH_CHARACTERS = 8192, 1 << 24


def nodes_of(start: ET.Element, cut: int | None = None) -> Iterator[tuple]:
    """(number, parent, depth, path, tag, attributes, text) of an element and all below it in document order. A text is a slice of
    the text of the whole, so that each character is joined once."""
    nodes, ends, pieces, length = [], {}, [], 0
    todo = [(start, None, 0, "0001")]
    while todo:
        e, parent, depth, path = todo.pop()
        if depth < 0:  # the end of the node whose number stands for the parent
            ends[parent] = length
            tail = e.tail if parent else None
            if tail:
                pieces.append(tail)
                length += len(tail)
            continue
        number = len(nodes)
        nodes.append((number, parent, depth, path, e.tag, e.attrib, length))
        if e.text:
            pieces.append(e.text)
            length += len(e.text)
        if len(e):
            todo.append((e, number, -1, ""))
            todo.extend(reversed([(kid, number, depth + 1, f"{path}.{i:04d}") for i, kid in enumerate(e, 1)]))
        else:
            ends[number] = length
            if e.tail and number:
                pieces.append(e.tail)
                length += len(e.tail)
    whole = "".join(pieces)
    for number, *rest, at in nodes:
        yield number, *rest, whole[at : ends[number]].strip()[:cut]


def xml_nodes(docs: DataFrame, column: str = "xml", cut: int | None = None) -> DataFrame:
    """(doc_id, node_id, parent_id, depth, path, tag, attributes, text): the whole tree, in order of doc_id and document order;
    texts are whole too, or cut at so many characters."""
    fields = ["node_id", "parent_id", "depth", "path", "tag", "attributes", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, places, size = batch.column("doc_id"), [], [], 0

            def held() -> pa.RecordBatch:
                columns = [pa.array([list(x.items()) for x in values] if n == "attributes" else values, kind) for n, kind, values in zip(fields, kinds, zip(*rows, strict=True), strict=True)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(places)), *columns], ["doc_id", *fields])

            for place, text in enumerate(batch.column(column)):
                root = _parsed(text.as_py())
                start = root if root is None or root.tag in ("akomaNtoso", "judgment") else next((e for e in root.iter() if e.tag in ("akomaNtoso", "judgment")), None)
                for row in nodes_of(start, cut) if start is not None else ():
                    rows.append(row)
                    places.append(place)
                    size += len(row[-1])
                    if len(rows) >= BATCH_NODES or size >= BATCH_CHARACTERS:
                        yield held()
                        rows, places, size = [], [], 0
            if rows:
                yield held()

    # Documents are put in order, not the nodes: those are more, and Spark would parse once more to sample them.
    ordered = docs.select("doc_id", column).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(walk, f"doc_id {id_type}, node_id long, parent_id long, depth int, path string, tag string, attributes map<string,string>, text string")


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[tuple[str, int]] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.rows.append((tag, self.depth))
        if tag not in ("meta", "br", "img", "input", "link", "hr"):
            self.depth += 1

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, position, tag, depth) of the elements of pages that need not be well-formed."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, text in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Elements()
                parser.feed(text or "")
                rows += [(page_id, i, tag, depth) for i, (tag, depth) in enumerate(parser.rows)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "tag", "depth"])

    return pages.select("page_id", "html").mapInPandas(walk, "page_id long, position int, tag string, depth int")


def plain_text(markup: Column | str, cut: int = 5000) -> Column:
    """Text without scripts, styles and tags, white space collapsed, cut off."""
    bare = F.regexp_replace(F.regexp_replace(c(markup), r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, cut)


def document_citations(text: Column | str) -> Column:
    """The first ten citations of each pattern, distinct and sorted."""
    found = [F.slice(F.regexp_extract_all(c(text), F.lit(f"(?i)({p})"), F.lit(1)), 1, 10) for p in DOCUMENT_CITATIONS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def missing_elements(text: str) -> list[str]:
    """What a judgment document lacks, by an event for each element and without a tree."""
    lacking = {tag: f"Missing {tag} element" for tag in ("judgment", "meta", "FRBRWork")}
    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler = lambda name, _: lacking.pop(name.rpartition(":")[2], None)
    parser.Parse(text, True)
    return list(lacking.values())


@vectorised("array<string>")
def structure_errors(xml_text: pd.Series) -> pd.Series:
    """What a judgment document lacks among judgment, meta and FRBRWork; the text must be well-formed, and one that is null or empty lacks nothing."""
    return pd.Series([missing_elements(t) if t else [] for t in xml_text], dtype=object)


class _Events(xml.sax.ContentHandler):
    """Collects metadata texts inside meta and a row for each paragraph, without a tree."""

    WANTED = ("FRBRuri", "FRBRdate", "judge")

    def __init__(self):
        super().__init__()
        self.found: dict[str, list[str]] = {k: [] for k in self.WANTED}
        self.events: list[tuple[int, str]] = []
        self.inside, self.open, self.text = 0, None, []

    def startElement(self, name, attrs):  # noqa: N802
        name = name.rpartition(":")[2]
        self.inside += name == "meta"
        if name == "paragraph":
            self.events.append((len(self.events) + 1, attrs.get("id") or attrs.get("eId") or ""))
        self.open, self.text = (name, []) if self.inside and name in self.WANTED else (self.open, self.text)

    def characters(self, content):
        if self.open:
            self.text.append(content)

    def endElement(self, name):  # noqa: N802
        name = name.rpartition(":")[2]
        if name == self.open:
            self.found[name].append("".join(self.text).strip())
            self.open = None
        self.inside -= name == "meta"


def streamed(docs: DataFrame, column: str = "xml") -> DataFrame:
    """(doc_id, parse_successful, error, uri, date, judges, paragraphs array<struct<number, id>>) by events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch[column], strict=True):
                handler, error = _Events(), None
                try:
                    xml.sax.parseString((text or "").encode(), handler)
                except xml.sax.SAXParseException as e:
                    error = e.getMessage()
                last = lambda k, h=handler: h.found[k][-1] if h.found[k] else None
                rows.append((doc_id, error is None, error, last("FRBRuri"), last("FRBRdate"), handler.found["judge"], [{"number": n, "id": i} for n, i in handler.events]))
            yield pd.DataFrame(rows, columns=["doc_id", "parse_successful", "error", "uri", "date", "judges", "paragraphs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", column).mapInPandas(run, f"doc_id {id_type}, parse_successful boolean, error string, uri string, date string, judges array<string>, paragraphs array<struct<number:int,id:string>>")


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, parent_id, position) with path and depth, level by level from the roots; order by path is depth first."""
    step = lambda position: F.lpad(position.cast("string"), 8, "0")
    level = nodes.filter("parent_id IS NULL").withColumns({"path": step(F.col("position")), "depth": F.lit(0)}).checkpoint()
    out = level
    while not level.isEmpty():
        above = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_p"), F.col("depth").alias("_d"))
        level = nodes.join(above, "parent_id").select(*nodes.columns, F.concat_ws(".", "_p", step(F.col("position"))).alias("path"), (F.col("_d") + 1).alias("depth")).checkpoint()
        out = out.unionByName(level)
    return out


def of_type(nodes: DataFrame, kind: str, column: str = "tag") -> DataFrame:
    """The nodes of a type, roots included, in the order of the nodes: that of xml_nodes is by document and depth first."""
    return nodes.filter(F.col(column) == kind)


def record(docs: DataFrame, column: str = "xml") -> DataFrame:
    """(doc_id, header, sections, citations): a document as one record."""
    return docs.select("doc_id", metadata(column).alias("header"), sections(column).alias("sections"), document_citations(column).alias("citations"))
