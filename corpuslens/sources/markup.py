"""Papers from PubMed and JATS XML, and links from JSON, from raw records.

JSON and HTML are column expressions. XML goes through a parser in Arrow batches, a record at a time: XPath functions fail the whole job
at a record that isn't well formed, and can't keep nested sections in order; here such a record is a row that says what is wrong."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row (xml) for each element with this tag in whole files of saved responses."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("xml"))


def without_citations(xml: Column) -> Column:
    """Bibliographic cross references removed, the text after them kept."""
    mark = r"<xref\b(?=[^>]*\bref-type\s*=\s*[\"']bibr[\"'])"
    return F.regexp_replace(F.regexp_replace(xml, rf"{mark}[^>]*/>", ""), rf"(?s){mark}[^>]*>.*?</xref>", "")


PAPER = "doc_id string, title string, text string, metadata map<string,string>"
PARSED = f"{PAPER}, stage string, identifier string, reason string"


def _whole(element: ET.Element | None) -> str:
    """All text of an element and what is in it, as one string."""
    return "" if element is None else "".join(element.itertext()).strip()


def _lead(root: ET.Element, path: str, default: str = "") -> str:
    """Text of an element before its first child; the default where there is no such element."""
    found = root.find(path)
    return default if found is None else found.text or ""


def _name(prefix: str, known: str, of: str) -> str:
    """An id from a known number, or from the text where there is none."""
    return f"{prefix}_{known}" if known else f"{prefix}_unknown_{hashlib.md5(of.encode()).hexdigest()[:12]}"


def _pubmed(root: ET.Element, whole_titles: bool) -> tuple:
    pmid = _lead(root, ".//PMID")
    title = _whole(root.find(".//ArticleTitle")) if whole_titles else _lead(root, ".//ArticleTitle", "No title")
    abstract = "\n".join(a.text or "" for a in root.iter("AbstractText"))
    about = {"year": _lead(root, ".//PubDate/Year", "Unknown"), "journal": _lead(root, ".//Journal/Title", "Unknown"), "source": "pubmed", "pmid": pmid, "has_full_text": "false"}
    return _name("pmid", pmid, title + abstract), title or "No title", f"Abstract\n{abstract}".strip(), about


def _jats(root: ET.Element, whole_titles: bool) -> tuple | None:
    pmc, pmid = (_lead(root, f".//article-id[@pub-id-type='{kind}']") for kind in ("pmc", "pmid"))
    title = _whole(root.find(".//article-title")) if whole_titles else _lead(root, ".//article-title", "No title")
    dates = [_lead(root, f".//pub-date{kind}/year") for kind in ("[@pub-type='epub']", "[@pub-type='ppub']", "")]
    texts = [t for p in root.iterfind(".//abstract//p") if (t := _whole(p))] or [t for a in root.iterfind(".//abstract") if (t := _whole(a))][:1]
    parts = ["Abstract\n" + "\n".join(texts)] if texts else []
    body = root.find(".//body")
    for section in () if body is None else body.iter("sec"):
        if own := [t for p in section.findall("p") if (t := _whole(p))]:
            head = _lead(section, "title").strip()
            parts.append("\n".join([f"\n{head}" if head else "", *own]))
    text = "\n\n".join(parts).strip()
    if not text:
        return None
    about = {"year": next(filter(None, dates), "Unknown"), "journal": _lead(root, ".//journal-title", "Unknown"), "source": "pubmed_central", "pmcid": pmc, "pmid": pmid, "has_full_text": str(len(parts) > bool(texts)).lower()}
    return _name("pmc", pmc, title + text) if pmc or not pmid else f"pmid_{pmid}", title, text, about


READERS = {"pubmed": _pubmed, "pmc": _jats}


def parsed(articles: DataFrame, kind: str, whole_titles: bool = False) -> DataFrame:
    """One row for each record (xml) of a kind (pubmed: PubmedArticle, pmc: JATS article): a paper, or why it couldn't be read.

    Records without any text give none. Titles end at their first inline mark-up, as long as whole_titles isn't set."""
    read, stage = READERS[kind], f"{kind}_parse"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for xml in batch.column(0).to_pylist():
                try:
                    if (paper := read(ET.fromstring(xml or ""), whole_titles)) is not None:
                        rows.append((*paper[:3], list(paper[3].items()), None, None, None))
                except ET.ParseError as e:
                    rows.append((None, None, None, None, stage, hashlib.md5((xml or "").encode()).hexdigest()[:12], str(e)))
            types = [pa.string()] * 3 + [pa.map_(pa.string(), pa.string())] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names=["doc_id", "title", "text", "metadata", "stage", "identifier", "reason"])

    return articles.select(without_citations(F.col("xml")).alias("xml")).mapInArrow(run, PARSED)


def papers(rows: DataFrame) -> DataFrame:
    """doc_id, title, text, metadata of the records that were read."""
    return rows.where("reason IS NULL").select("doc_id", "title", "text", "metadata")


def errors(rows: DataFrame) -> DataFrame:
    """stage, identifier, reason of the records that weren't."""
    return rows.where("reason IS NOT NULL").select("stage", "identifier", "reason")


def pubmed_papers(articles: DataFrame, full_text_titles: bool = False) -> DataFrame:
    return papers(parsed(articles, "pubmed", full_text_titles))


def jats_papers(articles: DataFrame) -> DataFrame:
    return papers(parsed(articles, "pmc"))


LINKS = "linksets array<struct<ids: array<string>, linksetdbs: array<struct<dbto: string, links: array<string>>>>>"


def pmc_links(responses: DataFrame) -> DataFrame:
    """(pmid, pmcid, error) of rows (pmid, json): the first link into PMC, or why there is none."""
    sets = F.from_json("json", LINKS)
    links = F.flatten(F.transform(sets["linksets"], lambda s: F.coalesce(s["linksetdbs"], F.array())))
    first = F.get(F.filter(links, lambda d: d["dbto"] == "pmc"), F.lit(0))["links"]
    return responses.select("pmid", F.get(first, F.lit(0)).alias("pmcid"), F.when(sets["linksets"].isNull(), F.lit("unreadable response")).alias("error"))


def search_ids(responses: DataFrame) -> DataFrame:
    """PMIDs of search responses (json), in order."""
    found = F.from_json("json", "esearchresult struct<idlist: array<string>>")
    return responses.select(F.posexplode(found["esearchresult"]["idlist"]).alias("no", "pmid"))


def html_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, n_links, text of raw pages; by patterns, as pages needn't be well formed."""
    html = F.coalesce(F.col("html"), F.lit(""))
    one = lambda tag: F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return pages.select("page_id", one("title").alias("title"), one("h1").alias("heading"), F.size(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href="), F.lit(0))).cast("long").alias("n_links"), F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")).alias("text"))
