"""Article markup: JATS bundles and citation records, parsed with the standard library in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skerry.functions import text as tx
from skerry.schemas import ARTICLE

#: Elements whose content isn't text of a section; what follows them is.
SKIPPED = ("table-wrap", "fig")
#: Files whose records are in memory at once.
PIECE_BYTES = 1 << 20
_RAW_DATE = "year string, month string, day string, free string"


def _text(node: ET.Element | None) -> str:
    """All text below an element, without what lies in skipped elements."""
    if node is None:
        return ""
    parts = [node.text or ""]
    for child in node:
        if child.tag not in SKIPPED:
            parts.append(_text(child))
        parts.append(child.tail or "")
    return "".join(parts)


def _plain(node: ET.Element | None) -> str | None:
    return (_text(node).strip() or None) if node is not None else None


def _section(node: ET.Element) -> tuple[str, str] | None:
    title = _text(node.find("title")).strip()
    text = _text(node).strip().removeprefix(title).lstrip()
    return (title, text) if title and text else None


def _sections(parent: ET.Element | None) -> list[tuple[str, str]]:
    return [s for n in (parent.findall("sec") if parent is not None else []) if (s := _section(n))]


def _abstract(article: ET.Element) -> list[tuple[str, str]]:
    node = article.find(".//abstract")
    if node is None:
        return []
    if node.find("sec") is not None:
        return _sections(node)
    text = _text(node).strip()
    return [("Abstract", text)] if text else []


def _identifier(article: ET.Element, *kinds: str) -> str | None:
    for kind in kinds:
        node = article.find(f".//article-id[@pub-id-type='{kind}']")
        if node is not None and (text := (node.text or "").strip().removeprefix("PMC")):
            return text
    return None


def _authors(article: ET.Element) -> list[str]:
    out = []
    for node in article.iterfind(".//contrib[@contrib-type='author']"):
        names = [(_plain(node.find(f".//{part}")) or "") for part in ("surname", "given-names")]
        out.append(", ".join(n for n in names if n))
    return [a for a in out if a]


def parse_article(raw: str | bytes) -> dict:
    """One article; ``ValueError`` without an article or its PMID."""
    root = ET.fromstring(raw)
    article = root if root.tag == "article" else root.find(".//article")
    if article is None:
        raise ValueError("no article")
    return _record(article, need_pmid=True)


def _record(article: ET.Element, need_pmid: bool = False) -> dict:
    pmid = _identifier(article, "pmid")
    if need_pmid and pmid is None:
        raise ValueError("no pmid")
    return {
        "pmid": pmid, "pmcid": _identifier(article, "pmc", "pmcid"), "doi": _identifier(article, "doi"), "title": _plain(article.find(".//article-title")) or "",
        "journal": _plain(article.find(".//journal-title")), "authors": _authors(article), "abstract": _abstract(article), "body": _sections(article.find("body")),
    }


def split_bundle(raw: bytes) -> list[tuple[str, str]]:
    """(pmcid, markup) of the articles of a bundle that have one."""
    root = ET.fromstring(raw)
    found = [root] if root.tag == "article" else root.iterfind(".//article")
    return [(number, ET.tostring(a, encoding="unicode")) for a in found if (number := _identifier(a, "pmc", "pmcid"))]


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """path, error and the article's columns for each ``*.xml`` file; a malformed one has its error and no article."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError(f"no *.xml file in {folder}")
    return parse_files(files)


def in_pieces(of: Callable[[str, bytes], list[dict]], schema: pa.Schema):
    """The rows that ``of`` finds in each file (path, content) of Arrow batches.

    Rows go on as soon as they come of PIECE_BYTES of files, so a task holds the records of few files, or of one
    large file, at a time; the files themselves come in batches whose bytes Spark bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.column("path"), batch.column("content")):
                raw = content.as_py()
                rows += of(path.as_py(), raw)
                size += len(raw)
                if size >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _read_files(files: DataFrame, of: Callable[[str, bytes], list[dict]], result: str) -> DataFrame:
    return files.select("path", "content").mapInArrow(in_pieces(of, to_arrow_schema(StructType.fromDDL(result))), result)


def bundle_articles(files: DataFrame) -> DataFrame:
    """(path, content: binary) to path, at, pmcid, content, error: the articles of bundles; a malformed bundle is one row with its error."""

    def of(path: str, raw: bytes) -> list[dict]:
        try:
            return [{"path": path, "at": k, "pmcid": number, "content": markup.encode()} for k, (number, markup) in enumerate(split_bundle(raw))]
        except ET.ParseError as error:
            return [{"path": path, "at": 0, "error": str(error)}]

    return _read_files(files, of, "path string, at int, pmcid string, content binary, error string")


_COLON = re.compile(r":[A-Za-z_]")


def _prefixes(markup: str) -> set[str]:
    """All that ``[<\\s/]([A-Za-z_][\\w.-]*):[A-Za-z_]`` finds; colons are fewer than words, so names are read back from these."""
    out = set()
    for colon in _COLON.finditer(markup):
        end = start = colon.start()
        while start and (markup[start - 1].isalnum() or markup[start - 1] in "_.-"):
            start -= 1
        before, first = markup[start - 1 : start], markup[start]
        if start < end and (before in ("<", "/") or before.isspace()) and first.isascii() and (first.isalpha() or first == "_"):
            out.add(markup[start:end])
    return out


def _single(piece: str) -> tuple[str | None, str | None, bytes | None]:
    """(pmcid, error, markup) of the article that ends a piece of a bundle; prefixes that the bundle's root declares get names here."""
    begin = re.search(r"<article[\s>]", piece)
    if begin is None:
        return None, "no article begins here", None
    markup = piece[begin.start() :] + "</article>"
    prefixes = {p for p in _prefixes(markup) if p not in ("xml", "xmlns") and f"xmlns:{p}=" not in markup}
    names = "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(prefixes))
    try:
        article = ET.fromstring(f"<article{names}{markup[len('<article') :]}")
    except ET.ParseError as error:
        return None, str(error), None
    return _identifier(article, "pmc", "pmcid"), None, ET.tostring(article)


def _single_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, place, piece) to (path, place, pmcid, content, error): rows go on as soon as they come of PIECE_BYTES of pieces."""

    def batch_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, numbers, errors, markups = zip(*found)
        own = batch.take(pa.array(rows))
        columns = [own.column("path"), own.column("place"), pa.array(numbers, pa.string()), pa.array(markups, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "place", "pmcid", "content", "error"])

    for batch in batches:
        keys, found, size = batch.select(["path", "place"]), [], 0
        for k, piece in enumerate(batch.column("piece")):
            piece = piece.as_py()
            number, error, markup = _single(piece)
            if number or error:
                found.append((k, number, error, markup))
            size += len(piece)
            if size >= PIECE_BYTES and found:
                yield batch_of(keys, found)
                found, size = [], 0
        if found:
            yield batch_of(keys, found)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, place, pmcid, content, error: one row per article of the bundles (UTF-8) that has an identifier, or that can't be parsed.

    A bundle is read in splits, up to the end of each article, so a task holds PIECE_BYTES of articles, or one
    larger article, at a time, however large the bundle; one that is malformed doesn't cost the others.  What
    stands in the root itself isn't looked at.  The order of ``place`` (split, row) is that of the articles in their file.
    """
    rows = spark.read.option("lineSep", "</article>").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    pieces = rows.filter(F.col("value").rlike(r"<article[\s>]")).select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("piece"))

    return pieces.mapInArrow(_single_in_pieces, "path string, place struct<block:bigint,row:bigint>, pmcid string, content binary, error string")


def parse_files(files: DataFrame) -> DataFrame:
    """(path, content: binary) to path, error, article columns."""

    def of(path: str, raw: bytes) -> list[dict]:
        try:
            record = parse_article(raw)
            return [{"path": path, **record, **{k: [{"title": t, "text": x} for t, x in record[k]] for k in ("abstract", "body")}}]
        except (ValueError, ET.ParseError) as error:
            return [{"path": path, "error": str(error)}]

    return _read_files(files, of, f"path string, error string, {ARTICLE}")


def corpus(parsed: DataFrame) -> DataFrame:
    """One article per pmid: of several files the last path counts."""
    good = parsed.filter(F.col("error").isNull())
    record = F.struct(*[c for c in good.columns if c not in ("path", "error")])
    return good.groupBy("pmid").agg(F.max_by(record, "path").alias("a")).select("a.*")


def papers(parsed: DataFrame) -> DataFrame:
    """Metadata of the articles that have a pmid and a title."""
    good = parsed.filter(F.col("pmid").isNotNull() & (F.coalesce("title", F.lit("")) != ""))
    missing = [F.array().cast("array<string>").alias("mesh_terms"), F.lit(None).cast("date").alias("published_at"), F.lit(None).cast("string").alias("full_text")]
    return good.select("pmid", "doi", "title", "journal", "authors", *missing)


def parse_citations(raw: bytes) -> list[dict]:
    """pmid, mesh_terms and the parts of the publication date of each citation."""
    out = []
    for node in ET.fromstring(raw).iterfind(".//PubmedArticle"):
        pmid = _plain(node.find(".//PMID"))
        if pmid is None:
            continue
        terms = [t for d in node.iterfind(".//MeshHeading/DescriptorName") if (t := _text(d).strip())]
        date = node.find(".//JournalIssue/PubDate")
        part = {k: (_plain(date.find(tag)) if date is not None else None) for k, tag in (("year", "Year"), ("month", "Month"), ("day", "Day"), ("free", "MedlineDate"))}
        out.append({"pmid": pmid, "mesh_terms": terms, **part})
    return out


def read_citations(files: DataFrame) -> DataFrame:
    """(content: binary, and path, if there) to pmid, mesh_terms, published_at, path, at (the place in the file)."""

    def of(path: str, raw: bytes) -> list[dict]:
        return [{"path": path, "at": k, **record} for k, record in enumerate(parse_citations(raw))]

    path = F.col("path") if "path" in files.columns else F.lit("").alias("path")
    rows = _read_files(files.select(path, "content"), of, f"path string, at int, pmid string, mesh_terms array<string>, {_RAW_DATE}")
    return rows.select("pmid", "mesh_terms", tx.partial_date(F.col("year"), F.col("month"), F.col("day"), F.col("free")).alias("published_at"), "path", "at")


def enriched(papers_: DataFrame, citations: DataFrame) -> DataFrame:
    """Papers with mesh terms and date: of several citations the last counts, by path and place.

    Citations of unknown papers are left out (see :func:`unknown_citations`).
    """
    last = citations.groupBy("pmid").agg(F.max_by(F.struct("mesh_terms", "published_at"), F.struct("path", "at")).alias("c"))
    terms = F.coalesce("c.mesh_terms", F.array().cast("array<string>"))
    known = papers_.drop("mesh_terms", "published_at").join(last, "pmid", "left")
    return known.withColumn("mesh_terms", terms).withColumn("published_at", F.col("c.published_at")).drop("c")


def unknown_citations(papers_: DataFrame, citations: DataFrame) -> DataFrame:
    return citations.select("pmid").distinct().join(papers_, "pmid", "left_anti")
