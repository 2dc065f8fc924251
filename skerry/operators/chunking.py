"""Sliding character windows over the sections of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(length: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over ``length`` characters: the last one is the first to reach the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"size {size} and overlap {overlap}: the size must be positive, the overlap not negative and smaller")
    stride = size - overlap
    last = F.greatest(F.ceil((length - size) / stride), F.lit(0)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def chunk(articles: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(pmid, sections: array of title and text) to one row per chunk; windows never cross sections.

    All in one row's arrays until the chunks are exploded: positions need no shuffle.
    """
    found = F.flatten(F.transform("sections", lambda s: F.transform(windows(F.length(F.coalesce(s["text"], F.lit(""))), size, overlap), lambda w: F.struct(
        s["title"].alias("section"), w.alias("char_start"), F.least(w + size, F.length(s["text"])).alias("char_end"), F.substring(s["text"], w + 1, F.lit(size)).alias("content")
    ))))
    rows = articles.select("pmid", F.posexplode(found).alias("position", "c"))
    return rows.select(
        F.concat(F.col("pmid"), F.lit(":"), F.when(F.col("position") < 10_000, F.lpad(F.col("position").cast("string"), 4, "0")).otherwise(F.col("position").cast("string"))).alias("chunk_id"),
        "pmid", "c.section", "position", "c.char_start", "c.char_end", "c.content", F.array().cast("array<string>").alias("hq_questions"),
    )


def article_sections(articles: DataFrame) -> DataFrame:
    """(pmid, sections) of parsed articles: the abstract before the body."""
    return articles.select("pmid", F.concat("abstract", "body").alias("sections"))


def document_sections(docs: DataFrame, by_line: bool = False) -> DataFrame:
    """Documents as articles: one section each, or one for each line that isn't blank."""
    if by_line:
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        sections = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("title"), x.alias("text")))
    else:
        sections = F.array(F.struct(F.lit("Abstract").alias("title"), F.col("text").alias("text")))
    return docs.select(F.col("doc_id").cast("string").alias("pmid"), sections.alias("sections"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """pmid and its chunk ids in order."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "chunk_id")))
    return chunks.groupBy("pmid").agg(F.transform(ordered, lambda x: x["chunk_id"]).alias("chunk_ids"))
