"""Readers and writers of questions, labels, runs and lay-question sets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import schemas
from skerry.operators import agreement, ordering
from skerry.sources import files
from skerry.sources.store import Collection  # noqa: F401

_RESERVED = ("question", "question_type")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_labels_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """qa_id, chunk_id, value of filled label sheets, with or without a byte-order mark; other values than 0 and 1 don't count."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip('"') for c in rows.columns])
    value = F.trim(column)
    return rows.filter(value.isin("0", "1")).select("qa_id", "chunk_id", value.cast("int").alias("value"))


def read_ranked_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{query: {variant: [item…]}} as query_id, variant, rank, item_id.

    A file is one such object, however it is laid out, or several that each begin a line; ``lines``
    promises an object per line, as :func:`write_ranked_json` writes them, so that files can be split.
    """
    found = spark.read.text(path, wholetext=not lines)
    if not lines:
        found = found.select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    whole = found.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    rows = whole.select(F.explode("m").alias("query_id", "by")).select("query_id", F.explode("by").alias("variant", "ids"))
    return rows.select("query_id", "variant", F.posexplode("ids").alias("p", "item_id")).select("query_id", "variant", (F.col("p") + 1).alias("rank"), "item_id")


def write_ranked_json(hits: DataFrame, path: str) -> None:
    """The inverse of :func:`read_ranked_json`, a line per query."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"])
    by = hits.groupBy("query_id", "variant").agg(ids.alias("ids")).groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variant", "ids")))).alias("by"))
    by.select(F.to_json(F.create_map("query_id", "by")).alias("value")).write.mode("overwrite").text(path)


class JsonEntries:
    """Cuts one JSON object into its entries, as its text comes in pieces; holds one entry at a time."""

    _MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)

    def __init__(self):
        self.depth, self.quoted, self.held = 0, False, ""

    def feed(self, piece: str) -> Iterator[tuple[str, dict]]:
        """(key, value) of the entries that end in this piece; a piece must not end within an escape."""
        begin = 0
        for mark in self._MARK.finditer(piece):
            sign = mark.group()
            if sign == '"':
                self.quoted = not self.quoted
            elif self.quoted or len(sign) > 1:
                continue
            elif sign in "{[":
                self.depth += 1
                if self.depth == 1:
                    self.held, begin = "", mark.end()
            else:
                self.depth -= 1
                if self.depth == 1:
                    yield from json.loads("{" + (self.held + piece[begin : mark.end()]).lstrip().removeprefix(",") + "}").items()
                    self.held, begin = "", mark.end()
        self.held += piece[begin:]

    def end(self) -> None:
        if self.depth or self.quoted:
            raise ValueError("the JSON object isn't whole")


def lay_rows(qid: str, entry: dict) -> list[tuple[str, str, str, str, str]]:
    """(qid, question, pmid, title, abstract) of an entry; its data is in its keys, whose order counts."""
    return [(qid, entry["question"], pmid, a["Title"], " ".join(a["abstract"].values())) for pmid, a in entry.items() if pmid not in _RESERVED]


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, place, piece: the text of JSON files up to each closing brace; pieces in the order of path and place make up the files.

    Files are read in splits, as lines that end in a brace.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("piece"))


def read_lay_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles: pmid, title, sections), (queries: qid, question, gold_pmids, at); of a pmid the first occurrence counts.

    Order within a file counts, so a file is one task's; it holds one entry of it at a time, the rest is
    sorted by Spark, on disk where it must be.  ``at`` is the place in file and entry.  A file that isn't
    whole is an error; one that lacks nothing but its last brace, before white space, reads as if it had it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entries, n = None, JsonEntries(), 0
        for batch in batches:
            rows = []
            for name, piece in zip(batch["path"], batch["piece"]):
                if name != now:
                    entries.end()
                    now, entries, n = name, JsonEntries(), 0
                # The last piece of a file has no brace after it: only white space may follow the object.
                for qid, entry in entries.feed(piece + "}" if piece.strip() or entries.depth else ""):
                    for row in lay_rows(qid, entry):
                        rows.append((name, n, *row))
                        n += 1
            yield pd.DataFrame(rows, columns=["path", "n", "qid", "question", "pmid", "title", "abstract"])
        entries.end()

    pieces = json_pieces(spark, path).repartition("path").sortWithinPartitions("path", "place").select("path", "piece")
    rows = pieces.mapInPandas(run, "path string, n long, qid string, question string, pmid string, title string, abstract string").withColumn("at", F.struct("path", "n"))
    first = rows.groupBy("pmid").agg(F.min_by(F.struct("title", "abstract"), "at").alias("a"))
    articles = first.select("pmid", "a.title", F.array(F.struct(F.lit("Abstract").alias("title"), F.col("a.abstract").alias("text"))).alias("sections"))
    gold = F.transform(F.sort_array(F.collect_list(F.struct("at", "pmid"))), lambda x: x["pmid"])
    queries = rows.groupBy("qid").agg(F.min_by("question", "at").alias("question"), gold.alias("gold_pmids"), F.min("at").alias("at"))
    return articles, queries


def first_queries(articles: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` queries in file order and the articles that they name."""
    few = queries.orderBy("at").limit(n)
    named = few.select(F.explode("gold_pmids").alias("pmid")).distinct()
    return articles.join(named, "pmid", "left_semi"), few


def write_questions(rows: DataFrame, path: str) -> None:
    """A JSON line per question; the files one after another are in the order of qa_id."""
    rows.orderBy("qa_id").write.mode("overwrite").json(path)


def tagged(name: str, tag: str = "") -> str:
    """The name of a run's file or collection: that of the run without a tag, and the tag."""
    return f"{name}_{tag}" if tag else name


ABLATION = "means array<struct<variant:string,recall_at_5:double,recall_at_10:double,mrr:double,ndcg_at_10:double>>, comparisons array<struct<a:string,b:string,metric:string,mean_a:double,mean_b:double,statistic:double,p_value:double,significant:boolean>>, n_queries long, n_excluded_empty_gold long, run_config map<string,string>"


def write_ablation(means: DataFrame, comparisons: DataFrame, n_queries: int, n_excluded: int, path: str, tag: str = "", run_config: dict | None = None) -> None:
    """One JSON line of a run: means by variant (in their order), comparisons with verdicts, how many queries were scored and left out."""
    m, c = ([f.split(":")[0] for f in part.split("struct<")[1].split(">")[0].split(",")] for part in ABLATION.split(">>")[:2])
    rows = means.agg(F.sort_array(F.collect_list(F.struct(*m))).alias("means"))  # a row per variant
    tests = comparisons.agg(F.sort_array(F.collect_list(F.struct(*c))).alias("comparisons"))  # a row per pair and metric
    config = F.from_json(F.lit(json.dumps(run_config or {})), "map<string,string>")
    one = rows.crossJoin(tests).select("means", "comparisons", F.lit(n_queries).cast("long").alias("n_queries"), F.lit(n_excluded).cast("long").alias("n_excluded_empty_gold"), config.alias("run_config"))
    one.coalesce(1).write.mode("overwrite").json(f"{path}/{tagged('ablation', tag)}")


def read_ablation(spark: SparkSession, path: str, tag: str = "") -> DataFrame:
    return read_jsonl(spark, f"{path}/{tagged('ablation', tag)}", ABLATION)


def write_results(rows: DataFrame, path: str, tag: str) -> None:
    """Per-query results under ``run=<tag>/variant=<v>``."""
    rows.withColumn("run", F.lit(tag)).write.mode("overwrite").partitionBy("run", "variant").json(path)


# The German headers of a numbered sheet.
NUMBERED_SHEET = ("nr", "qa_id", "chunk_id", "frage", "textausschnitt", "relevant", "kommentar")
#: A sheet of so many rows is one file, for a person to fill in; a larger one is as many as Spark makes.
ONE_FILE_ROWS = 5_000


def blind_sheet(sample: DataFrame, questions: DataFrame, chunks: DataFrame, numbered: bool = False) -> DataFrame:
    """What a rater sees of a sample: no judge's label; unknown texts are empty."""
    rows = sample.select("qa_id", "chunk_id")
    if numbered:
        rows = ordering.numbered(rows, ["qa_id", "chunk_id"], "nr", 1)
    rows = rows.join(questions.select("qa_id", "question"), "qa_id", "left").join(chunks.select("chunk_id", F.col("content").alias("chunk_text")), "chunk_id", "left")
    texts = [F.coalesce("question", F.lit("")), F.coalesce("chunk_text", F.lit(""))]
    if not numbered:
        return rows.select("qa_id", "chunk_id", texts[0].alias("question"), texts[1].alias("chunk_text"), F.lit("").alias("human_relevant"))
    columns = [F.col("nr"), F.col("qa_id"), F.col("chunk_id"), *texts, F.lit(""), F.lit("")]
    return rows.select(*[c.alias(n) for c, n in zip(columns, NUMBERED_SHEET)])


def write_sheet(sheet: DataFrame, path: str, mark: bool = False) -> None:
    """A sheet as CSV with a header, in the order of its first column; with ``mark`` a file begins with a byte-order mark.

    Up to ONE_FILE_ROWS rows are one file; more are several, each with the header, that follow each other in order.
    """
    first = sheet.columns[0]
    few = sheet.limit(ONE_FILE_ROWS + 1).count() <= ONE_FILE_ROWS
    rows = sheet.orderBy(first)
    rows = rows.coalesce(1) if few else rows
    rows = rows.withColumnRenamed(first, f"\ufeff{first}") if mark else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_run(spark: SparkSession, path: str, **settings) -> None:
    """The settings of a run as one JSON line."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> dict:
    """The settings of :func:`write_run`; empty if there are none."""
    if not files.exists(spark, path):
        return {}
    return json.loads(spark.read.text(path).first()["value"])


def write_articles(articles: DataFrame, path: str) -> None:
    """A JSON object per article and line."""
    articles.write.mode("overwrite").json(path)


def read_article_statistics(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, sections and characters of abstract and body, from :func:`write_articles`."""
    rows = spark.read.schema(schemas.ARTICLE).option("mode", "FAILFAST").json(path)

    def chars(name: str):
        return F.aggregate(F.coalesce(name, F.array()), F.lit(0), lambda n, s: n + F.length(F.coalesce(s["text"], F.lit(""))))

    count = [F.size(F.coalesce(c, F.array())).alias(f"n_{c}_sections") for c in ("abstract", "body")]
    return rows.select("pmid", "title", "journal", *count, chars("abstract").alias("abstract_chars"), chars("body").alias("body_chars"))


def section_histogram(articles: DataFrame) -> DataFrame:
    """n, articles and share of articles by number of abstract sections."""
    counts = articles.groupBy(F.size(F.coalesce("abstract", F.array())).alias("n_sections")).agg(F.count(F.lit(1)).alias("articles"))
    total = counts.agg(F.sum("articles").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("n_sections", "articles", F.bround(F.col("articles") / F.col("total"), 2).alias("share"))


def write_enrichment(chunks: DataFrame, path: str) -> None:
    """A line {chunk_id: {content, hq_questions}} per chunk."""
    entry = F.create_map("chunk_id", F.struct("content", "hq_questions"))
    chunks.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def write_rewrites(rows: DataFrame, path: str) -> None:
    """A line {qa_id: {original, rewritten}} per question."""
    entry = F.create_map("qa_id", F.struct(F.col("question").alias("original"), "rewritten"))
    rows.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def write_gold(labels: DataFrame, report: DataFrame, path: str) -> None:
    """labels, gold (query_id, relevant_ids) and report, each as JSON lines below ``path``."""
    labels.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in labels.dtypes]).write.mode("overwrite").json(f"{path}/labels")
    agreement.gold_lists(labels).write.mode("overwrite").json(f"{path}/gold")
    rounded = [F.bround(c, 4).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes]
    report.select(*rounded).write.mode("overwrite").json(f"{path}/report")


def ordered_ids(rows: DataFrame, column: str) -> DataFrame:
    """Distinct identifiers, shorter ones first."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.length(column), column)


def write_ids(rows: DataFrame, column: str, path: str) -> None:
    """An identifier per line, in the order of :func:`ordered_ids`."""
    ordered_ids(rows, column).write.mode("overwrite").text(path)


@lru_cache(maxsize=64)
def prompt(path: str) -> str:
    return Path(path).read_text(encoding="utf-8").strip()


def query_string(domain: str) -> str:
    return f"{domain}[MeSH] AND open access[filter] AND english[lang]"
