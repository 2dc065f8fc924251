"""Pools for judging: a question's source chunks, then what the variants found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pool(source: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, pos, item_id), (query_id, rank, item_id): query_id, pos, item_id, from_source.

    Source items keep their order, first occurrence; the rest of the top ``depth`` follows sorted.
    """
    own = source.select("query_id", "item_id", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("place"))
    found = hits.filter(F.col("rank") <= depth).select("query_id", "item_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"))
    first = own.union(found).groupBy("query_id", "item_id").agg(F.min(F.struct("kind", "place")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.kind", "at.place", "item_id")
    return first.select("query_id", (F.row_number().over(order) - 1).alias("pos"), "item_id", (F.col("at.kind") == 0).alias("from_source"))


def source_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, item_ids: the chunks of each question's own article, in order; empty where it has none.

    (query_id, pmid), (item_id, pmid, position).  A question without a pmid has no article.
    """
    mine = questions.select("query_id", "pmid").join(chunks.select("item_id", "pmid", "position"), "pmid", "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("item_id").isNotNull(), F.struct("position", "item_id"))))
    return mine.groupBy("query_id").agg(F.transform(ordered, lambda c: c["item_id"]).alias("item_ids"))


def of_lists(lists: DataFrame) -> DataFrame:
    """(query_id, item_ids) as the source of :func:`pool`: query_id, item_id, pos."""
    return lists.select("query_id", F.posexplode("item_ids").alias("pos", "item_id"))


def size_statistics(rows: DataFrame) -> DataFrame:
    """mean_size, max_size, queries of the pools that have any row."""
    sizes = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), F.count(F.lit(1)).alias("queries"))


def missing(pool_rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """item_id of the pooled items that the corpus lacks."""
    return pool_rows.select("item_id").distinct().join(corpus.select("item_id"), "item_id", "left_anti")


def require_known(pool_rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """``pool_rows``, if the corpus has all of their items; else an error that counts the missing ones."""
    n = missing(pool_rows, corpus).count()
    if n:
        raise ValueError(f"{n} pooled items aren't in the corpus; were other articles chunked?")
    return pool_rows
