"""Ranked-list metrics over long tables: hits (keys, query_id, rank, item_id), gold (query_id, item_id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions import text as tx

#: Discounts as literals: logarithms of different libraries differ in the last bit.
DEPTH = 1000


def _discount(rank: Column, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(1.0 / math.log2(i + 2)) for i in range(k)]), rank.cast("int"))


def _ideal(n: Column, k: int) -> Column:
    sums, total = [0.0], 0.0
    for i in range(k):
        total += 1.0 / math.log2(i + 2)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(n, F.lit(k)).cast("int") + 1)


def per_query(hits: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("variant",), recall_at=(5, 10), ndcg_at: int = 10, keep_empty: bool = True) -> DataFrame:
    """keys, query_id, n_gold, recall_at_k, mrr, ndcg_at_k: one aggregation per list.

    Queries without gold score 0, or are left out with ``keep_empty=False``.
    """
    right = gold.select("query_id", "item_id").distinct().withColumn("relevant", F.lit(True))
    sizes = right.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = hits.join(right, ["query_id", "item_id"], "left").join(sizes, "query_id", "left" if keep_empty else "inner")
    return of_marked(marked.withColumn("relevant", F.col("relevant").isNotNull()), keys, recall_at, ndcg_at)


def of_marked(marked: DataFrame, keys: tuple[str, ...] = ("variant",), recall_at=(5, 10), ndcg_at: int = 10) -> DataFrame:
    """As :func:`per_query`, of hits that know whether they are ``relevant`` and their query's ``n_gold``."""
    relevant, rank = F.col("relevant"), F.col("rank")
    n = F.coalesce(F.first("n_gold"), F.lit(0))
    gain = F.sum(F.when(relevant & (rank <= ndcg_at), _discount(F.least(rank, F.lit(ndcg_at)), ndcg_at)).otherwise(0.0))
    recalls = [F.when(n > 0, F.count_if(relevant & (rank <= k)) / n).otherwise(0.0).alias(f"recall_at_{k}") for k in recall_at]
    return marked.groupBy(*keys, "query_id").agg(
        n.cast("long").alias("n_gold"), F.count(F.lit(1)).alias("n_retrieved"), *recalls, F.coalesce(F.lit(1.0) / F.min(F.when(relevant, rank)), F.lit(0.0)).alias("mrr"),
        F.when(n > 0, gain / _ideal(n, ndcg_at)).otherwise(0.0).alias(f"ndcg_at_{ndcg_at}"),
    )


def of_labels(hits: DataFrame, labels: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """As :func:`per_query`, where items of a query's own label are relevant, without itself: (item_id, label), (query_id, label).

    Labels are counted instead of listing all items of each query's label.
    """
    counts = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    asked = queries.join(counts, "label").select("query_id", F.col("label").alias("asked_label"), "n_gold").filter("n_gold > 0")
    marked = hits.join(asked, "query_id").join(labels.select("item_id", "label"), "item_id")
    return of_marked(marked.withColumn("relevant", F.col("label") == F.col("asked_label")), keys)


def common(scores: DataFrame, variants: list[str]) -> DataFrame:
    """Scores of the queries that all variants have."""
    mine = scores.filter(F.col("variant").isin(variants))
    everywhere = mine.groupBy("query_id").agg(F.count_distinct("variant").alias("v")).filter(F.col("v") == len(variants))
    return mine.join(everywhere.select("query_id"), "query_id", "left_semi")


def means(scores: DataFrame, metrics: tuple[str, ...] = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10"), keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def scorable(queries: DataFrame, gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries with gold that were searched."""
    return queries.join(gold.select("query_id").distinct(), "query_id", "left_semi").join(hits.select("query_id").distinct(), "query_id", "left_semi")


def collapsed(hits: DataFrame, article: Column, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Hits by article: the first of each article counts, ranks close up.  Comes after the top k."""
    first = hits.withColumn("article", article).groupBy(*keys, "query_id", "article").agg(F.min("rank").alias("first"))
    order = Window.partitionBy(*keys, "query_id").orderBy("first")
    return first.select(*keys, "query_id", F.col("article").alias("item_id"), F.row_number().over(order).alias("rank"))


def latency(rows: DataFrame, value: str, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))


def timed(scores: DataFrame, times: DataFrame, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Scores per query with ``latency_ms`` and ``tokens`` of (keys, query_id, latency_ms, tokens); null where a query wasn't timed."""
    return scores.join(times.select(*keys, "query_id", "latency_ms", "tokens"), [*keys, "query_id"], "left")


def run_metrics(rows: DataFrame, metrics: tuple[str, ...] = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10"), keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Means of a run's :func:`timed` rows: the metrics, avg_latency_ms and avg_tokens over the queries that have them."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics], F.avg("latency_ms").alias("avg_latency_ms"), F.avg("tokens").alias("avg_tokens"))


def deltas(scores: DataFrame, metric: str, baseline: str, epsilon: float = 1e-9) -> DataFrame:
    """variant, query_id, delta, change: against the baseline's score of the same query."""
    base = scores.filter(F.col("variant") == baseline).select("query_id", F.col(metric).alias("base"))
    out = scores.filter(F.col("variant") != baseline).join(base, "query_id").withColumn("delta", F.col(metric) - F.col("base"))
    change = F.when(F.col("delta") > epsilon, "better").when(F.col("delta") < -epsilon, "worse").otherwise("same")
    return out.select("variant", "query_id", "delta", change.alias("change"))


def change_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("better", "worse", "same")],
        F.sum(F.when(F.col("change") == "better", F.col("delta")).otherwise(0.0)).alias("gained"),
        F.sum(F.when(F.col("change") == "worse", F.col("delta")).otherwise(0.0)).alias("lost"), F.avg("delta").alias("mean_delta"),
    )


def with_rewrites(rows: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Deltas with the question as it was and as it was rewritten, and the ratio of their lengths."""
    texts = rewrites.select("query_id", "original", "rewritten", tx.length_ratio(F.col("rewritten"), F.col("original")).alias("ratio"))
    return rows.join(texts, "query_id")


def ordered_changes(rows: DataFrame, change: str, most: int | None = None) -> DataFrame:
    """The queries that got ``worse`` or ``better``, the greatest change first; ``most`` of them, if given."""
    found = rows.filter(F.col("change") == change).orderBy(F.abs("delta").desc(), "variant", "query_id")
    return found if most is None else found.limit(most)


def by_expansion(rows: DataFrame, limit: float = 1.8) -> DataFrame:
    """expanded (whether a rewrite is so many times as long), n, mean_delta."""
    return rows.groupBy((F.col("ratio") >= limit).alias("expanded")).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"))
