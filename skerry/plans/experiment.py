"""The experiment end to end: two collections, four variants of retrieval, pools, gold and verdicts.

Phases meet in written tables: embedding and model calls are made once, and a lost executor costs
tasks, not phases.  Collections serve two variants each, so each is read by one search that asks
original and rewritten questions together.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry import workspace
from skerry.config import Settings
from skerry.operators import agreement, metrics, pooling, statistics, vector_search
from skerry.schemas import VARIANTS

#: (item_id, text) to (item_id, vector).
Embedder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    hits: DataFrame
    pool: DataFrame
    labels: DataFrame
    agreement: DataFrame
    per_query: DataFrame
    means: DataFrame
    comparisons: DataFrame
    robustness: DataFrame
    excluded: DataFrame


def collections(chunks: DataFrame, embed: Embedder) -> dict[bool, DataFrame]:
    """Plain and enriched collection of (item_id, content, enriched), written at the same time: neither waits for the other's last tasks."""
    texts = {False: "content", True: "enriched"}

    def written(text: str) -> DataFrame:
        return workspace.materialize(embed(chunks.select("item_id", F.col(text).alias("text"))), f"collection-{text}")

    with ThreadPoolExecutor(len(texts)) as pool:
        return dict(zip(texts, pool.map(inheritable_thread_target(chunks.sparkSession)(written), texts.values())))


def retrieve(questions: DataFrame, stores: dict[bool, DataFrame], embed: Embedder, k: int = 10) -> DataFrame:
    """(query_id, question, rewritten) to variant, query_id, item_id, rank, score.

    Questions without a text in one of the forms ask with an empty one.
    """
    forms = {False: "question", True: "rewritten"}
    asked = None
    for new, text in forms.items():
        vectors = embed(questions.select(F.col("query_id").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
        one = vectors.select(F.col("item_id").alias("id"), F.lit(new).alias("new"), "vector")
        asked = one if asked is None else asked.unionByName(one)
    asked = workspace.materialize(asked, "asked")
    keys = asked.select(F.concat(F.when(F.col("new"), "1:").otherwise("0:"), F.col("id").cast("string")).alias("query_id"), "vector")
    kind = asked.schema["id"].dataType
    out = None
    for rich, items in stores.items():
        hits = vector_search.topk_block(keys, items, k)
        new = F.col("query_id").startswith("1:")
        names = {form: next(v for v, (r, n) in VARIANTS.items() if (r, n) == (rich, form)) for form in forms}
        variant = F.when(new, names[True]).otherwise(names[False])
        part = hits.select(variant.alias("variant"), F.substr("query_id", F.lit(3)).cast(kind).alias("query_id"), "item_id", "rank", "score")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(hits: DataFrame, labels: DataFrame, questions: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """per_query, means (over the questions that all variants have), comparisons, robustness and excluded (questions without gold or hits)."""
    gold = labels.filter("final").select("query_id", "item_id")
    kept = metrics.scorable(questions.select("query_id"), gold, hits)
    scores = workspace.materialize(metrics.per_query(hits.join(kept, "query_id", "left_semi"), gold, keep_empty=False), "scores")
    variants = list(VARIANTS)
    pairs = statistics.variant_pairs(scores, variants)
    tests = len(variants) * (len(variants) - 1)
    return {
        "per_query": scores,
        "means": metrics.means(metrics.common(scores, variants)),
        "comparisons": statistics.ablation(scores, variants, settings.alpha),
        "robustness": statistics.robustness(pairs, tests, settings.alpha),
        "excluded": questions.select("query_id").join(kept, "query_id", "left_anti"),
    }


def checked(chunks: DataFrame, settings: Settings, *credentials: str) -> DataFrame:
    """``chunks``, if an experiment can begin: enough hits for the pools, any chunk, all ``credentials`` (names of settings)."""
    if settings.top_k < settings.pool_depth:
        raise ValueError(f"{settings.top_k} hits don't fill a pool of depth {settings.pool_depth}")
    settings.require(*credentials)
    if chunks.isEmpty():
        raise ValueError("there are no chunks to search")
    return chunks


def run(chunks: DataFrame, questions: DataFrame, source: DataFrame, embed: Embedder, judge: Callable[[DataFrame], DataFrame], settings: Settings = Settings()) -> Outcome:
    """Chunks (item_id, content, enriched), questions (query_id, question, rewritten), source (query_id, pos, item_id).

    ``judge`` takes pool rows with question and content and adds judge_a, judge_b and final.
    """
    checked(chunks, settings)
    hits = workspace.materialize(retrieve(questions, collections(chunks, embed), embed, settings.top_k), "hits")
    pool = workspace.materialize(pooling.require_known(pooling.pool(source, hits, settings.pool_depth), chunks), "pool")
    rows = pool.join(chunks.select("item_id", "content"), "item_id").join(questions.select("query_id", "question"), "query_id")
    labels = workspace.materialize(judge(rows).select("query_id", "pos", "item_id", "judge_a", "judge_b", "final"), "labels")
    found = evaluate(hits, labels, questions, settings)
    return Outcome(hits, pool, labels, agreement.report(labels, "judge_a", "judge_b"), **found)
