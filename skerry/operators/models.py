"""Model calls as operators: cached, only for misses, model injected.

A model is a function over one input or a batch.  Its results are kept by :mod:`skerry.operators.answers`
under a digest of the model's name, its options and the input; a call joins the cache and runs the model on
the rows left over, which makes a repeated task harmless.  :class:`Calls` says how: how many at a time
within a task, how often again after errors that may pass, at which temperature.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import labels
from skerry.functions import text as tx
from skerry.operators.answers import Answers

COMPLETION = "text string, prompt_tokens int, completion_tokens int"


@dataclass(frozen=True)
class Calls:
    """How a model is called.

    ``options`` of a chat request go to the model as named arguments, and into the cache's key if they
    change its answers; models named like ``reasoning`` take no temperature.
    """

    threads: int = 1
    batch: int = 100
    attempts: int = 4
    first_wait: float = 1.0
    longest_wait: float = 20.0
    errors: tuple = (OSError,)
    temperature: float | None = None
    most_tokens: int | None = None
    reasoning: tuple[str, ...] = ()
    sleep: Callable[[float], None] = time.sleep

    def again(self, call: Callable) -> Callable:
        return retried(call, self.attempts, self.first_wait, self.longest_wait, self.errors, self.sleep)

    def options(self, model: str) -> dict:
        """Named arguments of each request; none unless a temperature or a limit is set."""
        if self.temperature is None and self.most_tokens is None:
            return {}
        return chat_options(model, self.temperature, self.most_tokens, self.reasoning)


def keyed(rows: DataFrame, model: str, *inputs: str) -> DataFrame:
    return rows.withColumn("cache_key", tx.cache_key(F.lit(model), *[F.col(c) for c in inputs]))


def _whole(column: str) -> Column:
    """A text as it goes into a prompt: null is empty."""
    return F.coalesce(column, F.lit(""))


def cached_call(rows: DataFrame, cache: str, result: str, call: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 100) -> DataFrame:
    """``rows`` (with cache_key) and the columns ``result``; misses are called once per distinct key and kept as their tasks end."""
    kept = Answers(rows.sparkSession, cache, result)
    kept.bring(rows, call, batch)
    return rows.join(kept.found(rows), "cache_key")


def embed(rows: DataFrame, text: str, cache: str, model: str, call: Callable[[list[str]], list[list[float]]], how: Calls = Calls()) -> DataFrame:
    """``rows`` with ``embedding``; a null text is an empty one.

    A call takes ``how.batch`` texts; a task has ``how.threads`` of them under way.
    """
    again, size = how.again(call), how.batch

    def vectors(part: pd.DataFrame) -> pd.DataFrame:
        texts = part["_input"].tolist()
        parts = threaded(again, how.threads)([texts[k : k + size] for k in range(0, len(texts), size)])
        return pd.DataFrame({"embedding": [v for p in parts for v in p]})

    asked = keyed(rows.withColumn("_input", F.coalesce(text, F.lit(""))), model, "_input")
    return cached_call(asked, cache, "embedding array<double>", vectors, size * how.threads).drop("cache_key", "_input")


def complete(rows: DataFrame, system: str, user: str, cache: str, model: str, call: Callable[..., tuple[str, int, int]], how: Calls = Calls()) -> DataFrame:
    """``rows`` with text, prompt_tokens, completion_tokens, total_tokens of the model's answer.

    ``call`` takes system, user and the named arguments of ``how``, which are part of the cache's key.
    """
    options = how.options(model)
    again = how.again(lambda pair: call(*pair, **options))

    def answers(part: pd.DataFrame) -> pd.DataFrame:
        got = threaded(again, how.threads)(list(zip(part[system], part[user])))
        return pd.DataFrame(got, columns=["text", "prompt_tokens", "completion_tokens"])

    name = "|".join([model, *[f"{k}={v}" for k, v in sorted(options.items()) if k != "model"]])
    out = cached_call(keyed(rows, name, system, user), cache, COMPLETION, answers, how.batch).drop("cache_key")
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def enrich(chunks: DataFrame, template: str, cache: str, model: str, call, k: int = 4, how: Calls = Calls()) -> DataFrame:
    """Chunks with ``hq_questions`` from the model and ``enriched`` text."""
    asked = chunks.drop("hq_questions").withColumn("system", F.lit("")).withColumn("user", tx.rendered(template, content=_whole("content"), n=F.lit(str(k))))
    done = complete(asked, "system", "user", cache, model, call, how).withColumn("hq_questions", tx.question_lines(F.col("text"), k))
    return done.select(*chunks.columns).withColumn("enriched", tx.enriched_text(_whole("content"), F.col("hq_questions")))


def rewrite(questions: DataFrame, template: str, cache: str, model: str, call, how: Calls = Calls()) -> DataFrame:
    """qa_id, question, rewritten, tokens."""
    asked = questions.withColumn("system", F.lit("")).withColumn("user", tx.rendered(template, query=_whole("question")))
    done = complete(asked, "system", "user", cache, model, call, how)
    return done.select("qa_id", "question", tx.strip(F.col("text")).alias("rewritten"), F.col("total_tokens").alias("tokens"))


def generate_questions(papers: DataFrame, templates: dict[str, str], cache: str, model: str, call, how: Calls = Calls()) -> DataFrame:
    """qa_id, pmid, question, prompting_strategy of sampled papers (ordinal, strategy, abstract)."""
    user = F.lit("")
    for name, template in templates.items():
        user = F.when(F.col("strategy") == name, tx.rendered(template, abstract=_whole("abstract"))).otherwise(user)
    done = complete(papers.withColumn("system", F.lit("")).withColumn("user", user), "system", "user", cache, model, call, how)
    qa_id = F.concat(F.lit("qa_"), F.when(F.col("ordinal") < 10_000, F.lpad(F.col("ordinal").cast("string"), 4, "0")).otherwise(F.col("ordinal").cast("string")))
    return done.select(qa_id.alias("qa_id"), "pmid", tx.first_question(F.col("text")).alias("question"), F.col("strategy").alias("prompting_strategy"))


def judge(rows: DataFrame, template: str, cache: str, model: str, call, name: str, how: Calls = Calls()) -> DataFrame:
    """``rows`` (question, content) with the boolean column ``name``: the model's verdict on relevance."""
    asked = rows.withColumn("system", F.lit("")).withColumn("user", tx.rendered(template, question=_whole("question"), chunk=_whole("content")))
    done = complete(asked, "system", "user", cache, model, call, how)
    return done.select(*rows.columns, labels.relevant_label("text").alias(name))


def judge_twice(rows: DataFrame, template: str, cache: str, models: tuple[str, str, str], calls: tuple, how: Calls = Calls()) -> DataFrame:
    """judge_a and judge_b of all rows; the third model is called only where these differ.  Each pair is judged once."""
    done = judge(judge(rows, template, cache, models[0], calls[0], "judge_a", how), template, cache, models[1], calls[1], "judge_b", how)
    same = F.col("judge_a").eqNullSafe(F.col("judge_b"))
    differ = judge(done.filter(~same), template, cache, models[2], calls[2], "final", how)
    return done.filter(same).withColumn("final", F.col("judge_a")).unionByName(differ)


def inspected(chunks: DataFrame, position: int, template: str, cache: str, model: str, call, k: int = 4, how: Calls = Calls()) -> DataFrame:
    """What enrichment does to the chunk at a place in the order of identifiers: prompt, answer, questions and enriched text, one row."""
    picked = chunks.orderBy("chunk_id").offset(position).limit(1)
    asked = picked.drop("hq_questions").withColumn("system", F.lit("")).withColumn("prompt", tx.rendered(template, content=_whole("content"), n=F.lit(str(k))))
    done = complete(asked, "system", "prompt", cache, model, call, how).withColumn("questions", tx.question_lines(F.col("text"), k))
    return done.select("chunk_id", "content", "prompt", F.col("text").alias("answer"), "total_tokens", "questions", tx.enriched_text(_whole("content"), F.col("questions")).alias("enriched"))


def retried(call: Callable, attempts: int = 4, first: float = 1.0, most: float = 20.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after errors that may pass; waits double up to ``most`` seconds and vary by up to a second."""

    def run(*arguments, **named):
        for attempt in range(attempts):
            try:
                return call(*arguments, **named)
            except errors:
                if attempt == attempts - 1:
                    raise
                sleep(min(most, first * 2**attempt) + random.random())

    return run


def threaded(call: Callable, threads: int) -> Callable:
    """A call over a list from a call over one element, by several threads within a task; the order stays."""

    def run(values: list) -> list:
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(call, values))

    return run


def chat_options(model: str, temperature: float | None, most_tokens: int | None, reasoning: tuple[str, ...]) -> dict:
    """Named arguments of a chat request; models whose names begin so take no temperature and count reasoning as output."""
    if reasoning and model.startswith(reasoning):
        return {"model": model, "max_completion_tokens": most_tokens}
    return {"model": model, "temperature": temperature, "max_tokens": most_tokens}


def probe(call: Callable[[list[str]], list[list[float]]]) -> int:
    """The dimensions of an embedding model, or an error before any work is done."""
    vectors = call(["probe"])
    if len(vectors) != 1 or not len(vectors[0]):
        raise ValueError("the embedding model gave no vector")
    return len(vectors[0])
