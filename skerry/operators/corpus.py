"""Descriptive statistics of a corpus, and one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import text as tx


def title_counts(titles: DataFrame, title: Column, most: int = 30) -> DataFrame:
    """title, n: the most frequent normalised titles; of equally frequent ones the alphabetically first."""
    rows = titles.select(tx.normalised_title(title).alias("title"))
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(most)


def candidate_share(titles: DataFrame, title: Column, candidates: list[str]) -> DataFrame:
    """candidate, n, share: normalised titles that are a candidate or begin with it."""
    rows = titles.select(tx.normalised_title(title).alias("title"))
    hits = [F.count_if(F.startswith("title", F.lit(c))).alias(f"n_{k}") for k, c in enumerate(candidates)]
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *hits)
    each = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(f"n_{k}").alias("n")) for k, c in enumerate(candidates)])
    return counts.select("rows", F.explode(each).alias("c")).select("c.candidate", "c.n", (F.col("c.n") / F.nullif(F.col("rows"), F.lit(0))).alias("share"))


def summary(rows: DataFrame, distinct: list[str], text: str) -> DataFrame:
    """n, distinct values of some columns (nulls don't count), rows with and without a text and their share."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n"), *[F.count_distinct(c).alias(f"{c}s") for c in distinct], F.count(text).alias("with_text"), (F.count(text) / F.nullif(n, F.lit(0))).alias("text_share"),
        F.count_if(F.col(text).isNull()).alias("without_text"),
    )


def described(rows: DataFrame, column: str) -> DataFrame:
    """n, mean, std (of a sample), min, exact quartiles by linear interpolation, max."""
    c = F.col(column)
    quartiles = [F.percentile(c, q).alias(name) for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quartiles, F.max(c).alias("max"))


def quantiles(rows: DataFrame, column: str, at: tuple[float, ...]) -> DataFrame:
    """p<percent> for each share, and the chunks of 1,000 that the values give, each rounded half to even."""
    found = [F.percentile(column, q).alias(f"p{round(100 * q)}") for q in at]
    return rows.agg(*found, F.sum(F.bround(F.col(column) / 1000)).cast("long").alias("est_chunks"))


def extremes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """longest, shortest: the keys of the greatest and the least value; the smaller key where values tie."""
    top = F.max(F.struct(F.col(value), F.bitwise_not(key).alias("i")))["i"]
    return rows.agg(F.bitwise_not(top).alias("longest"), F.min(F.struct(value, key))[key].alias("shortest"))


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def one_per_key(rows: DataFrame, key: Column, order: str, last: bool) -> DataFrame:
    """key and the row that comes last or first in ``order``, as a struct: partial before the shuffle, no sort."""
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key.alias("key")).agg((F.max_by if last else F.min_by)(record, F.col(order)).alias("row"))


def eligible(rows: DataFrame, text: str, least: int) -> DataFrame:
    return rows.filter(F.length(text) >= least)
