"""Paired tests on per-query scores, many comparisons at once.

Input is long: (a, b, metric, query_id, x, y).  Differences are taken once from the same doubles and
ranked exactly; only the distribution functions, one value per comparison, run in Python.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

KEYS = ("a", "b", "metric")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if i and abs(1 - c * d) < 1e-16:
            break
    return front * (value - 1)


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: normal_two_sided(v) if v == v else 1.0)


#: Up to so many pairs without ties or zeros the signed-rank distribution is counted out.
EXACT_PAIRS = 50


@lru_cache(EXACT_PAIRS + 1)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """For each sum, the sets of ranks 1 to ``n`` that have it."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
    return tuple(ways)


def signed_rank_two_sided(n: int, statistic: float) -> float:
    """The chance of the smaller rank sum being at most ``statistic``, on either side."""
    return min(1.0, 2 * sum(signed_rank_counts(n)[: int(statistic) + 1]) / 2**n)


@pandas_udf(DoubleType())
def _exact_p(n: pd.Series, statistic: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_two_sided(int(k), t) if k > 0 else 1.0 for k, t in zip(n, statistic)])


@pandas_udf(DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, n) if a == a else 1.0 for a, n in zip(t, df)])


def wilcoxon_parts(pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """keys, pairs, n, mean_a, mean_b, statistic, z, exact: the signed-rank test without zeros, tie-corrected.

    ``exact`` is whether the distribution itself applies: few pairs, none of them equal, no two differences of one size.

    Fewer than two pairs, or no difference at all, give statistic 0 and no z.  With ``digits``
    differences are rounded first, where scores are sums that came in any order.

    Pairs are summed up by the size of their difference, partially before the shuffle; only the
    distinct sizes of a comparison are put in order.
    """
    difference = F.col("x") - F.col("y")
    d = pairs.withColumn("d", difference if digits is None else F.round(difference, digits))
    sizes = d.groupBy(*KEYS, F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.sum("x").alias("x"), F.sum("y").alias("y")
    )
    used = F.col("size") > 0
    below = F.coalesce(F.sum(F.when(used, F.col("t"))).over(Window.partitionBy(*KEYS).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank, t = below + (F.col("t") + 1) / 2, F.col("t")
    ranked = sizes.withColumn("rank", rank)
    out = ranked.groupBy(*KEYS).agg(
        F.sum("t").alias("pairs"), F.coalesce(F.sum(F.when(used, t)), F.lit(0)).alias("n"), (F.sum("x") / F.sum("t")).alias("mean_a"), (F.sum("y") / F.sum("t")).alias("mean_b"),
        F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * F.col("down")).alias("minus"), F.sum(F.when(used, t * (t * t - 1)).otherwise(0)).alias("tied"),
    )
    n = F.col("n").cast("double")
    sigma = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tied") / 2) / 24)
    good = (F.col("pairs") >= 2) & (F.col("n") > 0)
    low = F.least("plus", "minus")
    z = F.when(good & (sigma > 0), (low - n * (n + 1) / 4) / F.nullif(sigma, F.lit(0.0)))
    exact = good & (F.col("pairs") <= EXACT_PAIRS) & (F.col("n") == F.col("pairs")) & (F.col("tied") == 0)
    return out.select(*KEYS, "pairs", "n", "mean_a", "mean_b", F.when(good, low).otherwise(0.0).alias("statistic"), z.alias("z"), exact.alias("exact"))


def wilcoxon(pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """:func:`wilcoxon_parts` with ``p_value``: counted out where ``exact``, else by the normal approximation."""
    parts = wilcoxon_parts(pairs, digits)
    exact = _exact_p(F.when(F.col("exact"), F.col("n")).otherwise(0), F.col("statistic"))
    return parts.withColumn("p_value", F.when(F.col("exact"), exact).otherwise(_normal_p("z"))).drop("exact")


def ttest_parts(pairs: DataFrame) -> DataFrame:
    """keys, n, mean_a, mean_b, statistic of the paired t-test; degenerate pairs give 0 and null df."""
    d = F.col("x") - F.col("y")
    out = pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.max(F.abs(d)).alias("most"))
    good = (F.col("n") >= 2) & (F.col("most") > 0)
    error = F.col("s") / F.sqrt("n")
    t = F.when(error > 0, F.col("m") / F.nullif(error, F.lit(0.0))).otherwise(F.signum("m") * F.lit(math.inf))  # differences that are all the same
    return out.select(*KEYS, "n", "mean_a", "mean_b", F.when(good, t).otherwise(0.0).alias("statistic"), F.when(good, F.col("n") - 1).cast("double").alias("df"))


def ttest(pairs: DataFrame) -> DataFrame:
    t = F.when(F.col("df").isNotNull(), F.col("statistic"))
    return ttest_parts(pairs).withColumn("p_value", _student_p(t, F.coalesce("df", F.lit(1.0))))


def variant_pairs(scores: DataFrame, variants: list[str], metrics: tuple[str, ...] = ("recall_at_10", "ndcg_at_10")) -> DataFrame:
    """(a, b, metric, query_id, x, y) for each unordered pair of variants, in their order, of the queries that all variants have.

    The scores of a query are put into one row, from which the pairs come: one shuffle, no join.
    """
    of = {v: F.col("variant") == v for v in variants}
    cells = [F.max(F.when(of[v], F.col(m))).alias(f"{m}_{i}") for i, v in enumerate(variants) for m in metrics]
    wide = scores.filter(F.col("variant").isin(variants)).groupBy("query_id").agg(F.count_distinct("variant").alias("present"), *cells).filter(F.col("present") == len(variants))
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("metric"), F.col(f"{m}_{i}").alias("x"), F.col(f"{m}_{j}").alias("y"))
        for i, a in enumerate(variants) for j, b in enumerate(variants) if i < j for m in metrics
    ]
    return wide.select("query_id", F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b", "p.metric", "query_id", "p.x", "p.y")


def bonferroni(tests: DataFrame, comparisons: int, alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("significant", F.col("p_value") < F.lit(alpha / comparisons))


def ablation(scores: DataFrame, variants: list[str], alpha: float = 0.05, digits: int | None = None) -> DataFrame:
    """All pairs and primary metrics with their test and Bonferroni verdict."""
    n = len(variants) * (len(variants) - 1)  # pairs times two metrics
    return bonferroni(wilcoxon(variant_pairs(scores, variants), digits), n, alpha)


def robustness(pairs: DataFrame, comparisons: int, alpha: float = 0.05, digits: int | None = None) -> DataFrame:
    """Verdicts of both tests side by side, and whether they differ."""
    w = bonferroni(wilcoxon(pairs, digits), comparisons, alpha).select(*KEYS, F.col("p_value").alias("p_wilcoxon"), F.col("significant").alias("by_wilcoxon"))
    t = bonferroni(ttest(pairs), comparisons, alpha).select(*KEYS, F.col("p_value").alias("p_ttest"), F.col("significant").alias("by_ttest"))
    return w.join(t, list(KEYS)).withColumn("flipped", F.col("by_wilcoxon") != F.col("by_ttest"))


def flips(verdicts: DataFrame) -> DataFrame:
    """comparisons, flipped: how many verdicts of :func:`robustness` differ."""
    return verdicts.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if("flipped").alias("flipped"))
