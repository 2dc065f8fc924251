"""Deterministic samples.  Order comes from a hash of seed and key, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace


def place(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(place(seed, F.col(key)), key).limit(n)


def round_robin(rows: DataFrame, key: str, n: int, seed: int, choices: int) -> DataFrame:
    """The first ``n`` in hash order with ``ordinal`` and ``choice`` (ordinal modulo ``choices``).

    The sample is bounded by ``n``, so numbering it in one partition is.
    """
    picked = sample(rows, key, n, seed)
    ordinal = F.row_number().over(Window.orderBy(place(seed, F.col(key)), key)) - 1
    return picked.withColumn("ordinal", ordinal).withColumn("choice", F.col("ordinal") % choices)


def quotas(n: int, available: int) -> dict[str, int]:
    """Half for disagreements, the rest shared by the other two; only what disagreements lack is passed on."""
    disagree = min(n // 2, available)
    rest = n - disagree
    return {"disagree": disagree, "agree_rel": rest - rest // 2, "agree_not": rest // 2}


def stratified(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """A sample of (…, stratum) by :func:`quotas`.

    The largest quota is a literal limit on each stratum's order, so every task sends on at most so many
    rows of a stratum; the stratum's own quota is taken of what arrives.
    """
    share = quotas(n, rows.filter("stratum = 'disagree'").limit(n).count())
    limit = F.create_map(*[F.lit(x) for item in share.items() for x in item])
    order = Window.partitionBy("stratum").orderBy(place(seed, *[F.col(k) for k in key]), *key)
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(share.values()))
    return few.filter(F.col("nth") <= limit[F.col("stratum")]).drop("nth")


def shuffled(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A sample with its place in a hash order; samples are bounded, so one partition numbers them."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(place(seed, *[F.col(k) for k in key]), *key)))


def capped(rows: DataFrame, key: list[str], n: int, seed: int, most: int, question: str = "qa_id") -> DataFrame:
    """A sample of (…, stratum) of ``n`` rows: half disagreements, the rest shared, nothing passed on.

    At most ``most`` rows of a question are taken over all strata.  A row of a stratum is open if fewer
    rows of its question precede it there than earlier strata have left; the first open ones are taken.
    Rows that a step takes are bounded by ``n`` and written, so the next one counts them once.
    """
    rest = n - n // 2
    order = [place(seed, *[F.col(k) for k in key]), *key]
    out = None
    for stratum, target in (("disagree", n // 2), ("agree_rel", rest - rest // 2), ("agree_not", rest // 2)):
        mine = rows.filter(F.col("stratum") == stratum).withColumn("nth", F.row_number().over(Window.partitionBy(question).orderBy(*order)))
        mine = mine.filter(F.col("nth") <= most)
        if out is not None:
            used = out.groupBy(F.col(question).alias("used_question")).agg(F.count(F.lit(1)).alias("used"))
            mine = mine.join(F.broadcast(used), F.col(question).eqNullSafe(F.col("used_question")), "left").filter(F.col("nth") <= most - F.coalesce("used", F.lit(0)))
        took = workspace.materialize(mine.orderBy(*order).limit(target).select(*rows.columns), "capped")
        out = took if out is None else out.unionByName(took)
    return out


def questions_in(sample_rows: DataFrame, question: str = "qa_id") -> DataFrame:
    """How many questions a sample has rows of."""
    return sample_rows.agg(F.count_distinct(question).alias("questions"), F.count(F.lit(1)).alias("rows"))
