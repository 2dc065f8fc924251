"""Agreement of raters: kappa, reports by group, confusion, population weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two 0/1 columns as an aggregate: 0 without rows, 1 where chance agreement is complete."""
    observed = F.avg((a == b).cast("double"))
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    expected = pa * pb + (1 - pa) * (1 - pb)
    return F.when(F.count(F.lit(1)) == 0, 0.0).when(expected >= 1.0, 1.0).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))


def stratum(a: Column, b: Column, final: Column) -> Column:
    return F.when(a != b, "disagree").when(final == 1, "agree_rel").otherwise("agree_not")


#: Groups of a report: all rows, those on which raters differ or not, and the strata.
GROUPS = ("overall", "disagreements", "agreements", "disagree", "agree_rel", "agree_not")


def report(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agree, disagree, agreement_rate, kappa of two raters; one row."""
    return rows.agg(*_measures(F.col(a), F.col(b)))


def _measures(a: Column, b: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("n_agree"), F.count_if(a != b).alias("n_disagree"),
        F.coalesce(F.avg((a == b).cast("double")), F.lit(0.0)).alias("agreement_rate"), kappa(a, b).alias("kappa"),
    ]


def grouped_report(rows: DataFrame, a: str, b: str, differ: Column, stratum_col: str = "stratum") -> DataFrame:
    """group_name and :func:`report` for each of GROUPS, which overlap; a group without rows has null rates.

    ``differ`` says on which rows the judges differ, who need not be the raters compared.
    """
    named = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), F.when(differ, "disagreements").otherwise("agreements").alias("side"), F.col(stratum_col).alias("stratum"))
    sets = named.groupingSets([[], [F.col("side")], [F.col("stratum")]], F.col("side"), F.col("stratum"))
    found = sets.agg(F.grouping_id("side", "stratum").alias("level"), *_measures(F.col("a"), F.col("b")))
    name = F.when(F.col("level") == 3, F.lit("overall")).when(F.col("level") == 1, F.col("side")).otherwise(F.col("stratum"))
    every = rows.sparkSession.range(1).select(F.explode(F.lit(list(GROUPS))).alias("group_name"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_agree", "n_disagree")]
    return every.join(found.withColumn("group_name", name), "group_name", "left").select("group_name", *counts, "agreement_rate", "kappa")


def scored_sheet(sheet: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of a filled sheet (qa_id, chunk_id, value) with the judges' labels; rows without labels don't count."""
    known = labels.select("qa_id", "chunk_id", "judge_a", "judge_b", "final")
    out = sheet.select("qa_id", "chunk_id", "value").join(known, ["qa_id", "chunk_id"])
    return out.withColumn("stratum", stratum(F.col("judge_a"), F.col("judge_b"), F.col("final")))


def validation(scored: DataFrame) -> DataFrame:
    """A rater against the final labels, by group: group_name, n, accuracy, kappa."""
    rows = grouped_report(scored, "value", "final", F.col("judge_a") != F.col("judge_b"))
    return rows.select("group_name", "n", F.col("agreement_rate").alias("accuracy"), "kappa")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    t, g = F.col(truth) == 1, F.col(guess) == 1
    return rows.agg(
        F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"),
        F.avg(t.cast("double")).alias("truth_rate"), F.avg(g.cast("double")).alias("guess_rate"),
    )


def weighted_accuracy(sample: DataFrame, population: DataFrame) -> DataFrame:
    """Accuracy of (stratum, correct) weighted by the strata of ``population``; strata without sample don't count."""
    shares = population.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    accuracy = sample.groupBy("stratum").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    both = shares.join(accuracy, "stratum")
    return both.agg((F.sum(F.col("size") * F.col("accuracy")) / F.sum("size")).alias("weighted_accuracy"), F.sum("size").alias("population"))


def gold_sizes(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, gold_size: relevant rows of each question, also where there are none."""
    sizes = labels.filter("final").groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_size"))
    return questions.select("query_id").join(sizes, "query_id", "left").select("query_id", F.coalesce("gold_size", F.lit(0)).alias("gold_size"))


def empty_gold(sizes: DataFrame) -> DataFrame:
    """questions, empty: how many of :func:`gold_sizes` have nothing relevant; one row."""
    return sizes.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("gold_size") == 0).alias("empty"))


def gold_lists(labels: DataFrame) -> DataFrame:
    """query_id and its relevant items in pool order."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("final"), F.struct("pos", "item_id"))))
    return labels.groupBy("query_id").agg(F.transform(ordered, lambda x: x["item_id"]).alias("relevant_ids"))


def with_tiebreak(rows: DataFrame, a: Column, b: Column, tiebreak: Column) -> DataFrame:
    """judge_a, judge_b, final: the third judge counts only on rows on which two differ; a null vote is a no."""
    votes = [F.coalesce(v.cast("boolean"), F.lit(False)) for v in (a, b, tiebreak)]
    judged = rows.withColumn("judge_a", votes[0]).withColumn("judge_b", votes[1])
    return judged.withColumn("final", F.when(F.col("judge_a") == F.col("judge_b"), F.col("judge_a")).otherwise(votes[2]))
