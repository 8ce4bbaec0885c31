"""Accuracy of parsed templates against ground truth, from one small table of template pairs per dataset.

The only large shuffle is the join on (dataset, LineId); everything else reads ``pairs``, which has a row for each
combination of a true and a predicted template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text


def pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """dataset, gt, pred, n, ok (equal after normalising) for joined lines."""
    g = gt.select("dataset", "LineId", F.col("EventTemplate").alias("gt"))
    p = pred.select("dataset", "LineId", F.col("EventTemplate").alias("pred"))
    out = g.join(p, ["dataset", "LineId"]).groupBy("dataset", "gt", "pred").agg(F.count("*").alias("n"))
    return out.withColumn("ok", F.coalesce(text.normalise(F.col("gt")) == text.normalise(F.col("pred")), F.lit(False)))


def grouping(p: DataFrame) -> DataFrame:
    """dataset, GA and FGA."""
    by_pred = Window.partitionBy("dataset", "pred")
    # a null true template counts as a group of its own for the predictions that it shares
    alone = p.withColumn("gts", F.count("*").over(by_pred))
    good = alone.groupBy("dataset", "gt").agg(
        F.sum("n").alias("n"), (F.col("gt").isNotNull() & (F.count("*") == 1) & F.min(F.col("pred").isNotNull() & (F.col("gts") == 1))).alias("good")
    )
    g = good.groupBy("dataset").agg(
        (F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)) / F.sum("n")).alias("GA"),
        F.sum(F.col("good").cast("int")).alias("k"),
        F.count("gt").alias("n_gt"),
    )
    q = p.groupBy("dataset").agg((F.count_distinct("pred") + F.max(F.col("pred").isNull().cast("int"))).alias("n_pred"))
    pga, rga = F.col("k") / F.col("n_pred"), F.when(F.col("n_gt") > 0, F.col("k") / F.col("n_gt")).otherwise(0.0)
    return g.join(q, "dataset").select("dataset", "GA", F.when(F.col("k") == 0, 0.0).otherwise(2 * pga * rga / (pga + rga)).alias("FGA"))


def parsing(p: DataFrame) -> DataFrame:
    return p.groupBy("dataset").agg((F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n")).alias("PA"))


def templates(p: DataFrame) -> DataFrame:
    """Distinct templates by raw text: counts, matches, precision, recall, F1."""
    kinds = p.select("dataset", F.col("gt").alias("t"), F.lit(1).alias("g"), F.lit(0).alias("p")).distinct()
    kinds = kinds.unionByName(p.filter(F.col("pred").isNotNull()).select("dataset", F.col("pred").alias("t"), F.lit(0).alias("g"), F.lit(1).alias("p")).distinct())
    one = kinds.groupBy("dataset", "t").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    c = one.groupBy("dataset").agg(F.sum("g").alias("n_gt_templates"), F.sum("p").alias("n_pred_templates"), F.sum(F.col("g") * F.col("p")).alias("exact_template_matches"))
    pr = F.when(F.col("n_pred_templates") > 0, F.col("exact_template_matches") / F.col("n_pred_templates")).otherwise(0.0)
    re = F.when(F.col("n_gt_templates") > 0, F.col("exact_template_matches") / F.col("n_gt_templates")).otherwise(0.0)
    return c.withColumns({"template_precision": pr, "template_recall": re, "template_f1": F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)})


def per_template(p: DataFrame) -> DataFrame:
    """For each true template: lines, correct lines, share, and the templates predicted for it."""
    out = p.groupBy("dataset", F.col("gt").alias("gt_template")).agg(
        F.array_join(F.array_sort(F.collect_set("pred")), ", ").alias("pred_templates"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("correct"),
    )
    return out.withColumn("pa", F.col("correct") / F.col("total")).orderBy("pa", "gt_template")


def summary(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per dataset with every metric; the pair table is computed once (an exchange that all branches reuse)."""
    p = pairs(gt, pred)
    return grouping(p).join(parsing(p), "dataset").join(templates(p), "dataset")
