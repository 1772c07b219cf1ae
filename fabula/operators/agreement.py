"""Agreement of labels and of segmentations. Labels are rows (item, run, value); there is never a matrix.

Pairs of runs come from a self-join on the item, so a group is as large as the number of runs squared, which a study fixes;
the statistics that don't need pairs are computed from counts of values by item.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.scoring import jaccard, ratio, wilson


def pairs(labels: DataFrame) -> DataFrame:
    """Two runs' values of one item: item, run_a < run_b, a, b."""
    x, y = labels.alias("x"), labels.alias("y")
    on = (F.col("x.item") == F.col("y.item")) & (F.col("x.run") < F.col("y.run"))
    return x.join(y, on).select("x.item", F.col("x.run").alias("run_a"), F.col("y.run").alias("run_b"), F.col("x.value").alias("a"), F.col("y.value").alias("b"))


def pairwise_agreement(labels: DataFrame) -> DataFrame:
    """Agreement rate of each pair of runs: run_a, run_b, items, agreement."""
    return pairs(labels).groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def cohen_kappa(labels: DataFrame) -> DataFrame:
    """Kappa of each pair of runs; where chance agreement is certain, 1 if they agree everywhere, else 0."""
    joined = pairs(labels)
    n = joined.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    left = joined.groupBy("run_a", "run_b", F.col("a").alias("value")).agg(F.count(F.lit(1)).alias("ca"))
    right = joined.groupBy("run_a", "run_b", F.col("b").alias("value")).agg(F.count(F.lit(1)).alias("cb"))
    chance = left.join(right, ["run_a", "run_b", "value"]).groupBy("run_a", "run_b").agg(F.sum(F.col("ca") * F.col("cb")).alias("both"))
    pe = F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n"))
    rows = n.join(chance, ["run_a", "run_b"], "left").withColumn("pe", pe)
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(F.when(F.col("po") == 1, 1.0).otherwise(0.0))
    return rows.select("run_a", "run_b", "n", "po", "pe", kappa.alias("kappa"))


def krippendorff_alpha(labels: DataFrame, by: list[str]) -> DataFrame:
    """Nominal alpha by group, from counts alone: 1 - (n - 1) * (n - sum of diagonal) / (n^2 - sum of squares).

    Items with one label count nothing. Without any difference expected it is 1."""
    counts = labels.filter("value IS NOT NULL").groupBy(*by, "item", "value").agg(F.count(F.lit(1)).alias("c"))
    items = counts.withColumn("m", F.sum("c").over(Window.partitionBy(*by, "item"))).filter("m > 1")
    values = items.groupBy(*by, "value").agg(F.sum("c").alias("n_c"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("o_cc"))
    total = values.groupBy(*by).agg(F.sum("n_c").alias("n"), F.sum("o_cc").alias("agree"), F.sum(F.col("n_c") * (F.col("n_c") - 1)).alias("expected"))
    observed, expected = 1 - ratio(F.col("agree"), F.col("n")), 1 - ratio(F.col("expected"), F.col("n") * (F.col("n") - 1))
    return total.select(*by, F.col("n").cast("bigint").alias("n"), F.when(expected > 0, 1 - observed / expected).otherwise(1.0).alias("alpha"))


def stable_items(labels: DataFrame, by: list[str]) -> DataFrame:
    """Items on which all runs agree, and the Wilson lower bound of their share."""
    items = labels.groupBy(*by, "item").agg((F.count_distinct("value") == 1).alias("same"))
    out = items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if("same").alias("stable"))
    return out.withColumn("wilson", wilson(F.col("stable"), F.col("items")))


def pairwise_jaccard(labels: DataFrame) -> DataFrame:
    """Mean similarity of the runs' sets on each item (``value`` is an array); two empty sets are alike."""
    return pairs(labels).groupBy("item").agg(F.avg(jaccard(F.col("a"), F.col("b"))).alias("similarity"), F.count(F.lit(1)).alias("pairs"))


def similar_items(similarities: DataFrame, least: float = 0.5) -> DataFrame:
    """``items, stable``: how many items there are, and how many reach a mean similarity of ``least``. A mean that is a tie but
    for the last bits of a double reaches it, in whatever order its pairs were added."""
    return similarities.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("similarity") + 1e-9 >= least).alias("stable"))


def majority(labels: DataFrame) -> DataFrame:
    """The most frequent value of each item, empty ones aside; of equals the one that the earliest run gave."""
    counts = labels.filter("value IS NOT NULL AND value <> ''").groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first"))
    return counts.groupBy("item").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.max("n").alias("votes"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of (gold, predicted)."""
    return rows.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """F1 averaged over all labels that occur as gold or prediction."""
    n = confusion(rows)
    side = lambda c: n.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c))
    hits = n.filter("gold = predicted").select(F.col("gold").alias("label"), F.col("n").alias("tp"))
    each = side("gold").join(side("predicted"), "label", "full").join(hits, "label", "left").fillna(0)
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("gold") + F.col("predicted")), F.lit(0.0))
    return each.agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def window_diff(segments: DataFrame) -> DataFrame:
    """``id, ref, hyp`` (arrays of boundaries) and ``n``: the share of windows in which the numbers of boundaries differ.

    A window is k wide, k being half the mean segment of ``ref``, 2 at least and n at most; boundaries count strictly
    inside it."""
    half = F.greatest(F.lit(2), F.bround(F.col("n") / (2.0 * (F.size("ref") + 1)), 0).cast("int"))
    k = F.greatest(F.lit(1), F.least(half, F.col("n").cast("int")))
    rows = segments.filter("n > 1").withColumn("k", k)
    last = F.greatest(F.lit(1), F.col("n").cast("int") - F.col("k")) - 1
    starts = rows.select("id", "k", "ref", "hyp", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    inside = lambda c: F.size(F.filter(c, lambda b: (b > F.col("s")) & (b < F.col("s") + F.col("k"))))
    return starts.groupBy("id").agg(F.avg((inside("ref") != inside("hyp")).cast("double")).alias("window_diff"), F.count(F.lit(1)).alias("windows"))


def boundary_similarity(a: list[int], b: list[int], near: int = 2) -> float:
    """Boundaries of two segmentations matched one to one, nearest pairs first, up to ``near`` apart.

    An exact match counts 1; a near one half, and a half edit against it; a boundary without a partner is an edit."""
    left, right = set(a), set(b)
    close = sorted((abs(x - y), x, y) for x in left for y in right if abs(x - y) <= near)
    matched = edits = 0.0
    for apart, x, y in close:
        if x in left and y in right:
            left.remove(x)
            right.remove(y)
            matched += 1.0 if apart == 0 else 0.5
            edits += 0.0 if apart == 0 else 0.5
    total = matched + edits + len(left) + len(right)
    return matched / total if total else 1.0


def boundary_similarities(segments: DataFrame, near: int = 2) -> DataFrame:
    """``id, similarity`` of ``id, ref, hyp``; pairs are compared in batches."""

    @F.pandas_udf("double")
    def similar(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([boundary_similarity(x, y, near) for x, y in zip(ref, hyp, strict=True)])

    return segments.select("id", similar("ref", "hyp").alias("similarity"))


def verdict(intra: Column, inter: Column, kappa: Column, agreement: Column) -> Column:
    return (
        F.when((intra >= 0.7) & (inter >= 0.6) & (kappa >= 0.6) & (agreement >= 0.6), "online")
        .when((intra < 0.4) | (inter < 0.3) | (kappa < 0.4) | (agreement < 0.4), "offline")
        .otherwise("fix")
    )


def shared_gate(ours: Column, theirs: Column) -> Column:
    """Whether both sides' verdicts let a dimension be shared."""
    return (
        F.when((ours == "offline") | (theirs == "video_blocked"), "blocked")
        .when((ours == "fix") | (theirs == "video_experimental"), "experimental")
        .when((ours == "online") & (theirs == "video_stable"), "stable_shared")
        .when((ours == "online") & (theirs == "video_aggregate"), "aggregate_only")
        .otherwise("blocked")
    )


def segmentation_verdict(wd: Column, cv: Column) -> Column:
    return F.when((wd <= 0.15) & (cv <= 0.10), "stable").when((wd >= 0.40) | (cv >= 0.25), "unstable").otherwise("fixable")


def wilson_bucket(bound: Column) -> Column:
    return F.when(bound >= 0.85, "shared").when(bound >= 0.70, "aggregate").when(bound >= 0.50, "retest").otherwise("apart")
