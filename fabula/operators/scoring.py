"""From signals to dimension scores, tiers and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.scoring import confidence_label, least_label, ratio, tier


def dimension_scores(signals: DataFrame, rubric: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Weighted means with a coverage gate. ``signals``: script_id, key, score, confidence; ``rubric``: dimension, key, weight.

    A missing signal takes its weight out of the mean, and a dimension covered to less than ``threshold`` has no score.
    Coverage is the part of the dimension's weight whose signals have a score; the rubric is a small table of fixed size."""
    rows = signals.select("script_id", "key", "score", "confidence").join(F.broadcast(rubric.select("key", "dimension", "weight")), "key", "left")
    has, w = F.col("score").isNotNull(), F.col("weight")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("score")))
    of = lambda x: F.sum(F.when(has, x))
    sums = rows.groupBy("script_id", "dimension").agg(F.struct(of(clamped * w).alias("scored"), of(F.col("confidence") * w).alias("sure"), of(w).alias("found")).alias("s"))
    # a dimension of which a script has no signal is there too, without a score
    listed = F.filter(F.collect_list(F.struct("dimension", "s")), lambda x: x["dimension"].isNotNull())
    each = sums.groupBy("script_id").agg(F.map_from_entries(listed).alias("by"))
    totals = rubric.groupBy("dimension").agg(F.sum("weight").alias("total"))
    met = each.crossJoin(F.broadcast(totals)).select("script_id", "dimension", "total", F.try_element_at("by", F.col("dimension")).alias("s"))
    out = met.select(
        "script_id", "dimension", ratio(F.col("s.scored"), F.col("s.found")).alias("mean"), F.coalesce(ratio(F.col("s.found"), F.col("total")), F.lit(0.0)).alias("coverage"),
        ratio(F.col("s.sure"), F.col("s.found")).alias("sure"),
    )
    gated = F.when(F.col("coverage") >= threshold, F.col("mean"))
    return out.select(
        "script_id", "dimension", gated.alias("score"), "coverage", F.when(gated.isNull(), "insufficient").otherwise(confidence_label(F.col("sure"))).alias("confidence")
    )


def top_signals(signals: DataFrame, rubric: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` signals of each dimension that contribute most (score times weight)."""
    rows = signals.select("script_id", "key", "score").join(F.broadcast(rubric), "key").filter("score IS NOT NULL").withColumn("contribution", F.col("score") * F.col("weight"))
    order = Window.partitionBy("script_id", "dimension").orderBy(F.desc("contribution"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("script_id", "dimension", "key", "contribution", "rank")


def overall(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Overall score: weights (dimension, base, multiplier) normalised over the dimensions that have a score."""
    w = F.greatest(F.lit(0.0), F.col("base") * F.coalesce("multiplier", F.lit(1.0)))
    usable = scores.filter("score IS NOT NULL").join(F.broadcast(weights), "dimension").withColumn("w", w)
    return usable.groupBy("script_id").agg(F.round(ratio(F.sum(F.col("score") * F.col("w")), F.sum("w")), 3).alias("overall"), F.count(F.lit(1)).alias("dimensions"))


def tiers(scores: DataFrame, cuts: DataFrame, fallback: str = "default") -> DataFrame:
    """Tiers by the cut-offs of the script's genre, else of ``fallback``. ``cuts``: genre, dimension, p25, p50, p75."""
    own, other = cuts.alias("o"), cuts.filter(F.col("genre") == fallback).alias("f")
    rows = scores.alias("s").join(F.broadcast(own), (F.col("s.genre") == F.col("o.genre")) & (F.col("s.dimension") == F.col("o.dimension")), "left")
    rows = rows.join(F.broadcast(other), F.col("s.dimension") == F.col("f.dimension"), "left")
    cut = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"f.{c}"))
    return rows.select("s.*", tier(F.col("s.score"), cut("p25"), cut("p50"), cut("p75")).alias("tier"))


def decide(scores: DataFrame, core: tuple[str, ...], blocked: Column | None = None) -> DataFrame:
    """Decision by an overall score and the tiers of core dimensions. ``scores``: script_id, dimension, score, tier,
    confidence, overall."""
    weak = F.filter(F.array_sort(F.collect_list(F.when(F.col("dimension").isin(*core) & F.col("tier").isin("poor", "insufficient"), F.col("dimension")))), lambda x: x.isNotNull())
    rows = scores.groupBy("script_id").agg(F.max("overall").alias("overall"), weak.alias("weak_core"), F.collect_list(F.when(F.col("tier") != "insufficient", F.col("confidence"))).alias("labels"))
    verdict = (
        F.when(F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False), "not_recommended")
        .when(F.col("overall").isNull(), "insufficient_data")
        .when((F.col("overall") >= 7.5) & (F.size("weak_core") == 0), "recommended")
        .when(F.col("overall") >= 6, "conditional_recommend")
        .otherwise("not_recommended")
    )
    return rows.select("script_id", "overall", verdict.alias("decision"), "weak_core", F.coalesce(least_label(F.col("labels")), F.lit("low")).alias("confidence"))


def pacing_curve(units: DataFrame) -> DataFrame:
    """Per episode: units, mean and greatest intensity, how many have a hook, conflict, payoff, and a histogram of
    intensities as ``level:count``. A script without any episode number is one episode, 1."""
    from fabula.operators.signals import intensity

    level = intensity(*(F.col(c) for c in ("plot_hook", "conflict_type", "payoff_type", "emotional_driver")))
    any_ = F.max("episode_no").over(Window.partitionBy("script_id"))
    rows = units.withColumn("x", level).withColumn("episode", F.when(any_.isNull(), F.lit(1).cast("bigint")).otherwise(F.col("episode_no"))).filter("episode IS NOT NULL")
    told = lambda c: F.sum(F.when(F.col(c) != "none", F.col("n")).otherwise(0))
    first = rows.groupBy("script_id", "episode", "x", "plot_hook", "conflict_type", "payoff_type").agg(F.count(F.lit(1)).alias("n"))
    levels = first.groupBy("script_id", "episode", "x").agg(F.sum("n").alias("n"), *(told(c).alias(c) for c in ("plot_hook", "conflict_type", "payoff_type")))
    out = levels.groupBy("script_id", "episode").agg(
        F.sum("n").alias("units"),
        F.sum(F.col("x") * F.col("n")).alias("total"),
        F.max("x").cast("bigint").alias("max_intensity"),
        F.sum("plot_hook").alias("hooks"),
        F.sum("conflict_type").alias("conflicts"),
        F.sum("payoff_type").alias("payoffs"),
        F.array_sort(F.collect_list(F.struct("x", "n"))).alias("levels"),
    )
    histogram = F.array_join(F.transform("levels", lambda s: F.concat_ws(":", s["x"].cast("string"), s["n"].cast("string"))), ",")
    return out.select("script_id", "episode", "units", F.round(F.col("total") / F.col("units"), 4).alias("avg_intensity"), "max_intensity", "hooks", "conflicts", "payoffs", histogram.alias("histogram"))


def risk_level(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Risk of hits (``level``: high, medium, low; ``category``): a cascade over how many of each level there are."""
    n = lambda x: F.count_if(F.col("level") == x)
    out = hits.groupBy(*keys).agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), F.array_sort(F.collect_set("category")).alias("categories"))
    score = F.when(F.col("high") >= 1, 1).when(F.col("medium") >= 3, 4).when((F.col("medium") >= 1) | (F.col("low") >= 6), 7).otherwise(9)
    return out.withColumn("score", score)
