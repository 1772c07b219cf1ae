"""The 34 rule signals, set-based: every script at once, one aggregation of each relation, then columns.

A signal is a row of a registry: key, dimension, and its score over the facts of a script. ``facts`` aggregates units (with
a window for runs and places), tags, characters, relationships and scenes by script; all of them share the partitioning
by script, so after the window there is one exchange for each relation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.scoring import clamp, ladder, ratio

# Tag values that the signals look for.
REVERSAL_HOOKS = ("reversal", "identity_reveal", "secret_exposure", "betrayal", "conflict_escalation")
PAYOFF_EVENTS = ("face_slapping", "counterattack", "reveal_power", "justice_served")
POSITIVE = ("tenderness", "pity", "desire", "curiosity")
NEGATIVE = ("humiliation", "jealousy", "regret", "anger", "fear")
PROTAGONIST = ("protagonist", "lead", "主角", "男主", "女主")
ANTAGONIST = ("antagonist", "villain", "反派", "对手", "反角")


@dataclass(frozen=True)
class Signal:
    key: str
    dimension: str
    score: Callable[[], Column]
    confidence: Callable[[], Column]


REGISTRY: dict[str, Signal] = {}


def signal(key: str, dimension: str, confidence: float | Callable[[], Column]):
    """Registers a function that gives a signal's score over ``facts``."""

    def add(score: Callable[[], Column]) -> Callable[[], Column]:
        sure = confidence if callable(confidence) else lambda: F.lit(float(confidence))
        REGISTRY[key] = Signal(key, dimension, score, sure)
        return score

    return add


def intensity(hook: Column, conflict: Column, payoff: Column, driver: Column) -> Column:
    """How much happens in a unit: 2 for a hook, 2 for a conflict, 3 for a payoff, 1 for a driver; 8 at most."""
    told = lambda c, n: F.when(F.coalesce(c, F.lit("none")) != "none", n).otherwise(0)
    return F.least(F.lit(8), told(hook, 2) + told(conflict, 2) + told(payoff, 3) + told(driver, 1))


def longest_run(df: DataFrame, keys: list[str], order: list[str], condition: Column, name: str) -> DataFrame:
    """For each group the length of its longest run of rows that meet the condition (gaps and islands)."""
    in_order = Window.partitionBy(*keys).orderBy(*order)
    breaks = F.sum(F.when(condition, 0).otherwise(1)).over(in_order)
    runs = df.select(*keys, condition.alias("_in"), breaks.alias("_run")).groupBy(*keys, "_run").agg(F.count_if("_in").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(name))


def spread(whole: Column) -> Column:
    """Standard deviation of whole numbers from their sums, so that the order of rows doesn't decide its last bits."""
    n, s = F.count(whole).cast("decimal(19,0)"), F.sum(whole.cast("bigint")).cast("decimal(19,0)")
    squares = F.sum(whole.cast("bigint") * whole.cast("bigint")).cast("decimal(19,0)")
    return F.when(n > 0, F.sqrt((n * squares - s * s).cast("double")) / n.cast("double"))


def unit_facts(units: DataFrame) -> DataFrame:
    """``units``: script_id, idx, episode_no and the tag dimensions as columns. A row for each script."""
    level = intensity(*(F.col(c) for c in ("plot_hook", "conflict_type", "payoff_type", "emotional_driver")))
    by_script = Window.partitionBy("script_id")
    in_order = by_script.orderBy("idx")
    low, dry = F.col("x") <= 2, F.coalesce(F.col("payoff_type"), F.lit("none")) == "none"
    rows = units.withColumn("x", level).withColumns(
        {
            "rn": F.row_number().over(in_order),
            "n": F.count(F.lit(1)).over(by_script),
            "low_run": F.sum(F.when(low, 0).otherwise(1)).over(in_order),
            "dry_run": F.sum(F.when(dry, 0).otherwise(1)).over(in_order),
        }
    )
    # a run's length is the count of its members; the row that breaks it has the same number and isn't one
    rows = rows.withColumns(
        {
            "low_len": F.count_if(low).over(Window.partitionBy("script_id", "low_run")),
            "dry_len": F.count_if(dry).over(Window.partitionBy("script_id", "dry_run")),
        }
    )
    third, two = F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3)
    middle = (F.col("rn") > third) & (F.col("rn") <= F.greatest(third + 1, two))
    first = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    told = lambda c: F.coalesce(F.col(c), F.lit("none")) != "none"
    counted = lambda c, *vs: F.count_if(F.col(c).isin(*vs))
    share = rows.filter(told("emotional_driver")).groupBy("script_id", "emotional_driver").count()
    total = share.groupBy("script_id").agg(F.sum("count").alias("drivers"), F.max("count").alias("top_driver"), F.count(F.lit(1)).alias("driver_kinds"), F.sum(F.col("count") * F.log2("count")).alias("c_log_c"))
    facts = rows.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_distinct("episode_no").alias("unit_episodes"),
        F.avg("x").alias("x_mean"),
        spread(F.col("x")).alias("x_std"),
        F.avg(F.when(middle, F.col("x"))).alias("x_middle"),
        F.count_if(F.col("x") >= 3).alias("effective"),
        F.min(F.when(F.col("x") >= 3, F.col("rn"))).alias("opening"),
        F.max("low_len").alias("low_streak"),
        F.max("dry_len").alias("dry_streak"),
        F.max(first & (told("plot_hook") | told("conflict_type"))).alias("early"),
        counted("plot_hook", *REVERSAL_HOOKS).alias("reversals"),
        counted("payoff_type", *PAYOFF_EVENTS).alias("boosters"),
        F.count_if(told("payoff_type")).alias("payoffs"),
        F.count_if(told("story_stage")).alias("stages"),
        F.max(F.col("story_stage").isin("setup", "trigger")).alias("has_setup"),
        F.max(F.col("story_stage") == "escalation").alias("has_escalation"),
        F.max(F.col("story_stage") == "climax").alias("has_climax"),
        F.max(F.col("story_stage").isin("payoff", "teaser")).alias("has_payoff"),
        counted("story_stage", "trigger", "escalation", "climax").alias("decisions"),
        counted("story_stage", "setup", "trigger").alias("setups"),
        F.max(F.col("emotional_driver").isin(*POSITIVE)).alias("positive"),
        F.max(F.col("emotional_driver").isin(*NEGATIVE)).alias("negative"),
        *(counted("dialogue_density", v).alias(v) for v in ("dense", "moderate", "sparse")),
        F.count_if(F.col("dialogue_density").isNotNull()).alias("densities"),
        F.count_if(told("dialogue_density")).alias("told_densities"),
        F.count_if(F.col("voiceover_type").isNotNull()).alias("voices"),
        *(counted("voiceover_type", v).alias(v) for v in ("narrator", "mixed")),
    )
    return facts.join(total, "script_id", "left")


def character_facts(entities: DataFrame) -> DataFrame:
    has = lambda names: F.lower("role").rlike("|".join(names))
    able = F.lower("agency_level").isin("high", "medium")
    lead = F.coalesce(has(PROTAGONIST), F.lit(False))
    return entities.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(lead).alias("leads"),
        F.count_if(lead & able).alias("able_leads"),
        F.min_by(able.cast("int"), "char_id").alias("able_first"),
        F.count_if(has(ANTAGONIST)).alias("antagonists"),
    )


def relationship_facts(relationships: DataFrame) -> DataFrame:
    polarity = F.lower("polarity")
    arc = F.coalesce(F.lower(F.trim("dynamic_arc")), F.lit(""))
    return relationships.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(polarity.isin("negative", "unstable")).alias("hostile"),
        F.count_if(polarity.isin("negative", "mixed", "unstable")).alias("conflicts"),
        F.count_if(~arc.isin("", "none")).alias("arcs"),
    )


def scene_facts(scenes: DataFrame) -> DataFrame:
    """Of scenes (script_id, text): lengths and lines of dialogue, which are lines with a colon."""
    text = F.coalesce("text", F.lit(""))
    spoken = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.contains(":") | x.contains("："))
    rows = scenes.select("script_id", F.when(F.trim(text) != "", F.length(text)).alias("len"), F.transform(spoken, F.length).alias("said"))
    return rows.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("scenes"),
        F.count("len").alias("told_scenes"),
        F.avg("len").alias("len_mean"),
        spread(F.col("len")).alias("len_std"),
        F.count_if(F.size("said") >= 2).alias("talking"),
        F.sum(F.aggregate("said", F.lit(0), lambda a, x: a + x)).alias("said_chars"),
        F.sum(F.size("said")).alias("said_lines"),
    )


def tag_facts(script_tags: DataFrame, episode_tags: DataFrame, genres: tuple[str, ...]) -> DataFrame:
    drama = F.col("dim") == "drama_tags"
    mainstream = F.col("value").rlike("|".join(genres))
    of_script = script_tags.groupBy("script_id").agg(
        F.count_if(drama).alias("dramas"),
        F.avg(F.when(drama, F.col("confidence"))).alias("drama_confidence"),
        F.count_if(drama & mainstream).alias("mainstream"),
        F.count_if((F.col("dim") == "paid_break_pattern") & (F.col("value") != "no_break")).alias("script_breaks"),
    )
    told = F.col("value") != "none"
    of_episode = episode_tags.groupBy("script_id").agg(
        F.count_if((F.col("dim") == "episode_end_hook") & told).alias("end_hooks"),
        F.count_if((F.col("dim") == "paid_break_position") & told).alias("breaks"),
        F.count_if((F.col("dim") == "qa_relevance") & told).alias("answers"),
        F.count_if((F.col("dim") == "qa_relevance") & F.col("value").isin("high", "good", "relevant")).alias("good_answers"),
    )
    return of_script.join(of_episode, "script_id", "full")


def facts(scripts: DataFrame, units: DataFrame, script_tags: DataFrame, episode_tags: DataFrame, entities: DataFrame, relationships: DataFrame, scenes: DataFrame, genres: tuple[str, ...] = ("revenge", "romance")) -> DataFrame:
    """A row of facts for each of ``scripts`` (script_id, total_episodes)."""
    out = scripts.select("script_id", "total_episodes")
    for part in (unit_facts(units), tag_facts(script_tags, episode_tags, genres), character_facts(entities), relationship_facts(relationships), scene_facts(scenes)):
        out = out.join(part, "script_id", "left")
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "long" and f.name not in ("script_id", "opening", "total_episodes")]
    out = out.fillna(0, subset=numbers)
    listed = F.when(F.col("total_episodes") > 0, F.col("total_episodes"))
    return out.withColumn("episodes", F.greatest(F.lit(1), F.coalesce(listed, F.col("unit_episodes"), F.lit(1))))


_ = F.col


def _r2(value: Column, digits: int = 2) -> Column:
    """Rounded; what is a tie but for the last bits of a double goes up, whatever the order of operations."""
    return F.round(value + 1e-9, digits)


def _none(condition: Column, missing: float, score: Column) -> Column:
    return F.when(condition, F.lit(float(missing))).otherwise(score)


def _flag(name: str) -> Column:
    return F.coalesce(_(name), F.lit(False)).cast("int")


def _per_episode(name: str) -> Column:
    return ratio(_(name), _("episodes"))


def _add(key: str, dimension: str, confidence, score: Callable[[], Column]) -> None:
    signal(key, dimension, confidence)(score)


# ---- story
_add("structural_completeness", "story", lambda: F.when(_("units") >= 8, 0.85).otherwise(0.65), lambda: _r2((_flag("has_setup") + _flag("has_escalation") + _flag("has_climax") + _flag("has_payoff")) / 4.0 * 10.0, 2))
_add("reversal_effectiveness", "story", 0.8, lambda: _r2(F.least(F.lit(10.0), (_("reversals") + 0.5 * _("boosters")) / F.greatest(_("units"), F.lit(1)) * 8.0 + F.when(_("reversals") > 0, 2.0).otherwise(0.0)), 2))
_add("plot_unit_count_per_ep", "story", 0.9, lambda: ladder(_per_episode("units"), [(6, 10), (4, 8), (2, 6), (1, 4)], 2))
# ---- character
_add("protagonist_identifiable", "character", 0.8, lambda: F.when(_("leads") > 0, 10.0).when(_("entities") > 0, 6.0).otherwise(2.0))
_agency = lambda: F.when(_("entities") == 0, F.lit(2.0)).otherwise(_r2(clamp(10 * F.when(_("leads") > 0, ratio(_("able_leads"), _("leads"))).otherwise(F.coalesce(_("able_first"), F.lit(0)).cast("double")), 1, 10), 2))
_setup = lambda: _none(_("stages") == 0, 3.0, _r2(clamp(8 * _("setups") / F.greatest(_("decisions"), F.lit(1)), 1, 10), 2))
_add("protagonist_agency", "character", lambda: F.when(_("entities") > 0, 0.75).otherwise(0.2), _agency)
_add("decision_setup_rate", "character", lambda: F.when(_("stages") > 0, 0.65).otherwise(0.3), _setup)
_add("ooc_rate", "character", 0.55, lambda: _r2(10.0 - 10.0 * F.greatest(F.lit(0.0), 1.0 - (_agency() + _setup()) / 20.0), 2))
_add("antagonist_quality", "character", 0.75, lambda: F.when((_("antagonists") > 0) & (_("hostile") > 0), 9.0).when(_("antagonists") > 0, 7.0).when(_("hostile") > 0, 6.0).when(_("entities") > 0, 4.0).otherwise(2.0))
_add("relationship_conflict_strength", "character", lambda: F.when(_("relations") > 0, 0.8).otherwise(0.3), lambda: _none(_("relations") == 0, 3.0, _r2(clamp(10 * ratio(_("conflicts"), _("relations")), 1, 10), 2)))
_add("relationship_arc_change", "character", lambda: F.when(_("relations") > 0, 0.7).otherwise(0.3), lambda: _none(_("relations") == 0, 3.0, _r2(clamp(1 + 9 * ratio(_("arcs"), _("relations")), 1, 10), 2)))
# ---- concept
_add("drama_tags_confidence", "concept", 0.85, lambda: F.when(_("drama_confidence").isNotNull(), _r2(clamp(10 * _("drama_confidence"), 0, 10), 2)).when(_("dramas") > 0, 6.0).otherwise(2.0))
_add("genre_market_fit", "concept", lambda: F.when(_("dramas") > 0, 0.8).otherwise(0.4), lambda: _none(_("dramas") == 0, 2.0, _r2(clamp(10 * ratio(_("mainstream"), _("dramas")), 1, 10), 2)))
_add("early_genre_signal", "concept", lambda: F.when(_("units") > 0, 0.75).otherwise(0.3), lambda: _none(_("units") == 0, 2.0, F.when(_("early"), 9.0).otherwise(3.5)))
# ---- emotion
_add("payoff_density", "emotion", 0.85, lambda: ladder(_per_episode("payoffs"), [(1.5, 10), (0.8, 8), (0.3, 6)], 3))
_add("emotional_driver_distribution", "emotion", lambda: F.when(_("drivers") > 0, 0.7).otherwise(0.4), lambda: _none(_("drivers") == 0, 3.0, _r2(F.greatest(F.lit(2.0), 10 - 5 * ratio(_("top_driver"), _("drivers"))), 2)))
_add("emotional_variety", "emotion", lambda: F.when(_("drivers") > 0, 0.75).otherwise(0.3), lambda: _none(_("drivers") == 0, 2.0, _r2(clamp(10 * (F.log2("drivers") - _("c_log_c") / _("drivers")) / F.greatest(F.log2(F.greatest(_("driver_kinds"), F.lit(1))), F.lit(1e-9)), 1, 10), 2)))
_add("emotional_contrast", "emotion", 0.7, lambda: F.when((_flag("positive") + _flag("negative")) == 2, 9.0).when((_flag("positive") + _flag("negative")) == 1, 6.0).otherwise(3.0))
_add("dry_streak_max", "emotion", 0.8, lambda: ladder(F.coalesce("dry_streak", F.lit(0)), [(2, 10), (4, 8), (6, 6)], 3, down=True))
_add("episode_end_hook_rate", "emotion", 0.8, lambda: ladder(_per_episode("end_hooks"), [(0.8, 10), (0.5, 8), (0.25, 6)], 3))
_add("paid_break_potential", "emotion", 0.7, lambda: ladder(ratio(F.when(_("breaks") > 0, _("breaks")).otherwise(_("script_breaks")), _("episodes")), [(0.8, 10), (0.4, 8), (0.15, 6)], 3))
# ---- pacing
_told = lambda yes, no: lambda: F.when(_("units") > 0, yes).otherwise(no)
_add("opening_speed", "pacing", _told(0.85, 0.3), lambda: _none(_("units") == 0, 2.0, ladder(ratio(F.coalesce("opening", F.lit(1)), _("units")), [(0.05, 10), (0.12, 8), (0.20, 6)], 3, down=True)))
_add("plot_unit_density", "pacing", 0.9, lambda: ladder(_per_episode("units"), [(5, 10), (3, 8), (1.5, 6)], 3))
_add("narrative_intensity_distribution", "pacing", _told(0.85, 0.3), lambda: _none(_("units") == 0, 2.0, ladder(_("x_mean"), [(4.5, 10), (3, 8), (2, 6)], 3)))
_add("intensity_cv", "pacing", _told(0.8, 0.3), lambda: _none(_("units") == 0, 2.0, ladder(F.coalesce(ratio(_("x_std"), _("x_mean")), F.lit(0.0)), [(0.6, 10), (0.8, 8), (1.0, 6)], 3, down=True)))
_add("middle_sag", "pacing", lambda: F.when(_("units") >= 3, 0.75).otherwise(0.4), lambda: _none(_("units") < 3, 4.0, ladder(_("x_middle") / F.greatest(_("x_mean"), F.lit(1e-9)), [(0.9, 10), (0.8, 8), (0.7, 6)], 3)))
_add("downtime_penalty", "pacing", 0.75, lambda: ladder(F.coalesce("low_streak", F.lit(0)), [(1, 10), (3, 7), (5, 5)], 2, down=True))
_add("dialogue_action_ratio", "pacing", lambda: F.when(_("densities") > 0, 0.65).otherwise(0.3), lambda: _none(_("densities") == 0, 5.0, _r2(F.greatest(F.lit(2.0), 10 - 10 * F.abs(ratio(_("dense"), _("densities")) - ratio(_("sparse"), _("densities")))), 2)))
_add("beats_per_episode", "pacing", 0.8, lambda: ladder(_per_episode("stages"), [(3, 10), (2, 8), (1, 6)], 3))
_add("effective_narrative_rate", "pacing", _told(0.8, 0.3), lambda: _none(_("units") == 0, 2.0, ladder(ratio(_("effective"), _("units")), [(0.8, 10), (0.65, 8), (0.45, 6)], 3)))
_add("scene_length_distribution", "pacing", lambda: F.when(_("told_scenes") > 0, 0.7).otherwise(0.2), lambda: _none(_("told_scenes") == 0, 3.0, ladder(_("len_std") / F.greatest(_("len_mean"), F.lit(1e-9)), [(0.6, 9), (0.9, 7), (1.2, 5)], 3, down=True)))
# ---- dialogue
_add("dialogue_density", "dialogue", lambda: F.when(_("told_densities") > 0, 0.8).otherwise(0.3), lambda: _none(_("told_densities") == 0, 3.0, _r2(clamp(10 * (_("dense") + 0.75 * _("moderate") + 0.45 * _("sparse")) / _("told_densities"), 1, 10), 2)))
_add("topic_focus", "dialogue", lambda: F.when(_("answers") > 0, 0.6).when(_("scenes") > 0, 0.45).otherwise(0.2), lambda: F.when(_("answers") > 0, _r2(clamp(10 * ratio(_("good_answers"), _("answers")), 1, 10), 2)).when(_("scenes") > 0, _r2(clamp(10 * ratio(_("talking"), _("scenes")), 1, 10), 2)).otherwise(3.0))
_add("voiceover_fit", "dialogue", lambda: F.when(_("voices") > 0, 0.7).otherwise(0.3), lambda: _none(_("voices") == 0, 6.0, _r2(clamp(10 * (1 - 0.8 * ratio(_("narrator"), _("voices")) + 0.2 * ratio(_("mixed"), _("voices"))), 1, 10), 2)))
_add("brevity_ratio", "dialogue", lambda: F.when(_("said_lines") > 0, 0.75).otherwise(0.2), lambda: _none(_("said_lines") == 0, 3.0, (lambda a: F.when(a.between(18, 36), 9.0).when(a.between(12, 48), 7.0).when(a.between(8, 60), 5.0).otherwise(3.0))(ratio(_("said_chars"), _("said_lines")))))


def signals(fact_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The facts as signals: script_id, key, dimension, score, confidence, a row for each script and registered signal."""
    chosen = [s for k, s in REGISTRY.items() if keys is None or k in keys]
    each = [F.struct(F.lit(s.key).alias("key"), F.lit(s.dimension).alias("dimension"), s.score().alias("score"), s.confidence().cast("double").alias("confidence")) for s in chosen]
    return fact_rows.select("script_id", F.inline(F.array(*each)))
