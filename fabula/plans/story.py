"""Queries over scripts: signals, pacing, dimension scores, decisions, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions.scoring import label
from fabula.operators import scoring, signals
from fabula.operators.relational import stored
from fabula.plans.adapters import (
    CAST,
    ENTITIES,
    EPISODE_TAGS,
    INTENSITY,
    RELATIONSHIPS,
    SCRIPT_TAGS,
    UNITS,
    cast_of,
    entities,
    episode_tags,
    events,
    read,
    relationships,
    script_tags,
    units,
    with_,
)
from fabula.plans.registry import query

GENRES = ("genre1", "genre2")


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's scenes: what users say in the conversation of its number, with a colon after the first word of some."""
    turns = read(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("script_id"), F.regexp_replace("text", r"\. ", "\n").alias("text"))


_SCENES = "scene_rows AS (SELECT conv_id AS script_id, regexp_replace(text, '\\. ', chr(10), 'g') AS text FROM conversations)"


def script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every script, from units that are put in order and tagged once."""
    u = stored(units(spark, sf_dir), "units")
    return signals.facts(u.select("script_id").distinct().withColumn("total_episodes", F.lit(None).cast("bigint")), u, script_tags(spark, u), episode_tags(spark, u), entities(spark, u), relationships(spark, u), _scenes(spark, sf_dir), GENRES)


_FACTS = f"""x AS (SELECT *, {INTENSITY} AS x FROM units),
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY script_id) AS n,
    sum(CASE WHEN x <= 2 THEN 0 ELSE 1 END) OVER w AS lr, sum(CASE WHEN payoff_type = 'none' THEN 0 ELSE 1 END) OVER w AS dr
  FROM x WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
low_runs AS (SELECT script_id, max(c) AS low_streak FROM (SELECT script_id, lr, count(*) FILTER (x <= 2) AS c FROM ranked GROUP BY 1, 2) GROUP BY 1),
dry_runs AS (SELECT script_id, max(c) AS dry_streak FROM (SELECT script_id, dr, count(*) FILTER (payoff_type = 'none') AS c FROM ranked GROUP BY 1, 2) GROUP BY 1),
drv AS (SELECT script_id, sum(c) AS drivers, max(c) AS top_driver, count(*) AS kinds, -sum(c / t * log2(c / t)) AS h
  FROM (SELECT script_id, emotional_driver, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY script_id)::DOUBLE AS t FROM units WHERE emotional_driver <> 'none' GROUP BY 1, 2) GROUP BY 1),
uf AS (SELECT script_id, count(*)::DOUBLE AS units, greatest(1, count(DISTINCT episode_no))::DOUBLE AS ep, avg(x) AS x_mean, stddev_pop(x) AS x_std,
    avg(x) FILTER (rn > n // 3 AND rn <= greatest(n // 3 + 1, 2 * n // 3)) AS x_middle, count(*) FILTER (x >= 3) AS effective, min(rn) FILTER (x >= 3) AS opening,
    bool_or(rn <= greatest(1, floor(n * 0.2)) AND (plot_hook <> 'none' OR conflict_type <> 'none')) AS early,
    count(*) FILTER (plot_hook IN ('reversal', 'identity_reveal')) AS reversals, count(*) FILTER (payoff_type IN ('face_slapping', 'counterattack')) AS boosters,
    count(*) FILTER (payoff_type <> 'none') AS payoffs, count(*) FILTER (story_stage <> 'none') AS stages,
    bool_or(story_stage IN ('setup', 'trigger'))::INT + bool_or(story_stage = 'escalation')::INT + bool_or(story_stage = 'climax')::INT + bool_or(story_stage IN ('payoff', 'teaser'))::INT AS blocks,
    count(*) FILTER (story_stage IN ('trigger', 'escalation', 'climax')) AS decisions, count(*) FILTER (story_stage IN ('setup', 'trigger')) AS setups,
    bool_or(emotional_driver IN ('pity', 'desire', 'curiosity'))::INT AS pos, bool_or(emotional_driver = 'anger')::INT AS neg,
    count(*) FILTER (dialogue_density = 'dense') AS dense, count(*) FILTER (dialogue_density = 'moderate') AS moderate, count(*) FILTER (dialogue_density = 'sparse') AS sparse,
    count(*) FILTER (voiceover_type = 'narrator') AS narrator, count(*) FILTER (voiceover_type = 'mixed') AS mixed
  FROM ranked GROUP BY 1),
tf AS (SELECT script_id, count(*) AS dramas, avg(confidence) AS dc, count(*) FILTER (value IN ('genre1', 'genre2')) AS mainstream FROM script_tags GROUP BY 1),
ef AS (SELECT script_id, count(*) FILTER (value <> 'none' AND dim = 'episode_end_hook') AS end_hooks, count(*) FILTER (value <> 'none' AND dim = 'paid_break_position') AS breaks FROM episode_tags GROUP BY 1),
cf AS (SELECT script_id, count(*) AS entities, count(*) FILTER (role = 'protagonist') AS leads, count(*) FILTER (role = 'protagonist' AND agency_level IN ('high', 'medium')) AS able,
    count(*) FILTER (role = 'antagonist') AS antagonists FROM entities GROUP BY 1),
rf AS (SELECT script_id, count(*) AS relations, count(*) FILTER (polarity = 'negative') AS hostile, count(*) FILTER (polarity IN ('negative', 'mixed')) AS conflicts,
    count(*) FILTER (dynamic_arc <> 'none') AS arcs FROM relationships GROUP BY 1),
said AS (SELECT script_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: contains(l, ':') OR contains(l, '：')) AS ls FROM scene_rows),
sf AS (SELECT script_id, count(*) AS scenes, count(*) FILTER (trim(text) <> '') AS told, avg(length(text)) FILTER (trim(text) <> '') AS lm, stddev_pop(length(text)) FILTER (trim(text) <> '') AS ls,
    count(*) FILTER (len(ls) >= 2) AS talking, sum(list_sum(list_transform(ls, lambda l: length(l)))) AS chars, sum(len(ls)) AS nlines FROM said GROUP BY 1),
f AS (SELECT * FROM uf JOIN low_runs USING (script_id) JOIN dry_runs USING (script_id) LEFT JOIN drv USING (script_id) LEFT JOIN tf USING (script_id) LEFT JOIN ef USING (script_id)
  LEFT JOIN cf USING (script_id) LEFT JOIN rf USING (script_id) LEFT JOIN sf USING (script_id)),
scored AS (SELECT *, CASE WHEN coalesce(entities, 0) = 0 THEN 2.0 ELSE round(greatest(1.0, least(10.0, 10.0 * able / leads)) + 1e-9, 2) END AS agency,
    CASE WHEN stages = 0 THEN 3.0 ELSE round(greatest(1.0, least(10.0, 8.0 * setups / greatest(decisions, 1))) + 1e-9, 2) END AS setup FROM f)"""

_SCORES = {
    "story": {
        "structural_completeness": "round(blocks / 4.0 * 10.0 + 1e-9, 2)",
        "reversal_effectiveness": "round(least(10.0, (reversals + 0.5 * boosters) / greatest(units, 1) * 8.0 + CASE WHEN reversals > 0 THEN 2.0 ELSE 0.0 END) + 1e-9, 2)",
        "plot_unit_count_per_ep": "CASE WHEN units / ep >= 6 THEN 10 WHEN units / ep >= 4 THEN 8 WHEN units / ep >= 2 THEN 6 WHEN units / ep >= 1 THEN 4 ELSE 2 END",
    },
    "character": {
        "protagonist_identifiable": "CASE WHEN leads > 0 THEN 10 WHEN entities > 0 THEN 6 ELSE 2 END",
        "protagonist_agency": "agency",
        "decision_setup_rate": "setup",
        "ooc_rate": "round(10.0 - 10.0 * greatest(0.0, 1.0 - (agency + setup) / 20.0) + 1e-9, 2)",
        "antagonist_quality": "CASE WHEN antagonists > 0 AND coalesce(hostile, 0) > 0 THEN 9 WHEN antagonists > 0 THEN 7 WHEN coalesce(hostile, 0) > 0 THEN 6 WHEN entities > 0 THEN 4 ELSE 2 END",
        "relationship_conflict_strength": "CASE WHEN coalesce(relations, 0) = 0 THEN 3.0 ELSE round(greatest(1.0, least(10.0, 10.0 * conflicts / relations)) + 1e-9, 2) END",
        "relationship_arc_change": "CASE WHEN coalesce(relations, 0) = 0 THEN 3.0 ELSE round(greatest(1.0, least(10.0, 1.0 + 9.0 * arcs / relations)) + 1e-9, 2) END",
    },
    "concept": {
        "drama_tags_confidence": "CASE WHEN dc IS NOT NULL THEN round(greatest(0.0, least(10.0, 10.0 * dc)) + 1e-9, 2) WHEN dramas > 0 THEN 6 ELSE 2 END",
        "genre_market_fit": "CASE WHEN coalesce(dramas, 0) = 0 THEN 2.0 ELSE round(greatest(1.0, least(10.0, 10.0 * mainstream / dramas)) + 1e-9, 2) END",
        "early_genre_signal": "CASE WHEN early THEN 9.0 ELSE 3.5 END",
    },
    "emotion": {
        "payoff_density": "CASE WHEN payoffs / ep >= 1.5 THEN 10 WHEN payoffs / ep >= 0.8 THEN 8 WHEN payoffs / ep >= 0.3 THEN 6 ELSE 3 END",
        "emotional_driver_distribution": "CASE WHEN drivers IS NULL THEN 3.0 ELSE round(greatest(2.0, 10.0 - 5.0 * top_driver / drivers) + 1e-9, 2) END",
        "emotional_variety": "CASE WHEN drivers IS NULL THEN 2.0 ELSE round(greatest(1.0, least(10.0, 10.0 * h / greatest(log2(kinds), 1e-9))) + 1e-9, 2) END",
        "emotional_contrast": "CASE pos + neg WHEN 2 THEN 9 WHEN 1 THEN 6 ELSE 3 END",
        "dry_streak_max": "CASE WHEN dry_streak <= 2 THEN 10 WHEN dry_streak <= 4 THEN 8 WHEN dry_streak <= 6 THEN 6 ELSE 3 END",
        "episode_end_hook_rate": "CASE WHEN end_hooks / ep >= 0.8 THEN 10 WHEN end_hooks / ep >= 0.5 THEN 8 WHEN end_hooks / ep >= 0.25 THEN 6 ELSE 3 END",
        "paid_break_potential": "CASE WHEN breaks / ep >= 0.8 THEN 10 WHEN breaks / ep >= 0.4 THEN 8 WHEN breaks / ep >= 0.15 THEN 6 ELSE 3 END",
    },
    "pacing": {
        "opening_speed": "CASE WHEN coalesce(opening, 1) / units <= 0.05 THEN 10 WHEN coalesce(opening, 1) / units <= 0.12 THEN 8 WHEN coalesce(opening, 1) / units <= 0.2 THEN 6 ELSE 3 END",
        "plot_unit_density": "CASE WHEN units / ep >= 5 THEN 10 WHEN units / ep >= 3 THEN 8 WHEN units / ep >= 1.5 THEN 6 ELSE 3 END",
        "narrative_intensity_distribution": "CASE WHEN x_mean >= 4.5 THEN 10 WHEN x_mean >= 3 THEN 8 WHEN x_mean >= 2 THEN 6 ELSE 3 END",
        "intensity_cv": "CASE WHEN x_mean = 0 OR x_std / x_mean <= 0.6 THEN 10 WHEN x_std / x_mean <= 0.8 THEN 8 WHEN x_std / x_mean <= 1.0 THEN 6 ELSE 3 END",
        "middle_sag": "CASE WHEN units < 3 THEN 4 WHEN x_middle / greatest(x_mean, 1e-9) >= 0.9 THEN 10 WHEN x_middle / greatest(x_mean, 1e-9) >= 0.8 THEN 8 WHEN x_middle / greatest(x_mean, 1e-9) >= 0.7 THEN 6 ELSE 3 END",
        "downtime_penalty": "CASE WHEN low_streak <= 1 THEN 10 WHEN low_streak <= 3 THEN 7 WHEN low_streak <= 5 THEN 5 ELSE 2 END",
        "dialogue_action_ratio": "round(greatest(2.0, 10.0 - 10.0 * abs(dense / units - sparse / units)) + 1e-9, 2)",
        "beats_per_episode": "CASE WHEN stages / ep >= 3 THEN 10 WHEN stages / ep >= 2 THEN 8 WHEN stages / ep >= 1 THEN 6 ELSE 3 END",
        "effective_narrative_rate": "CASE WHEN effective / units >= 0.8 THEN 10 WHEN effective / units >= 0.65 THEN 8 WHEN effective / units >= 0.45 THEN 6 ELSE 3 END",
        "scene_length_distribution": "CASE WHEN coalesce(told, 0) = 0 THEN 3 WHEN ls / greatest(lm, 1e-9) <= 0.6 THEN 9 WHEN ls / greatest(lm, 1e-9) <= 0.9 THEN 7 WHEN ls / greatest(lm, 1e-9) <= 1.2 THEN 5 ELSE 3 END",
    },
    "dialogue": {
        "dialogue_density": "round(greatest(1.0, least(10.0, 10.0 * (dense + 0.75 * moderate + 0.45 * sparse) / units)) + 1e-9, 2)",
        "topic_focus": "CASE WHEN coalesce(scenes, 0) = 0 THEN 3.0 ELSE round(greatest(1.0, least(10.0, 10.0 * talking / scenes)) + 1e-9, 2) END",
        "voiceover_fit": "round(greatest(1.0, least(10.0, 10.0 * (1 - 0.8 * narrator / units + 0.2 * mixed / units))) + 1e-9, 2)",
        "brevity_ratio": "CASE WHEN coalesce(nlines, 0) = 0 THEN 3 WHEN chars / nlines BETWEEN 18 AND 36 THEN 9 WHEN chars / nlines BETWEEN 12 AND 48 THEN 7 WHEN chars / nlines BETWEEN 8 AND 60 THEN 5 ELSE 3 END",
    },
}
_BASE = (UNITS, SCRIPT_TAGS, EPISODE_TAGS, ENTITIES, RELATIONSHIPS, _SCENES, _FACTS)


def _signal_sql(dimension: str) -> str:
    return " UNION ALL ".join(f"SELECT script_id, '{k}' AS key, CAST({e} AS DOUBLE) AS score FROM scored" for k, e in _SCORES[dimension].items())


def _dimension(dimension: str):
    keys = [k for k, s in signals.REGISTRY.items() if s.dimension == dimension]

    @query(f"sg_{dimension}_signals", with_(*_BASE, select=_signal_sql(dimension)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signals.signals(script_facts(spark, sf_dir), keys).select("script_id", "key", "score")

    return run


for _name in _SCORES:
    _dimension(_name)

_SIGNALS = "sig AS (" + " UNION ALL ".join(_signal_sql(d) for d in _SCORES) + ")"
#: A rubric over the rule signals: every signal of a dimension weighs alike but the first, which weighs double; each
#: dimension also lists one signal that nothing resolves, and dialogue three, so its gate isn't always met.
RUBRIC = [(d, k, 2.0 if i == 0 else 1.0) for d, s in _SCORES.items() for i, k in enumerate(s)]
RUBRIC += [(d, f"judged_{d}_{i}", 1.0) for d in _SCORES for i in range(5 if d == "dialogue" else 1)]
WEIGHTS = [("story", 0.25, 1.2), ("character", 0.2, 1.0), ("concept", 0.1, 0.8), ("emotion", 0.2, 1.1), ("pacing", 0.15, 1.0), ("dialogue", 0.1, None)]


def _values(rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_RUBRIC = f"rubric(dimension, key, weight) AS (VALUES {_values(RUBRIC)})"
_WEIGHTS = f"weights(dimension, base, multiplier) AS (VALUES {_values(WEIGHTS)})"
_DIMS = """dims AS (SELECT script_id, dimension, CASE WHEN coverage >= 0.5 THEN mean END AS score, coverage FROM (
  SELECT s.script_id, r.dimension, sum(greatest(0, least(10, sig.score)) * r.weight) FILTER (sig.score IS NOT NULL) / sum(r.weight) FILTER (sig.score IS NOT NULL) AS mean,
    coalesce(sum(r.weight) FILTER (sig.score IS NOT NULL), 0) / sum(r.weight) AS coverage
  FROM (SELECT DISTINCT script_id FROM sig) s CROSS JOIN rubric r LEFT JOIN sig ON sig.script_id = s.script_id AND sig.key = r.key GROUP BY 1, 2))"""


def _rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRIC, "dimension string, key string, weight double")


def _all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signals(script_facts(spark, sf_dir))


@query("agg9_dimension_scores", with_(*_BASE, _SIGNALS, _RUBRIC, _DIMS, select="SELECT script_id, dimension, round(score, 6) AS score, round(coverage, 6) AS coverage FROM dims"))
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.dimension_scores(_all_signals(spark, sf_dir), _rubric(spark))
    return out.select("script_id", "dimension", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(
    "top2_top_signals",
    with_(
        *_BASE, _SIGNALS, _RUBRIC,
        select="SELECT * FROM (SELECT script_id, dimension, key, round(score * weight, 6) AS contribution, row_number() OVER (PARTITION BY script_id, dimension ORDER BY score * weight DESC, key) AS rank FROM sig JOIN rubric USING (key)) WHERE rank <= 3",
    ),
)
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.top_signals(_all_signals(spark, sf_dir), _rubric(spark))
    return out.select("script_id", "dimension", "key", F.round("contribution", 6).alias("contribution"), F.col("rank").cast("bigint").alias("rank"))


_OVERALL = "overall AS (SELECT script_id, round(sum(score * w) / sum(w), 3) AS overall, count(*) AS dimensions FROM (SELECT script_id, score, greatest(0, base * coalesce(multiplier, 1)) AS w FROM dims JOIN weights USING (dimension) WHERE score IS NOT NULL) GROUP BY 1)"


def _overall(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scores = stored(scoring.dimension_scores(_all_signals(spark, sf_dir), _rubric(spark)), "scores")
    return scores, scoring.overall(scores, spark.createDataFrame(WEIGHTS, "dimension string, base double, multiplier double"))


@query("agg11_overall_score", with_(*_BASE, _SIGNALS, _RUBRIC, _WEIGHTS, _DIMS, _OVERALL, select="SELECT * FROM overall"))
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overall(spark, sf_dir)[1]


CUTS = [("default", d, 4.0, 6.0, 8.0) for d in _SCORES] + [("genre0", "story", 5.0, 7.0, 9.0), ("genre0", "pacing", 3.0, 5.0, 7.0)]
_GENRE = "genre AS (SELECT script_id, min_by(value, (-c, value)) AS genre FROM (SELECT script_id, value, count(*) AS c FROM script_tags GROUP BY 1, 2) GROUP BY 1)"
_TIERED = f"""cuts(genre, dimension, p25, p50, p75) AS (VALUES {_values(CUTS)}),
tiered AS (SELECT d.script_id, d.dimension, d.score, CASE WHEN d.score IS NULL THEN 'insufficient' WHEN d.score >= coalesce(o.p75, f.p75) THEN 'excellent' WHEN d.score >= coalesce(o.p50, f.p50) THEN 'good'
    WHEN d.score >= coalesce(o.p25, f.p25) THEN 'weak' ELSE 'poor' END AS tier
  FROM dims d LEFT JOIN genre g USING (script_id) LEFT JOIN cuts o ON o.genre = g.genre AND o.dimension = d.dimension JOIN cuts f ON f.genre = 'default' AND f.dimension = d.dimension)"""


def _genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = script_tags(spark, sf_dir).groupBy("script_id", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("script_id").agg(F.min_by("value", F.struct(-F.col("c"), "value")).alias("genre"))


def _tiered(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    cuts = spark.createDataFrame(CUTS, "genre string, dimension string, p25 double, p50 double, p75 double")
    return scoring.tiers(scores.join(_genre(spark, sf_dir), "script_id", "left"), cuts)


@query("sg_tiers", with_(*_BASE, _SIGNALS, _RUBRIC, _DIMS, _GENRE, _TIERED, select="SELECT script_id, dimension, round(score, 6) AS score, tier FROM tiered"))
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.dimension_scores(_all_signals(spark, sf_dir), _rubric(spark))
    return _tiered(spark, sf_dir, scores).select("script_id", "dimension", F.round("score", 6).alias("score"), "tier")


@query(
    "agg15_decision",
    with_(
        *_BASE, _SIGNALS, _RUBRIC, _WEIGHTS, _DIMS, _OVERALL, _GENRE, _TIERED,
        "w AS (SELECT script_id, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (dimension IN ('story', 'character', 'emotion') AND tier IN ('poor', 'insufficient')), '') AS weak_core FROM tiered GROUP BY 1)",
        select="SELECT script_id, overall, weak_core, CASE WHEN overall IS NULL THEN 'insufficient_data' WHEN overall >= 7.5 AND weak_core = '' THEN 'recommended' WHEN overall >= 6 THEN 'conditional_recommend' ELSE 'not_recommended' END AS decision FROM w LEFT JOIN overall USING (script_id)",
    ),
)
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, total = _overall(spark, sf_dir)
    rows = _tiered(spark, sf_dir, scores).join(total, "script_id", "left")
    return scoring.decide(rows, ("story", "character", "emotion")).select("script_id", "overall", F.array_join("weak_core", ",").alias("weak_core"), "decision")


_PACING = f"""px AS (SELECT script_id, episode_no AS episode, {INTENSITY} AS x, plot_hook, conflict_type, payoff_type FROM units),
pl AS (SELECT script_id, episode, x, count(*) AS n FROM px GROUP BY 1, 2, 3),
ph AS (SELECT script_id, episode, string_agg(x || ':' || n, ',' ORDER BY x) AS histogram FROM pl GROUP BY 1, 2)"""


@query(
    "agg8_pacing_curve",
    with_(
        UNITS, _PACING,
        select="""SELECT script_id, episode, count(*) AS units, round(avg(x), 4) AS avg_intensity, CAST(max(x) AS BIGINT) AS max_intensity, count(*) FILTER (plot_hook <> 'none') AS hooks,
  count(*) FILTER (conflict_type <> 'none') AS conflicts, count(*) FILTER (payoff_type <> 'none') AS payoffs, any_value(histogram) AS histogram FROM px JOIN ph USING (script_id, episode) GROUP BY 1, 2""",
    ),
)
def pacing_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: how each episode of each script moves."""
    return scoring.pacing_curve(units(spark, sf_dir))


@query(
    "agg14_risk_level",
    with_(
        "hits AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 150 THEN 'high' WHEN event_type = 'error' THEN 'medium' ELSE 'low' END AS level, event_type AS category FROM events WHERE value > 100)",
        "c AS (SELECT user_id, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY 1)",
        select="SELECT *, CAST(CASE WHEN high >= 1 THEN 1 WHEN medium >= 3 THEN 4 WHEN medium >= 1 OR low >= 6 THEN 7 ELSE 9 END AS BIGINT) AS score FROM c",
    ),
)
def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    hits = events(spark, sf_dir).filter("value > 100").select("user_id", F.when(error & (F.col("value") > 150), "high").when(error, "medium").otherwise("low").alias("level"), F.col("event_type").alias("category"))
    out = scoring.risk_level(hits, ["user_id"])
    return out.withColumns({"categories": F.array_join("categories", ","), "score": F.col("score").cast("bigint")})


@query(
    "agg16_motivation",
    with_(
        UNITS,
        select="""SELECT script_id, setups, breaks, CAST(CASE WHEN setups = 0 THEN 3 WHEN breaks > setups THEN 4 WHEN breaks > 0 THEN 7 ELSE 9 END AS BIGINT) AS score FROM (
  SELECT script_id, count(*) FILTER (story_stage IN ('setup', 'trigger')) AS setups, count(*) FILTER (story_stage = 'none' AND event_type = 'error') AS breaks FROM units GROUP BY 1)""",
    ),
)
def motivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units(spark, sf_dir).groupBy("script_id").agg(
        F.count_if(F.col("story_stage").isin("setup", "trigger")).alias("setups"), F.count_if((F.col("story_stage") == "none") & (F.col("event_type") == "error")).alias("breaks")
    )
    score = F.when(F.col("setups") == 0, 3).when(F.col("breaks") > F.col("setups"), 4).when(F.col("breaks") > 0, 7).otherwise(9)
    return out.withColumn("score", score.cast("bigint"))


@query(
    "agg1_characters_by_appearances",
    with_(CAST, select="SELECT name, count(*) AS appearances FROM cast_of GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
)
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_of(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("appearances")).orderBy(F.desc("appearances"), "name").limit(25)


@query(
    "agg2_character_roles",
    with_(
        CAST,
        "s AS (SELECT name, count(*) AS appearances, min((scene_id, line)) AS f FROM cast_of GROUP BY 1)",
        "r AS (SELECT *, row_number() OVER (ORDER BY appearances DESC, name) - 1 AS rank, max(appearances) OVER () AS top FROM s)",
        select="""SELECT name, appearances, f[1] AS first_scene, CASE WHEN rank < 2 AND appearances >= 0.5 * top THEN 'lead' WHEN appearances >= greatest(3, 0.2 * top) THEN 'supporting' ELSE 'minor' END AS role FROM r""".replace("f[1]", "struct_extract_at(f, 1)"),
    ),
)
def character_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by rank and by the share of the most frequent character's appearances, which one row holds."""
    stats = cast_of(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("appearances"), F.min(F.struct("scene_id", "line")).alias("f"))
    top = stats.agg(F.max("appearances").alias("top"))
    leading = stats.orderBy(F.desc("appearances"), "name").limit(2).select("name", F.lit(True).alias("leads"))
    rows = stats.join(F.broadcast(leading), "name", "left").crossJoin(F.broadcast(top))
    role = F.when(F.col("leads") & (F.col("appearances") >= 0.5 * F.col("top")), "lead").when(F.col("appearances") >= F.greatest(F.lit(3), 0.2 * F.col("top")), "supporting").otherwise("minor")
    return rows.select("name", "appearances", F.col("f.scene_id").alias("first_scene"), role.alias("role"))


@query(
    "agg28_best_event",
    "SELECT user_id, CAST(day(ts) AS BIGINT) AS day, max_by(event_id, (p, -event_id)) AS event_id FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS p FROM events) GROUP BY 1, 2",
)
def best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each scene (a user's day) the event of the first kind in order; the first one wins a tie."""
    kinds = ["error", "view", "click", "signup", "purchase"]
    priority = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type"))
    return events(spark, sf_dir).groupBy("user_id", F.dayofmonth("ts").cast("bigint").alias("day")).agg(F.max_by("event_id", F.struct(priority, -F.col("event_id"))).alias("event_id"))


@query(
    "win12_paid_break_position",
    with_(
        UNITS,
        "e AS (SELECT script_id, episode_no, max(idx) FILTER (plot_hook <> 'none') AS anchor, count(DISTINCT unit_id) AS n, max(row_in) FILTER (plot_hook <> 'none') AS local FROM (SELECT *, row_number() OVER (PARTITION BY script_id, episode_no ORDER BY idx) AS row_in FROM units) GROUP BY 1, 2)",
        select="""SELECT script_id, episode_no, anchor, n, CASE WHEN anchor / n >= 0.85 THEN 'ep_end' WHEN anchor / n >= 0.6 THEN 'two_third' WHEN anchor / n >= 0.3 THEN 'mid' ELSE 'none' END AS position,
  CASE WHEN local / n >= 0.85 THEN 'ep_end' WHEN local / n >= 0.6 THEN 'two_third' WHEN local / n >= 0.3 THEN 'mid' ELSE 'none' END AS local_position FROM e""",
    ),
)
def paid_break_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an episode's last hook is, by the index in the script (as it is) and by the one in the episode (as it may be meant)."""
    rows = units(spark, sf_dir).withColumn("row_in", F.row_number().over(Window.partitionBy("script_id", "episode_no").orderBy("idx")))
    hook = F.col("plot_hook") != "none"
    out = rows.groupBy("script_id", "episode_no").agg(F.max(F.when(hook, F.col("idx"))).alias("anchor"), F.count_distinct("unit_id").alias("n"), F.max(F.when(hook, F.col("row_in"))).alias("local"))
    where = lambda c: label(F.col(c) / F.col("n"), [(0.85, "ep_end"), (0.6, "two_third"), (0.3, "mid")], "none", "none")
    return out.select("script_id", "episode_no", "anchor", "n", where("anchor").alias("position"), where("local").alias("local_position"))
