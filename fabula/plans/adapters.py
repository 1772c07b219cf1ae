"""The given tables seen as story relations, in DataFrames and, for the oracles, in SQL.

* a user's events are a script's plot units, in order of time, a day being an episode; the kind of event, its value and its
  properties give the tags;
* documents are scenes: the source is the script, ``doc_id % 10`` the episode;
* conversations are scripts of lines; orders with their suppliers are scenes with characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMS = ("plot_hook", "conflict_type", "payoff_type", "emotional_driver", "dialogue_density", "story_stage", "voiceover_type")
_TAGS = {
    "plot_hook": {"click": "identity_reveal", "error": "reversal"},
    "conflict_type": {"error": "revenge", "purchase": "confrontation"},
    "payoff_type": {"purchase": "face_slapping", "signup": "counterattack"},
    "emotional_driver": {"click": "curiosity", "error": "anger", "purchase": "desire", "signup": "pity"},
}
STAGES = ("setup", "trigger", "escalation", "climax", "payoff", "teaser", "none")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def units(spark: SparkSession, sf_dir: str | DataFrame) -> DataFrame:
    """script_id, unit_id, idx, episode_no, k, value and DIMS as columns."""
    if isinstance(sf_dir, DataFrame):
        return sf_dir  # units that are there already
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.col("event_type")
    tags = {
        dim: F.coalesce(*(F.when(kind == e, F.lit(v)) for e, v in values.items()), F.lit("none")) for dim, values in _TAGS.items()
    } | {
        "dialogue_density": F.when(F.col("value") < 20, "sparse").when(F.col("value") < 60, "moderate").otherwise("dense"),
        "story_stage": F.element_at(F.array(*map(F.lit, STAGES)), (F.col("k") % 7 + 1).cast("int")),
        "voiceover_type": F.when(F.col("k") % 5 == 0, "narrator").when(F.col("k") % 5 == 1, "mixed").otherwise("none"),
    }
    return rows.select(
        F.col("user_id").alias("script_id"), F.col("event_id").alias("unit_id"), idx.cast("bigint").alias("idx"), F.dayofmonth("ts").cast("bigint").alias("episode_no"), "k", "value", "ts", "event_type", *(c.alias(d) for d, c in tags.items())
    )


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE 'none' END"


UNITS = f"""units AS (
  SELECT user_id AS script_id, event_id AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
    CAST(day(ts) AS BIGINT) AS episode_no, k, value, ts, event_type,
    {", ".join(f"{_case('event_type', v)} AS {d}" for d, v in _TAGS.items())},
    CASE WHEN value < 20 THEN 'sparse' WHEN value < 60 THEN 'moderate' ELSE 'dense' END AS dialogue_density,
    (ARRAY[{", ".join(f"'{s}'" for s in STAGES)}])[k % 7 + 1] AS story_stage,
    CASE k % 5 WHEN 0 THEN 'narrator' WHEN 1 THEN 'mixed' ELSE 'none' END AS voiceover_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

INTENSITY = "least(8, CASE WHEN plot_hook <> 'none' THEN 2 ELSE 0 END + CASE WHEN conflict_type <> 'none' THEN 2 ELSE 0 END + CASE WHEN payoff_type <> 'none' THEN 3 ELSE 0 END + CASE WHEN emotional_driver <> 'none' THEN 1 ELSE 0 END)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("script_id")).distinct().withColumn("total_episodes", F.lit(None).cast("bigint"))


def unit_tags(unit_rows: DataFrame) -> DataFrame:
    """Units as rows of tags: script_id, unit_id, idx, dim, value; a tag that says none is left out."""
    each = F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("tag")) for d in DIMS)))
    rows = unit_rows.select("script_id", "unit_id", "idx", "episode_no", each)
    return rows.filter("tag <> 'none'").withColumnRenamed("tag", "value")


UNIT_TAGS = "unit_tags AS (" + " UNION ALL ".join(f"SELECT script_id, unit_id, idx, episode_no, '{d}' AS dim, {d} AS value FROM units WHERE {d} <> 'none'" for d in DIMS) + ")"


def script_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's genres: the last digit of each unit's property, with a confidence by its value."""
    return units(spark, sf_dir).select("script_id", F.lit("drama_tags").alias("dim"), F.concat(F.lit("genre"), F.col("k") % 3).alias("value"), (F.col("k") / 100).alias("confidence"))


SCRIPT_TAGS = "script_tags AS (SELECT script_id, 'drama_tags' AS dim, 'genre' || (k % 3) AS value, k / 100.0::DOUBLE AS confidence FROM units)"


def episode_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last unit of an episode says whether it ends with a hook, and whether with a paid break."""
    last = units(spark, sf_dir).groupBy("script_id", "episode_no").agg(F.max_by("plot_hook", "idx").alias("hook"), F.max_by("k", "idx").alias("k"))
    breaks = F.when(F.col("k") % 3 == F.col("script_id") % 4, "ep_end").otherwise("none")
    both = F.array(F.struct(F.lit("episode_end_hook").alias("dim"), F.col("hook").alias("value")), F.struct(F.lit("paid_break_position").alias("dim"), breaks.alias("value")))
    return last.select("script_id", "episode_no", F.inline(both))


EPISODE_TAGS = """episode_tags AS (SELECT script_id, episode_no, 'episode_end_hook' AS dim, max_by(plot_hook, idx) AS value FROM units GROUP BY 1, 2
  UNION ALL SELECT script_id, episode_no, 'paid_break_position', CASE WHEN max_by(k, idx) % 3 = script_id % 4 THEN 'ep_end' ELSE 'none' END FROM units GROUP BY 1, 2)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters: the kinds of event in a script, the most frequent one leading."""
    n = units(spark, sf_dir).groupBy("script_id", "event_type").agg(F.count(F.lit(1)).alias("appearances"), F.avg("value").alias("v"))
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("appearances"), "event_type"))
    role = F.when(F.col("r") == 1, "protagonist").when(F.col("event_type") == "error", "antagonist").otherwise("supporting")
    level = F.when(F.col("v") >= 55, "high").when(F.col("v") >= 45, "medium").otherwise("low")
    return n.withColumn("r", rank).select("script_id", F.col("event_type").alias("char_id"), role.alias("role"), level.alias("agency_level"), "appearances")


ENTITIES = """entities AS (
  SELECT script_id, event_type AS char_id, CASE WHEN r = 1 THEN 'protagonist' WHEN event_type = 'error' THEN 'antagonist' ELSE 'supporting' END AS role,
    CASE WHEN v >= 55 THEN 'high' WHEN v >= 45 THEN 'medium' ELSE 'low' END AS agency_level, appearances
  FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY appearances DESC, event_type) AS r
        FROM (SELECT script_id, event_type, count(*) AS appearances, avg(value) AS v FROM units GROUP BY 1, 2)))"""


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event that follow each other, tied by how often."""
    by_script = Window.partitionBy("script_id").orderBy("idx")
    pairs = units(spark, sf_dir).withColumn("next", F.lead("event_type").over(by_script)).filter("next IS NOT NULL AND next <> event_type")
    tied = pairs.groupBy("script_id", F.least("event_type", "next").alias("src"), F.greatest("event_type", "next").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    polarity = F.when((F.col("src") == "error") | (F.col("dst") == "error"), "negative").when(F.col("n") % 3 == 0, "mixed").otherwise("positive")
    return tied.select("script_id", "src", "dst", "n", polarity.alias("polarity"), F.when(F.col("n") >= 5, "rising").otherwise("none").alias("dynamic_arc"))


RELATIONSHIPS = """relationships AS (
  SELECT *, CASE WHEN src = 'error' OR dst = 'error' THEN 'negative' WHEN n % 3 = 0 THEN 'mixed' ELSE 'positive' END AS polarity,
    CASE WHEN n >= 5 THEN 'rising' ELSE 'none' END AS dynamic_arc
  FROM (SELECT script_id, least(event_type, nx) AS src, greatest(event_type, nx) AS dst, count(*) AS n
        FROM (SELECT script_id, event_type, lead(event_type) OVER (PARTITION BY script_id ORDER BY idx) AS nx FROM units)
        WHERE nx IS NOT NULL AND nx <> event_type GROUP BY 1, 2, 3))"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scenes: script (the source), scene_id, episode_no, scene_no (text), text."""
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("script"), F.col("doc_id").alias("scene_id"), (F.col("doc_id") % 10).alias("episode_no"), F.concat_ws("-", (F.col("doc_id") % 10).cast("string"), F.floor(F.col("doc_id") / 10).cast("string")).alias("scene_no"), "text", "lang"
    )


SCENES = "scenes AS (SELECT source AS script, doc_id AS scene_id, doc_id % 10 AS episode_no, (doc_id % 10) || '-' || (doc_id // 10) AS scene_no, text, lang FROM documents)"


def cast_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes with their suppliers as characters: scene_id, name; one row for each mention."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_suppkey").alias("name"), F.col("l_linenumber").cast("bigint").alias("line"))


CAST = "cast_of AS (SELECT l_orderkey AS scene_id, l_suppkey AS name, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty trimmed lines of documents: doc_id, pos (in the text, from 0), line."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim("raw").alias("line")).filter("line <> ''")


LINES = "lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE line <> '')"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
