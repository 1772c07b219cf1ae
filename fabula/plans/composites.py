"""Queries for composite operators: plot units, candidates, events, targets, experiments, and arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.operators import relational as ops
from fabula.operators import retrieval
from fabula.plans.adapters import CAST, INTENSITY, LINES, UNIT_TAGS, UNITS, cast_of, events, lines, read, unit_tags, units, with_
from fabula.plans.registry import query

S = SparkSession


@query("cmp3_fallback_units", with_(UNITS, "s AS (SELECT script_id, episode_no, min(idx) AS first, max(idx) AS last FROM units GROUP BY 1, 2)", select="SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY episode_no, first) AS idx, first, last FROM s"))
def fallback_units(spark: S, sf: str) -> DataFrame:
    """Where nothing was segmented, each scene (here a day) is a unit, numbered through the script."""
    s = units(spark, sf).groupBy("script_id", "episode_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    idx = F.row_number().over(Window.partitionBy("script_id").orderBy("episode_no", "first"))
    return s.select("script_id", idx.cast("bigint").alias("idx"), "first", "last")


@query(
    "cmp5_relationship_candidates",
    with_(
        "terms AS (SELECT n_nationkey AS name, lower(left(n_name, 3)) AS alias FROM nation)", "m AS (SELECT DISTINCT doc_id, name FROM documents JOIN terms ON contains(lower(text), alias))",
        select="SELECT a.name AS a, b.name AS b, count(*) AS c FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY c DESC, a, b LIMIT 15",
    ),
)
def relationship_candidates(spark: S, sf: str) -> DataFrame:
    """Names found in units, then pairs of names that share units. Names are few (25), so a unit has few pairs."""
    terms = read(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), F.lower(F.left("n_name", F.lit(3))).alias("alias"))
    docs = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    found = docs.join(F.broadcast(terms), F.contains("t", "alias")).groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("ns"))
    pairs = found.select(F.explode("ns").alias("a"), "ns").select("a", F.explode(F.filter("ns", lambda n: n > F.col("a"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    return counted.orderBy(F.desc("c"), "a", "b").limit(15)


@query("cmp7_tag_targets", with_(UNITS, "t AS (SELECT 'script' AS scope, script_id::VARCHAR AS target FROM units UNION SELECT 'episode', script_id || ':' || episode_no FROM units UNION SELECT 'unit', unit_id::VARCHAR FROM units)", "b(scope, bundle) AS (VALUES ('script', 'genre'), ('episode', 'pacing'), ('unit', 'emotion'), ('unit', 'dialogue'))", select="SELECT scope, bundle, count(*) AS targets FROM t JOIN b USING (scope) GROUP BY 1, 2"))
def tag_targets(spark: S, sf: str) -> DataFrame:
    """What is to be tagged at each grain, by bundle."""
    u = units(spark, sf)
    parts = [("script", F.col("script_id").cast("string")), ("episode", F.concat_ws(":", F.col("script_id").cast("string"), F.col("episode_no").cast("string"))), ("unit", F.col("unit_id").cast("string"))]
    targets = [u.select(F.lit(s).alias("scope"), t.alias("target")).distinct() for s, t in parts]
    bundles = spark.createDataFrame([("script", "genre"), ("episode", "pacing"), ("unit", "emotion"), ("unit", "dialogue")], "scope string, bundle string")
    rows = targets[0].unionByName(targets[1]).unionByName(targets[2]).join(F.broadcast(bundles), "scope")
    return rows.groupBy("scope", "bundle").agg(F.count(F.lit(1)).alias("targets"))


@query("cmp9_reward_events", with_(UNITS, "r AS (SELECT script_id, episode_no, unit_id, CASE payoff_type WHEN 'face_slapping' THEN 2 WHEN 'counterattack' THEN 1 END AS p FROM units WHERE payoff_type <> 'none')", select="SELECT script_id, episode_no, max_by(unit_id, (p, -unit_id)) AS unit_id, count(*) AS n FROM r GROUP BY 1, 2"))
def reward_events(spark: S, sf: str) -> DataFrame:
    """The best payoff of each scene; the first one wins among equals."""
    rows = units(spark, sf).filter("payoff_type <> 'none'").withColumn("p", F.when(F.col("payoff_type") == "face_slapping", 2).otherwise(1))
    return rows.groupBy("script_id", "episode_no").agg(F.max_by("unit_id", F.struct("p", -F.col("unit_id"))).alias("unit_id"), F.count(F.lit(1)).alias("n"))


@query(
    "cmp11_rewrite_targets",
    with_(UNITS, f"x AS (SELECT *, {INTENSITY} AS x FROM units)", "e AS (SELECT script_id, episode_no, count(*) FILTER (x <= 2) AS weak, count(DISTINCT event_type) AS dims, min(idx) AS i FROM x GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY weak DESC, dims DESC, i) AS k FROM e)", select="SELECT script_id, episode_no, row_number() OVER (PARTITION BY script_id ORDER BY i) AS place FROM r WHERE k <= 4"),
)
def rewrite_targets(spark: S, sf: str) -> DataFrame:
    """The scenes that need rewriting most, in story order."""
    from fabula.operators.signals import intensity

    x = intensity(*(F.col(c) for c in ("plot_hook", "conflict_type", "payoff_type", "emotional_driver")))
    e = units(spark, sf).withColumn("x", x).groupBy("script_id", "episode_no").agg(F.count_if(F.col("x") <= 2).alias("weak"), F.count_distinct("event_type").alias("dims"), F.min("idx").alias("i"))
    best = ops.top_n(e, ["script_id"], [F.desc("weak"), F.desc("dims"), F.asc("i")], 4)
    return best.select("script_id", "episode_no", F.row_number().over(Window.partitionBy("script_id").orderBy("i")).cast("bigint").alias("place"))


@query("cmp15_experiment_progress", with_(UNITS, UNIT_TAGS, "d AS (SELECT dim, script_id, count(*) AS n FROM unit_tags GROUP BY 1, 2)", select="SELECT dim, count(*) FILTER (n >= 10) AS complete, count(*) FILTER (n < 10) AS pending FROM d GROUP BY 1"))
def experiment_progress(spark: S, sf: str) -> DataFrame:
    d = unit_tags(units(spark, sf)).groupBy("dim", "script_id").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("dim").agg(F.count_if(F.col("n") >= 10).alias("complete"), F.count_if(F.col("n") < 10).alias("pending"))


@query(
    "jn16_kind_neighbours",
    with_(UNITS, "n AS (SELECT unit_id, event_type, value, lag(unit_id) OVER w AS p, lag(event_type) OVER w AS pe, lead(unit_id) OVER w AS q, lead(event_type) OVER w AS qe FROM units WINDOW w AS (PARTITION BY script_id ORDER BY idx))", "sel AS (SELECT * FROM n WHERE value > 120)", "c AS (SELECT p AS unit_id, value * 0.5 AS s FROM sel WHERE pe = 'signup' UNION ALL SELECT q, value * 0.5 FROM sel WHERE qe = 'signup')", select="SELECT unit_id, round(max(s), 6) AS score FROM c WHERE unit_id NOT IN (SELECT unit_id FROM sel) GROUP BY 1"),
)
def kind_neighbours(spark: S, sf: str) -> DataFrame:
    """Neighbours of one kind, for half of the score."""
    by = Window.partitionBy("script_id").orderBy("idx")
    near = lambda f: F.struct(f("unit_id").over(by).alias("id"), f("event_type").over(by).alias("kind"))
    chosen = units(spark, sf).select("unit_id", "value", F.array(near(F.lag), near(F.lead)).alias("near")).filter("value > 120")
    around = chosen.select(F.explode("near").alias("x"), (F.col("value") * 0.5).alias("s")).filter("x.kind = 'signup'").select(F.col("x.id").alias("unit_id"), "s")
    return around.join(chosen.select("unit_id"), "unit_id", "left_anti").groupBy("unit_id").agg(F.round(F.max("s"), 6).alias("score"))


@query("str15_query_build", "WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM benchmark), a AS (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM t WHERE len(ws) > 1) SELECT item_id, ws[i] || ' ' || ws[i + 1] AS phrase, count(*) * 2 AS weight FROM a GROUP BY 1, 2")
def query_build(spark: S, sf: str) -> DataFrame:
    """Adjacent words of a query as phrases of double weight, as rows instead of a query string."""
    words = read(spark, sf, "benchmark").select("item_id", retrieval.tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 1)
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select("item_id", F.explode(pairs).alias("phrase")).groupBy("item_id", "phrase").agg((F.count(F.lit(1)) * 2).alias("weight"))


@query("str18_synonyms", with_("s(term, synonym) AS (VALUES ('error', 'fault'), ('view', 'look'), ('view', 'glance'))", select="SELECT event_id, synonym FROM events LEFT JOIN s ON s.term = event_type"))
def synonyms(spark: S, sf: str) -> DataFrame:
    table = spark.createDataFrame([("error", "fault"), ("view", "look"), ("view", "glance")], "event_type string, synonym string")
    return events(spark, sf).select("event_id", "event_type").join(F.broadcast(table), "event_type", "left").select("event_id", "synonym")


_QUOTES = """CASE WHEN event_type = 'view' AND idx % 50 = 7 THEN '▲' || value || repeat(' 走', 60) WHEN event_type = 'error' THEN '人物：' || value WHEN event_type = 'click' AND idx % 3 = 0 THEN ' click：' || value
  WHEN event_type = 'purchase' THEN 'much too long a name: ' || value ELSE '第' || idx || '场' END"""


@query(
    "str22_quote_pick",
    with_(UNITS, f"r AS (SELECT script_id, episode_no, idx, trim({_QUOTES}) AS line, row_number() OVER (PARTITION BY script_id, episode_no ORDER BY idx) AS no FROM units)", "p AS (SELECT *, CASE WHEN line LIKE '▲%' THEN 1 WHEN line LIKE 'click：%' THEN 2 WHEN line LIKE 'much%' THEN 3 ELSE 4 END AS pass FROM r)", "b AS (SELECT script_id, episode_no, min(pass) AS pass, min_by(line, (pass, no)) AS line, min_by(no, (pass, no)) AS no, string_agg(line, chr(10) ORDER BY no) AS text FROM p GROUP BY 1, 2)", "q AS (SELECT *, CASE WHEN pass < 4 THEN line ELSE text END AS q FROM b)", select="SELECT script_id, episode_no, CASE WHEN length(q) > 90 THEN left(q, 89) || '…' ELSE q END AS quote, CASE WHEN pass < 4 THEN no ELSE 1 END AS line FROM q"),
)
def quote_pick(spark: S, sf: str) -> DataFrame:
    """The quote of each episode: an action, else something said, else any line that isn't structure, else the beginning."""
    rows = units(spark, sf).select("script_id", "episode_no", "idx", F.expr(_QUOTES).alias("line"))
    texts = rows.groupBy("script_id", "episode_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("text"))
    best = texts.withColumn("q", tx.best_quote(F.col("text")))
    return best.select("script_id", "episode_no", "q.quote", F.col("q.line").cast("bigint").alias("line"))


@query("str34_title_keys", r"SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' — ' || p_type, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM part")
def title_keys(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", tx.title_key(F.concat_ws(" — ", "p_name", "p_type")).alias("key"))


@query("arr1_arr2_arrays", with_(CAST, "s AS (SELECT scene_id, list_sort(list_distinct(list(name))) AS ns FROM cast_of GROUP BY 1)", select="SELECT scene_id, len(ns) AS n, array_to_string(ns[1:3], ',') AS head, list_contains(ns, 1) AS has_first FROM s"))
def arrays(spark: S, sf: str) -> DataFrame:
    """Sets of names written as a list literal and read again: size, first members, membership."""
    s = cast_of(spark, sf).groupBy("scene_id").agg(F.array_sort(F.collect_set("name")).alias("ns"))
    written = F.concat(F.lit("['"), F.array_join(F.transform("ns", lambda x: x.cast("string")), "', '"), F.lit("']"))
    read_ = F.transform(F.from_json(F.replace(written, F.lit("'"), F.lit('"')), "array<string>"), lambda x: x.cast("bigint"))
    return s.select("scene_id", read_.alias("ns")).select("scene_id", F.size("ns").cast("bigint").alias("n"), F.array_join(F.transform(F.slice("ns", 1, 3), lambda x: x.cast("string")), ",").alias("head"), F.array_contains("ns", 1).alias("has_first"))


@query("map1_histograms", "SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def histograms(spark: S, sf: str) -> DataFrame:
    n = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    shown = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("user_id", F.array_join(shown, ";").alias("histogram"))


@query("jsn2_jsn4_report_cards", "SELECT user_id, event_type AS dimension, max(value) AS score FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def report_cards(spark: S, sf: str) -> DataFrame:
    """A score card kept as a JSON array, and one of its cards looked up."""
    rows = events(spark, sf).groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    cards = rows.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct(F.col("event_type").alias("dimension"), "score"))).alias("cards"))
    card = F.from_json("cards", "array<struct<dimension:string,score:double>>")
    return cards.select("user_id", F.inline(F.filter(card, lambda c: c["dimension"] == "click")))
