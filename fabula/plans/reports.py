"""Queries for lookups, chunk tables, reports and files: what is read and written around the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import scoring as fn
from fabula.functions import text as tx
from fabula.operators import graph, retrieval, scoring, structure
from fabula.operators import relational as ops
from fabula.operators.relational import new_folder
from fabula.plans import story
from fabula.plans.adapters import SCENES, UNITS, events, read, scenes, units, with_
from fabula.plans.registry import query
from fabula.sources import files

S = SparkSession


@query("src10_point_lookup", with_(SCENES, select="SELECT scene_id, script, episode_no, scene_no, text FROM scenes WHERE scene_id = 117"))
def point_lookup(spark: S, sf: str) -> DataFrame:
    """One scene by its id; the predicate reaches the scan."""
    return scenes(spark, sf).filter("scene_id = 117").select("scene_id", "script", "episode_no", "scene_no", "text")


@query("snk4_chunk_upsert", "WITH c AS (SELECT lang AS index_name, sha256(source || '|' || (doc_id % 200)) AS chunk_id, doc_id AS v, length(text) AS n FROM documents) SELECT index_name, chunk_id, max(v) AS v, max_by(n, v)::BIGINT AS n FROM c GROUP BY 1, 2")
def chunk_upsert(spark: S, sf: str) -> DataFrame:
    """Chunks written by index and id: later documents of a source replace the chunks of earlier ones."""
    digest = F.sha2(F.concat_ws("|", "source", (F.col("doc_id") % 200).cast("string")), 256)
    rows = read(spark, sf, "documents").select(F.col("lang").alias("index_name"), digest.alias("chunk_id"), F.col("doc_id").alias("v"), F.length("text").cast("bigint").alias("n"))
    middle = rows.agg(F.max("v").alias("m"))
    parts = rows.crossJoin(F.broadcast(middle))
    old, new = parts.filter("2 * v <= m").drop("m"), parts.filter("2 * v > m").drop("m")
    return ops.upsert(old, new, ["index_name", "chunk_id"], "v")


_YAML = "'video_side:' || chr(10) || '  - dim: ' || n_name || chr(10) || '    stable: ' || n_nationkey || '  # of 25' || chr(10) || '  - dim: \"' || n_name || ' 2\"' || chr(10) || '    stable: ' || n_regionkey"


@query("src13_yaml_side", "WITH y(nation, dim, stable) AS (SELECT n_nationkey, n_name, n_nationkey FROM nation UNION ALL SELECT n_nationkey, n_name || ' 2', n_regionkey FROM nation) SELECT c_mktsegment AS segment, dim, stable::BIGINT AS stable, count(*) AS n FROM customer JOIN y ON c_nationkey = nation GROUP BY 1, 2, 3")
def yaml_side(spark: S, sf: str) -> DataFrame:
    """A snapshot kept as YAML items (here written from the nations), read as rows and joined to what was measured."""
    item = lambda name, key: F.concat(F.lit("  - dim: "), name, F.lit("\n    stable: "), key)
    text = F.concat(F.lit("video_side:\n"), item(F.col("n_name"), F.col("n_nationkey").cast("string")), F.lit("  # of 25\n"), item(F.concat(F.lit('"'), "n_name", F.lit(' 2"')), F.col("n_regionkey").cast("string")))
    rows = read(spark, sf, "nation").select("n_nationkey", F.explode(files.yaml_items(text)).alias("x"))
    side = rows.select(F.col("n_nationkey").alias("c_nationkey"), F.col("x")["dim"].alias("dim"), F.col("x")["stable"].cast("bigint").alias("stable"))
    joined = read(spark, sf, "customer").join(side, "c_nationkey")
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), "dim", "stable").agg(F.count(F.lit(1)).alias("n"))


@query("snk8_report_lines", "WITH r AS (SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean FROM events GROUP BY 1) SELECT '| dim | n | verdict |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || CASE WHEN mean >= 50 THEN 'PASS' ELSE 'FAIL' END || ' |', chr(10) ORDER BY event_type) AS report FROM r")
def report_lines(spark: S, sf: str) -> DataFrame:
    """A report as a table of Markdown, a row for each of a few dimensions."""
    r = events(spark, sf).groupBy(F.col("event_type").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("mean"))
    return files.markdown_table(r.select("dim", "n", F.when(F.col("mean") >= 50, "PASS").otherwise("FAIL").alias("verdict")), ["dim"])


@query(
    "cmp12_report",
    with_(
        *story._BASE, story._SIGNALS, story._RUBRIC, story._WEIGHTS, story._DIMS, story._OVERALL, story._GENRE, story._TIERED,
        "w AS (SELECT script_id, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (dimension IN ('story', 'character', 'emotion') AND tier IN ('poor', 'insufficient')), '') AS weak_core FROM tiered GROUP BY 1)",
        select="SELECT script_id, CASE WHEN overall IS NULL THEN 'insufficient_data' WHEN overall >= 7.5 AND weak_core = '' THEN 'recommended' WHEN overall >= 6 THEN 'conditional_recommend' ELSE 'not_recommended' END AS decision, dimension, round(score, 6) AS score, tier FROM tiered JOIN w USING (script_id) LEFT JOIN overall USING (script_id)",
    ),
)
def report(spark: S, sf: str) -> DataFrame:
    """Each script's report as one JSON document, decision, weak dimensions and cards, read again as the rows of its cards."""
    scores, total = story._overall(spark, sf)
    tiered = ops.stored(story._tiered(spark, sf, scores).join(total, "script_id", "left"), "tiered")
    cards = tiered.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("dimension", F.round("score", 6).alias("score"), "tier"))).alias("cards"))
    made = scoring.decide(tiered, ("story", "character", "emotion")).join(cards, "script_id")
    documents = made.select("script_id", F.to_json(F.struct("decision", "overall", "weak_core", "cards"), {"ignoreNullFields": "false"}).alias("report"))
    parsed = F.from_json("report", "decision string, cards array<struct<dimension:string,score:double,tier:string>>")
    return documents.select("script_id", parsed.alias("r")).select("script_id", "r.decision", F.inline("r.cards"))


@query(
    "cmp8_risk_screen",
    with_(
        "h AS (SELECT user_id, event_id, ts, event_type AS category, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'signup' THEN 'low' END AS level FROM events WHERE event_type IN ('error', 'purchase', 'signup') AND value > 60)",
        "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS n FROM h) WHERE n <= CASE level WHEN 'high' THEN 30 ELSE 60 END)",
        "c AS (SELECT user_id, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM k GROUP BY 1)",
        select="SELECT *, CAST(CASE WHEN high >= 1 THEN 1 WHEN medium >= 3 THEN 4 WHEN medium >= 1 OR low >= 6 THEN 7 ELSE 9 END AS BIGINT) AS score FROM c",
    ),
)
def risk_screen(spark: S, sf: str) -> DataFrame:
    """Terms looked up by level, at most 30 high, 60 medium and 60 low hits of a script kept, and the level of risk of these."""
    terms = spark.createDataFrame([(0, "error", "high"), (1, "purchase", "medium"), (2, "sign", "low")], "ord int, term string, level string")
    hits = events(spark, sf).filter("value > 60").join(F.broadcast(terms), F.contains("event_type", "term"))
    first = Window.partitionBy("event_id").orderBy("ord")
    hits = hits.withColumn("r", F.row_number().over(first)).filter("r = 1")
    place = F.row_number().over(Window.partitionBy("user_id", "level").orderBy("ts", "event_id"))
    kept = hits.withColumn("n", place).filter(F.col("n") <= F.when(F.col("level") == "high", 30).otherwise(60))
    out = scoring.risk_level(kept.select("user_id", "level", F.col("event_type").alias("category")), ["user_id"])
    return out.withColumns({"categories": F.array_join("categories", ","), "score": F.col("score").cast("bigint")})


_TEMPLATES = [("error", "poor", "Mend {n} errors first"), ("error", "weak", "Look at {n} errors"), ("view", "weak", "Shorten {n} views"), ("click", "poor", "Rethink {n} clicks")]


@query(
    "cmp10_tiered_actions",
    with_(
        "t(event_type, tier, body) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _TEMPLATES) + ")",
        "s AS (SELECT user_id, event_type, count(*) AS n, CASE WHEN round(avg(value), 6) >= 60 THEN 'good' WHEN round(avg(value), 6) >= 45 THEN 'weak' ELSE 'poor' END AS tier FROM events GROUP BY 1, 2)",
        "e AS (SELECT user_id, event_type, min_by(event_id, (value, event_id)) AS evidence FROM events WHERE value < 20 GROUP BY 1, 2)",
        select="SELECT user_id, event_type, tier, replace(body, '{n}', n::VARCHAR) AS action, evidence FROM s JOIN t USING (event_type, tier) JOIN e USING (user_id, event_type) WHERE tier IN ('poor', 'weak')",
    ),
)
def tiered_actions(spark: S, sf: str) -> DataFrame:
    """One action for each signal whose tier can be acted on, that has a template for the tier and evidence, its text filled in."""
    mean = F.round(F.avg("value"), 6)
    tier = F.when(mean >= 60, "good").when(mean >= 45, "weak").otherwise("poor")
    signals = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), tier.alias("tier"))
    evidence = events(spark, sf).filter("value < 20").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("evidence"))
    templates = spark.createDataFrame(_TEMPLATES, "event_type string, tier string, body string")
    rows = signals.filter(F.col("tier").isin("poor", "weak")).join(F.broadcast(templates), ["event_type", "tier"]).join(evidence, ["user_id", "event_type"])
    return rows.select("user_id", "event_type", "tier", tx.rendered(F.col("body"), {"n": F.col("n").cast("string")}).alias("action"), "evidence")


@query("cmp3_units_with_scenes")
def units_with_scenes(spark: S, sf: str) -> DataFrame:
    """Proposed intervals repaired in each episode, and the lines (here units) that fall into each; an episode without a
    proposal is one interval. The repair is sequential, so there is no SQL twin; every line is in one interval."""
    u = units(spark, sf)
    proposed = F.when(F.col("k") % 17 == 0, "?").otherwise((F.col("idx") - F.col("k") % 3).cast("string"))
    listed = F.struct("idx", proposed.alias("start"), (F.col("idx") + F.col("k") % 7).cast("string").alias("end"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("idx"), F.min("idx").cast("string").alias("start"), F.max("idx").cast("string").alias("end")))
    found = F.array_sort(F.collect_list(F.when(F.col("idx") % 9 == 1, listed)))
    spans = u.groupBy("script_id", "episode_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.when(F.size(found) > 0, found).otherwise(whole).alias("spans"))
    repaired = structure.repaired(spans).select("script_id", "episode_no", F.col("idx").alias("place"), "start", "end")
    joined = ops.interval_join(u.select("script_id", "idx"), repaired, "script_id", "idx", "start", "end", 64)
    return joined.groupBy("script_id", "episode_no", "place", "start", "end").agg(F.count(F.lit(1)).alias("lines"))


@query("cmp4_entities_with_roles")
def entities_with_roles(spark: S, sf: str) -> DataFrame:
    """Names joined to entities, those too unlike to join but like enough to ask about, and the entities' roles by the scenes
    that they are in. Greedy, tested against a plain version."""
    u = units(spark, sf).withColumn("name", F.substr("event_type", F.lit(1), (3 + F.col("k") % 6).cast("int")))
    mentions = ops.stored(u.groupBy("script_id", "name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("episode_no").alias("in_scenes")), "mentions")
    resolved = ops.stored(graph.resolve_names(mentions), "resolved")
    scenes_of = resolved.join(mentions, ["script_id", "name"]).select("script_id", "entity", "place", F.explode("in_scenes").alias("scene"))
    sizes = scenes_of.groupBy("script_id", "entity", "place").agg(F.count_distinct("scene").alias("scenes"))
    told = graph.roles(sizes).select("script_id", "entity", "scenes", "role")
    return resolved.join(told, ["script_id", "entity"]).select("script_id", "name", "entity", "ask", "scenes", "role")


@query("str24_numbered_lines", "SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: '[L' || i || '] ' || l), chr(10))) AS digest FROM documents")
def numbered_lines(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.sha2(tx.numbered(F.col("text")), 256).alias("digest"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    "str15_weighted_query",
    with_(
        f"q AS (SELECT item_id, unnest({_WORDS}) AS term, unnest(range(len({_WORDS}))) AS pos FROM benchmark)",
        f"dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) WHERE term IN (SELECT term FROM q))",
        "raw AS (SELECT term, log10(10 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM dt GROUP BY 1)", "tw AS (SELECT term, raw / sum(raw) OVER () AS w FROM raw)",
        "wq AS (SELECT item_id, pos, term, w, lead(term) OVER b AS nt, lead(w) OVER b AS nw, lead(pos) OVER b AS np FROM q JOIN tw USING (term) WINDOW b AS (PARTITION BY item_id ORDER BY pos))",
        select="SELECT item_id, kind, term, round(max(w), 9) AS w FROM (SELECT item_id, 'term' AS kind, term, w FROM wq UNION ALL SELECT item_id, 'synonym', term || 's', w / 4 FROM wq WHERE length(term) >= 6 UNION ALL SELECT item_id, 'phrase', term || ' ' || nt, greatest(w, nw) * 2 FROM wq WHERE np = pos + 1) GROUP BY 1, 2, 3",
    ),
)
def weighted_query(spark: S, sf: str) -> DataFrame:
    """A query as weighted terms: its words, their synonyms (here plurals of long words) for a quarter of the weight, and
    neighbouring words as phrases for twice the larger weight."""
    items = read(spark, sf, "benchmark").select("item_id", F.posexplode(retrieval.tokens(F.col("text"))).alias("pos", "term"))
    docs = read(spark, sf, "documents")
    terms = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term")).join(items.select("term").distinct(), "term", "left_semi")
    weights = retrieval.term_weights(terms, docs.agg(F.count(F.lit(1)).alias("n"))).select("term", "w")
    synonyms = items.filter(F.length("term") >= 6).select("term", F.concat("term", F.lit("s")).alias("synonym")).distinct()
    return retrieval.weighted_terms(items.join(weights, "term"), synonyms).select(F.col("item_id"), "kind", "term", F.round("w", 9).alias("w"))


@query("mth3_agg10_score_labels", "SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 'high' WHEN value / 100 >= 0.45 THEN 'medium' ELSE 'low' END AS label, greatest(1.0, least(10.0, value / 10)) AS score, CASE WHEN value >= 100 THEN 10.0 WHEN value >= 50 THEN 8.0 WHEN value >= 20 THEN 6.0 ELSE 3.0 END AS step FROM events")
def score_labels(spark: S, sf: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf).select("event_id", fn.confidence_label(v / 100).alias("label"), fn.clamp(v / 10, 1, 10).alias("score"), fn.ladder(v, [(100, 10), (50, 8), (20, 6)], 3).alias("step"))


# ---- files, written from the tables and read again
@query("src1_src5_src16_text_files", "WITH t AS (SELECT source, string_agg(replace(text, chr(13), ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1) SELECT source, len(list_filter(string_split(t, chr(10)), lambda l: trim(l) <> '')) AS lines FROM t")
def text_files(spark: S, sf: str) -> DataFrame:
    """Each source's documents as text files in a folder of its own, listed and read line by line."""
    folder = new_folder(spark, "texts")
    read(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(folder)
    rows = files.read_text_lines(spark, f"{folder}/*/*.txt")
    source = F.regexp_extract("path", r"source=([^/]+)/", 1)
    return rows.filter(F.trim("line") != "").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("lines"))


@query("src5_ingested_folder", "WITH f AS (SELECT source || CASE WHEN source IN ('src1', 'src2') THEN '.csv' WHEN source = 'src3' THEN '/完整本_x.md' ELSE '.txt' END AS path, count(*) AS n FROM documents GROUP BY source), s AS (SELECT path, CASE WHEN contains(path, '完整本_') THEN 'guarded' WHEN path LIKE '%.csv' THEN 'skipped' WHEN n < 3 THEN 'short' ELSE 'ingested' END AS status, n AS scenes FROM f), k AS (SELECT *, sum((status = 'ingested')::INT) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) - (status = 'ingested')::INT AS before FROM s) SELECT path, status, scenes FROM k WHERE before < 9")
def ingested_folder(spark: S, sf: str) -> DataFrame:
    """Sources seen as files, their documents as scenes: the first nine files that can be used, and what was left out on the
    way there. Two are of another format and one is a report of a data set."""
    ending = F.when(F.col("source").isin("src1", "src2"), ".csv").when(F.col("source") == "src3", "/完整本_x.md").otherwise(".txt")
    scenes = read(spark, sf, "documents").groupBy(F.concat("source", ending).alias("path")).agg(F.count(F.lit(1)).alias("scenes"))
    listed = scenes.select("path", F.when(files.suffix(F.col("path")).isin(*files.TEXT, *files.DOCX), "supported").otherwise("skipped").alias("status"))
    return files.ingested(listed, scenes, 9)


@query("src12_report_files", "SELECT event_type AS dim, 'reported' AS status, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT r_name, 'missing', 0 FROM region")
def report_files(spark: S, sf: str) -> DataFrame:
    """Reports written as a JSON file each and read again, with the wanted dimensions that none of them has."""
    folder = new_folder(spark, "reports")
    made = events(spark, sf).groupBy(F.col("event_type").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    made.write.option("maxRecordsPerFile", 1).json(folder)
    wanted = made.select("dim").unionByName(read(spark, sf, "region").select(F.col("r_name").alias("dim")))
    reports, missing = files.read_reports(spark, folder, wanted)
    return reports.select("dim", F.lit("reported").alias("status"), "n").unionByName(missing.select("dim", F.lit("missing").alias("status"), F.lit(0).cast("bigint").alias("n")))


@query("src12_src14_snk_label_files", "SELECT event_type AS dim, count(*) AS n, count(DISTINCT user_id) AS targets FROM events GROUP BY 1")
def label_files(spark: S, sf: str) -> DataFrame:
    """Raw labels as JSON lines by dimension, read again."""
    folder = new_folder(spark, "labels")
    rows = events(spark, sf).select(F.col("event_type").alias("dim"), F.col("user_id").cast("string").alias("target_id"), F.dayofmonth("ts").alias("run"), F.col("value").cast("string").alias("value"))
    files.append_labels(rows, folder)
    return files.read_labels(spark, folder).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").cast("bigint").alias("targets"))


@query("snk1_parents_with_children", "SELECT o_orderkey AS k, count(l_orderkey) AS n_children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def parents_with_children(spark: S, sf: str) -> DataFrame:
    """Orders and their lines written as one batch, and again as if it had failed: a batch that is there is replaced."""
    folder = new_folder(spark, "orders")
    parents = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    children = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    for _ in range(2):
        files.insert_with_children(parents, children, folder, "k", "first")
    return spark.read.parquet(f"{folder}/parents").select("k", "n_children")
