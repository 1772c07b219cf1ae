"""Queries for filters, joins, aggregations, windows, top-k and set operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import scoring as fn
from fabula.operators import relational as ops
from fabula.operators.signals import intensity, longest_run
from fabula.plans.adapters import CAST, EPISODE_TAGS, INTENSITY, SCENES, SCRIPT_TAGS, UNIT_TAGS, UNITS, cast_of, episode_tags, events, read, scenes, script_tags, unit_tags, units, with_
from fabula.plans.registry import query

S = SparkSession


def _day(column: str = "ts"):
    return F.dayofmonth(column).cast("bigint")


def _intensity():
    return intensity(*(F.col(c) for c in ("plot_hook", "conflict_type", "payoff_type", "emotional_driver")))


# ---- filters and projections
WORDS = ("the", "LA", "der")


@query("flt1_keyword_or", with_(SCENES, select="SELECT scene_id, episode_no FROM scenes WHERE " + " OR ".join(f"text ILIKE '% {w} %'" for w in WORDS)))
def keyword_or(spark: S, sf: str) -> DataFrame:
    return scenes(spark, sf).filter(fn.any_of([F.col("text").ilike(f"% {w} %") for w in WORDS])).select("scene_id", "episode_no")


@query("flt2_member_or_substring", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') OR text ILIKE '%tion.%'")
def member_or_substring(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").filter(F.array_contains(F.split(F.lower("text"), " "), "the") | F.col("text").ilike("%tion.%")).select("doc_id")


@query(
    "flt3_first_episodes",
    with_(UNITS, "r AS (SELECT script_id, unit_id, episode_no, dense_rank() OVER (PARTITION BY script_id ORDER BY episode_no) AS d, max(episode_no) OVER (PARTITION BY script_id) AS m, row_number() OVER (PARTITION BY script_id ORDER BY idx) AS rn FROM units)", select="SELECT script_id, unit_id, episode_no FROM r WHERE (m IS NOT NULL AND d <= 3) OR (m IS NULL AND rn <= 6)"),
)
def first_episodes(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("script_id")
    rows = units(spark, sf).withColumns({"d": F.dense_rank().over(by.orderBy(F.asc_nulls_last("episode_no"))), "m": F.max("episode_no").over(by), "rn": F.row_number().over(by.orderBy("idx"))})
    return rows.filter((F.col("m").isNotNull() & (F.col("d") <= 3)) | (F.col("m").isNull() & (F.col("rn") <= 6))).select("script_id", "unit_id", "episode_no")


@query(
    "flt10_request_filters",
    "SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13) AND event_type <> 'error' AND value >= 10",
)
def request_filters(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).filter(fn.all_of([F.col("user_id").isin(1, 2, 3, 5, 8, 13), F.col("event_type") != "error", F.col("value") >= 10])).select("event_id")


ALLOWED = [("plot_hook", "identity_reveal"), ("conflict_type", "revenge"), ("conflict_type", "confrontation"), ("story_stage", "setup"), ("story_stage", "climax")]
_ALLOWED = "allowed(dim, value) AS (VALUES " + ", ".join(f"('{d}', '{v}')" for d, v in ALLOWED) + ")"


@query(
    "flt11_enum_validation",
    with_(UNITS, UNIT_TAGS, _ALLOWED, select="SELECT t.dim, t.value, count(*) AS n FROM unit_tags t WHERE t.dim IN (SELECT dim FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.dim = t.dim AND a.value = t.value) GROUP BY 1, 2"),
)
def enum_validation(spark: S, sf: str) -> DataFrame:
    allowed = F.broadcast(spark.createDataFrame(ALLOWED, "dim string, value string"))
    closed = unit_tags(units(spark, sf)).join(allowed.select("dim").distinct(), "dim", "left_semi")
    return closed.join(allowed, ["dim", "value"], "left_anti").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


@query("flt13_json_guards", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_guards(spark: S, sf: str) -> DataFrame:
    k = F.from_json("props", "map<string,bigint>")["k"]
    return events(spark, sf).select("event_id", k.alias("k")).filter("k IS NOT NULL AND k > 50")


@query("prj1_prefix", "SELECT doc_id, left(text, 40) AS head FROM documents")
def prefix(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.left("text", F.lit(40)).alias("head"))


_WIDE = ("plot_hook", "payoff_type", "story_stage")


@query("prj2_tags_wide", with_(UNITS, select=f"SELECT unit_id, {', '.join(_WIDE)} FROM units"))
def tags_wide(spark: S, sf: str) -> DataFrame:
    """Tags as rows turned into columns again, a missing one being none: a pivot over a fixed list of dimensions."""
    base = units(spark, sf)
    wide = unit_tags(base).filter(F.col("dim").isin(*_WIDE)).groupBy("unit_id").pivot("dim", list(_WIDE)).agg(F.last("value"))
    return base.select("unit_id").join(wide, "unit_id", "left").fillna("none", subset=list(_WIDE))


@query(
    "prj3_tags_nested",
    with_(UNITS, UNIT_TAGS, "g AS (SELECT unit_id, dim, string_agg(value, '+' ORDER BY value) AS vs FROM unit_tags GROUP BY 1, 2)", select="SELECT unit_id, string_agg(dim || '=' || vs, ';' ORDER BY dim) AS tags FROM g GROUP BY 1"),
)
def tags_nested(spark: S, sf: str) -> DataFrame:
    by_dim = unit_tags(units(spark, sf)).groupBy("unit_id", "dim").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    nested = by_dim.groupBy("unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "vs")))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return nested.select("unit_id", F.array_join(shown, ";").alias("tags"))


# ---- joins
@query("jn1_tags_of_units", with_(UNITS, UNIT_TAGS, select="SELECT t.unit_id, t.dim, t.value, u.event_type FROM unit_tags t JOIN units u USING (unit_id) WHERE t.dim = 'conflict_type'"))
def tags_of_units(spark: S, sf: str) -> DataFrame:
    base = units(spark, sf)
    return unit_tags(base).filter("dim = 'conflict_type'").join(base.select("unit_id", "event_type"), "unit_id").select("unit_id", "dim", "value", "event_type")


@query("jn2_left_with_predicate", with_(UNITS, UNIT_TAGS, select="SELECT u.unit_id, t.value FROM units u LEFT JOIN unit_tags t ON t.unit_id = u.unit_id AND t.dim IN ('plot_hook', 'payoff_type')"))
def left_with_predicate(spark: S, sf: str) -> DataFrame:
    """Units without a tag of these dimensions stay, so the predicate belongs to the join, not to a filter after it."""
    base = units(spark, sf)
    u, t = base.alias("u"), unit_tags(base).alias("t")
    return u.join(t, (F.col("u.unit_id") == F.col("t.unit_id")) & F.col("t.dim").isin("plot_hook", "payoff_type"), "left").select("u.unit_id", "t.value")


@query("jn3_left_all_tags", with_(UNITS, UNIT_TAGS, select="SELECT u.unit_id, count(t.dim) AS tags FROM units u LEFT JOIN unit_tags t USING (unit_id) GROUP BY 1"))
def left_all_tags(spark: S, sf: str) -> DataFrame:
    base = units(spark, sf)
    return base.select("unit_id").join(unit_tags(base), "unit_id", "left").groupBy("unit_id").agg(F.count("dim").alias("tags"))


@query("jn4_double_lookup", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, s.n_name AS supplier_nation, c.n_name AS customer_nation FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation c ON c.n_nationkey = c_nationkey")
def double_lookup(spark: S, sf: str) -> DataFrame:
    """Both ends of a relation looked up in one dimension."""
    nation = read(spark, sf, "nation")
    side = lambda name: F.broadcast(nation.select(F.col("n_nationkey").alias(f"{name}_key"), F.col("n_name").alias(f"{name}_nation")))  # noqa: E731  25 rows
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = rows.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(side("supplier"), F.col("s_nationkey") == F.col("supplier_key")).join(side("customer"), F.col("c_nationkey") == F.col("customer_key"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "supplier_nation", "customer_nation")


@query("jn5_two_aggregates", with_(CAST, "a AS (SELECT name, count(*) AS n FROM cast_of GROUP BY 1)", "b AS (SELECT name, min(scene_id) AS first_scene FROM cast_of GROUP BY 1)", select="SELECT * FROM a JOIN b USING (name)"))
def two_aggregates(spark: S, sf: str) -> DataFrame:
    """Two aggregates of one relation by one key are one aggregation."""
    return cast_of(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first_scene"))


@query("jn6_lateral_latest", "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true")
def lateral_latest(spark: S, sf: str) -> DataFrame:
    """For each customer its newest finished order, if any: an aggregation by customer in place of a lateral join."""
    done = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    newest = ops.latest(done, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return read(spark, sf, "customer").select("c_custkey").join(newest, "c_custkey", "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("jn7_either_side_counted", "SELECT count(*) AS n FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) s ON s_suppkey = l_suppkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 45) p ON p_partkey = l_partkey WHERE s_suppkey IS NOT NULL OR p_partkey IS NOT NULL")
def either_side_counted(spark: S, sf: str) -> DataFrame:
    poor = read(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("a"))
    large = read(spark, sf, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("b"))
    rows = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(poor, "l_suppkey", "left").join(large, "l_partkey", "left")
    return rows.agg(F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("n"))


_SPANS = "spans AS (SELECT script_id, episode_no, min(idx) AS first, max(idx) AS last FROM units GROUP BY 1, 2)"


@query("jn8_interval_join", with_(UNITS, _SPANS, select="SELECT u.unit_id, s.episode_no FROM units u JOIN spans s ON s.script_id = u.script_id AND u.idx BETWEEN s.first AND s.last"))
def interval_join(spark: S, sf: str) -> DataFrame:
    base = units(spark, sf)
    spans = base.groupBy("script_id", "episode_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return ops.interval_join(base.select("script_id", "unit_id", "idx"), spans, "script_id", "idx", "first", "last", 16).select("unit_id", "episode_no")


@query("jn9_boundary_ordinals", with_(UNITS, "o AS (SELECT script_id, unit_id, row_number() OVER (PARTITION BY script_id ORDER BY idx) - 1 AS ordinal FROM units)", "b AS (SELECT script_id, episode_no, min_by(unit_id, idx) AS unit_id FROM units GROUP BY 1, 2)", select="SELECT b.script_id, b.episode_no, o.ordinal FROM b JOIN o USING (script_id, unit_id) WHERE ordinal > 0"))
def boundary_ordinals(spark: S, sf: str) -> DataFrame:
    base = units(spark, sf)
    ordinal = base.select("script_id", "unit_id", (F.row_number().over(Window.partitionBy("script_id").orderBy("idx")) - 1).cast("bigint").alias("ordinal"))
    first = base.groupBy("script_id", "episode_no").agg(F.min_by("unit_id", "idx").alias("unit_id"))
    return first.join(ordinal, ["script_id", "unit_id"]).filter("ordinal > 0").select("script_id", "episode_no", "ordinal")


_PAIRS = "members AS (SELECT DISTINCT scene_id, name FROM cast_of), prs AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM members a JOIN members b ON a.scene_id = b.scene_id AND a.name < b.name GROUP BY 1, 2)"


def _pairs(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    """Distinct members of scenes, and how many scenes two share. A scene's cast is small, so its pairs are few."""
    members = cast_of(spark, sf).select("scene_id", "name").distinct()
    x, y = members.alias("x"), members.alias("y")
    pairs = x.join(y, (F.col("x.scene_id") == F.col("y.scene_id")) & (F.col("x.name") < F.col("y.name")))
    return members, pairs.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count(F.lit(1)).alias("c"))


@query("jn10_theta_self_join", with_(CAST, _PAIRS, select="SELECT a, b, c FROM prs WHERE c >= 2"))
def theta_self_join(spark: S, sf: str) -> DataFrame:
    return _pairs(spark, sf)[1].filter("c >= 2")


@query("agg17_pair_candidates", with_(CAST, _PAIRS, select="SELECT * FROM prs WHERE c >= 2 ORDER BY c DESC, a, b LIMIT 15"))
def pair_candidates(spark: S, sf: str) -> DataFrame:
    return _pairs(spark, sf)[1].filter("c >= 2").orderBy(F.desc("c"), "a", "b").limit(15)


@query(
    "agg18_cooccurrence_graph",
    with_(
        CAST,
        "n AS (SELECT name, count(DISTINCT scene_id) AS k FROM cast_of GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)",
        "members AS (SELECT DISTINCT scene_id, name FROM cast_of WHERE name IN (SELECT name FROM n))",
        "prs AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM members a JOIN members b ON a.scene_id = b.scene_id AND a.name < b.name GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT 120)",
        select="SELECT a, b, round(c / (x.k + y.k - c), 3) AS weight FROM prs JOIN n x ON x.name = a JOIN n y ON y.name = b WHERE round(c / (x.k + y.k - c), 3) >= 0.002",
    ),
)
def cooccurrence_graph(spark: S, sf: str) -> DataFrame:
    """The most frequent characters as nodes, their pairs as edges weighted by Jaccard similarity of scenes."""
    from fabula.operators.graph import cooccurrence_graph as graph

    return graph(cast_of(spark, sf), max_nodes=40, max_edges=30, least=0.002)


@query("jn11_mentions", with_("terms AS (SELECT n_name AS name, lower(left(n_name, 3)) AS alias FROM nation)", select="SELECT t.name, count(DISTINCT doc_id) AS docs FROM documents d JOIN terms t ON contains(lower(d.text), t.alias) GROUP BY 1"))
def mentions(spark: S, sf: str) -> DataFrame:
    """Which documents mention a short list of names: the list is broadcast (25 rows) and tested against each text."""
    terms = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lower(F.left("n_name", F.lit(3))).alias("alias"))
    docs = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.join(F.broadcast(terms), F.contains("t", "alias")).groupBy("name").agg(F.count_distinct("doc_id").alias("docs"))


@query("jn12_edges_of_kept_nodes", with_(CAST, _PAIRS, "kept AS (SELECT name FROM cast_of GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 20)", select="SELECT a, b, c FROM prs WHERE a IN (SELECT name FROM kept) AND b IN (SELECT name FROM kept)"))
def edges_of_kept_nodes(spark: S, sf: str) -> DataFrame:
    kept = cast_of(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)
    return ops.keep_edges(_pairs(spark, sf)[1], kept, "a", "b", "name").select("a", "b", "c")


@query("jn13_key_intersection", "SELECT l.doc_id, l.quality, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS rule FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND d.text <> ''".replace("l.quality,", "l.quality::BIGINT AS quality,").replace("AS rule", "AS rule").replace("ELSE 0 END", "ELSE 0 END::BIGINT"))
def key_intersection(spark: S, sf: str) -> DataFrame:
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").filter("text <> ''").select("doc_id", "n_chars"), "doc_id").filter("quality IS NOT NULL")
    return rows.select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).cast("bigint").alias("rule"))


@query(
    "jn14_pending_work",
    with_(UNITS, "grid AS (SELECT s.script_id, d.episode_no FROM (SELECT DISTINCT script_id FROM units) s CROSS JOIN (SELECT DISTINCT episode_no FROM units) d)", "done AS (SELECT script_id, episode_no, count(*) AS n FROM units GROUP BY 1, 2)", select="SELECT script_id, episode_no, 3 - coalesce(n, 0) AS missing FROM grid LEFT JOIN done USING (script_id, episode_no) WHERE coalesce(n, 0) < 3"),
)
def pending_work(spark: S, sf: str) -> DataFrame:
    """The grid of scripts and episodes (at most 31) against what is there."""
    base = units(spark, sf)
    grid = base.select("script_id").distinct().crossJoin(F.broadcast(base.select("episode_no").distinct()))
    return ops.pending(grid, base, ["script_id", "episode_no"], 3).select("script_id", "episode_no", F.col("missing").cast("bigint").alias("missing"))


@query(
    "jn15_neighbour_context",
    with_(UNITS, "n AS (SELECT unit_id, value, lag(unit_id) OVER w AS p, lead(unit_id) OVER w AS q FROM units WINDOW w AS (PARTITION BY script_id ORDER BY idx))", "sel AS (SELECT * FROM n WHERE value > 120)", "c AS (SELECT p AS unit_id, value * 0.4 AS score FROM sel UNION ALL SELECT q, value * 0.4 FROM sel)", select="SELECT unit_id, round(max(score), 6) AS score FROM c WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT unit_id FROM sel) GROUP BY 1"),
)
def neighbour_context(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("script_id").orderBy("idx")
    linked = units(spark, sf).select("unit_id", "value", F.lag("unit_id").over(by).alias("p"), F.lead("unit_id").over(by).alias("q"))
    chosen = linked.filter("value > 120")
    around = chosen.select(F.explode(F.array("p", "q")).alias("unit_id"), (F.col("value") * 0.4).alias("score")).filter("unit_id IS NOT NULL")
    return around.join(chosen.select("unit_id"), "unit_id", "left_anti").groupBy("unit_id").agg(F.round(F.max("score"), 6).alias("score"))


@query("jn17_evidence_fan_out", "SELECT o_orderkey, o_orderpriority, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'")
def evidence_fan_out(spark: S, sf: str) -> DataFrame:
    """Evidence lists unnested and joined with what they point to."""
    lists = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    urgent = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderpriority")
    return urgent.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", F.explode("refs").alias("l_partkey"))


@query(
    "jn19_duplicate_lookup",
    "WITH d AS (SELECT doc_id, text, nullif(regexp_extract(text, '[a-z0-9._]+@[a-z0-9.]+'), '') AS id FROM documents), t AS (SELECT text, min(doc_id) AS m FROM d GROUP BY 1 HAVING count(*) > 1), h AS (SELECT id, min(doc_id) AS m FROM d WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT d.doc_id, coalesce(h.m, t.m) AS same_as, CASE WHEN h.m IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS source FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN h ON h.id = d.id WHERE coalesce(h.m, t.m) <> d.doc_id",
)
def duplicate_lookup(spark: S, sf: str) -> DataFrame:
    """Duplicates by keys in order of trust: an outside identifier (here the first address in a text), then the digest of the
    whole text."""
    found = F.nullif(F.regexp_extract("text", r"[a-z0-9._]+@[a-z0-9.]+", 0), F.lit(""))
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("whole"), found.alias("outside"))
    same = lambda key: docs.filter(f"{key} IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias(f"by_{key}"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = docs.join(same("outside"), "outside", "left").join(same("whole"), "whole", "left")
    out = rows.select("doc_id", F.coalesce("by_outside", "by_whole").alias("same_as"), F.when(F.col("by_outside").isNotNull(), 0).otherwise(1).cast("bigint").alias("source"))
    return out.filter("same_as IS NOT NULL AND same_as <> doc_id")


# ---- aggregations
@query("agg3_last_by_time", "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def last_by_time(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("agg4_totals", "SELECT count(*) AS n, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean FROM events WHERE event_type = 'view'")
def totals(spark: S, sf: str) -> DataFrame:
    zero = F.lit(0.0)
    return events(spark, sf).filter("event_type = 'view'").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("value"), zero), 4).alias("total"), F.round(F.coalesce(F.avg("value"), zero), 6).alias("mean"))


@query("agg5_counts_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def counts_by_source(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("agg6_distinct_targets", "SELECT DISTINCT CAST(day(ts) AS BIGINT) AS episode_no, event_type FROM events ORDER BY 1, 2 LIMIT 80")
def distinct_targets(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).select(_day().alias("episode_no"), "event_type").distinct().orderBy("episode_no", "event_type").limit(80)


@query("agg7_first_per_key", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_shipdate, l_partkey")
def first_per_key(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("l_partkey"))


@query("agg13_mean_of_cuts", "SELECT p_brand, round(avg(p_size), 6) AS c0, round(avg(p_retailprice), 6) AS c1, round(avg(p_partkey), 6) AS c2 FROM part GROUP BY 1")
def mean_of_cuts(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "part").groupBy("p_brand").agg(*(F.round(F.avg(c), 6).alias(f"c{i}") for i, c in enumerate(("p_size", "p_retailprice", "p_partkey"))))


@query("agg12_least_label", with_(UNITS, "l AS (SELECT script_id, episode_no, min(CASE dialogue_density WHEN 'sparse' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END) AS r FROM units GROUP BY 1, 2)", select="SELECT script_id, episode_no, (ARRAY['low', 'medium', 'high'])[r] AS label FROM l"))
def least_label(spark: S, sf: str) -> DataFrame:
    named = F.when(F.col("dialogue_density") == "sparse", "low").when(F.col("dialogue_density") == "moderate", "medium").otherwise("high")
    rows = units(spark, sf).groupBy("script_id", "episode_no").agg(F.collect_set(named).alias("labels"))
    return rows.select("script_id", "episode_no", fn.least_label(F.col("labels")).alias("label"))


@query("agg20_unit_count_spread", with_(UNITS, select="SELECT script_id, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END, 6) AS cv FROM (SELECT script_id, episode_no, count(*) AS n FROM units GROUP BY 1, 2) GROUP BY 1"))
def unit_count_spread(spark: S, sf: str) -> DataFrame:
    n = units(spark, sf).groupBy("script_id", "episode_no").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("script_id").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    return out.select("script_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.coalesce(fn.ratio(F.col("std"), F.col("mean")), F.lit(0.0)), 6).alias("cv"))


@query("agg21_variance", "SELECT event_type, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def variance(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(F.round(F.coalesce(F.var_pop("value"), F.lit(0.0)), 4).alias("variance"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "agg22_correlations",
    "WITH d AS (SELECT user_id, " + ", ".join(f"coalesce(avg(value) FILTER (event_type = '{k}'), 0) AS {k}" for k in _KINDS) + " FROM events GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(corr({a}, {b})) OR corr({a}, {b}) IS NULL THEN 0 ELSE corr({a}, {b}) END, 6) AS r FROM d" for i, a in enumerate(_KINDS) for b in _KINDS[:i]),
)
def correlations(spark: S, sf: str) -> DataFrame:
    """Correlations of the kinds' means over users, in one aggregation; a constant column has none, which counts as 0."""
    wide = events(spark, sf).groupBy("user_id").agg(*(F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in _KINDS))
    names = [(a, b) for i, a in enumerate(_KINDS) for b in _KINDS[:i]]
    n = F.count(F.lit(1)).cast("double")

    def r(a: str, b: str):
        cov = F.covar_pop(a, b)
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.when((n > 1) & (spread > 0), cov / F.nullif(spread, F.lit(0.0))).otherwise(0.0)

    one = wide.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r(a, b), 6).alias("r")) for a, b in names)).alias("x"))
    return one.select(F.inline("x"))


@query("agg23_coverage", with_(UNITS, "c AS (SELECT script_id, episode_no, avg(CASE WHEN payoff_type <> 'none' THEN 1.0 ELSE 0.0 END) AS c FROM units GROUP BY 1, 2)", select="SELECT episode_no, round(avg(c), 6) AS mean_coverage, count(*) FILTER (c < 0.5) AS insufficient FROM c GROUP BY 1"))
def coverage(spark: S, sf: str) -> DataFrame:
    c = units(spark, sf).groupBy("script_id", "episode_no").agg(F.avg((F.col("payoff_type") != "none").cast("double")).alias("c"))
    return c.groupBy("episode_no").agg(F.round(F.avg("c"), 6).alias("mean_coverage"), F.count_if(F.col("c") < 0.5).alias("insufficient"))


@query("agg24_actionability", "SELECT o_orderpriority, round(avg(((o_totalprice > 1000)::INT + (o_orderstatus <> 'P')::INT + (o_custkey % 2 = 0)::INT + (month(o_orderdate) > 6)::INT + (o_totalprice < 300000)::INT) / 5.0), 6) AS actionability FROM orders GROUP BY 1")
def actionability(spark: S, sf: str) -> DataFrame:
    checks = [F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P", F.col("o_custkey") % 2 == 0, F.month("o_orderdate") > 6, F.col("o_totalprice") < 300000]
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(sum(c.cast("int") for c in checks) / 5.0), 6).alias("actionability"))


@query("agg25_facets", "SELECT source, count(*) AS n FROM documents WHERE text ILIKE '%the%' GROUP BY 1 ORDER BY n DESC, source")
def facets(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").filter(F.col("text").ilike("%the%")).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("agg26_smoothed_shares", with_(UNITS, UNIT_TAGS, "c AS (SELECT dim, value, count(*) AS n FROM unit_tags GROUP BY 1, 2)", select="SELECT dim, value, n, round((n + 1) / (sum(n) OVER () + 1000), 8) AS share FROM c"))
def smoothed_shares(spark: S, sf: str) -> DataFrame:
    n = unit_tags(units(spark, sf)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("dim", "value", "n", F.round((F.col("n") + 1) / (F.col("total") + 1000), 8).alias("share"))


@query("agg27_reconcile", "SELECT count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus <> 'F') AS waiting FROM orders")
def reconcile(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") != "F").alias("waiting"))


@query("agg29_run_metrics", "SELECT event_type AS tool, count(*) AS runs, round(avg(value), 6) AS mean_duration, round(avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END), 6) AS success FROM events GROUP BY 1")
def run_metrics(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 6).alias("mean_duration"), F.round(F.avg((F.col("value") < 100).cast("double")), 6).alias("success"))


@query("agg31_parse_statistics", "SELECT 'lang' AS kind, lang AS name, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY 2")
def parse_statistics(spark: S, sf: str) -> DataFrame:
    """Two histograms from one pass: the rows are pre-aggregated by both keys."""
    both = read(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    named = both.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("lang", "source")))), "n", "chars")
    return named.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("agg34_roll_ups", with_(UNITS, select="SELECT event_type, unit_id // 1000 AS block, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) AS ids, count(*) AS n FROM units GROUP BY 1, 2"))
def roll_ups(spark: S, sf: str) -> DataFrame:
    """The units of each kind in numbered blocks of a thousand ids, so no list grows with the table."""
    rows = units(spark, sf).groupBy("event_type", F.expr("unit_id div 1000").alias("block")).agg(F.array_sort(F.collect_list("unit_id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n")


@query("agg35_merge_pages", with_(UNITS, "p AS (SELECT script_id, k % 10 AS page, min(idx) AS f FROM units GROUP BY 1, 2)", select="SELECT script_id, string_agg(page::VARCHAR, ',' ORDER BY f) AS pages FROM p GROUP BY 1"))
def merge_pages(spark: S, sf: str) -> DataFrame:
    """Pages in the order of their first mention, each once."""
    rows = units(spark, sf).groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("k") % 10).alias("page")))).alias("x"))
    return rows.select("script_id", F.array_join(F.transform(F.array_distinct("x.page"), lambda x: x.cast("string")), ",").alias("pages"))


# ---- windows
@query("win2_rank_in_channel", with_(UNITS, select="SELECT unit_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, unit_id) AS rank FROM units"))
def rank_in_channel(spark: S, sf: str) -> DataFrame:
    """Ranks in a few large channels: in ranges of values, which are small, and then each range's offset is added."""
    rows = units(spark, sf).select("unit_id", "event_type", "value").withColumn("step", F.floor(-F.col("value")))
    sizes = rows.groupBy("event_type", "step").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("event_type", "step").orderBy(F.desc("value"), "unit_id"))
    ranked = rows.withColumn("inside", inside).join(sizes.select("event_type", "step", before.alias("before")), ["event_type", "step"])
    return ranked.select("unit_id", "event_type", (F.col("before") + F.col("inside")).cast("bigint").alias("rank"))


@query("win3_frame_before", with_(UNITS, select="SELECT unit_id, round(sum(value) OVER (PARTITION BY script_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS context FROM units"))
def frame_before(spark: S, sf: str) -> DataFrame:
    frame = Window.partitionBy("script_id").orderBy("idx").rowsBetween(-5, 0)
    return units(spark, sf).select("unit_id", F.round(F.sum("value").over(frame), 4).alias("context"))


@query("win4_neighbours", with_(UNITS, select="SELECT unit_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM units WINDOW w AS (PARTITION BY script_id ORDER BY idx)"))
def neighbours(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("script_id").orderBy("idx")
    return units(spark, sf).select("unit_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


@query(
    "win5_longest_runs",
    with_(UNITS, f"x AS (SELECT *, {INTENSITY} AS x FROM units)", "r AS (SELECT script_id, x, sum(CASE WHEN x <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY script_id ORDER BY idx) AS g FROM x)", select="SELECT script_id, max(n) AS longest FROM (SELECT script_id, g, count(*) FILTER (x <= 2) AS n FROM r GROUP BY 1, 2) GROUP BY 1"),
)
def longest_runs(spark: S, sf: str) -> DataFrame:
    return longest_run(units(spark, sf), ["script_id"], ["idx"], _intensity() <= 2, "longest")


@query("win6_first_place", with_(UNITS, f"x AS (SELECT *, {INTENSITY} AS x FROM units)", select="SELECT script_id, coalesce(min(idx) FILTER (x >= 5), 1) AS place FROM x GROUP BY 1"))
def first_place(spark: S, sf: str) -> DataFrame:
    return units(spark, sf).groupBy("script_id").agg(F.coalesce(F.min(F.when(_intensity() >= 5, F.col("idx"))), F.lit(1)).alias("place"))


@query("win7_middle_third", with_(UNITS, "r AS (SELECT script_id, value, row_number() OVER (PARTITION BY script_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY script_id) AS n FROM units)", select="SELECT script_id, round(avg(value), 6) AS middle FROM r WHERE i >= n // 3 AND i < greatest(n // 3 + 1, 2 * n // 3) GROUP BY 1"))
def middle_third(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("script_id")
    rows = units(spark, sf).select("script_id", "value", (F.row_number().over(by.orderBy("idx")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    third = F.floor(F.col("n") / 3)
    return rows.filter((F.col("i") >= third) & (F.col("i") < F.greatest(third + 1, F.floor(2 * F.col("n") / 3)))).groupBy("script_id").agg(F.round(F.avg("value"), 6).alias("middle"))


@query("win8_early_condition", with_(UNITS, "r AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY script_id) AS n FROM units)", select="SELECT script_id, bool_or(event_type = 'purchase') AS early FROM r WHERE rn <= greatest(1, floor(n * 0.2)) GROUP BY 1"))
def early_condition(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("script_id")
    rows = units(spark, sf).withColumns({"rn": F.row_number().over(by.orderBy("idx")), "n": F.count(F.lit(1)).over(by)})
    return rows.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).groupBy("script_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("early"))


@query("win9_fill_forward", with_(UNITS, select="SELECT unit_id, last_value(CASE WHEN event_type = 'signup' THEN unit_id END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS marker FROM units"))
def fill_forward(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("script_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return units(spark, sf).select("unit_id", F.last(F.when(F.col("event_type") == "signup", F.col("unit_id")), ignorenulls=True).over(w).alias("marker"))


@query("win10_span_ends", with_(UNITS, "n AS (SELECT script_id, max(idx) AS n FROM units GROUP BY 1)", select="SELECT unit_id, idx AS first, coalesce(lead(idx) OVER (PARTITION BY script_id ORDER BY idx) - 1, n) AS last FROM units JOIN n USING (script_id) WHERE event_type = 'signup'"))
def span_ends(spark: S, sf: str) -> DataFrame:
    """A span goes from its marker to the next one, the last to the end."""
    by = Window.partitionBy("script_id")
    rows = units(spark, sf).withColumn("n", F.max("idx").over(by)).filter("event_type = 'signup'")
    return rows.select("unit_id", F.col("idx").alias("first"), F.coalesce(F.lead("idx").over(by.orderBy("idx")) - 1, "n").alias("last"))


@query(
    "win13_three_samples",
    with_(UNITS, "r AS (SELECT script_id, unit_id, value, row_number() OVER (PARTITION BY script_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY script_id) AS n FROM units)", "c AS (SELECT *, i <= 8 OR i > n - 8 OR (i > (n - 8) // 2 AND i <= (n - 8) // 2 + 8) OR value > 150 AS s FROM r)", select="SELECT script_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY i) AS k FROM c WHERE s) WHERE k <= 26"),
)
def three_samples(spark: S, sf: str) -> DataFrame:
    """The first, middle and last eight units and those with events, 26 at most."""
    by = Window.partitionBy("script_id")
    rows = units(spark, sf).select("script_id", "unit_id", "value", F.row_number().over(by.orderBy("idx")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    i, n = F.col("i"), F.col("n")
    half = F.when(n >= 8, F.floor((n - 8) / 2)).otherwise(F.ceil((n - 8) / 2))
    chosen = rows.filter((i <= 8) | (i > n - 8) | ((i > half) & (i <= half + 8)) | (F.col("value") > 150))
    return ops.top_n(chosen, ["script_id"], [F.col("i").asc()], 26).select("script_id", "unit_id")


@query("win15_linked_list", with_(UNITS, select="SELECT unit_id, lag(unit_id) OVER w AS prev_id, lead(unit_id) OVER w AS next_id FROM units WHERE event_type <> 'view' WINDOW w AS (PARTITION BY script_id ORDER BY idx)"))
def linked_list(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("script_id").orderBy("idx")
    return units(spark, sf).filter("event_type <> 'view'").select("unit_id", F.lag("unit_id").over(w).alias("prev_id"), F.lead("unit_id").over(w).alias("next_id"))


_NOW = "2024-02-01 00:00:00"


@query(
    "win14_recency_decay",
    f"SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rk FROM (SELECT user_id, event_id, round(0.7 * value / 500 + 0.3 * exp(-0.1 * (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 3.6e9), 9) AS score FROM events)) WHERE rk <= 6",
)
def recency_decay(spark: S, sf: str) -> DataFrame:
    """Of each user's events the six best by likeness and recency; the time now is a parameter."""
    hours = fn.hours_between(F.lit(_NOW).cast("timestamp"), F.col("ts").cast("timestamp"))
    rows = events(spark, sf).select("user_id", "event_id", F.round(0.7 * F.col("value") / 500 + 0.3 * fn.decay(hours), 9).alias("score"))
    return ops.top_n(rows, ["user_id"], [F.desc("score"), F.asc("event_id")], 6)


# ---- top-k
@query("top1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("top3_ranked_in_story_order", with_(UNITS, f"x AS (SELECT *, {INTENSITY} AS x FROM units)", "r AS (SELECT script_id, unit_id, idx, row_number() OVER (PARTITION BY script_id ORDER BY x DESC, value DESC, idx) AS rk FROM x)", select="SELECT script_id, unit_id, row_number() OVER (PARTITION BY script_id ORDER BY idx) AS place FROM r WHERE rk <= 5"))
def ranked_in_story_order(spark: S, sf: str) -> DataFrame:
    best = ops.top_n(units(spark, sf).withColumn("x", _intensity()), ["script_id"], [F.desc("x"), F.desc("value"), F.asc("idx")], 5)
    return best.select("script_id", "unit_id", F.row_number().over(Window.partitionBy("script_id").orderBy("idx")).cast("bigint").alias("place"))


@query("top4_distinct_by_priority", with_(UNITS, "f AS (SELECT script_id, episode_no, min_by(unit_id, (-value, unit_id)) AS unit_id, max(value) AS v FROM units GROUP BY 1, 2)", select="SELECT script_id, episode_no, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY v DESC, episode_no) AS k FROM f) WHERE k <= 3"))
def distinct_by_priority(spark: S, sf: str) -> DataFrame:
    first = units(spark, sf).groupBy("script_id", "episode_no").agg(F.min_by("unit_id", F.struct(-F.col("value"), "unit_id")).alias("unit_id"), F.max("value").alias("v"))
    return ops.top_n(first, ["script_id"], [F.desc("v"), F.asc("episode_no")], 3).select("script_id", "episode_no", "unit_id")


@query("top5_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def page(spark: S, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    rows = orders.select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(40).limit(20)
    return rows.crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("total")))).select("o_orderkey", "total")


@query("top6_keep_first", with_(UNITS, select="SELECT script_id, unit_id FROM units WHERE idx <= 12"))
def keep_first(spark: S, sf: str) -> DataFrame:
    return ops.top_n(units(spark, sf), ["script_id"], [F.asc("idx")], 12).select("script_id", "unit_id")


@query("top8_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('11|' || doc_id), doc_id LIMIT 60")
def seeded_sample(spark: S, sf: str) -> DataFrame:
    """A sample without replacement that depends on the seed and the ids alone."""
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("11|"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h", "doc_id").limit(60).select("doc_id")


@query("top9_split", "SELECT doc_id, CASE WHEN ('0x' || left(sha256('s|' || doc_id), 8))::BIGINT % 10 < 8 THEN 'dev' ELSE 'test' END AS part FROM documents")
def split(spark: S, sf: str) -> DataFrame:
    bucket = fn.pick(F.concat(F.lit("s|"), F.col("doc_id").cast("string")), 10)
    return read(spark, sf, "documents").select("doc_id", F.when(bucket < 8, "dev").otherwise("test").alias("part"))


@query("top11_nulls_last", with_(UNITS, SCRIPT_TAGS, select="SELECT script_id, value, rank FROM (SELECT script_id, value, row_number() OVER (PARTITION BY script_id ORDER BY c DESC NULLS LAST, value) AS rank FROM (SELECT script_id, value, max(CASE WHEN confidence > 0.3 THEN confidence END) AS c FROM script_tags GROUP BY 1, 2)) WHERE rank <= 2"))
def nulls_last(spark: S, sf: str) -> DataFrame:
    best = script_tags(spark, sf).groupBy("script_id", "value").agg(F.max(F.when(F.col("confidence") > 0.3, F.col("confidence"))).alias("c"))
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc_nulls_last("c"), "value"))
    return best.select("script_id", "value", rank.cast("bigint").alias("rank")).filter("rank <= 2")


@query("top12_latest_row", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_row(spark: S, sf: str) -> DataFrame:
    return ops.latest(events(spark, sf).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("top13_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def newest(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")


@query("top14_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 4")
def line_range(spark: S, sf: str) -> DataFrame:
    split_ = F.split("text", "\n")
    return read(spark, sf, "documents").filter(F.size(split_) >= 4).select("doc_id", F.array_join(F.slice(split_, 2, 3), "\n").alias("lines"))


# ---- sets
@query(
    "set1_schema_diff",
    with_(
        UNITS, UNIT_TAGS, "a AS (SELECT DISTINCT dim, value FROM unit_tags WHERE episode_no < 16)", "b AS (SELECT DISTINCT dim, CASE WHEN value = 'climax' THEN 'peak' ELSE value END AS value FROM unit_tags WHERE episode_no >= 16)",
        "d AS (SELECT *, 'add_value' AS kind FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'remove_value' FROM (SELECT * FROM a EXCEPT SELECT * FROM b))",
        select="SELECT dim, value, CASE WHEN count(*) FILTER (kind = 'add_value') OVER (PARTITION BY dim) = 1 AND count(*) FILTER (kind = 'remove_value') OVER (PARTITION BY dim) = 1 THEN 'relabel' ELSE kind END AS kind FROM d",
    ),
)
def schema_diff(spark: S, sf: str) -> DataFrame:
    """The tags of the first half of the episodes and those of the second, where one was given a new name."""
    tags = unit_tags(units(spark, sf))
    renamed = F.when(F.col("value") == "climax", "peak").otherwise(F.col("value"))
    return ops.schema_diff(tags.filter("episode_no < 16"), tags.filter("episode_no >= 16").withColumn("value", renamed))


@query("set2_changed_attributes", "SELECT a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand = b.p_brand AND round(a.p_retailprice, 6) <> round(b.p_retailprice, 6)")
def changed_attributes(spark: S, sf: str) -> DataFrame:
    """Keys in both versions whose attributes differ."""
    old = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    new = old.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    return old.join(new, "p_partkey").filter((F.col("p_brand") == F.col("brand")) & (F.round("p_retailprice", 6) != F.round("price", 6))).select("p_partkey")


@query("set3_merge_channels", "SELECT event_id, max(s) AS score FROM (SELECT event_id, value AS s FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, round(value * 1.5, 6) FROM events WHERE value > 100) GROUP BY 1")
def merge_channels(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf)
    both = e.filter("event_type = 'click'").select("event_id", F.col("value").alias("s")).unionByName(e.filter("value > 100").select("event_id", F.round(F.col("value") * 1.5, 6).alias("s")))
    return both.groupBy("event_id").agg(F.max("s").alias("score"))


@query("set4_distinct_places", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, left(text, 64) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def distinct_places(spark: S, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", "source", F.left("text", F.lit(64)).alias("head"), "n_chars")
    return rows.groupBy("source", "head").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id")).select("doc_id")


@query("set5_evidence_merge", with_(UNITS, "e AS (SELECT unit_id, 0 AS o FROM units WHERE plot_hook <> 'none' UNION ALL SELECT unit_id, 1 FROM units WHERE value > 60 UNION ALL SELECT unit_id, 2 FROM units WHERE payoff_type <> 'none')", select="SELECT unit_id, min(o)::BIGINT AS source FROM e GROUP BY 1"))
def evidence_merge(spark: S, sf: str) -> DataFrame:
    """Evidence of several sources by one key; the first source wins."""
    u = units(spark, sf).select("unit_id", "plot_hook", "value", "payoff_type")
    parts = [u.filter("plot_hook <> 'none'"), u.filter("value > 60"), u.filter("payoff_type <> 'none'")]
    rows = [p.select("unit_id", F.lit(i).cast("bigint").alias("source")) for i, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("unit_id").agg(F.min("source").alias("source"))


@query("set6_inheritance", "SELECT p_brand, p_type, max(p_retailprice) AS price FROM part WHERE p_size > 25 GROUP BY 1, 2 UNION ALL SELECT p_brand, p_type, max(p_retailprice) FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size > 25 AND b.p_brand = a.p_brand AND b.p_type = a.p_type) GROUP BY 1, 2")
def inheritance(spark: S, sf: str) -> DataFrame:
    """A child registry over its parent: a key of the child replaces the parent's."""
    part = read(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    best = lambda df: df.groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("price"))
    return ops.inherit(best(part), best(part.filter("p_size > 25")), ["p_brand", "p_type"])


@query("set7_ordered_distinct", with_(UNITS, "f AS (SELECT script_id, event_type, min(idx) AS i FROM units GROUP BY 1, 2)", select="SELECT script_id, string_agg(event_type, '>' ORDER BY i) AS kinds FROM f GROUP BY 1"))
def ordered_distinct(spark: S, sf: str) -> DataFrame:
    f = units(spark, sf).groupBy("script_id", "event_type").agg(F.min("idx").alias("i"))
    rows = f.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("i", "event_type"))).alias("x"))
    return rows.select("script_id", F.array_join("x.event_type", ">").alias("kinds"))


# ---- sinks as transformations
@query("snk2_upsert", "SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 6) ELSE o_totalprice END AS o_totalprice FROM orders) GROUP BY 1")
def upsert(spark: S, sf: str) -> DataFrame:
    """Orders as a log of changes by customer: the last write wins."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_orderkey")
    old, new = orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 6))
    return ops.upsert(old, new, ["o_custkey"], "v").select("o_custkey", "o_totalprice")


@query("snk3_merge_maps", with_("a AS (SELECT user_id, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'view' AND day(ts) < 15) AS v1, max(value) FILTER (event_type = 'view' AND day(ts) >= 15) AS v2 FROM events GROUP BY 1)", select="SELECT user_id, concat_ws(';', 'click=' || c, 'view=' || coalesce(v2, v1)) AS merged FROM a WHERE c IS NOT NULL AND coalesce(v1, v2) IS NOT NULL"))
def merge_maps(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf)
    best = lambda cond: F.max(F.when(cond, F.col("value"))).cast("string")
    kind, late = F.col("event_type"), F.dayofmonth("ts") >= 15
    rows = e.groupBy("user_id").agg(best(kind == "click").alias("c"), best((kind == "view") & ~late).alias("v1"), best((kind == "view") & late).alias("v2"))
    rows = rows.filter("c IS NOT NULL AND coalesce(v1, v2) IS NOT NULL")
    full = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), F.col(v)))), lambda _, v: v.isNotNull())
    merged = F.array_sort(F.map_entries(ops.merge_maps(full(click="c", view="v1"), full(view="v2"))))
    return rows.select("user_id", F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("snk5_cascade_delete", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def cascade_delete(spark: S, sf: str) -> DataFrame:
    """What a delete of one customer would take with it, by table."""
    gone = read(spark, sf, "orders").filter("o_custkey = 7").select("o_orderkey")
    lines = read(spark, sf, "lineitem").select("l_orderkey").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(gone, "orders").unionByName(count(lines, "lineitem"))


@query("snk6_delete_rewrite", "SELECT doc_id FROM documents WHERE NOT (source = 'src3' OR source LIKE 'src1%')")
def delete_rewrite(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").filter(~((F.col("source") == "src3") | F.col("source").like("src1%"))).select("doc_id")


@query("snk9_memoised_calls", with_("k AS (SELECT event_id, sha256(event_type || '|' || props) AS h FROM events)", "c AS (SELECT DISTINCT h FROM k WHERE event_id % 2 = 0)", select="SELECT count(*) FILTER (h IN (SELECT h FROM c)) AS hits, count(*) FILTER (h NOT IN (SELECT h FROM c)) AS misses FROM k"))
def memoised_calls(spark: S, sf: str) -> DataFrame:
    """Calls by the digest of their input against a cache of those made before."""
    keyed = events(spark, sf).select("event_id", F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("h"))
    cache = keyed.filter("event_id % 2 = 0").select("h").distinct().withColumn("hit", F.lit(True))
    return keyed.join(cache, "h", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("snk10_chunk_ids", "SELECT doc_id, sha256(source || '|' || doc_id || '|0|' || left(text, 2048)) AS chunk_id FROM documents")
def chunk_ids(spark: S, sf: str) -> DataFrame:
    """Ids that depend on the content alone, so indexing twice writes the same rows."""
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string"), F.lit("0"), F.left("text", F.lit(2048))), 256).alias("chunk_id"))


@query("src9_ordered_scan", with_(SCENES, select="SELECT scene_id FROM scenes WHERE script = 'src1' ORDER BY episode_no NULLS LAST, scene_no, scene_id LIMIT 5000"))
def ordered_scan(spark: S, sf: str) -> DataFrame:
    return scenes(spark, sf).filter("script = 'src1'").orderBy(F.asc_nulls_last("episode_no"), "scene_no", "scene_id").limit(5000).select("scene_id")


@query("src11_context", with_(UNITS, UNIT_TAGS, SCRIPT_TAGS, EPISODE_TAGS, select="SELECT script_id, (SELECT count(*) FROM unit_tags t WHERE t.script_id = s.script_id) AS unit_tags, (SELECT count(*) FROM script_tags t WHERE t.script_id = s.script_id) AS script_tags, (SELECT count(*) FROM episode_tags t WHERE t.script_id = s.script_id) AS episode_tags FROM (SELECT DISTINCT script_id FROM units) s"))
def context(spark: S, sf: str) -> DataFrame:
    """The relations of all scripts at once, dealt by script; here their sizes."""
    base = units(spark, sf)
    size = lambda df, name: df.groupBy("script_id").agg(F.count(F.lit(1)).alias(name))
    out = base.select("script_id").distinct()
    for df, name in ((unit_tags(base), "unit_tags"), (script_tags(spark, sf), "script_tags"), (episode_tags(spark, sf), "episode_tags")):
        out = out.join(size(df, name), "script_id", "left")
    return out.fillna(0)


# ---- windows in time
@query("stm7_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch(ts)::BIGINT // 43200 ORDER BY ts, event_id) <= 2 AS accepted FROM events".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def quota(spark: S, sf: str) -> DataFrame:
    """Tumbling half-day windows by user: the first two events of a window are accepted."""
    window = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 43200)
    order = Window.partitionBy("user_id", window).orderBy("ts", "event_id")
    return events(spark, sf).select("event_id", (F.row_number().over(order) <= 2).alias("accepted"))


@query("stm5_progress_snapshots", "SELECT user_id, event_type AS stage, max_by(value, (ts, event_id)) AS state, count(*) AS updates FROM events GROUP BY 1, 2")
def progress_snapshots(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("updates"))


@query("stm2_replay_after_cursor", "SELECT user_id AS run_id, event_id AS seq FROM events e WHERE event_id > (SELECT median(event_id) FROM events)")
def replay_after_cursor(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf)
    cursor = e.agg(F.median("event_id").alias("c"))
    return e.crossJoin(F.broadcast(cursor)).filter("event_id > c").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"))
