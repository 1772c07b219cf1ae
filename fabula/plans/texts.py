"""Queries for text functions, structure and streams over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import scoring as fn
from fabula.functions import text as tx
from fabula.operators import diff, folds, graph, retrieval, segmentation, structure, table_functions
from fabula.operators.relational import new_folder, stored
from fabula.plans.adapters import LINES, UNITS, events, lines, read, scenes, units, with_
from fabula.plans.registry import query
from fabula.sources import commits, files
from fabula.streaming import runs

S = SparkSession


def docs(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


@query(
    "flt4_flt5_block_quality",
    """WITH t AS (SELECT doc_id, trim(text) AS t FROM documents), m AS (SELECT doc_id, t, length(t) AS n, length(t) - length(regexp_replace(t, 'https?://[^\\s]+', '', 'g')) AS u,
  length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS a, len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS w, len(list_distinct(string_split(t, ''))) AS d FROM t)
SELECT doc_id, CASE WHEN n < 30 THEN 'short' WHEN regexp_full_match(t, 'https?://[^\\s]+') THEN 'url' WHEN u >= 0.65 * n THEN 'url_ratio' WHEN n <= 8000 AND w < 5 THEN 'few_words' WHEN d < 20 THEN 'few_characters' WHEN a < 0.3 * n THEN 'symbols' ELSE 'keep' END AS reason FROM m""",
)
def block_quality(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.coalesce(tx.low_information(F.col("text")), F.lit("keep")).alias("reason"))


@query("flt6_body_is_title", r"SELECT doc_id FROM documents WHERE NOT (length(lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) >= 12 AND lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) = lower(regexp_replace(regexp_replace(left(text, 80), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')))")
def body_is_title(spark: S, sf: str) -> DataFrame:
    body, title = tx.title_key(F.col("text")), tx.title_key(F.left("text", F.lit(80)))
    return docs(spark, sf).filter(~((F.length(body) >= 12) & (body == title))).select("doc_id")


@query("flt7_short_chunks", "SELECT doc_id FROM documents WHERE lang IN ('de') OR length(trim(text)) >= 400")
def short_chunks(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).filter(F.col("lang").isin("de") | (F.length(F.trim("text")) >= 400)).select("doc_id")


_NAMES = """n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '场景' || doc_id WHEN 1 THEN '宾客' || doc_id % 10 WHEN 2 THEN '护士' WHEN 3 THEN '王' || source WHEN 4 THEN '站起来' ELSE regexp_extract(trim(text), '^([^\\s]+)', 1) END AS name FROM documents)"""


@query("flt8_flt9_names", with_(_NAMES, select="SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 4 THEN false ELSE name <> '' AND length(name) <= 8 END AS real, length(name) <= 16 AND regexp_matches(name, '[\\p{L}\\p{N}_]') AS valid FROM n"))
def names(spark: S, sf: str) -> DataFrame:
    """First words of documents, and in their place numbered scenes and guests, generic names and actions."""
    i = F.col("doc_id")
    first = F.regexp_extract(F.trim("text"), r"^([^\s]+)", 1)
    name = F.when(i % 6 == 0, F.concat(F.lit("场景"), i.cast("string"))).when(i % 6 == 1, F.concat(F.lit("宾客"), (i % 10).cast("string"))).when(i % 6 == 2, "护士")
    name = name.when(i % 6 == 3, F.concat(F.lit("王"), F.col("source"))).when(i % 6 == 4, "站起来").otherwise(first)
    rows = docs(spark, sf).select("doc_id", name.alias("name"))
    return rows.select("doc_id", tx.real_name(F.col("name")).alias("real"), ((F.length("name") <= 16) & F.col("name").rlike(r"[\p{L}\p{N}_]")).alias("valid"))


_META = """CASE idx % 8 WHEN 0 THEN '人物：' || event_type WHEN 1 THEN '人物关系图：' || event_type WHEN 2 THEN episode_no || '-' || idx || ' 客厅' WHEN 3 THEN '  ' || idx || '场 夜'
  WHEN 4 THEN '第' || episode_no || '集' WHEN 5 THEN '  ' WHEN 6 THEN event_type || '：' || value ELSE ' 地点: ' || event_type END"""


@query("flt12_meta_lines", with_(UNITS, select="SELECT script_id, count(*) FILTER (idx % 8 IN (0, 3, 4, 5, 7) OR (idx % 8 = 2 AND episode_no < 10)) AS meta, count(*) AS n FROM units GROUP BY 1"))
def meta_lines(spark: S, sf: str) -> DataFrame:
    """Units written as lines of a script, some of them structure and some that only begin alike."""
    line = F.expr(_META)
    return units(spark, sf).groupBy("script_id").agg(F.count_if(tx.meta_line(line)).alias("meta"), F.count(F.lit(1)).alias("n"))


@query("flt14_planner_artifacts", "SELECT conv_id, turn, conv_id % 5 = 0 OR (conv_id % 5 IN (1, 2) AND turn % 2 = 1) AS internal FROM conversations")
def planner_artifacts(spark: S, sf: str) -> DataFrame:
    """Messages of a planner's inner dialogue: by source, and by plans as JSON where a plan was asked for."""
    i, odd = F.col("conv_id") % 5, F.col("turn") % 2 == 1
    item = F.struct(F.left("text", F.lit(20)).alias("title"), F.lit("why").alias("question"), F.lit(1).alias("depth"), F.lit("x").alias("parent_title"))
    answer = F.when(odd & i.isin(0, 1), F.to_json(F.array(item))).when(odd & i.isin(2, 3), F.to_json(F.struct(F.array(item, item).alias("items")))).otherwise(F.col("text"))
    question = F.when(i == 1, "You are a  Research planner").when(i == 2, "answer as JSON").otherwise("no such thing")
    rows = read(spark, sf, "conversations").withColumns({"q": question, "a": answer, "s": F.when(i == 0, "Inner").otherwise("user")})
    return rows.select("conv_id", "turn", tx.planner_artifact(F.col("q"), F.col("a"), F.col("s"), ("inner",)).alias("internal"))


@query("str9_query_terms", r"SELECT item_id, array_to_string(list_distinct_ordered[1:8], '|') AS terms FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(ws), lambda w: {'p': list_position(ws, w), 'w': w})), lambda s: s.w) AS list_distinct_ordered FROM (SELECT item_id, list_concat([trim(text)], list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS ws FROM benchmark))")
def query_terms(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.array_join(retrieval.query_terms(F.col("text")), "|").alias("terms"))


@query("str10_half_width", "SELECT doc_id, text AS t FROM documents")
def half_width(spark: S, sf: str) -> DataFrame:
    """Every text with its ASCII made full-width, and read as half-width again."""
    plain = "".join(map(chr, range(0x21, 0x7F)))
    return docs(spark, sf).select("doc_id", tx.half_width(F.translate("text", plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))).alias("t"))


_STOPPED = "text"
for _pattern, _by in tx.QUESTION_PHRASES:
    _STOPPED = f"regexp_replace({_STOPPED}, '{_pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{_by}', 'gi')"


@query("str16_str17_stop_phrases", f"SELECT item_id, {_STOPPED} AS t, len(string_split_regex(text, '[ \\t]+')) <= 3 OR len(list_filter(string_split_regex(text, '[ \\t]+'), lambda w: NOT regexp_full_match(w, '[a-zA-Z]+'))) >= 0.7 * len(string_split_regex(text, '[ \\t]+')) AS other FROM benchmark")
def stop_phrases(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", tx.without_question_phrases(F.col("text")).alias("t"), tx.mostly_other_script(F.col("text")).alias("other"))


_KEY = "list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.KEYWORD_STOPS) + "], lower(w)))"


@query("str19_keywords", f"WITH k AS (SELECT item_id, {_KEY} AS ws FROM benchmark), l AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS ls FROM k) SELECT item_id, array_to_string(list_filter(ws, lambda w, i: list_position(ls, lower(w)) = i)[1:6], ',') AS keywords FROM l")
def keywords(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), ",").alias("keywords"))


@query("str20_token_jaccard", r"WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS j FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def token_jaccard(spark: S, sf: str) -> DataFrame:
    """Neighbouring items compared by their sets of tokens."""
    t = read(spark, sf, "benchmark").select("item_id", F.array_distinct(retrieval.tokens(F.col("text"))).alias("s"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("o"))
    return t.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(fn.jaccard(F.col("s"), F.col("o")), 6).alias("j"))


@query("str21_trigrams", "WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark) SELECT item_id, len(list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)))) AS n FROM t")
def trigrams(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.size(retrieval.trigrams(F.lower("text"))).cast("bigint").alias("n"))


@query("str23_str25_quote_lines", with_(LINES, "q AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM lines WHERE length(line) >= 40 GROUP BY 1)", select="SELECT doc_id, length(left(text, instr(text, line))) - length(replace(left(text, instr(text, line)), chr(10), '')) + 1 AS line_no FROM q JOIN documents USING (doc_id)"))
def quote_lines(spark: S, sf: str) -> DataFrame:
    """The line at which a quote (here a document's first long line) begins."""
    quote = lines(spark, sf).filter(F.length("line") >= 40).groupBy("doc_id").agg(F.min_by("line", "pos").alias("quote"))
    rows = docs(spark, sf).select("doc_id", "text").join(quote, "doc_id")
    return rows.select("doc_id", tx.quote_line(F.col("text"), F.col("quote")).cast("bigint").alias("line_no"))


@query("str27_sliding_chunks", "SELECT doc_id, s AS start, substr(text, s + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS s FROM documents WHERE text <> '')")
def sliding_chunks(spark: S, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", F.explode(tx.sliding_chunks(F.col("text"), 500, 100)).alias("c"))
    return rows.select("doc_id", F.col("c.start").cast("bigint").alias("start"), "c.piece")


@query("str26_recursive_chunks")
def recursive_chunks(spark: S, sf: str) -> DataFrame:
    """Cuts depend on the cuts before, so there is no SQL twin; tested for cover and order."""
    return structure.chunked(docs(spark, sf), lambda t: structure.recursive_chunks(t, 800, 80))


def _by_meaning(text: str) -> list[tuple[int, str]]:
    import re

    parts = [s for s in re.split(r"(?<=[。！？!?.])\s+|\n+", text) if s.strip()]
    return [*enumerate(structure.semantic_chunks(parts, 300, 900, 0.2))]


@query("str28_semantic_chunks")
def semantic_chunks(spark: S, sf: str) -> DataFrame:
    return structure.chunked(docs(spark, sf), _by_meaning).drop("start")


@query("str30_budget_merge")
def budget_merge(spark: S, sf: str) -> DataFrame:
    return structure.chunked(docs(spark, sf), lambda t: [(k, c) for k, c in enumerate(structure.budget_merge(t.split("\n"), 120))]).drop("start")


@query("str29_sentences", with_("s AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)", select="SELECT doc_id, count(*) AS n FROM s WHERE trim(s) <> '' GROUP BY 1"))
def sentences(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("str31_citations", "SELECT event_id, array_to_string(list_filter([k, k + 1], lambda x: x BETWEEN 1 AND 60), ',') AS cited FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def citations(spark: S, sf: str) -> DataFrame:
    """Citations in brackets of both widths, lists split, those out of range left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit("see 【"), k.cast("string"), F.lit("， "), (k + 1).cast("string"), F.lit("】 and ["), k.cast("string"), F.lit("]"))
    found = tx.citations(text, F.lit(60))
    return events(spark, sf).select("event_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("cited"))


@query("str35_first_sentences", r"SELECT doc_id, regexp_extract(trim(text), '^([^。！？!?.\n]*[。！？!?.]?)', 1) AS first, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS short FROM documents")
def first_sentences(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.first_sentence(F.col("text")).alias("first"), tx.truncated(F.col("text"), 60).alias("short"))


@query("str36_templates", "SELECT p_partkey, p_name || ' by ' || p_brand || ', {missing}' AS t FROM part")
def templates(spark: S, sf: str) -> DataFrame:
    values = {"name": F.col("p_name"), "brand": F.col("p_brand"), "missing": F.lit(None)}
    return read(spark, sf, "part").select("p_partkey", tx.rendered(F.lit("{name} by {brand}, {missing}"), values).alias("t"))


@query("str37_intents", "WITH s AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, round(least(0.25 * ((t LIKE '%the%' AND NOT regexp_matches(t, '(?:not|don''t|no)\\s+the'))::INT + (t LIKE '%que%' AND NOT regexp_matches(t, '(?:not|don''t|no)\\s+que'))::INT), 0.6) + least(0.25 * (regexp_matches(t, '^[a-m]')::INT), 0.4), 6) AS score FROM s")
def intents(spark: S, sf: str) -> DataFrame:
    score = tx.intent_score(F.col("text"), ["the", "que"], ["^[a-m]"])
    return docs(spark, sf).select("doc_id", F.round(score, 6).alias("score"))


@query("str38_str40_first_rule", "SELECT doc_id, CASE WHEN contains(text, 'ß') THEN 'a' WHEN contains(text, 'que') THEN 'b' WHEN contains(text, 'the') THEN 'c' ELSE 'other' END AS kind FROM documents")
def first_rule(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.first_match(F.col("text"), [("ß", "a"), ("que", "b"), ("the", "c")], "other").alias("kind"))


TERMS = [("error", "high", "fault"), ("purchase", "medium", "money"), ("sign", "low", "account")]


@query("str39_cmp8_term_lookup", "SELECT event_id, CASE WHEN contains(event_type, 'error') THEN 'high' WHEN contains(event_type, 'purchase') THEN 'medium' WHEN contains(event_type, 'sign') THEN 'low' END AS level FROM events WHERE event_type NOT IN ('view', 'click')")
def term_lookup(spark: S, sf: str) -> DataFrame:
    """The first term, in order of the list, that a text contains gives its level."""
    terms = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(TERMS)], "ord int, term string, level string, category string"))
    hits = events(spark, sf).select("event_id", "event_type").join(terms, F.contains("event_type", "term"))
    return hits.groupBy("event_id").agg(F.min_by("level", "ord").alias("level"))


@query("str1_str2_markers", "SELECT event_id, k AS episode FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def markers(spark: S, sf: str) -> DataFrame:
    """Numbers below 100 written in Chinese numerals inside episode markers, and read again."""
    k = F.get_json_object("props", "$.k").cast("int")
    digits = F.array(*map(F.lit, "零一二三四五六七八九"))
    digit = lambda d: F.element_at(digits, (d + 1).cast("int"))
    ten, one = F.floor(k / 10), k % 10
    tens = F.when(ten == 0, "").when(ten == 1, "十").otherwise(F.concat(digit(ten), F.lit("十")))
    ones = F.when((one > 0) | (ten == 0), digit(one)).otherwise("")
    line = F.concat(F.lit(" 第"), tens, ones, F.lit("集："))
    return events(spark, sf).select("event_id", tx.episode_number(line).cast("bigint").alias("episode"))


@query("str3_str4_scene_markers", "SELECT event_id, CASE WHEN d BETWEEN 1 AND 200 AND k BETWEEN 1 AND 50 THEN d || '-' || k END AS marker FROM (SELECT event_id, day(ts) AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def scene_markers(spark: S, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    m = tx.scene_marker(F.concat(F.dayofmonth("ts").cast("string"), F.lit("-"), k.cast("string"), F.lit(" 客厅 日内")))
    return events(spark, sf).select("event_id", F.when(m.isNotNull(), F.concat_ws("-", m["episode"].cast("string"), m["scene"].cast("string"))).alias("marker"))


def script_lines(spark: S, sf: str) -> DataFrame:
    """Units written as lines of a script. Each episode begins with its marker; of three episodes one has scene numbers and
    headings, one headings alone, and one neither; each tenth unit may begin a scene."""
    u = units(spark, sf)
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("script_id", "episode_no"))
    said = F.concat(F.col("event_type"), F.lit("：value "), F.col("value").cast("string"))
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("（"), F.col("value").cast("string"), F.lit("）"))).otherwise(said)
    number = F.concat(F.col("episode_no").cast("string"), F.lit("-"), (F.floor(F.col("idx") / 10) % 50 + 1).cast("string"), F.lit(" 内景"))
    kind, tenth = F.col("episode_no") % 3, F.col("idx") % 10
    rows = F.array(
        F.when(first, F.concat(F.lit("第"), F.col("episode_no").cast("string"), F.lit("集"))),
        F.when((kind == 0) & (tenth == 0), number),
        F.when((kind < 2) & (tenth == 5), F.lit("客厅 日内")),
        text,
    )
    each = u.withColumn("rows", F.filter(rows, lambda x: x.isNotNull())).select("script_id", "idx", F.posexplode("rows").alias("k", "line"))
    return each.select("script_id", (F.col("idx") * 4 + F.col("k")).alias("pos"), "line")


_SCRIPT = """sl AS (SELECT script_id, idx * 4 + k AS pos, line, part, numbered FROM (SELECT script_id, idx, part, numbered, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (
  SELECT script_id, idx, count(CASE WHEN starts THEN 1 END) OVER (PARTITION BY script_id ORDER BY idx) AS part, episode_no % 3 = 0 AND bool_or(idx % 10 = 0) OVER (PARTITION BY script_id, episode_no) AS numbered,
    list_filter([CASE WHEN starts THEN '第' || episode_no || '集' END, CASE WHEN episode_no % 3 = 0 AND idx % 10 = 0 THEN episode_no || '-' || (idx // 10 % 50 + 1) || ' 内景' END,
    CASE WHEN episode_no % 3 < 2 AND idx % 10 = 5 THEN '客厅 日内' END, CASE WHEN event_type = 'view' THEN '（' || value || '）' ELSE event_type || '：value ' || value END], lambda x: x IS NOT NULL) AS ls
  FROM (SELECT *, idx = min(idx) OVER (PARTITION BY script_id, episode_no) AS starts FROM units))))"""
_SEG = """sg AS (SELECT *, sum((line LIKE '第%集' OR line LIKE '% 内景' OR (line = '客厅 日内' AND NOT numbered))::INT) OVER (PARTITION BY script_id ORDER BY pos) AS scene FROM sl)"""


@query("cmp1_segment_scripts", with_(UNITS, _SCRIPT, _SEG, select="SELECT script_id, scene::BIGINT AS scene, min(pos) AS first, max(pos) AS last, count(*) AS lines FROM sg GROUP BY 1, 2"))
def segment_scripts(spark: S, sf: str) -> DataFrame:
    """Scripts cut into scenes at episode markers and at scene numbers or, in episodes without any, headings; every line is in
    one scene."""
    out = structure.scenes_of(structure.segment_scripts(script_lines(spark, sf)))
    return out.select("script_id", F.col("scene").cast("bigint").alias("scene"), "first", "last", "lines")


@query("str5_cmp2_line_kinds", with_(UNITS, _SCRIPT, select="SELECT script_id, CASE WHEN line LIKE '第%集' OR line LIKE '% 内景' OR line = '客厅 日内' THEN 'stage_direction' WHEN line LIKE '（%' THEN 'action' ELSE 'dialogue' END AS kind, count(*) AS n, count(DISTINCT CASE WHEN line LIKE '%：%' THEN string_split(line, '：')[1] END) AS speakers FROM sl GROUP BY 1, 2"))
def line_kinds(spark: S, sf: str) -> DataFrame:
    rows = structure.script_lines(script_lines(spark, sf))
    return rows.groupBy("script_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speaker").alias("speakers"))


@query("str6_str7_cast_lists", "SELECT s_suppkey, array_to_string(list_filter(string_split_regex(trim(s_name || '、' || s_nationkey || '；ab'), '[、,，;；/\\s]+'), lambda p: p <> '' AND length(p) <= 8), '|') AS names FROM supplier")
def cast_lists(spark: S, sf: str) -> DataFrame:
    text = F.concat("s_name", F.lit("、"), F.col("s_nationkey").cast("string"), F.lit("；ab"))
    return read(spark, sf, "supplier").select("s_suppkey", F.array_join(tx.cast_list(text), "|").alias("names"))


@query("str8_name_similarity")
def name_similarity(spark: S, sf: str) -> DataFrame:
    """Names of nations compared with those that follow; Jaro-Winkler isn't built in, so this is tested by known values."""
    n = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("a"))
    pairs = n.join(n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("a").alias("b")), "n_nationkey")
    customers = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return graph.similar_names(pairs, "a", "b").join(customers, "n_nationkey").select("n_nationkey", F.round("similarity", 6).alias("similarity"), "customers")


@query("cmp6_graph_of_script", with_(UNITS, "p AS (SELECT script_id, least(event_type, nx) AS a, greatest(event_type, nx) AS b FROM (SELECT script_id, event_type, lead(event_type) OVER (PARTITION BY script_id ORDER BY idx) AS nx FROM units) WHERE nx <> event_type)", select="SELECT script_id, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3"))
def graph_of_script(spark: S, sf: str) -> DataFrame:
    """One undirected edge for each pair of characters that follow each other."""
    u = units(spark, sf).withColumn("nx", F.lead("event_type").over(Window.partitionBy("script_id").orderBy("idx"))).filter("nx <> event_type")
    return u.groupBy("script_id", F.least("event_type", "nx").alias("a"), F.greatest("event_type", "nx").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("win11_repair_intervals")
def repair_intervals(spark: S, sf: str) -> DataFrame:
    """Overlapping spans of units made contiguous; each depends on the one before. Tested by given cases and invariants."""
    u = units(spark, sf)
    a = F.when(F.col("k") % 17 == 0, "?").otherwise((F.col("idx") - F.col("k") % 3).cast("string"))
    spans = u.filter("idx % 4 = 1").groupBy("script_id", "episode_no").agg(F.array_sort(F.collect_list(F.struct("idx", a.alias("start"), (F.col("idx") + F.col("k") % 7).cast("string").alias("end")))).alias("spans"))
    bounds = u.groupBy("script_id", "episode_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return structure.repaired(bounds.join(spans, ["script_id", "episode_no"]))


@query("top7_budget_prefix")
def budget_prefix(spark: S, sf: str) -> DataFrame:
    """The turns of a conversation, newest first, that fit into a budget of characters; a fold, tested against a plain one."""
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), F.length("text").alias("n")))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform(structure.budget_prefix(F.col("x.n"), 1500), lambda i: i.cast("string")), ",").alias("taken"))


def _neighbours(spark: S, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


@query("agg30_str32_line_changes")
def line_changes(spark: S, sf: str) -> DataFrame:
    """Lines added and removed between each document and the next; a longest common subsequence isn't built in."""
    return diff.line_diffs(_neighbours(spark, sf), "text", "other").select("doc_id", "added", "removed")


@query("str32_line_diff")
def line_diff(spark: S, sf: str) -> DataFrame:
    """The hunks from each document to the next, and what a preview shows of both."""
    return diff.line_diffs(_neighbours(spark, sf), "text", "other").drop("text", "other")


@query("str32_word_diff")
def word_diff(spark: S, sf: str) -> DataFrame:
    """Words changed from each line to the next of its document, one row for each change."""
    d = lines(spark, sf)
    pairs = d.select("doc_id", "pos", F.col("line").alias("old"), F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos")).alias("new")).filter("new IS NOT NULL")
    return diff.word_changes(pairs, "old", "new").select("doc_id", "pos", F.explode("changes").alias("c")).select("doc_id", "pos", F.col("c.at").alias("at"), "c.went", "c.came")


_LISTED = """bl AS (SELECT doc_id, pos, CASE (doc_id + pos) % 9 WHEN 0 THEN '第一章 ' WHEN 1 THEN '（二）' WHEN 2 THEN '3. ' WHEN 3 THEN '2.1 ' WHEN 4 THEN '4.1.2' WHEN 5 THEN 'PART SEVEN ' WHEN 6 THEN '0. ' WHEN 7 THEN '12 3' ELSE '' END || line AS line FROM lines)"""
_BULLET = lambda ps: "regexp_matches(line, '^(?:" + "|".join(f"(?:{p})" for p in ps) + ")') AND NOT regexp_matches(line, '^(?:" + "|".join(f"(?:{p})" for p in structure.NO_BULLETS) + ")')"


def listed_lines(spark: S, sf: str) -> DataFrame:
    """Lines of documents, most of them with a bullet or what looks like one before them."""
    at = (F.col("doc_id") + F.col("pos")) % 9
    mark = F.lit("")
    for i, x in enumerate(("第一章 ", "（二）", "3. ", "2.1 ", "4.1.2", "PART SEVEN ", "0. ", "12 3")):
        mark = F.when(at == i, x).otherwise(mark)
    return lines(spark, sf).select("doc_id", "pos", F.concat(mark, "line").alias("line"))


@query("agg32_bullet_families", with_(LINES, _LISTED, "c AS (SELECT doc_id, [" + ", ".join(f"count(*) FILTER ({_BULLET(f)})" for f in structure.BULLETS) + "] AS n FROM bl GROUP BY 1)", select="SELECT doc_id, CASE WHEN list_max(n) > 0 THEN list_position(n, list_max(n)) - 1 ELSE -1 END AS family FROM c"))
def bullet_families(spark: S, sf: str) -> DataFrame:
    return structure.bullet_family(listed_lines(spark, sf))


@query("agg33_heading_levels", with_(LINES, _LISTED, "l AS (SELECT doc_id, CASE " + " ".join(f"WHEN {_BULLET([p])} THEN {i}" for i, p in enumerate(structure.BULLETS[1])) + f" ELSE {len(structure.BULLETS[1]) + 1} END AS level FROM bl)", select="SELECT doc_id, level::BIGINT AS level, count(*) AS n FROM l GROUP BY 1, 2"))
def heading_levels(spark: S, sf: str) -> DataFrame:
    return structure.heading_levels(listed_lines(spark, sf), 1).groupBy("doc_id", F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("cmp13b_reference_groups", with_(LINES, "n AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines)", select="SELECT doc_id, (n - 1) // 25 AS bucket, 'References ' || min(n) || '-' || max(n) AS title, string_agg(line, chr(10) ORDER BY pos) AS text FROM n GROUP BY 1, 2"))
def reference_groups(spark: S, sf: str) -> DataFrame:
    return structure.reference_groups(lines(spark, sf).withColumnRenamed("line", "text"))


@query("cmp13c_attached_blocks", with_(LINES, "b AS (SELECT doc_id, pos, CASE WHEN length(line) % 5 = 0 THEN 'equation' ELSE 'text' END AS type FROM lines)", "o AS (SELECT doc_id, pos, type, coalesce(last_value(CASE WHEN type = 'text' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN type = 'text' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM b)", select="SELECT doc_id, pos, owner FROM o WHERE type = 'equation'"))
def attached_blocks(spark: S, sf: str) -> DataFrame:
    blocks = lines(spark, sf).select("doc_id", "pos", F.when(F.length("line") % 5 == 0, "equation").otherwise("text").alias("type"))
    return structure.attach_to_text(blocks, "equation").select("doc_id", "pos", "owner")


_ROUTE = "CASE WHEN source IN ('src1', 'src2') THEN 'whole' WHEN source <> 'src3' AND length(trim(text)) >= 1200 THEN 'semantic' WHEN length(trim(text)) <= 4000 THEN 'whole' ELSE 'sliding' END"


def _blocks(spark: S, sf: str) -> DataFrame:
    """Documents as blocks of a layout: two sources are tables, one is code."""
    kind = F.when(F.col("source").isin("src1", "src2"), "table").when(F.col("source") == "src3", "code").otherwise("text")
    return docs(spark, sf).select("doc_id", F.lit(0).cast("bigint").alias("pos"), kind.alias("kind"), "text")


@query("cmp16_chunk_routes", f"SELECT doc_id, {_ROUTE} AS route FROM documents")
def chunk_routes(spark: S, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", structure.chunk_route(F.col("kind"), F.col("text")).alias("route"))


@query("cmp16_routed_chunks")
def routed_chunks(spark: S, sf: str) -> DataFrame:
    """Blocks chunked each by its route. Cuts by meaning depend on the cuts before, so there is no SQL twin."""
    return structure.routed_chunks(_blocks(spark, sf), 1200, 4000, 1000, 100, _by_meaning)


@query("cmp16_lateral_chunks")
def lateral_chunks(spark: S, sf: str) -> DataFrame:
    """The same chunks in SQL: each block beside the table function of its route."""
    table_functions.register(spark)
    routed = _blocks(spark, sf).withColumn("route", structure.chunk_route(F.col("kind"), F.col("text"))).filter(F.trim("text") != "")
    return spark.sql(
        """SELECT doc_id, pos, route, CAST(chunk AS bigint) AS chunk, piece FROM {b} b, LATERAL sliding_chunks(b.text, 1000, 100) WHERE route = 'sliding'
        UNION ALL SELECT doc_id, pos, route, CAST(chunk AS bigint), piece FROM {b} b, LATERAL semantic_chunks(b.text, 300, 900, 0.2D) WHERE route = 'semantic'
        UNION ALL SELECT doc_id, pos, route, 0, trim(text) FROM {b} b WHERE route = 'whole'""",
        b=routed,
    )


@query("str30_partitioned_merge")
def partitioned_merge(spark: S, sf: str) -> DataFrame:
    """Lines joined up to a budget of words by a table function over the lines of each document."""
    table_functions.register(spark)
    lines(spark, sf).createOrReplaceTempView("budget_lines")
    out = spark.sql("SELECT * FROM budget_merge(TABLE(SELECT doc_id, pos, line AS text, 120 AS budget FROM budget_lines) PARTITION BY doc_id ORDER BY pos)")
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "first", "last", "piece")


@query("str11_str12_segmented_lines")
def segmented_lines(spark: S, sf: str) -> DataFrame:
    """Lines written without spaces and cut into words again, by a dictionary of the words of all documents."""
    given = lines(spark, sf)
    joined = given.select("doc_id", "pos", F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "").alias("run")).filter("run <> ''")
    words = docs(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("term"))
    terms = segmentation.dictionary(words)
    return segmentation.segmented(joined, "run", terms).select("doc_id", "pos", F.array_join("tokens", " ").alias("tokens"), F.array_join("fine", " ").alias("fine"), F.size("unclear").alias("n_unclear"))


@query("snk1_committed_families", with_(LINES, select="SELECT d.doc_id, lang, coalesce(n, 0) AS n_lines, coalesce(c, 0)::BIGINT AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(line)) AS c FROM lines GROUP BY 1) USING (doc_id)"))
def committed_families(spark: S, sf: str) -> DataFrame:
    """Documents and their lines written as one commit and read back together."""
    store = commits.Families(new_folder(spark, "families"))
    store.write(docs(spark, sf).select("doc_id", "lang", "source"), lines(spark, sf))
    parents, children = store.read(spark)
    counted = children.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return parents.join(counted, "doc_id", "left").select("doc_id", "lang", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("cmp13_str33_layout_match")
def layout_match(spark: S, sf: str) -> DataFrame:
    """Where a document's longest line, damaged in every second document, is found among its blocks of 400 characters."""
    longest = lines(spark, sf).groupBy("doc_id").agg(F.max_by("line", F.struct(F.length("line"), -F.col("pos"))).alias("line"))
    snippet = F.when(F.col("doc_id") % 2 == 0, F.translate("line", "et", "ae")).otherwise(F.col("line"))
    blocks = docs(spark, sf).select("doc_id", F.posexplode(tx.sliding_chunks(F.col("text"), 400, 0)).alias("pos", "c")).select("doc_id", "pos", F.col("c.piece").alias("text"))
    out = structure.layout_match(longest.select("doc_id", snippet.alias("snippet")), blocks)
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


def _pieces(spark: S, sf: str) -> DataFrame:
    cut = docs(spark, sf).select("doc_id", F.posexplode(tx.sliding_chunks(F.col("text"), 400, 0)).alias("pos", "c"))
    return cut.select("doc_id", "pos", F.col("c.piece").alias("text"))


@query("cmp13_growing_windows")
def growing_windows(spark: S, sf: str) -> DataFrame:
    """The blocks that each document's longest line and the one after it take in, damaged in every second document. A fold
    with a sequence ratio, tested against a plain one."""
    d = lines(spark, sf).withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos")))
    target = F.max_by(F.concat_ws(" ", "line", "after"), F.struct(F.length("line"), -F.col("pos"))).alias("line")
    longest = d.groupBy("doc_id").agg(target)
    damaged = longest.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.translate("line", "et", "ae")).otherwise(F.col("line")).alias("snippet"))
    blocks = stored(_pieces(spark, sf), "blocks")
    begun = stored(structure.layout_match(damaged, blocks), "begun").join(damaged, "doc_id")
    matches = begun.select("doc_id", F.lit(0).alias("key"), "pos", F.col("snippet").alias("target"))
    out = folds.growing_windows(matches, blocks)
    return out.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("first", "last", "n_blocks")), "outcome")


@query("cmp13a_short_blocks")
def short_blocks(spark: S, sf: str) -> DataFrame:
    """Documents' lines as blocks, the short ones joined to their neighbours. A fold, tested against a plain one."""
    kind = F.when(F.col("line").startswith("#"), "section").when(F.length("line") % 11 == 3, "table").otherwise("paragraph")
    return folds.merge_short_blocks(lines(spark, sf).select("doc_id", "pos", kind.alias("kind"), F.col("line").alias("text"), F.contains("line", F.lit("$$")).alias("whole")))


@query("cmp13d_metadata", r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def metadata(spark: S, sf: str) -> DataFrame:
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return read(spark, sf, "pages").select("page_id", part("html", r"<title>(.*?)</title>").alias("title"), part("html", r'<html lang="([a-z]+)"').alias("lang"), part("url", r"^https?://([^/]+)").alias("host"))


@query("cmp10_improvement_actions", "WITH t(event_type, action) AS (VALUES ('error', 'repair'), ('view', 'shorten')), r AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, event_type, action FROM r JOIN t USING (event_type) WHERE v < 50 AND n >= 10")
def improvement_actions(spark: S, sf: str) -> DataFrame:
    """Actions where a weak signal has a template and evidence enough."""
    made = F.broadcast(spark.createDataFrame([("error", "repair"), ("view", "shorten")], "event_type string, action string"))
    r = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return r.join(made, "event_type").filter("v < 50 AND n >= 10").select("user_id", "event_type", "action")


@query("cmp14_cmp17_rewrite_seeds", with_(UNITS, "e AS (SELECT script_id, episode_no, avg(value) / 10 AS score, min_by(unit_id, (value, unit_id)) AS unit_id FROM units GROUP BY 1, 2)", select="SELECT script_id, episode_no, unit_id, CASE WHEN score < 3 THEN 'high' WHEN score < 5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY round(score, 9), episode_no) AS k FROM e WHERE round(score, 9) < 7) WHERE k <= 3"))
def rewrite_seeds(spark: S, sf: str) -> DataFrame:
    from fabula.operators.relational import top_n

    score = F.round(F.avg("value") / 10, 9)
    e = units(spark, sf).groupBy("script_id", "episode_no").agg(score.alias("score"), F.min_by("unit_id", F.struct("value", "unit_id")).alias("unit_id")).filter("score < 7")
    severity = F.when(F.col("score") < 3, "high").when(F.col("score") < 5, "medium").otherwise("low")
    return top_n(e, ["script_id"], [F.asc("score"), F.asc("episode_no")], 3).select("script_id", "episode_no", "unit_id", severity.alias("severity"))


@query("jsn1_jsn3_lookups", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.z') IS NOT NULL AS has_z FROM events")
def json_lookups(spark: S, sf: str) -> DataFrame:
    variant = F.try_parse_json("props")
    return events(spark, sf).select("event_id", F.try_variant_get(variant, "$.k", "bigint").alias("k"), F.try_variant_get(variant, "$.z", "string").isNotNull().alias("has_z"))


@query("mth1_mth2_entropy", with_(UNITS, "c AS (SELECT script_id, event_type, count(*)::DOUBLE AS c FROM units GROUP BY 1, 2)", "p AS (SELECT script_id, c / sum(c) OVER (PARTITION BY script_id) AS p FROM c)", select="SELECT script_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1"))
def entropy(spark: S, sf: str) -> DataFrame:
    """Entropy from two sums, so no window is needed: log n - (sum of c log c) / n."""
    c = units(spark, sf).groupBy("script_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("script_id").agg(F.round(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), 6).alias("entropy"))


@query("mth4_cosines", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosines(spark: S, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("mth7_intensity", with_(UNITS, select="SELECT unit_id, CAST(least(8, CASE WHEN plot_hook <> 'none' THEN 2 ELSE 0 END + CASE WHEN conflict_type <> 'none' THEN 2 ELSE 0 END + CASE WHEN payoff_type <> 'none' THEN 3 ELSE 0 END + CASE WHEN emotional_driver <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS x FROM units"))
def intensities(spark: S, sf: str) -> DataFrame:
    from fabula.operators.signals import intensity

    level = intensity(*(F.col(c) for c in ("plot_hook", "conflict_type", "payoff_type", "emotional_driver")))
    return units(spark, sf).select("unit_id", level.cast("bigint").alias("x"))


@query("mth8_deterministic_pick", "SELECT event_id, ('0x' || left(sha256(event_type || ':' || event_id), 8))::BIGINT % 7 AS pick FROM events")
def deterministic_pick(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", fn.pick(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 7).alias("pick"))


@query("mth9_canonical_digest", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def canonical_digest(spark: S, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("digest"))


@query("dat1_dat2_age_and_ttl", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 6) AS hours, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) > 864000000000 AS expired FROM events")
def age_and_ttl(spark: S, sf: str) -> DataFrame:
    hours = fn.hours_between(F.lit("2024-02-01").cast("timestamp"), F.col("ts").cast("timestamp"))
    return events(spark, sf).select("event_id", F.round(hours, 6).alias("hours"), (hours > 240).alias("expired"))


@query("src15_virtual_tree", "SELECT source AS script, doc_id AS scene_id, '/' || source || '/ep' || lpad((doc_id % 10)::VARCHAR, 3, '0') || '/' || (doc_id % 10) || '-' || (doc_id // 10) || '.txt' AS path FROM documents")
def virtual_tree(spark: S, sf: str) -> DataFrame:
    return files.virtual_paths(scenes(spark, sf)).select("script", "scene_id", "path")


@query("snk7_export_text", "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def export_text(spark: S, sf: str) -> DataFrame:
    return files.export_text(read(spark, sf, "conversations"), "conv_id", ["turn"]).select("conv_id", F.sha2("text", 256).alias("digest"))


# ---- streams, here over what is there
def frames(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "done").otherwise(F.col("event_type")).alias("frame"), "ts")


@query("stm1_ring_buffer", "SELECT user_id AS run_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def ring_buffer(spark: S, sf: str) -> DataFrame:
    return runs.ring(frames(spark, sf), 20).select("run_id", "seq")


@query("stm3_stm4_live_runs", "WITH r AS (SELECT user_id * 100000 + (ts::DATE - DATE '1970-01-01') AS run_id, max(ts) AS latest, count(*) AS frames FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') = 0) SELECT run_id, frames FROM r WHERE floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(latest)) <= 86400 ORDER BY latest DESC, run_id LIMIT 256")
def live_runs(spark: S, sf: str) -> DataFrame:
    """Runs, here a user's days, with a frame in the last day and no completion."""
    f = frames(spark, sf).withColumn("run_id", F.col("run_id") * 100000 + F.unix_date(F.to_date("ts")))
    return runs.alive(f, "2024-01-31", 86400).select("run_id", "frames")


@query("stm8_byte_quota")
def byte_quota(spark: S, sf: str) -> DataFrame:
    """Events of a user's day that fit into a quota of value; refused ones use up nothing. A fold, tested against a plain one."""
    rows = events(spark, sf).withColumn("day", F.to_date("ts"))
    return runs.byte_quota(rows, ["user_id", "day"], "value", 120, ["ts", "event_id"], "event_id")


@query("stx1_event_time_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_time_windows(spark: S, sf: str) -> DataFrame:
    """Beyond what was asked for: windows in event time, the same function as for streams."""
    out = runs.windowed_counts(events(spark, sf), "1 hour", "1 hour", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stx2_sessions", "WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_rows(spark: S, sf: str) -> DataFrame:
    out = runs.sessions(events(spark, sf), "6 hours", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
