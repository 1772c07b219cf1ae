"""Queries for the agreement of labels and segmentations: three raters of documents, and a script's units as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import scoring as fn
from fabula.operators import agreement as ops
from fabula.plans.adapters import UNITS, events, read, units, with_
from fabula.plans.registry import query

S = SparkSession
_SYMBOLS = "length(text) - length(translate(text, '|#$%&*!', ''))"
LABELS = f"""lab AS (
  SELECT doc_id AS item, 1 AS run, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS value FROM labels
  UNION ALL SELECT doc_id, 2, CASE WHEN {_SYMBOLS} > 20 OR n_chars < 300 THEN 'bad' ELSE 'good' END FROM documents JOIN (SELECT doc_id FROM labels) USING (doc_id)
  UNION ALL SELECT doc_id, 3, CASE WHEN {_SYMBOLS} > 5 THEN 'bad' WHEN n_chars < 200 THEN 'short' ELSE 'good' END FROM documents JOIN (SELECT doc_id FROM labels) USING (doc_id))"""
_PAIRS = "prs AS (SELECT x.item, x.run AS run_a, y.run AS run_b, x.value AS a, y.value AS b FROM lab x JOIN lab y ON x.item = y.item AND x.run < y.run)"


def label_rows(spark: S, sf: str) -> DataFrame:
    """item, run, value: the given quality label and two rules."""
    gold = read(spark, sf, "labels").select("doc_id", "quality")
    symbols = F.length("text") - F.length(F.translate("text", "|#$%&*!", ""))
    rows = gold.join(read(spark, sf, "documents").select("doc_id", symbols.alias("s"), "n_chars"), "doc_id")
    two = F.when((F.col("s") > 20) | (F.col("n_chars") < 300), "bad").otherwise("good")
    three = F.when(F.col("s") > 5, "bad").when(F.col("n_chars") < 200, "short").otherwise("good")
    one = F.when(F.col("quality") == 1, "good").otherwise("bad")
    each = F.inline(F.array(*(F.struct(F.lit(i + 1).alias("run"), c.alias("value")) for i, c in enumerate((one, two, three)))))
    return rows.select(F.col("doc_id").alias("item"), each)


@query(
    "st1_krippendorff_alpha",
    with_(
        LABELS, "c AS (SELECT item, value, count(*) AS c FROM lab GROUP BY 1, 2)", "m AS (SELECT *, sum(c) OVER (PARTITION BY item) AS m FROM c)",
        "v AS (SELECT value, sum(c)::DOUBLE AS nc, sum(c * (c - 1) / (m - 1))::DOUBLE AS oc FROM m WHERE m > 1 GROUP BY 1)", "t AS (SELECT sum(nc) AS n, sum(oc) AS o, sum(nc * (nc - 1)) AS e FROM v)",
        select="SELECT n::BIGINT AS n, round(1 - (1 - o / n) / (1 - e / (n * (n - 1))), 6) AS alpha FROM t",
    ),
)
def alpha(spark: S, sf: str) -> DataFrame:
    out = ops.krippendorff_alpha(label_rows(spark, sf).withColumn("g", F.lit(1)), ["g"])
    return out.select("n", F.round("alpha", 6).alias("alpha"))


_KAPPA = """n AS (SELECT run_a, run_b, count(*) AS n, avg((a = b)::INT) AS po FROM prs GROUP BY 1, 2),
x AS (SELECT run_a, run_b, a AS v, count(*) AS ca FROM prs GROUP BY 1, 2, 3), y AS (SELECT run_a, run_b, b AS v, count(*) AS cb FROM prs GROUP BY 1, 2, 3),
pe AS (SELECT run_a, run_b, sum(ca * cb)::DOUBLE AS both_ FROM x JOIN y USING (run_a, run_b, v) GROUP BY 1, 2),
k AS (SELECT run_a, run_b, n, po, both_ / (n * n) AS pe, (po - both_ / (n * n)) / (1 - both_ / (n * n)) AS kappa FROM n JOIN pe USING (run_a, run_b))"""


@query("st2_cohen_kappa", with_(LABELS, _PAIRS, _KAPPA, select="SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa FROM k"))
def kappa(spark: S, sf: str) -> DataFrame:
    out = ops.cohen_kappa(label_rows(spark, sf))
    return out.select(F.col("run_a").cast("bigint").alias("run_a"), F.col("run_b").cast("bigint").alias("run_b"), "n", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")))


@query("st3_pairwise_agreement", with_(LABELS, _PAIRS, select="SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, count(*) AS items, round(avg((a = b)::INT), 6) AS agreement FROM prs GROUP BY 1, 2"))
def pairwise_agreement(spark: S, sf: str) -> DataFrame:
    out = ops.pairwise_agreement(label_rows(spark, sf))
    return out.select(F.col("run_a").cast("bigint").alias("run_a"), F.col("run_b").cast("bigint").alias("run_b"), "items", F.round("agreement", 6).alias("agreement"))


@query(
    "st4_hash_embedding_cosine",
    with_(
        LABELS, _PAIRS,
        "e AS (SELECT DISTINCT value, list_transform(range(16), lambda i: (('0x' || substr(sha256(value), (4 * i + 1)::INT, 4))::INT - 32768)::DOUBLE) AS v FROM lab)",
        select="SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, round(avg(list_cosine_similarity(x.v, y.v)), 6) AS cosine FROM prs JOIN e x ON x.value = a JOIN e y ON y.value = b GROUP BY 1, 2",
    ),
)
def hash_embedding_cosine(spark: S, sf: str) -> DataFrame:
    """Labels as vectors of 16 numbers cut from their digest, where no model is at hand. There are few distinct labels."""
    rows = label_rows(spark, sf)
    digest = F.sha2("value", 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(digest, 4 * i + 1, F.lit(4)), 16, 10).cast("double") - 32768)
    vectors = rows.select("value").distinct().withColumn("v", parts)
    side = lambda c: F.broadcast(vectors.select(F.col("value").alias(c), F.col("v").alias(f"v_{c}")))
    joined = ops.pairs(rows).join(side("a"), "a").join(side("b"), "b")
    out = joined.groupBy("run_a", "run_b").agg(F.round(F.avg(fn.cosine(F.col("v_a"), F.col("v_b"))), 6).alias("cosine"))
    return out.select(F.col("run_a").cast("bigint").alias("run_a"), F.col("run_b").cast("bigint").alias("run_b"), "cosine")


_GOLD = "g AS (SELECT item, max(value) FILTER (run = 1) AS gold, max(value) FILTER (run = 3) AS predicted FROM lab GROUP BY 1)"


def _gold(spark: S, sf: str) -> DataFrame:
    rows = label_rows(spark, sf)
    return rows.groupBy("item").agg(*(F.max(F.when(F.col("run") == r, F.col("value"))).alias(n) for r, n in ((1, "gold"), (3, "predicted"))))


@query(
    "st5_macro_f1",
    with_(LABELS, _GOLD, "l AS (SELECT gold AS label FROM g UNION SELECT predicted FROM g)", "f AS (SELECT label, (SELECT count(*) FROM g WHERE gold = label) AS n, (SELECT count(*) FROM g WHERE predicted = label) AS m, (SELECT count(*) FROM g WHERE gold = label AND predicted = label) AS tp FROM l)", select="SELECT round(avg(2.0 * tp / (n + m)), 6) AS macro_f1, count(*) AS labels FROM f"),
)
def macro_f1(spark: S, sf: str) -> DataFrame:
    return ops.macro_f1(_gold(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"), "labels")


@query("st6_confusion", with_(LABELS, _GOLD, select="SELECT gold, predicted, count(*) AS n FROM g GROUP BY 1, 2"))
def confusion(spark: S, sf: str) -> DataFrame:
    return ops.confusion(_gold(spark, sf))


_WILSON = "round(greatest(0, (p + zz / (2 * n) - z * sqrt(greatest(0, p * (1 - p) / n + zz / (4 * n * n)))) / (1 + zz / n)), 6)"
_W = f"w AS (SELECT *, stable / n AS p, {fn.Z95} AS z, {fn.Z95**2} AS zz FROM s)"


@query(
    "st7_stable_items",
    with_(LABELS, "i AS (SELECT l.item, d.source, count(DISTINCT value) AS c FROM lab l JOIN documents d ON d.doc_id = l.item GROUP BY 1, 2)", "s AS (SELECT source, count(*) AS n, count(*) FILTER (c = 1) AS stable FROM i GROUP BY 1)", _W, select=f"SELECT source, n AS items, stable, {_WILSON} AS wilson FROM w"),
)
def stable_items(spark: S, sf: str) -> DataFrame:
    sources = read(spark, sf, "documents").select(F.col("doc_id").alias("item"), "source")
    return ops.stable_items(label_rows(spark, sf).join(sources, "item"), ["source"]).withColumn("wilson", F.round("wilson", 6))


_SETS = "st AS (SELECT user_id AS item, day(ts) % 3 AS run, list_sort(list(DISTINCT event_type)) AS value FROM events WHERE day(ts) <= 6 GROUP BY 1, 2)"
_SIM = "sim AS (SELECT x.item, avg(CASE WHEN len(list_distinct(list_concat(x.value, y.value))) = 0 THEN 1.0 ELSE len(list_intersect(x.value, y.value))::DOUBLE / len(list_distinct(list_concat(x.value, y.value))) END) AS similarity, count(*) AS pairs FROM st x JOIN st y ON x.item = y.item AND x.run < y.run GROUP BY 1)"


def _sets(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf).filter(F.dayofmonth("ts") <= 6)
    return e.groupBy(F.col("user_id").alias("item"), (F.dayofmonth("ts") % 3).alias("run")).agg(F.array_sort(F.collect_set("event_type")).alias("value"))


@query("st8_multi_label_jaccard", with_(_SETS, _SIM, select="SELECT item, round(similarity, 6) AS similarity, pairs FROM sim"))
def multi_label_jaccard(spark: S, sf: str) -> DataFrame:
    return ops.pairwise_jaccard(_sets(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("st9_jaccard_stable", with_(_SETS, _SIM, "s AS (SELECT count(*) AS n, count(*) FILTER (similarity >= 0.5) AS stable FROM sim)", _W, select=f"SELECT n AS items, stable, {_WILSON} AS wilson FROM w"))
def jaccard_stable(spark: S, sf: str) -> DataFrame:
    s = ops.similar_items(ops.pairwise_jaccard(_sets(spark, sf)))
    return s.withColumn("wilson", F.round(fn.wilson(F.col("stable"), F.col("items")), 6))


_SEG = """seg AS (SELECT script_id AS id, max(idx) AS n, coalesce(list_sort(list(idx) FILTER (event_type = 'signup')), []) AS ref, coalesce(list_sort(list(idx) FILTER (event_type = 'signup' AND k % 4 <> 0 OR event_type = 'error' AND k % 10 = 0)), []) AS hyp FROM units GROUP BY 1)"""


def _segments(spark: S, sf: str) -> DataFrame:
    at = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("idx"))))
    kind, k = F.col("event_type"), F.col("k")
    return units(spark, sf).groupBy(F.col("script_id").alias("id")).agg(
        F.max("idx").alias("n"), at(kind == "signup").alias("ref"), at(((kind == "signup") & (k % 4 != 0)) | ((kind == "error") & (k % 10 == 0))).alias("hyp")
    )


@query(
    "st10_window_diff",
    with_(
        UNITS, _SEG, "kk AS (SELECT *, greatest(1, least(n, greatest(2, round_even(n / (2.0 * (len(ref) + 1)), 0)::BIGINT))) AS k FROM seg WHERE n > 1)",
        "ws AS (SELECT id, k, ref, hyp, unnest(range(greatest(1, n - k))) AS s FROM kk)",
        select="SELECT id, round(avg((len(list_filter(ref, lambda b: b > s AND b < s + k)) <> len(list_filter(hyp, lambda b: b > s AND b < s + k)))::INT), 6) AS window_diff, count(*) AS windows FROM ws GROUP BY 1",
    ),
)
def window_diff(spark: S, sf: str) -> DataFrame:
    return ops.window_diff(_segments(spark, sf)).withColumn("window_diff", F.round("window_diff", 6))


@query("st11_boundary_similarity")
def boundary_similarity(spark: S, sf: str) -> DataFrame:
    """Greedy matching, so there is no SQL twin; tested by hand-made cases."""
    return ops.boundary_similarities(_segments(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("st12_pairwise_mean", with_(LABELS, _PAIRS, "p AS (SELECT run_a, run_b, avg((a = b)::INT) AS m FROM prs GROUP BY 1, 2)", select="SELECT round(avg(m), 6) AS mean, count(*) AS pairs FROM p"))
def pairwise_mean(spark: S, sf: str) -> DataFrame:
    return ops.pairwise_agreement(label_rows(spark, sf)).agg(F.round(F.avg("agreement"), 6).alias("mean"), F.count(F.lit(1)).alias("pairs"))


@query(
    "st13_verdicts",
    with_("v AS (SELECT user_id, avg((event_type <> 'error')::INT) AS a, avg((value < 90)::INT) AS b, avg((value > 3)::INT) AS c, avg((event_type <> 'view')::INT) AS d FROM events GROUP BY 1)", select="SELECT user_id, CASE WHEN a >= 0.7 AND b >= 0.6 AND c >= 0.6 AND d >= 0.6 THEN 'online' WHEN a < 0.4 OR b < 0.3 OR c < 0.4 OR d < 0.4 THEN 'offline' ELSE 'fix' END AS verdict FROM v"),
)
def verdicts(spark: S, sf: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    kind, value = F.col("event_type"), F.col("value")
    v = events(spark, sf).groupBy("user_id").agg(share(kind != "error").alias("a"), share(value < 90).alias("b"), share(value > 3).alias("c"), share(kind != "view").alias("d"))
    return v.select("user_id", ops.verdict(*map(F.col, "abcd")).alias("verdict"))


@query(
    "st14_segmentation_verdicts",
    with_(UNITS, "c AS (SELECT script_id, avg(n) AS m, stddev_pop(n) AS s, max(n) / 20.0 AS wd FROM (SELECT script_id, episode_no, count(*) AS n FROM units GROUP BY 1, 2) GROUP BY 1)", select="SELECT script_id, CASE WHEN wd <= 0.15 AND s / m <= 0.10 THEN 'stable' WHEN wd >= 0.40 OR s / m >= 0.25 THEN 'unstable' ELSE 'fixable' END AS verdict FROM c"),
)
def segmentation_verdicts(spark: S, sf: str) -> DataFrame:
    n = units(spark, sf).groupBy("script_id", "episode_no").agg(F.count(F.lit(1)).alias("n"))
    c = n.groupBy("script_id").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"), (F.max("n") / 20.0).alias("wd"))
    return c.select("script_id", ops.segmentation_verdict(F.col("wd"), F.col("s") / F.col("m")).alias("verdict"))


@query("st15_unstable_values", with_(LABELS, "u AS (SELECT item FROM lab GROUP BY 1 HAVING count(DISTINCT value) > 1)", select="SELECT string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM lab JOIN u USING (item)"))
def unstable_values(spark: S, sf: str) -> DataFrame:
    """Values of items whose runs differ: each item's set is small, and the union has few members."""
    sets = label_rows(spark, sf).groupBy("item").agg(F.collect_set("value").alias("vs")).filter(F.size("vs") > 1)
    values = sets.select(F.explode("vs").alias("v")).distinct()
    return values.agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("vals"))


@query(
    "st16_stability_report",
    with_(
        LABELS, _PAIRS, _KAPPA, "i AS (SELECT item, count(DISTINCT value) AS c FROM lab GROUP BY 1)", "s AS (SELECT count(*) AS n, count(*) FILTER (c = 1) AS stable FROM i)", _W,
        select=f"SELECT n AS items, stable, {_WILSON} AS wilson, (SELECT round(avg(po), 6) FROM k) AS agreement, (SELECT round(avg(kappa), 6) FROM k) AS kappa FROM w",
    ),
)
def stability_report(spark: S, sf: str) -> DataFrame:
    rows = label_rows(spark, sf).withColumn("g", F.lit(1))
    stable = ops.stable_items(rows, ["g"]).select("items", "stable", F.round("wilson", 6).alias("wilson"))
    pairs = ops.cohen_kappa(rows.drop("g")).agg(F.round(F.avg("po"), 6).alias("agreement"), F.round(F.avg("kappa"), 6).alias("kappa"))
    return stable.crossJoin(F.broadcast(pairs))


@query("st17_llm_against_rule", with_(LABELS, _PAIRS, _KAPPA, select="SELECT round(po, 6) AS agreement, round(kappa, 6) AS kappa FROM k WHERE run_a = 1 AND run_b = 2"))
def llm_against_rule(spark: S, sf: str) -> DataFrame:
    out = ops.cohen_kappa(label_rows(spark, sf).filter("run <= 2"))
    return out.select(F.round("po", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(
    "st18_set_f1",
    with_(UNITS, _SEG, "m AS (SELECT id, len(list_intersect(ref, hyp)) AS i, len(ref) AS r, len(hyp) AS h FROM seg)", select="SELECT id, round(CASE WHEN r + h > 0 THEN 2.0 * i / (r + h) ELSE 1 END, 6) AS f1, round(CASE WHEN r + h - i > 0 THEN i / (r + h - i) ELSE 1 END, 6) AS jaccard FROM m"),
)
def set_f1(spark: S, sf: str) -> DataFrame:
    both = F.size(F.array_intersect("ref", "hyp"))
    total = F.size("ref") + F.size("hyp")
    f1 = F.when(total > 0, 2.0 * both / total).otherwise(1.0)
    return _segments(spark, sf).select("id", F.round(f1, 6).alias("f1"), F.round(fn.jaccard(F.col("ref"), F.col("hyp")), 6).alias("jaccard"))


@query(
    "st19_wilson_buckets",
    with_(LABELS, "i AS (SELECT l.item, d.source, count(DISTINCT value) AS c FROM lab l JOIN documents d ON d.doc_id = l.item GROUP BY 1, 2)", "s AS (SELECT source, count(*) AS n, count(*) FILTER (c = 1) AS stable FROM i GROUP BY 1)", _W, f"b AS (SELECT source, {_WILSON} AS w FROM w)", select="SELECT source, CASE WHEN w >= 0.85 THEN 'shared' WHEN w >= 0.7 THEN 'aggregate' WHEN w >= 0.5 THEN 'retest' ELSE 'apart' END AS bucket FROM b"),
)
def wilson_buckets(spark: S, sf: str) -> DataFrame:
    return stable_items(spark, sf).select("source", ops.wilson_bucket(F.col("wilson")).alias("bucket"))


OURS, THEIRS = ("online", "fix", "offline", "other"), ("video_stable", "video_aggregate", "video_experimental", "video_blocked")


@query(
    "st20_jn18_shared_gate",
    "WITH d AS (SELECT event_id, (ARRAY['online', 'fix', 'offline', 'other'])[event_id % 4 + 1] AS ours, (ARRAY['video_stable', 'video_aggregate', 'video_experimental', 'video_blocked'])[event_id // 4 % 4 + 1] AS theirs FROM events) "
    "SELECT event_id, CASE WHEN ours = 'offline' OR theirs = 'video_blocked' THEN 'blocked' WHEN ours = 'fix' OR theirs = 'video_experimental' THEN 'experimental' WHEN ours = 'online' AND theirs = 'video_stable' THEN 'stable_shared' WHEN ours = 'online' AND theirs = 'video_aggregate' THEN 'aggregate_only' ELSE 'blocked' END AS gate FROM d",
)
def shared_gate(spark: S, sf: str) -> DataFrame:
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    e = F.col("event_id")
    ours = events(spark, sf).select("event_id", named(OURS, e % 4).alias("ours"))
    theirs = events(spark, sf).select("event_id", named(THEIRS, F.floor(e / 4) % 4).alias("theirs"))
    return ours.join(theirs, "event_id").select("event_id", ops.shared_gate(F.col("ours"), F.col("theirs")).alias("gate"))


@query("agg19_majority_vote", with_(LABELS, "c AS (SELECT item, value, count(*) AS n, min(run) AS f FROM lab GROUP BY 1, 2)", select="SELECT item, max_by(value, (n, -f)) AS value, max(n) AS votes FROM c GROUP BY 1"))
def majority_vote(spark: S, sf: str) -> DataFrame:
    return ops.majority(label_rows(spark, sf))
