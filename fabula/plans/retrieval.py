"""Queries for retrieval: benchmark items are the questions, documents and embeddings what is searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.operators import positions, vector_index
from fabula.operators import retrieval as ops
from fabula.operators.relational import stored
from fabula.plans.adapters import UNIT_TAGS, UNITS, read, unit_tags, units, with_
from fabula.plans.registry import Query, query

S = SparkSession
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: A whole question is all distinct words of an item, a question the three of them that come last; the items are a given, small table.
WHOLE_QUESTIONS = f"questions AS (SELECT item_id AS qid, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark)"
QUESTIONS = f"questions AS (SELECT item_id AS qid, unnest(list_sort(list_distinct({_TOK.format('text')}), 'DESC')[1:3]) AS term FROM benchmark)"
WORDS = f"words AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents)"
LENS = f"lens AS (SELECT doc_id AS id, len({_TOK.format('text')}) AS len FROM documents)"
_BM25 = """tf AS (SELECT term, id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM questions) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
hits AS (SELECT qid, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) AS w FROM questions JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (id) CROSS JOIN corpus),
bm AS (SELECT qid, id, sum(w) AS score, count(*) AS terms FROM hits GROUP BY 1, 2)"""


def questions(spark: S, sf: str) -> DataFrame:
    words = F.slice(F.reverse(F.array_sort(F.array_distinct(ops.tokens(F.col("text"))))), 1, 3)
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words).alias("term"))


def whole_questions(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(ops.tokens(F.col("text")))).alias("term"))


def docs(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


def _index(spark: S, sf: str) -> DataFrame:
    return stored(ops.postings(docs(spark, sf), "doc_id", "text"), "index")


def _bm25(spark: S, sf: str, match_all: bool, index: DataFrame | None = None, ask: Query = questions) -> DataFrame:
    return ops.bm25(ask(spark, sf), index or _index(spark, sf), match_all)


@query("ret2_all_terms_bm25", with_(QUESTIONS, WORDS, LENS, _BM25, "need AS (SELECT qid, count(*) AS need FROM questions GROUP BY 1)", select="SELECT qid, id, round(score, 6) AS score FROM bm JOIN need USING (qid) WHERE terms = need"))
def all_terms_bm25(spark: S, sf: str) -> DataFrame:
    return _bm25(spark, sf, True).withColumn("score", F.round("score", 6))


@query("ret4_any_term_bm25", with_(WHOLE_QUESTIONS, WORDS, LENS, _BM25, select="SELECT qid, id, round(score, 6) AS score FROM bm"))
def any_term_bm25(spark: S, sf: str) -> DataFrame:
    return _bm25(spark, sf, False, ask=whole_questions).withColumn("score", F.round("score", 6))


_SPOTS = f"spots AS (SELECT doc_id AS id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, {_TOK.format('text')} AS ws FROM documents))"
#: From unit occurrences ``occ`` (qid, id, unit, s, e), the number of units ``need`` and the tokens' positions ``tok`` (qid, id, p).
_COVERS = """lasts AS (SELECT a.qid, a.id, a.e, b.unit, max(b.s) AS s FROM (SELECT DISTINCT qid, id, e FROM occ) a JOIN occ b ON a.qid = b.qid AND a.id = b.id AND b.e <= a.e GROUP BY ALL),
whole AS (SELECT qid, id, e, min(s) AS s FROM lasts JOIN need USING (qid) GROUP BY qid, id, e HAVING count(*) = any_value(need)),
cover AS (SELECT qid, id, s, min(e) AS e FROM whole GROUP BY 1, 2, 3),
noisy AS (SELECT c.qid, c.id, s, e, e - s + 1 - count(*) AS noise FROM cover c JOIN tok t ON t.qid = c.qid AND t.id = c.id AND t.p BETWEEN s AND e GROUP BY c.qid, c.id, s, e)"""
_DENSITY = "SELECT qid, id, round(sum(0.1 / (1 + noise)), 9) AS score, count(*) AS n_covers, min((noise, s, e))[2]::INT AS first, min((noise, s, e))[3]::INT AS last FROM noisy GROUP BY 1, 2"


def _density(queries: DataFrame, spark: S, sf: str) -> DataFrame:
    out = positions.cover_density(queries, positions.build(docs(spark, sf), "doc_id", "text"))
    return out.withColumn("score", F.round("score", 9))


@query("ret2_cover_density", with_(QUESTIONS, _SPOTS, "tok AS (SELECT qid, id, p FROM questions JOIN spots USING (term))", "occ AS (SELECT qid, id, term AS unit, p AS s, p AS e FROM questions JOIN spots USING (term))", "need AS (SELECT qid, count(*) AS need FROM questions GROUP BY 1)", _COVERS, select=_DENSITY))
def cover_density(spark: S, sf: str) -> DataFrame:
    """Documents with all three words of a question, by how close together they are, from positions alone."""
    units = questions(spark, sf).groupBy("qid").agg(F.collect_list(F.array("term")).alias("units"))
    return _density(units, spark, sf)


_PHRASES = f"ph AS (SELECT item_id AS qid, ws[1] AS one, ws[2] AS two, list_sort(list_distinct(ws), 'DESC')[1] AS word FROM (SELECT item_id, {_TOK.format('text')} AS ws FROM benchmark) WHERE len(ws) > 1)"


@query("ret2_phrase_cover_density", with_(_PHRASES, _SPOTS, "tok AS (SELECT DISTINCT qid, id, p FROM ph JOIN spots ON term IN (one, two, word))", "occ AS (SELECT qid, a.id, 0 AS unit, a.p AS s, b.p AS e FROM ph JOIN spots a ON a.term = one JOIN spots b ON b.term = two AND b.id = a.id AND b.p = a.p + 1 UNION ALL SELECT qid, id, 1, p, p FROM ph JOIN spots ON term = word)", "need AS (SELECT qid, 2 AS need FROM ph)", _COVERS, select=_DENSITY))
def phrase_cover_density(spark: S, sf: str) -> DataFrame:
    """Documents with the first two words of an item side by side and a third one anywhere."""
    words = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), ops.tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 1)
    phrase, word = F.slice("ws", 1, 2), F.array(F.array_max("ws"))
    return _density(words.select("qid", F.array(phrase, word).alias("units")), spark, sf)


def _vector_sides(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), rows


def _found(spark: S, sf: str) -> DataFrame:
    queries, rows = _vector_sides(spark, sf)
    centres = vector_index.fit(rows)
    index = stored(vector_index.assign(rows, centres), "lists")
    return vector_index.search(queries, index, centres, 10, vector_index.tuned_probes(rows, centres))


@query("ret22_vector_index")
def indexed_neighbours(spark: S, sf: str) -> DataFrame:
    """The neighbours of every fiftieth vector by an index of lists; approximate, so its recall is measured beside it."""
    return _found(spark, sf).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@query("ret22_index_recall")
def index_recall(spark: S, sf: str) -> DataFrame:
    """How many of the ten exact neighbours of each query the index finds."""
    return vector_index.recall(_found(spark, sf), _vectors(spark, sf, 10))


@query("ret3_keyword_hits", with_(QUESTIONS, select="SELECT qid, doc_id AS id, count(DISTINCT term) AS hits FROM questions JOIN documents ON contains(lower(text), term) GROUP BY 1, 2"))
def keyword_hits(spark: S, sf: str) -> DataFrame:
    return ops.keyword_hits(questions(spark, sf), _index(spark, sf))


_QV = "qv AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
_SIM = "vs AS (SELECT qid, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings CROSS JOIN qv)"


def _vectors(spark: S, sf: str, k: int) -> DataFrame:
    e = read(spark, sf, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return ops.vector_top_k(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k)


@query("ret5_mth5_vector_top_k", with_(_QV, _SIM, select="SELECT qid, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM vs) WHERE k <= 10"))
def vector_top_k(spark: S, sf: str) -> DataFrame:
    """The neighbours of a stated set of queries, every fiftieth vector, against all vectors."""
    return _vectors(spark, sf, 10).select("qid", "id", F.round("score", 5).alias("score"))


_CHANNELS = """kw AS (SELECT qid, doc_id AS id, count(DISTINCT term)::DOUBLE AS score FROM questions JOIN documents ON contains(lower(text), term) GROUP BY 1, 2),
ch AS (SELECT qid, id, round(score, 9) AS score, 'bm25' AS channel FROM bm UNION ALL SELECT qid, id, score, 'keyword' FROM kw),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, id) AS rank FROM ch), rec AS (SELECT * FROM rk WHERE rank <= 30)"""


def _recalled(spark: S, sf: str) -> DataFrame:
    """Two channels, each to rank 30, with ranks in the channel."""
    index = _index(spark, sf)
    one = _bm25(spark, sf, False, index).select("qid", "id", F.round("score", 9).alias("score"), F.lit("bm25").alias("channel"))
    two = ops.keyword_hits(questions(spark, sf), index).select("qid", "id", F.col("hits").cast("double").alias("score"), F.lit("keyword").alias("channel"))
    return ops.channel_ranks(one.unionByName(two)).filter("rank <= 30")


@query("ret6_multi_path_recall", with_(QUESTIONS, WORDS, LENS, _BM25, _CHANNELS, select="SELECT qid, id, channel, rank FROM rec"))
def multi_path_recall(spark: S, sf: str) -> DataFrame:
    return _recalled(spark, sf).select("qid", "id", "channel", F.col("rank").cast("bigint").alias("rank"))


@query("ret8_reciprocal_rank_fusion", with_(QUESTIONS, WORDS, LENS, _BM25, _CHANNELS, select="SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS fused, round(max(score), 6) AS best, string_agg(channel, ',' ORDER BY channel) AS channels FROM rec GROUP BY 1, 2"))
def reciprocal_rank_fusion(spark: S, sf: str) -> DataFrame:
    return ops.rrf(_recalled(spark, sf)).select("qid", "id", F.round("fused", 9).alias("fused"), F.round("best", 6).alias("best"), F.array_join("channels", ",").alias("channels"))


@query("ret18_fast_path", with_(QUESTIONS, WORDS, LENS, _BM25, _CHANNELS, select="SELECT qid, id, round(max(score), 6) AS score FROM rec GROUP BY 1, 2"))
def fast_path(spark: S, sf: str) -> DataFrame:
    """The best raw score of any channel, channels compared as they are."""
    return _recalled(spark, sf).groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score"))


@query("ret7_memory_boost", with_(QUESTIONS, WORDS, LENS, _BM25, select="SELECT qid, id, round(CASE WHEN id % 7 = 0 THEN score * 1.3 ELSE score END, 6) AS score FROM bm"))
def memory_boost(spark: S, sf: str) -> DataFrame:
    remembered = docs(spark, sf).filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    return ops.boosted(_bm25(spark, sf, False), remembered).select("qid", "id", F.round("score", 6).alias("score"))


@query("ret9_mmr")
def mmr(spark: S, sf: str) -> DataFrame:
    """Greedy, so there is no SQL twin; tested against a plain version."""
    found = stored(ops.rrf(_recalled(spark, sf)).select("qid", "id", F.col("fused").alias("score")), "found")
    texts = docs(spark, sf).join(F.broadcast(found), F.col("doc_id") == F.col("id"))  # 60 rows a question at most
    return ops.mmr(texts.select("qid", "id", "score", F.array_distinct(ops.tokens(F.col("text"))).alias("toks")), 10)


@query("ret10_mth6_metadata_rescoring", with_(WHOLE_QUESTIONS, WORDS, LENS, _BM25, select="SELECT qid, id, round(score * (1 + 0.15 * greatest(0, least(1, (1970 + id % 60 - 1970) / 55.0)) + 0.05 * ln(1 + id % 100) + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END), 6) AS score FROM bm"))
def metadata_rescoring(spark: S, sf: str) -> DataFrame:
    i = F.col("id")
    out = ops.rescored(_bm25(spark, sf, False, ask=whole_questions), 1970 + i % 60, (i % 100).cast("double"), F.when(i % 3 == 0, 0.1).otherwise(0.0), 1970, 2025)
    return out.select("qid", "id", F.round("score", 6).alias("score"))


_WEIGHTS = "dt AS (SELECT DISTINCT id, term FROM words WHERE term IN (SELECT term FROM questions)), raw AS (SELECT term, count(*) AS df, log10(10 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM dt GROUP BY 1), tw AS (SELECT term, df, raw / sum(raw) OVER () AS w FROM raw)"


def _doc_terms(spark: S, sf: str, index: DataFrame, ask: Query = questions) -> DataFrame:
    return index.select("id", "term").join(ask(spark, sf).select("term").distinct(), "term", "left_semi")


def _weights(spark: S, sf: str, terms: DataFrame) -> DataFrame:
    return ops.term_weights(terms, docs(spark, sf).agg(F.count(F.lit(1)).alias("n")))


def _similarity(spark: S, sf: str, index: DataFrame, ask: Query = questions) -> DataFrame:
    terms = _doc_terms(spark, sf, index, ask)
    weights = ask(spark, sf).join(_weights(spark, sf, terms), "term").select("qid", "term", "w")
    return ops.token_similarity(weights, terms)


@query("str13_term_weights", with_(QUESTIONS, WORDS, _WEIGHTS, select="SELECT term, df, round(w, 9) AS w FROM tw"))
def term_weights(spark: S, sf: str) -> DataFrame:
    return _weights(spark, sf, _doc_terms(spark, sf, _index(spark, sf))).withColumn("w", F.round("w", 9))


_TSIM = "qw AS (SELECT qid, term, w FROM questions JOIN tw USING (term)), ts AS (SELECT qid, id, sum(w) / (SELECT sum(w) FROM qw x WHERE x.qid = q.qid) AS sim FROM qw q JOIN dt USING (term) GROUP BY 1, 2)"


@query("str14_token_similarity", with_(WHOLE_QUESTIONS, WORDS, _WEIGHTS, _TSIM, select="SELECT qid, id, round(sim, 6) AS similarity FROM ts"))
def token_similarity(spark: S, sf: str) -> DataFrame:
    return _similarity(spark, sf, _index(spark, sf), whole_questions).withColumn("similarity", F.round("similarity", 6))


#: A document's source is its title, its language its important word and its first line its question; the vector of a number
#: is that of the item and of the document with it.
_FIELDS = f"""ft AS (SELECT DISTINCT id, term FROM (SELECT doc_id AS id, unnest(list_concat({_TOK.format('text')}, list_concat({_TOK.format('source')}, {_TOK.format('lang')}))) AS term FROM documents) WHERE term IN (SELECT term FROM questions)),
fraw AS (SELECT term, count(*) AS df, log10(10 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM ft GROUP BY 1), fw AS (SELECT term, raw / sum(raw) OVER () AS w FROM fraw),
fq AS (SELECT qid, term, w FROM questions JOIN fw USING (term)), fs AS (SELECT qid, id, sum(w) / (SELECT sum(w) FROM fq x WHERE x.qid = q.qid) AS sim FROM fq q JOIN ft USING (term) GROUP BY 1, 2),
hy AS (SELECT qid, bm.id, score, 0.3 * coalesce(sim, 0) + 0.7 * coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0) + 0.01 * (bm.id % 5) AS hybrid
  FROM bm LEFT JOIN fs USING (qid, id) LEFT JOIN embeddings e ON e.vec_id = bm.id LEFT JOIN embeddings q ON q.vec_id = qid)"""


def _hybrid(spark: S, sf: str, ask: Query = questions) -> DataFrame:
    """Documents that have a term, scored again by terms of all fields, by vectors and by a feature of rank."""
    d, e = read(spark, sf, "documents"), read(spark, sf, "embeddings")
    first_line = F.substring_index("text", "\n", 1)
    fields = ops.field_tokens(d, "doc_id", F.col("text"), F.col("source"), F.col("lang"), first_line)
    fields = stored(fields.join(F.broadcast(ask(spark, sf).select("term").distinct()), "term", "left_semi").select("id", "term"), "fields")
    similarity = _similarity(spark, sf, fields, ask)
    asked = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).join(read(spark, sf, "benchmark").select(F.col("item_id").alias("qid")), "qid")
    out = ops.hybrid(_bm25(spark, sf, False, ask=ask), similarity, asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return out.withColumn("hybrid", F.col("hybrid") + 0.01 * (F.col("id") % 5))


@query("ret12_hybrid_rerank", with_(WHOLE_QUESTIONS, WORDS, LENS, _BM25, _FIELDS, select="SELECT qid, id, round(hybrid, 5) AS score FROM hy"))
def hybrid_rerank(spark: S, sf: str) -> DataFrame:
    return _hybrid(spark, sf, whole_questions).select("qid", "id", F.round("hybrid", 5).alias("score"))


@query(
    "top10_ret15_adaptive_page",
    with_(
        QUESTIONS, WORDS, LENS, _BM25, _FIELDS,
        "st AS (SELECT *, qid % 5 + 1 AS page, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS stored FROM hy)",
        "pl AS (SELECT qid, id, page, row_number() OVER (PARTITION BY qid ORDER BY round(hybrid, 5) DESC, id) AS place FROM st WHERE page <= 3 AND stored <= 128 UNION ALL SELECT qid, id, page, stored FROM st WHERE page > 3)",
        select="SELECT qid, page, place, id FROM pl WHERE place > (page - 1) * 10 AND place <= page * 10",
    ),
)
def adaptive_page(spark: S, sf: str) -> DataFrame:
    """One of five pages of ten for each question: the first three ranked again from a wide pool, the others as stored."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "id")
    ranked = _hybrid(spark, sf).select("qid", "id", F.row_number().over(order).alias("stored"), F.round("hybrid", 5).alias("score"))
    out = ops.adaptive_page(ranked, (F.col("qid") % 5 + 1).cast("bigint"), 10)
    return out.select("qid", "page", F.col("place").cast("bigint").alias("place"), "id")


@query("ret11_relaxed_fusion", with_(WHOLE_QUESTIONS, WORDS, LENS, _BM25, "f AS (SELECT qid, id, 0.05 * score + 0.95 * terms AS f FROM bm)", "strict AS (SELECT * FROM f WHERE f >= 1.5)", select="SELECT qid, id, round(f, 6) AS score, 0::BIGINT AS level FROM strict UNION ALL SELECT qid, id, round(f, 6), 1 FROM f WHERE f >= 1.0 AND qid NOT IN (SELECT qid FROM strict)"))
def relaxed_fusion(spark: S, sf: str) -> DataFrame:
    """Weighted fusion of a score and of the number of terms; questions that find nothing are asked again with a lower bar."""
    hits = stored(keyword_terms(spark, sf), "hits")
    strict, loose = hits.filter("score >= 1.5"), hits.filter("score >= 1.0")
    return ops.cascade([strict, loose]).select("qid", "id", F.round("score", 6).alias("score"), F.col("level").cast("bigint").alias("level"))


def keyword_terms(spark: S, sf: str) -> DataFrame:
    found = ops.term_scores(whole_questions(spark, sf), _index(spark, sf))
    return found.select("qid", "id", (0.05 * F.col("score") + 0.95 * F.col("terms")).alias("score"))


@query("ret1_cascade", with_(QUESTIONS, WORDS, LENS, _BM25, "need AS (SELECT qid, count(*) AS need FROM questions GROUP BY 1)", "one AS (SELECT qid, id FROM bm JOIN need USING (qid) WHERE terms = need)", "two AS (SELECT DISTINCT qid, doc_id AS id FROM questions JOIN documents ON contains(lower(text), term))", select="SELECT qid, id, 0::BIGINT AS level FROM one UNION ALL SELECT qid, id, 1 FROM two WHERE qid NOT IN (SELECT qid FROM one)"))
def cascade(spark: S, sf: str) -> DataFrame:
    """All terms first; questions without a hit fall back to any keyword."""
    index = _index(spark, sf)
    one = _bm25(spark, sf, True, index)
    two = ops.keyword_hits(questions(spark, sf), index).withColumnRenamed("hits", "score")
    return ops.cascade([one, two.withColumn("score", F.col("score").cast("double"))]).select("qid", "id", F.col("level").cast("bigint").alias("level"))


@query("ret13_rank_features", with_(UNITS, UNIT_TAGS, "c AS (SELECT script_id, value, count(*)::DOUBLE AS c FROM unit_tags WHERE dim = 'story_stage' GROUP BY 1, 2)", "q AS (SELECT value, c FROM c WHERE script_id = 1)", "d AS (SELECT c.script_id, sum(c.c * q.c) AS dot FROM c JOIN q USING (value) GROUP BY 1)", "n AS (SELECT script_id, sqrt(sum(c * c)) AS norm FROM c GROUP BY 1)", select="SELECT script_id, round(dot / norm / (SELECT norm FROM n WHERE script_id = 1) * 10, 6) AS score FROM d JOIN n USING (script_id)"))
def rank_features(spark: S, sf: str) -> DataFrame:
    """Sparse feature maps of scripts compared with one script's map."""
    c = unit_tags(units(spark, sf)).filter("dim = 'story_stage'").groupBy("script_id", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    q = c.filter("script_id = 1").select("value", F.col("c").alias("q"))
    dot = c.join(F.broadcast(q), "value").groupBy("script_id").agg(F.sum(F.col("c") * F.col("q")).alias("dot"))
    norm = c.groupBy("script_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    own = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own"))
    return dot.join(norm, "script_id").crossJoin(F.broadcast(own)).select("script_id", F.round(F.col("dot") / F.col("norm") / F.col("own") * 10, 6).alias("score"))


_TAG_SCORE = "round_even(0.1 * (c + 1) / (cnt + {s}) / greatest(1e-6, share), 0)::BIGINT"
_TAGS = f"c AS (SELECT id, term AS tag, count(*) AS c FROM words WHERE length(term) >= 8 GROUP BY 1, 2), s AS (SELECT tag, (sum(c) + 1) / (sum(sum(c)) OVER () + 1000) AS share FROM c GROUP BY 1)"


def _long_words(spark: S, sf: str) -> DataFrame:
    words = docs(spark, sf).select(F.col("doc_id").alias("id"), F.explode(ops.tokens(F.col("text"))).alias("tag"))
    return words.filter("length(tag) >= 8").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("c"))


@query("ret16_tag_suggestions", with_(WORDS, _TAGS, "o AS (SELECT id, sum(c) AS cnt FROM c GROUP BY 1)", f"r AS (SELECT id, tag, {_TAG_SCORE.format(s=1000)} AS score FROM c JOIN s USING (tag) JOIN o USING (id))", select="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rank FROM r) WHERE rank <= 3 AND score > 0"))
def tag_suggestions(spark: S, sf: str) -> DataFrame:
    """Documents' long words as tags: those that are more frequent in a document than anywhere; none of score 0."""
    c = stored(_long_words(spark, sf), "tags")
    return ops.tag_portion(c, ops.tag_shares(c)).withColumn("rank", F.col("rank").cast("bigint"))


@query("ret16_question_tags", with_(WHOLE_QUESTIONS, WORDS, _TAGS, "hit AS (SELECT DISTINCT qid, id FROM questions JOIN words USING (term))", "qc AS (SELECT qid AS id, tag, sum(c) AS c FROM hit JOIN c USING (id) GROUP BY 1, 2)", "o AS (SELECT id, sum(c) AS cnt FROM qc GROUP BY 1)", f"r AS (SELECT id, tag, {_TAG_SCORE.format(s=1000)} AS score FROM qc JOIN s USING (tag) JOIN o USING (id))", select="SELECT id, tag, greatest(1, score) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rank FROM r) WHERE rank <= 3"))
def question_tags(spark: S, sf: str) -> DataFrame:
    """Tags of questions by the documents that have a word of theirs; three each, of score 1 at least."""
    index = _index(spark, sf).select("id", "term", "tf")
    c = index.filter("length(term) >= 8").select("id", F.col("term").alias("tag"), F.col("tf").alias("c"))
    return ops.question_tags(whole_questions(spark, sf), index.select("id", "term"), c).withColumn("rank", F.col("rank").cast("bigint"))


@query("ret17_document_prefetch", with_(WHOLE_QUESTIONS, WORDS, LENS, _BM25, "t AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS k FROM bm) WHERE k <= 3)", "ls AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)", select="SELECT qid, id, line FROM t JOIN ls USING (id)"))
def document_prefetch(spark: S, sf: str) -> DataFrame:
    """Chunks (lines) of each question's three best documents."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    top = _bm25(spark, sf, False, ask=whole_questions).withColumn("k", F.row_number().over(order)).filter("k <= 3").select("qid", "id")
    lines = docs(spark, sf).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "_"))
    return top.join(lines, "id").select("qid", "id", F.col("line").cast("bigint").alias("line"))


@query("ret15_facets_and_page", with_(QUESTIONS, WORDS, LENS, _BM25, select="SELECT source, count(*) AS n, min(bm.id) AS first_id FROM bm JOIN documents ON doc_id = bm.id GROUP BY 1"))
def facets_and_page(spark: S, sf: str) -> DataFrame:
    sources = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return _bm25(spark, sf, False).join(sources, "id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("ret20_conversation_memory", "WITH r AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), s AS (SELECT *, round(0.7 * l / 2000.0 + 0.3 * exp(-0.1 * back), 9) AS score FROM r WHERE back <= 40), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM s) SELECT conv_id, turn, CASE WHEN score >= 0.6 THEN 'full' WHEN score >= 0.4 THEN 'short' ELSE 'title' END AS form FROM t WHERE k <= 6")
def conversation_memory(spark: S, sf: str) -> DataFrame:
    """Of a conversation's last 40 turns the six that count most, in one of three forms."""
    from fabula.functions.scoring import decay, label

    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("l"), back.alias("back")).filter("back <= 40")
    scored = rows.withColumn("score", F.round(0.7 * F.col("l") / 2000.0 + 0.3 * decay(F.col("back")), 9))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))
    return scored.withColumn("k", k).filter("k <= 6").select("conv_id", "turn", label(F.col("score"), [(0.6, "full"), (0.4, "short")], "title").alias("form"))


def _question_texts(spark: S, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query("ret21_line_search")
def line_search(spark: S, sf: str) -> DataFrame:
    """The ten lines that answer each benchmark item best: chunks by vectors, their best lines by words."""
    rows = docs(spark, sf).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    out = ops.searched_lines(_question_texts(spark, sf), rows, 10)
    return out.select("qid", "id", F.col("line").cast("bigint").alias("line"), F.col("rank").cast("bigint").alias("rank"), *(F.round(c, 4).alias(c) for c in ("score", "cosine", "lexical")))


@query("ret14_citation_support")
def citation_support(spark: S, sf: str) -> DataFrame:
    """Which chunks of the three best documents of a question support each sentence of its item."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = _bm25(spark, sf, False).withColumn("k", F.row_number().over(order)).filter("k <= 3").select("qid", "id")
    cut = docs(spark, sf).join(top, F.col("doc_id") == F.col("id")).select("qid", "id", F.posexplode(tx.sliding_chunks(F.col("text"), 800, 80)).alias("k", "c"))
    chunks = cut.select("qid", F.struct("id", "k").alias("chunk"), ops.tokens(F.col("c.piece")).alias("terms"), ops.hash_vectors("c.piece").alias("vec"))
    said = _question_texts(spark, sf).select("qid", F.posexplode(tx.sentences(F.col("text"))).alias("piece", "s")).filter("length(s) >= 5")
    pieces = said.select("qid", "piece", ops.tokens(F.col("s")).alias("terms"), ops.hash_vectors("s").alias("vec"))
    out = ops.cited_chunks(pieces, chunks)
    return out.select("qid", F.col("piece").cast("bigint").alias("piece"), F.col("chunk.id").alias("id"), F.col("chunk.k").cast("bigint").alias("chunk"), F.round("score", 5).alias("score"), F.round("bar", 5).alias("bar"))
