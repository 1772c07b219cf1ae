"""Cases that only large tables brought up."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions.scoring import cosine
from fabula.operators import agreement, diff, relational, retrieval, segmentation, signals, structure


def test_a_mean_that_is_a_tie_is_stable_in_any_order(spark):
    a, b, c = 1 / 3, 1 / 2, 2 / 3
    means = [((a + b) + c) / 3, ((b + c) + a) / 3, ((c + a) + b) / 3, 0.5 - 2**-54, 0.4999]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(means)], "item int, similarity double")
    assert agreement.similar_items(rows).first().asDict() == {"items": 5, "stable": 4}


@pytest.mark.parametrize(("lengths", "step"), [((1, 5, 13, 14, 17), 0.6), ((1, 7, 9, 15, 18), 0.6), ((1, 3, 7, 19, 20), 0.8), ((1, 1, 1, 16, 31), 1.2)])
def test_the_spread_of_lengths_does_not_depend_on_the_order_of_rows(spark, lengths, step):
    rows = [(i, "x" * n) for i, order in enumerate(sorted(set(itertools.permutations(lengths)))) for n in order]
    facts = signals.scene_facts(spark.createDataFrame(rows, "script_id int, text string").coalesce(1))
    assert {r[0] for r in facts.select(F.col("len_std") / F.col("len_mean")).collect()} == {step}


def test_neighbours_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Copies, vectors of another length, null ones and such without a direction; both sides in several parts."""
    monkeypatch.setattr(retrieval, "ITEM_PART", (100, 100))
    monkeypatch.setattr(retrieval, "QUERY_PART", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[i % 3][1]) for i in range(300, 400)] + [(400, [0.0] * 8), (401, None), (402, [1.0, None] + [0.0] * 6), (403, rows[0][1][:5]), (404, [])]
    items = spark.createDataFrame(rows, "id bigint, vec array<double>")
    queries = items.filter("id % 40 = 0 OR id IN (1, 401, 403)").select(F.col("id").alias("qid"), "vec")
    found = retrieval.vector_top_k(queries, items, 7)
    scored = items.crossJoin(queries.select("qid", F.col("vec").alias("q"))).select("qid", "id", cosine(F.col("vec"), F.col("q")).alias("score"))
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter("rank <= 7")
    rows_of = lambda df: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows_of(found) == rows_of(want)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbours_of_rows_named_by_structs(spark):
    items = spark.range(50).select(F.struct((F.col("id") % 5).alias("a"), F.expr("id div 5").alias("b")).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    found = retrieval.vector_top_k(spark.sql("SELECT 1 AS qid, array(2d, 4d) AS vec"), items, 3)
    assert [tuple(r["id"]) for r in found.orderBy("rank").collect()] == [(0, 0), (0, 1), (0, 2)]


def test_postings_are_counted_inside_their_documents(spark):
    docs = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, "x"), (5, "é É e")], "doc bigint, text string")
    index = retrieval.postings(docs, "doc", "text")
    got = {(r["id"], r["term"], r["tf"], r["len"]) for r in index.collect()}
    assert got == {(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (2, None, 1, 0), (3, None, 1, None), (4, "x", 1, 1), (5, "é", 2, 3), (5, "e", 1, 3)}
    assert "Aggregate" not in index._jdf.queryExecution().executedPlan().toString()


def test_statistics_of_a_corpus_take_one_row_of_each_document(spark):
    """No pass over all postings deals them again, and postings of terms are found once."""
    docs = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, "x b")], "doc bigint, text string")
    index = retrieval.postings(docs, "doc", "text")
    heads = index.filter("head").collect()
    assert sorted((r["id"], r["len"]) for r in heads if r["len"] is not None) == [(1, 6), (2, 0), (4, 2)] and len(heads) == 4
    found = retrieval.term_scores(spark.createDataFrame([(1, "b"), (2, "x")], "qid bigint, term string"), index)
    weight = lambda df, tf, n: np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (8 / 3)))
    got = {(r["qid"], r["id"]): r["score"] for r in found.collect()}
    assert got == {k: pytest.approx(v) for k, v in {(1, 1): weight(2, 3, 6), (1, 4): weight(2, 1, 2), (2, 4): weight(1, 1, 2)}.items()}
    assert "first" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_dealt_by_document_to_parts_of_bounded_size(spark, monkeypatch):
    """A term of all documents doesn't come together in one task."""
    monkeypatch.setattr(retrieval, "HITS_PART", 50)
    docs = spark.range(600).select(F.col("id").alias("doc"), F.concat(F.lit("common word"), F.col("id")).alias("text"))
    queries = spark.createDataFrame([(1, "common"), (2, "common"), (2, "word7"), (3, "omm")], "qid bigint, term string")
    index = retrieval.postings(docs, "doc", "text").cache()
    for found in (retrieval.term_scores(queries, index), retrieval.keyword_hits(queries, index), retrieval.token_similarity(queries.withColumn("w", F.lit(1.0)), index.select("id", "term"))):
        sizes = found.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.max("count")).first()
        assert sizes[0] >= 20 and sizes[1] <= 150
    assert {(r["qid"], r["n"]) for r in retrieval.keyword_hits(queries, index).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 600), (2, 600), (3, 600)}
    both = retrieval.bm25(queries, index, True).filter("qid = 2").collect()
    assert [r["id"] for r in both] == [7]


def test_tags_of_queries_are_those_of_all_pairs(spark):
    """More queries than bits of a number, and tags that go over several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        hits = spark.range(400).select(F.explode(F.sequence(F.lit(0), F.lit(69))).alias("qid"), "id").filter("(id * 7 + qid * 13) % 5 = 0")
        tags = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr("id", "concat('tag', (id * k) % 11) AS tag", "k + 1 AS c")
        tags = tags.groupBy("id", "tag").agg(F.sum("c").alias("c"))
        found = retrieval.query_tags(hits.unionByName(hits), tags)
        rows = found.collect()
        want = hits.join(tags, "id").groupBy("qid", "tag").agg(F.sum("c").alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"a": ["x" * 10, None, "y" * 30, "zz", ""], "b": ["", "é" * 5, "", "", None]})
    parts = [*relational.slices(batch, ["a", "b"], 20)]
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in relational.slices(batch.slice(0, 0), ["a"], 20)] == []


def test_line_diffs_and_chunks_go_in_slices(spark):
    """Nothing collects a whole batch of results in Python."""
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "same", "same")], "k bigint, old string, new string")
    out = diff.line_diffs(pairs, "old", "new")
    assert [(r["k"], r["added"], r["removed"]) for r in out.orderBy("k").collect()] == [(1, 1, 1), (2, 1, 0), (3, 0, 0)]
    blocks = spark.createDataFrame([(1, 0, "text", "Some words here. " * 200), (2, 0, "table", " t "), (3, 0, "text", "short")], "doc_id int, pos int, kind string, text string")
    routed = structure.routed_chunks(blocks, 1200, 4000, 1000, 100, lambda t: [(0, t[:5]), (1, t[5:])])
    assert {(r["doc_id"], r["route"], r["chunk"]) for r in routed.collect()} == {(1, "semantic", 0), (1, "semantic", 1), (2, "whole", 0), (3, "whole", 0)}
    for df in (out, routed):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_a_worker_makes_the_trie_of_a_dictionary_once():
    """Tasks of one worker share it; another dictionary takes its place."""
    table = type("Table", (), {"value": {"ab": 3.0, "abc": 2.0, "c": 4.0, "cab": 1.0}})()
    first = segmentation._of_worker("one", table)
    assert segmentation._of_worker("one", table) is first
    trie = first[0]
    for run in ("", "c", "abcab", "abxcab", "ccabcabab"):
        cuts = [[]]
        for at in range(len(run)):  # all cuts, by brute force
            cuts += [[*c, run[sum(map(len, c)) : at + 1]] for c in cuts if sum(map(len, c)) <= at]
        cuts = [c for c in cuts if "".join(c) == run and all(t in trie.weight or len(t) == 1 for t in c)]
        score = lambda c: sum(trie.weight.get(t, trie.unknown) for t in c)
        ends = trie.best(run)
        assert score([run[a:b] for a, b in zip([0, *ends], ends, strict=False)]) == pytest.approx(max(map(score, cuts)))
    assert segmentation._of_worker("two", table) is not first and [*segmentation._TRIES] == ["two"]


def test_hits_of_hybrid_and_cascade_are_dealt_in_bounded_parts(spark, monkeypatch):
    """A task's share of the hits doesn't grow with the table, and hits carry no vector through a shuffle."""
    monkeypatch.setattr(retrieval, "HITS_PART", 5)
    rows = [(q, i, float(i + q)) for q in (1, 2) for i in range(40)]
    hits = spark.createDataFrame(rows, "qid bigint, id bigint, score double")
    alike = spark.createDataFrame([(q, i, i / 40) for q, i, _ in rows if i % 2], "qid bigint, id bigint, similarity double")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, q array<float>")
    vectors = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(0, 40, 3)], "id bigint, vec array<float>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retrieval.hybrid(hits, alike, asked, vectors)
        got = {(r["qid"], r["id"]): round(r["hybrid"], 6) for r in out.collect()}
        assert got == {(q, i): round(0.3 * (i / 40 if i % 2 else 0) + (0.42 if q == 1 and i % 3 == 0 else 0), 6) for q, i, _ in rows}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "16), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" in plan
        found = retrieval.cascade([hits.filter("qid = 1 AND score > 30"), hits.filter("score > 38")])
        assert {(r["qid"], r["level"]) for r in found.collect()} == {(1, 0), (2, 1)}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_rows_of_term_weights_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HITS_PART", 5)
    terms = spark.createDataFrame([(i % 40, "ab"[i % 3 % 2]) for i in range(90)], "id bigint, term string")
    out = retrieval.term_weights(terms, spark.createDataFrame([(40,)], "n bigint"))
    rows = {r["term"]: (r["df"], r["w"]) for r in out.collect()}
    assert {t: df for t, (df, _) in rows.items()} == {t: len({i % 40 for i in range(90) if "ab"[i % 3 % 2] == t}) for t in "ab"}
    assert sum(w for _, w in rows.values()) == pytest.approx(1) and "18), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
