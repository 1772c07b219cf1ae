"""Operators on small given inputs, and greedy ones against plain versions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.operators import agreement, graph, relational, retrieval, scoring, signals, structure
from fabula.streaming import runs

DIMS = ("plot_hook", "conflict_type", "payoff_type", "emotional_driver", "dialogue_density", "story_stage", "voiceover_type")
UNITS = "script_id bigint, unit_id bigint, idx bigint, episode_no bigint, " + ", ".join(f"{d} string" for d in DIMS)


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        (1, 1, 1, 1, "identity_reveal", "revenge", "face_slap", "anger", "dense", "trigger", None),
        (1, 2, 2, 1, "none", "none", "none", "none", "sparse", "setup", None),
        (1, 3, 3, 2, "reversal", "confrontation", "revenge", "justice", "moderate", "climax", None),
    ]
    return spark.createDataFrame(rows, UNITS)


def test_intensity(units):
    x = signals.intensity(*(F.col(c) for c in DIMS[:4]))
    assert [r[0] for r in units.orderBy("idx").select(x).collect()] == [8, 0, 8]


def test_signals_of_the_given_context(spark, units):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    facts = signals.facts(
        frame([(1, 2)], "script_id bigint, total_episodes bigint"),
        units,
        frame([(1, "drama_tags", "战神", None)], "script_id bigint, dim string, value string, confidence double"),
        frame([], "script_id bigint, episode_no bigint, dim string, value string"),
        frame([(1, "c1", "protagonist", "high"), (1, "c2", "antagonist", "medium")], "script_id bigint, char_id string, role string, agency_level string"),
        frame([(1, "a", "b", "negative", "rising")], "script_id bigint, src string, dst string, polarity string, dynamic_arc string"),
        frame([(1, "甲：你好\n乙：走吧"), (1, "无")], "script_id bigint, text string"),
        ("战神",),
    )
    got = {r["key"]: r["score"] for r in signals.signals(facts).collect()}
    assert len(got) == len(signals.REGISTRY) == 34
    want = {
        "payoff_density": 8.0, "opening_speed": 3.0, "plot_unit_density": 6.0, "plot_unit_count_per_ep": 4.0, "narrative_intensity_distribution": 10.0, "protagonist_identifiable": 10.0,
        "protagonist_agency": 10.0, "antagonist_quality": 9.0, "relationship_conflict_strength": 10.0, "relationship_arc_change": 10.0, "drama_tags_confidence": 6.0, "genre_market_fit": 10.0,
        "early_genre_signal": 9.0, "dry_streak_max": 10.0, "downtime_penalty": 10.0, "middle_sag": 3.0, "structural_completeness": 5.0, "topic_focus": 5.0, "brevity_ratio": 3.0,
        "episode_end_hook_rate": 3.0, "paid_break_potential": 3.0, "voiceover_fit": 6.0,
    }
    assert {k: got[k] for k in want} == want


def test_a_script_without_anything(spark, units):
    none = units.limit(0)
    empty = lambda schema: spark.createDataFrame([], schema)
    facts = signals.facts(
        spark.createDataFrame([(9, None)], "script_id bigint, total_episodes bigint"), none, empty("script_id bigint, dim string, value string, confidence double"),
        empty("script_id bigint, episode_no bigint, dim string, value string"), empty("script_id bigint, char_id string, role string, agency_level string"),
        empty("script_id bigint, src string, dst string, polarity string, dynamic_arc string"), empty("script_id bigint, text string"),
    )
    rows = signals.signals(facts).collect()
    assert len(rows) == 34 and all(r["score"] is not None for r in rows)


def _scores(spark, rows):
    signal_rows = spark.createDataFrame(rows, "script_id bigint, key string, score double, confidence double")
    rubric = spark.createDataFrame([("d", "a", 0.4), ("d", "b", 0.6)], "dimension string, key string, weight double")
    return scoring.dimension_scores(signal_rows, rubric), scoring.top_signals(signal_rows, rubric)


def test_coverage_gate(spark):
    r = _scores(spark, [(1, "a", 8.0, 0.9), (1, "b", None, 0.0)])[0].first()
    assert r["score"] is None and r["confidence"] == "insufficient" and r["coverage"] < 0.5


def test_weighted_mean(spark):
    scores, top = _scores(spark, [(1, "a", 8.0, 0.9), (1, "b", 6.0, 0.9)])
    r = scores.first()
    assert r["score"] == pytest.approx(6.8) and r["coverage"] == 1.0
    assert [x["key"] for x in top.orderBy("rank").collect()] == ["b", "a"]


def _labels(spark, matrix):
    rows = [(i, r, v) for r, run in enumerate(matrix) for i, v in enumerate(run)]
    return spark.createDataFrame(rows, "item int, run int, value string")


def test_agreement_of_equal_and_different_runs(spark):
    equal, apart = _labels(spark, [["a", "b", "c"]] * 5), _labels(spark, [[f"{r}{i}" for i in range(3)] for r in range(5)])
    for labels, stable, rate in ((equal, 3, 1.0), (apart, 0, 0.0)):
        r = agreement.stable_items(labels.withColumn("g", F.lit(1)), ["g"]).first()
        assert (r["items"], r["stable"]) == (3, stable)
        assert (r["wilson"] > 0.43) == (stable == 3) and r["wilson"] <= 1.0
        assert agreement.pairwise_agreement(labels).agg(F.avg("agreement")).first()[0] == rate
        assert agreement.cohen_kappa(labels).agg(F.avg("kappa")).first()[0] == rate


def test_alpha(spark):
    labels = _labels(spark, [["a", "a", "b", "b"], ["a", "b", "b", "b"]]).withColumn("g", F.lit(1))
    # coincidences: aa 2, bb 4, ab 2 of 8; expected disagreement 2 * 3 * 5 / (8 * 7)
    want = 1 - (2 / 8) / (2 * 3 * 5 / 56)
    assert agreement.krippendorff_alpha(labels, ["g"]).first()["alpha"] == pytest.approx(want)
    same = _labels(spark, [["a", "a"], ["a", "a"]]).withColumn("g", F.lit(1))
    assert agreement.krippendorff_alpha(same, ["g"]).first()["alpha"] == 1.0


@pytest.mark.parametrize(("hyp", "want"), [([3, 6], 0.1), ([3, 6, 8, 9], 0.1), ([2, 5, 8], 0.6)])
def test_window_diff(spark, hyp, want):
    df = spark.createDataFrame([(1, [3, 6, 9], hyp, 12)], "id int, ref array<int>, hyp array<int>, n int")
    assert agreement.window_diff(df).first()["window_diff"] == pytest.approx(want)


def test_boundary_similarity():
    a, b = [3, 6, 9], [2, 6, 10]
    assert agreement.boundary_similarity(a, b) == agreement.boundary_similarity(b, a) == pytest.approx(2 / 3)
    assert agreement.boundary_similarity(a, a) == 1.0 and agreement.boundary_similarity([], []) == 1.0 and agreement.boundary_similarity(a, []) == 0.0


def test_majority_prefers_the_first_run(spark):
    got = agreement.majority(_labels(spark, [["a", ""], ["b", "c"], ["b", None], ["a", None]])).collect()
    assert {r["item"]: r["value"] for r in got} == {0: "a", 1: "c"}


def test_gates(spark):
    cases = [(o, t) for o in ("online", "fix", "offline", "other") for t in ("video_stable", "video_aggregate", "video_experimental", "video_blocked")]
    df = spark.createDataFrame(cases, "o string, t string").select("o", "t", agreement.shared_gate(F.col("o"), F.col("t")).alias("g"))
    got = {(r["o"], r["t"]): r["g"] for r in df.collect()}
    for (o, t), g in got.items():
        blocked, trial = o == "offline" or t == "video_blocked", o == "fix" or t == "video_experimental"
        want = "blocked" if blocked else "experimental" if trial else "stable_shared" if (o, t) == ("online", "video_stable") else "aggregate_only" if o == "online" else "blocked"
        assert g == want


def test_cooccurrence(spark):
    members = {"u1": "abc", "u2": "ab", "u3": "ab", "u4": "ac", "u5": "bc", "u6": "ad"}
    cast = spark.createDataFrame([(u, c) for u, cs in members.items() for c in cs], "scene_id string, name string")
    got = [tuple(r) for r in graph.cooccurrence_graph(cast, 10, 10, 0.0).orderBy(F.desc("weight"), "a", "b").collect()]
    assert got[0] == ("a", "b", 0.5) and ("a", "d", 0.2) in got  # a in 5 scenes, b in 4, 3 shared


def test_name_similarity():
    assert graph.name_similarity("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert graph.name_similarity("ab", "ac") == pytest.approx(0.70)
    assert graph.name_similarity("林茵", "林茵茵") >= 0.92 and graph.name_similarity("", "x") == 0.0


def test_resolve_names(spark):
    df = spark.createDataFrame([(1, "marhta", 2), (1, "martha", 5), (1, "bob", 3)], "script_id bigint, name string, n bigint")
    assert {r["name"]: r["entity"] for r in graph.resolve_names(df).collect()} == {"martha": "martha", "marhta": "martha", "bob": "bob"}


@pytest.mark.parametrize(
    ("bounds", "spans", "want"),
    [
        ((1, 20), [(1, 10), (5, 15), (16, 20)], [(1, 10), (11, 15), (16, 20)]),
        ((1, 10), [], []),
        ((1, 10), [(5, 3)], []),
    ],
)
def test_repair_given_cases(bounds, spans, want):
    assert structure.repair_intervals(spans, *bounds) == want


@settings(max_examples=200)
@given(st.integers(-3, 5), st.integers(0, 40), st.lists(st.tuples(st.one_of(st.integers(-9, 50), st.just("x")), st.one_of(st.integers(-9, 50), st.none())), max_size=8))
def test_repaired_intervals_cover_their_bounds(first, size, spans):
    got = structure.repair_intervals(spans, first, first + size)
    if got:
        assert got[0][0] == first and got[-1][1] == first + size
        assert all(a <= b for a, b in got) and all(x[1] + 1 == y[0] for x, y in zip(got, got[1:], strict=False))


def test_repair_with_other_values():
    got = structure.repair_intervals([(10, 15), ("not_int", 20), (50, 80), (16, 30)], 10, 30)
    assert got == [(10, 15), (16, 30)]


def test_segmentation_loses_nothing(spark):
    lines = ["前言", "第一集", "1-1 客厅 日 内", "甲：你好", "1-2 街道 夜 外", "乙：走吧", "第二集", "2-1 车内", "丙：停"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "只有一行"), (3, 0, "客厅 日内"), (3, 1, "走"), (3, 2, "车内，夜")], "script_id bigint, pos bigint, line string")
    seg = structure.segment_scripts(df)
    assert seg.count() == df.count()
    got = {(r["script_id"], r["pos"]): (r["episode"], r["scene_no"]) for r in seg.collect()}
    assert got[(1, 3)] == (1, "1-1") and got[(1, 5)] == (1, "1-2") and got[(1, 8)] == (2, "2-1")
    assert got[(2, 0)] == (None, "1-1")
    scenes = {(r["script_id"], r["scene"]): r["text"] for r in structure.scenes_of(seg).collect()}
    assert scenes[(1, 3)] == "1-2 街道 夜 外\n乙：走吧"
    assert sum(k[0] == 3 for k in scenes) == 2


@settings(max_examples=100)
@given(st.text("ab. \n", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_recursive_chunks_cover_the_text(text, target, overlap):
    got = structure.recursive_chunks(text, target, overlap, 15, 10)
    at = 0
    for start, piece in got:
        assert start <= at and piece and text[start : start + len(piece)] == piece
        assert start + len(piece) > at
        at = start + len(piece)
    assert at == len(text)


def test_budget_merge_may_overshoot_by_one():
    assert structure.budget_merge(["a b", "c d", "e", "f"], 3) == ["a b\nc d", "e\nf"]


def test_semantic_chunks_split_on_change():
    s = ["red red red red", "red red red", "blue blue blue", "blue"]
    assert structure.semantic_chunks(s, 10, 100, 0.5) == ["red red red red red red red", "blue blue blue blue"]
    assert structure.cosine([1.0], [1.0, 2.0]) == 1.0


def _prefix(costs, budget):
    used, taken = 0, []
    for i, c in enumerate(costs):
        if used >= budget:
            break
        if used + c > budget and taken:
            continue
        used += c
        taken.append(i)
    return taken


def test_budget_prefix(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(1, 60) for _ in range(rng.randrange(0, 9))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "c array<int>").select("c", structure.budget_prefix(F.col("c"), 80).alias("t"))
    for r in df.collect():
        assert r["t"] == _prefix(r["c"], 80)


def test_byte_quota_is_a_fold(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 4, 101), (2, 5, 100)], "u int, id bigint, size bigint")
    got = {r["id"]: r["accepted"] for r in runs.byte_quota(df, ["u"], "size", 100, ["id"], "id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_mmr_against_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(q, i, round(rng.random(), 3), [f"t{rng.randrange(12)}" for _ in range(5)]) for q in (1, 2) for i in range(20)]
    got = retrieval.mmr(spark.createDataFrame(rows, "qid bigint, id bigint, score double, toks array<string>"), 6).orderBy("qid", "place").collect()
    for q in (1, 2):
        left, picked = {i: (s, set(t)) for x, i, s, t in rows if x == q}, []
        while len(picked) < 6:
            gain = lambda i: 0.65 * left[i][0] - 0.35 * max((len(left[i][1] & p) / len(left[i][1] | p) for _, p in picked), default=0)  # noqa: E731, B023
            best = max(left, key=lambda i: (gain(i), left[i][0], -i))
            picked.append((best, left.pop(best)[1]))
        assert [r["id"] for r in got if r["qid"] == q] == [i for i, _ in picked]


def test_interval_join_finds_every_point(spark):
    rng = random.Random(1)
    spans = [(k % 3, a, a + rng.randrange(0, 70), k) for k in range(40) for a in [rng.randrange(200)]]
    points = [(k % 3, rng.randrange(260), k) for k in range(80)]
    got = relational.interval_join(spark.createDataFrame(points, "k int, at int, p int"), spark.createDataFrame(spans, "k int, a int, b int, s int"), "k", "at", "a", "b", 16)
    want = {(p, s) for k, at, p in points for j, a, b, s in spans if j == k and a <= at <= b}
    rows = [(r["p"], r["s"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_schema_modes(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "dim string, value string")
    new = spark.createDataFrame([("a", "x2"), ("b", "y"), ("b", "y2")], "dim string, value string")
    diff = relational.schema_diff(old, new)
    assert {(r["dim"], r["value"]): r["kind"] for r in diff.collect()} == {("a", "x"): "relabel", ("a", "x2"): "relabel", ("b", "y2"): "add_value", ("c", "z"): "remove_value"}
    assert relational.compatible(diff, "BACKWARD").filter("kind = 'add_value'").count() == 0
    assert relational.compatible(diff, "FORWARD").count() == 3 and relational.compatible(diff, "FULL").count() == 4 and relational.compatible(diff, "NONE").count() == 0


def test_cascade_uses_the_first_level_with_hits(spark):
    schema = "qid bigint, id bigint, score double"
    one, two = spark.createDataFrame([(1, 5, 1.0)], schema), spark.createDataFrame([(1, 6, 9.0), (2, 7, 1.0)], schema)
    assert {(r["qid"], r["id"], r["level"]) for r in retrieval.cascade([one, two]).collect()} == {(1, 5, 0), (2, 7, 1)}


def test_first_of(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert {(r["k"], r["x"], r["source"]) for r in relational.first_of([(a, "v"), (b, "v")], "k", "x").collect()} == {(1, "a", 0), (2, "b", 1)}


def test_episodes_are_cut_each_by_its_own_marks(spark):
    """One episode with scene numbers, one with headings alone, one with neither."""
    told = ["第1集", "1-1 客厅 日内", "走廊 夜内", "a", "1-2 客厅 日内", "b", "第2集", "客厅 日内", "c", "走廊 夜内", "d", "第3集", "e", "f"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(told)], "script_id string, pos bigint, line string")
    got = {r["pos"]: (r["episode"], r["scene"]) for r in structure.segment_scripts(df).collect()}
    assert [got[i] for i in range(len(told))] == [(1, 1), (1, 2), (1, 2), (1, 2), (1, 3), (1, 3), (2, 4), (2, 5), (2, 5), (2, 6), (2, 6), (3, 7), (3, 7), (3, 7)]


def test_names_that_are_like_enough_are_asked_about(spark):
    df = spark.createDataFrame([(1, "martha", 5), (1, "marhta", 2), (1, "marcus", 1), (1, "bob", 3)], "script_id bigint, name string, n bigint")
    asked = {r["name"]: r["ask"] for r in graph.resolve_names(df).collect()}
    assert set(asked.values()) == {None}  # neither is there often enough
    df = df.withColumn("n", F.when(F.col("name") == "martha", 7).otherwise(F.col("n")))
    asked = {r["name"]: r["ask"] for r in graph.resolve_names(df).collect()}
    assert asked["marhta"] is None and asked["bob"] is None and asked["marcus"] == "martha"


def test_layout_match_against_a_plain_version(spark):
    from difflib import SequenceMatcher

    blocks = {1: ["the first block of words", "and then a second one with more", "last lines here"], 2: ["one two three four", "five six seven eight nine"], 3: ["nothing alike"]}
    snippets = {1: "a second one", 2: "fiv six sevn eigth nine", 3: "0123456789 abc"}

    def overlap(a, b):
        x, y = ({t for t in re.split("[^a-z0-9]+", c) if len(t) > 1} for c in (a, b))
        return len(x & y) / len(x | y) if x and y else 0.0

    want = {}
    for d, s in snippets.items():
        held = [i for i, b in enumerate(blocks[d]) if s in b or b in s]
        scores = []
        for i, b in enumerate(blocks[d]):
            both = " ".join(blocks[d][i : i + 2])
            ratio = lambda x: SequenceMatcher(None, s, x).ratio()  # noqa: E731, B023
            scores.append((max(0.7 * ratio(b) + 0.3 * overlap(s, b), 0.98 * (0.65 * ratio(both) + 0.35 * overlap(s, both))), -i))
        if held:
            want[d] = (held[0], 1.0)
        elif max(scores)[0] >= 0.42:
            want[d] = (-max(scores)[1], round(max(scores)[0], 9))
    asked = spark.createDataFrame([*snippets.items()], "doc_id bigint, snippet string")
    rows = spark.createDataFrame([(d, i, b) for d, bs in blocks.items() for i, b in enumerate(bs)], "doc_id bigint, pos bigint, text string")
    got = {r["doc_id"]: (r["pos"], round(r["score"], 9)) for r in structure.layout_match(asked, rows).collect()}
    assert got == want and set(got) == {1, 2}


def test_blocks_that_cannot_be_the_likeliest_are_not_compared(monkeypatch):
    """A ratio counts characters of a common subsequence; the same snippet in two documents is two searches."""
    rng, compared = random.Random(6), []
    ratio = structure.sequence_ratio
    monkeypatch.setattr(structure, "sequence_ratio", lambda a, b: compared.append(b) or ratio(a, b))
    monkeypatch.setattr(structure, "TOGETHER", 7)
    words = [["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 9))) for _ in range(30)] for _ in range(40)]
    blocks = [" ".join(w) for w in words]
    head = " ".join(w if rng.random() < 0.8 else "zq" for w in words[11])[:160]
    rows = [(doc, head, f"{blocks[i]} {blocks[i + 1]}" if i + 1 < end else blocks[i], len(blocks[i])) for doc, first, end in ((1, 0, 30), (2, 20, 40), (3, 30, 34)) for i in range(first, end)]
    toks = lambda c: {*re.findall("[a-z0-9]{2,}", c)}
    overlap = lambda a, b: len(toks(a) & toks(b)) / len(toks(a) | toks(b))
    scores = [max(0.7 * ratio(h, t[:n][:240]) + 0.3 * overlap(h, t[:n]), 0.98 * (0.65 * ratio(h, t[:360]) + 0.35 * overlap(h, t))) for _, h, t, n in rows]
    best = lambda found: {d: max((round(s, 9), -i, s) for i, s in enumerate(found) if rows[i][0] == d) for d in (1, 2, 3)}
    for least in (0.0, 0.1, 0.42):
        compared.clear()
        got = structure.likeliest(*zip(*rows, strict=True), least)
        assert {d: x for d, x in best(got).items() if x[2] >= least} == {d: x for d, x in best(scores).items() if x[2] >= least}
    assert len(compared) < 10 and best(scores)[1][1] == -11
    assert structure.likeliest([1, 2], [None, "a"], [None, ""], [None, 0], 0.0) == [0.0, 0.0]


def test_common_lengths_are_those_of_the_longest_common_subsequences():
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc\u00e9\u5b57\U0001f600") for _ in range(rng.randrange(most))) for most in (150, 200)) for _ in range(40)]
    short, long = zip(*([*p] for p in pairs), strict=True)
    want = []
    for a, b in zip(short, long, strict=True):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        want.append(row[-1])
    assert structure.common_lengths(short, long).tolist() == want
    assert structure.common_lengths(["", "a"], ["b", ""]).tolist() == [0, 0] and structure.common_lengths([], []).tolist() == []


def test_routed_chunks_lose_nothing(spark):
    long = "One sentence here. " * 120
    data = [(1, 0, "table", long), (2, 0, "text", long), (3, 0, "code", long * 3), (4, 0, "code", "short"), (5, 0, "text", "  ")]
    df = spark.createDataFrame(data, "doc_id bigint, pos bigint, kind string, text string")
    got = structure.routed_chunks(df, 1200, 4000, 1000, 100, lambda t: [(0, t[:1000]), (1, t[1000:])]).collect()
    of = lambda d: [r["piece"] for r in sorted(got, key=lambda r: (r["doc_id"], r["chunk"])) if r["doc_id"] == d]
    assert of(1) == [long.strip()] and "".join(of(2)) == long and of(4) == ["short"] and of(5) == []
    assert of(3)[0] + "".join(x[100:] for x in of(3)[1:]) == long * 3
    assert {r["doc_id"]: r["route"] for r in got} == {1: "whole", 2: "semantic", 3: "sliding", 4: "whole"}


def test_adaptive_pages(spark):
    rows = [(q, i, i + 1, float((i * 37) % 101)) for q in (1, 5) for i in range(200)]
    df = spark.createDataFrame(rows, "qid bigint, id bigint, stored int, score double")
    got = {}
    for r in retrieval.adaptive_page(df, F.col("qid"), 10).collect():
        got.setdefault(r["qid"], []).append((r["place"], r["id"]))
    again = sorted((-s, i) for q, i, k, s in rows if q == 1 and k <= 128)[:10]
    assert [i for _, i in sorted(got[1])] == [i for _, i in again]
    assert [i for _, i in sorted(got[5])] == [*range(40, 50)]


def test_bullets_that_only_look_so(spark):
    df = spark.createDataFrame([("0. x",), ("12 3",), ("1... x",), ("2. x",), ("PART NINE",), ("第三节 x",)], "line string")
    families = [[r[0] for r in df.select(structure.is_bullet(F.col("line"), f)).collect()] for f in structure.BULLETS]
    assert families[1] == [False, False, False, True, False, False] and families[3][4] and families[0][5]
