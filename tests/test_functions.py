"""Functions against values worked out by hand or by a plain version."""

import math

import pytest
from pyspark.sql import functions as F

from fabula.functions import scoring as fn
from fabula.functions import text as tx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("k", "n", "bound"),
    [(50, 50, 0.929), (48, 50, 0.865), (44, 50, 0.762), (43, 50, 0.738), (40, 50, 0.67), (31, 50, 0.482), (33, 50, 0.522)],
)
def test_wilson_has_the_published_values(spark, k, n, bound):
    assert one(spark, F.round(fn.wilson(F.lit(k), F.lit(n)), 3))[0] == bound


def test_wilson_without_items(spark):
    assert one(spark, fn.wilson(F.lit(0), F.lit(0)))[0] == 0.0


@pytest.mark.parametrize(("score", "tier"), [(8.2, "excellent"), (6.4, "good"), (4.3, "weak"), (2.2, "poor"), (None, "insufficient")])
def test_tiers(spark, score, tier):
    assert one(spark, fn.tier(F.lit(score).cast("double"), F.lit(4.0), F.lit(6.0), F.lit(8.0)))[0] == tier


def test_clamp_keeps_null(spark):
    assert tuple(one(spark, *(fn.clamp(F.lit(x).cast("double"), 0, 10) for x in (None, -1, 5, 11)))) == (None, 0.0, 5.0, 10.0)


def test_ladder(spark):
    up = lambda x: fn.ladder(F.lit(x), [(1.5, 10), (0.8, 8), (0.3, 6)], 3)
    assert tuple(one(spark, *map(up, (2.0, 1.5, 0.8, 0.3, 0.1)))) == (10, 10, 8, 6, 3)
    assert one(spark, fn.ladder(F.lit(2), [(2, 10), (4, 8)], 3, down=True))[0] == 10


def test_labels(spark):
    assert tuple(one(spark, *(fn.confidence_label(F.lit(x)) for x in (0.8, 0.5, 0.1)))) == ("high", "medium", "low")
    assert one(spark, fn.least_label(F.array(F.lit("high"), F.lit("medium"))))[0] == "medium"


def test_cosine_conventions(spark):
    a, b, z = (F.array(*map(F.lit, x)) for x in ((1.0, 0.0), (1.0, 1.0, 5.0), (0.0, 0.0)))
    got = one(spark, fn.cosine(a, b), fn.cosine(a, b, 1.0, ragged=False), fn.cosine(a, z), fn.cosine(a, z, 1.0))
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and tuple(got)[1:] == (1.0, 0.0, 1.0)


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    ab, x = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"))
    assert tuple(one(spark, fn.jaccard(empty, empty), fn.jaccard(ab, ab), fn.jaccard(ab, x))) == (1.0, 1.0, 0.0)


def test_pick_is_the_digest_modulo(spark):
    import hashlib

    for key in ("a", "unit-7"):
        assert one(spark, fn.pick(F.lit(key), 7))[0] == int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 7


@pytest.mark.parametrize(
    ("line", "number"),
    [("第一集", 1), ("第十集", 10), (" 第二十三集：", 23), ("第100集", 100), ("第一百零五回", 105), ("第两集A", 2), ("01、", 1), ("12.", 12), ("第三天", None), ("hello", None), ("第一集 开始", None)],
)
def test_episode_numbers(spark, line, number):
    assert one(spark, tx.episode_number(F.lit(line)))[0] == number


@pytest.mark.parametrize(
    ("line", "marker"),
    [("1-1 客厅 日 内", (1, 1, "", "客厅 日 内")), ("1-2A、街道", (1, 2, "A", "街道")), ("11-20：看到", None), ("201-1 x", None), ("1-51 x", None), ("1-1 " + "长" * 31, None), ("0-1", None), ("对白", None)],
)
def test_scene_markers(spark, line, marker):
    got = one(spark, tx.scene_marker(F.lit(line)))[0]
    assert (tuple(got) if got else None) == marker


def test_bare_headings(spark):
    lines = {"二层客厅 日内": True, "车内，夜": True, "甲：日内": False, "▲日内": False, "x" * 31 + "日内": False, "第一集": False, "走吧": False}
    assert {k: one(spark, tx.bare_heading(F.lit(k)))[0] for k in lines} == lines


def test_line_kinds(spark):
    lines = {
        "": "stage_direction", "内景 客厅": "scene_header", "旁白：从前": "os", "甲（OS）：想": "os", "画外音：喂": "vo", "甲：你好": "dialogue", "[Bob]: hi": "dialogue",
        "（转身）": "action", "镜头拉远": "action", "他走了": "stage_direction",
    }
    assert {k: one(spark, tx.line_kind(F.lit(k)))[0] for k in lines} == lines
    assert tuple(one(spark, tx.speaker(F.lit("甲：你好")), tx.body(F.lit("甲：你好")), tx.body(F.lit("旁白：从前")))) == ("甲", "你好", "从前")


def test_names(spark):
    names = {"林茵": True, "保镖若干。": False, "他转头": False, "": False, "九个字的很长的名字啊": False}
    assert {k: one(spark, tx.real_name(F.lit(k)))[0] for k in names} == names
    assert one(spark, tx.normal_name(F.lit("林茵（二十岁）：")))[0] == "林茵"
    assert one(spark, tx.cast_list(F.lit("甲、乙,丙；丁 一个太长的名字不要了")))[0] == ["甲", "乙", "丙", "丁"]


def test_low_information(spark):
    good = "The quick brown fox jumps over the lazy dog, twice."
    cases = {good: None, "too short": "short", "https://a.example/" + "x" * 40: "url", "a https://a.example/" + "x" * 80: "url_ratio", "a" * 40: "few_words", "ab ab ab ab ab ab ab ab ab ab ab": "few_characters"}
    assert {k: one(spark, tx.low_information(F.lit(k)))[0] for k in cases} == cases


def test_ranges_and_quotes(spark):
    got = one(spark, tx.line_range(F.lit("L9-L3"), F.lit(7)), tx.line_range(F.lit("L1-L90"), F.lit(200)), tx.line_range(F.lit("none"), F.lit(5)))
    assert (tuple(got[0]), tuple(got[1]), got[2]) == ((3, 7), (1, 20), None)
    text = F.lit("a\nb\nthe quote that is long and goes on for more than thirty characters\nc")
    assert one(spark, tx.quote_line(text, F.lit("the quote that is long and goes on, then differs")))[0] == 3
    assert one(spark, tx.quote_line(text, F.lit("the quote that differs")))[0] == 3
    assert one(spark, tx.quote_line(text, F.lit("absent")))[0] is None
    assert one(spark, tx.numbered(F.lit("x\ny")))[0] == "[L1] x\n[L2] y"


def test_citations(spark):
    assert one(spark, tx.citations(F.lit("see 【1， 2】 and [2][9] and [3]"), F.lit(3)))[0] == [1, 2, 3]


def test_sliding_chunks_cover(spark):
    got = one(spark, tx.sliding_chunks(F.lit("abcdefghij"), 4, 1))[0]
    assert [(c["start"], c["piece"]) for c in got] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert one(spark, tx.sliding_chunks(F.lit(""), 4, 1))[0] == []


def test_names_lines_and_quotes(spark):
    real = lambda x: one(spark, tx.real_name(F.lit(x)))[0]
    assert [real(x) for x in ("林茵", "场景12", "宾客3", "同学10", "护士", "站起来", "场景")] == [True, False, False, False, False, False, True]
    meta = lambda x: one(spark, tx.meta_line(F.lit(x)))[0]
    assert [meta(x) for x in ("", "人物：a", "人物关系：a", "第3集", "1-2 a", "12场", "3个人", "说：好")] == [True, True, False, True, True, True, False, False]
    quote = lambda x: tuple(one(spark, tx.best_quote(F.lit(x), 10))[0])
    assert quote("人物：a\n甲：你好\n ▲走") == ("▲走", 3)
    assert quote("第1集\n文字\n甲：你好") == ("甲：你好", 3)
    assert quote("第1集\nplain and long text") == ("plain and…", 2)
    assert quote("第1集") == ("第1集", 1)
    assert one(spark, tx.keywords(F.lit("What is the Main Graph of graph x-ray DATA in it?")))[0] == ["Graph", "x-ray", "DATA"]


def test_planner_artifacts(spark):
    plan = '[{"title": "a", "question": "b", "depth": 1, "parent_title": null}]'
    of = lambda *x: one(spark, tx.planner_artifact(*(F.lit(v).cast("string") for v in x), ("inner",)))[0]
    assert of("x", "y", "INNER") and of("Answer as JSON", plan, None) and of("you are a research planner", f'{{"items": {plan}}}', "user")
    assert not of("hello", plan, None) and not of("json", '[{"title": "a"}]', None) and not of(None, None, None)


def test_pieces_without_overlap_are_found_in_one_pass(spark):
    texts = ["", None, "a", "abc", "abcd", "é\n字😀\r\n\u2028x" * 5, " " * 7]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("c", tx.sliding_chunks(F.col("t"), 3, 0))
    got = {r["id"]: [(c["start"], c["piece"]) for c in r["c"]] for r in df.collect()}
    assert got == {i: [(k, t[k : k + 3]) for k in range(0, len(t), 3)] if t else [] for i, t in enumerate(texts)}
    assert "substr" not in df._jdf.queryExecution().optimizedPlan().toString()
