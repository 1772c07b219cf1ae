"""Text expressions: markers of scripts, kinds of lines, names, quality of blocks, chunks by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, word lists and limits of script texts
EPISODE = r"^\s*第\s*([零一二三四五六七八九十百千两\d]+)\s*[集回话]\s*[A-Za-z]?\s*[\s:：、，,。．.;；]*$"
EPISODE_NUMBER = r"^\s*(\d{1,4})\s*[、,，.．]\s*$"
SCENE_NUMBER = r"^\s*(\d{1,3})\s*-\s*(\d{1,3})\s*([A-Za-z])?\s*[、,，：:．\.]?\s*(.*)$"
MAX_EPISODE, MAX_SCENE, MAX_TAIL, MAX_HEADING = 200, 50, 30, 30
HEADING = r"(日内|夜内|日外|夜外|晨内|晨外|内景|外景|内\s*/\s*外|外\s*/\s*内|清晨|傍晚|黎明|凌晨|早晨|上午|中午|下午|晚上|深夜|半夜|[，,\s](日|夜|外|内|早|晚|晨|暮)$)"
ACTION_MARKS = ("▲", "△", "◇", "◆")
QUOTE_MARKS = (*ACTION_MARKS, "*")
SCENE_HEADER = r"(?i)^(?:第?\s*\d+\s*场|场\s*\d+|scene\b|int\.|ext\.|内景|外景|日|夜)"
OFF_SCREEN = r"(?i)(?:\bOS\b|（\s*OS\s*）|旁白\s*[：:]|内心独白\s*[：:])"
VOICE_OVER = r"(?i)(?:\bVO\b|V\.O\.|（\s*VO\s*）|画外音\s*[：:])"
DIALOGUE = r"^[\[\(（【]?\s*([一-鿿A-Za-z0-9_·]{1,24})\s*[\]\)）】]?\s*[：:]\s*(.+)$"
STAGE_WORDS = ("动作", "镜头", "切", "转", "灯光")
META_WORDS = ("人物", "出场", "角色", "登场", "场景", "时间", "地点", "时空")
NUMERALS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "两": 2}
NUMERAL_UNITS = {"十": 10, "百": 100, "千": 1000}
GENERIC_NAMES = ("出场人物", "电话", "空镜", "电子提示音", "保镖", "保镖若干", "保镖若干。", "宾客", "宾客若干", "工作人员", "小弟", "护士", "服务员", "店员")
ACTION_NAMES = r"(上前|迎上|走出|看向|转头|回头|冷喝|点头|挥手|指着|皱眉|扫视|目光|翻白眼|站起|伸出|拍了拍|握住|反手|一脚|趴倒|坐下|起身|惊讶|着急|疑惑|不屑|做出|手势|表情|动作|的样子|地说|的人)"
NUMBERED_NAMES = (r"^场景\d+$", r"^(同学|宾客)\d+$")
KEYWORD_STOPS = ("what", "which", "kind", "type", "does", "do", "and", "the", "a", "an", "of", "in", "is", "are", "for", "primarily", "primary", "address", "addresses", "problem", "problems", "solution", "solutions", "main", "major", "task", "tasks")
QUESTION_PHRASES = (
    (r"(?i)是*(什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    (r"(?i)(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (r"(?i)(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ", " "),
)
PLANNER_PROMPTS = (
    "你是一名研究规划助手", "输出 json 数组，每项包含 title, question, depth, parent_title", "depth=1 的 parent_title 为空", "你的输出不是有效 json", "请修复并仅输出 json 数组",
    "you are a research planner", "return a json array; each item has title, question, depth, parent_title", "depth=1 parent_title is null", "your previous output is invalid json", "fix it and output json array only",
)
URL = r"https?://[^\s]+"


def numeral(text: Column) -> Column:
    """Digits or Chinese numerals as a number: units multiply what stands before them, a bare unit counts once."""

    def value(ch: Column, table: dict[str, int]) -> Column:
        out = F.lit(None).cast("int")
        for k, v in table.items():
            out = F.when(ch == k, v).otherwise(out)
        return out

    def step(acc: Column, ch: Column) -> Column:
        unit, n = value(ch, NUMERAL_UNITS), value(ch, NUMERALS)
        carried = F.when(acc["now"] == 0, F.lit(1)).otherwise(acc["now"]) * unit
        return F.struct(
            F.when(unit.isNotNull(), acc["sum"] + carried).otherwise(acc["sum"]).alias("sum"),
            F.when(unit.isNotNull(), F.lit(0)).when(n.isNotNull(), n).otherwise(acc["now"]).alias("now"),
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    folded = F.aggregate(chars, start, step, lambda acc: acc["sum"] + acc["now"])
    return F.when(text.rlike(r"^\d+$"), F.try_to_number(text, F.lit("9999999999")).cast("int")).otherwise(folded)


def episode_number(line: Column) -> Column:
    """The number of an episode marker; null if the line is none."""
    worded, plain = F.regexp_extract(line, EPISODE, 1), F.regexp_extract(line, EPISODE_NUMBER, 1)
    return F.when(worded != "", numeral(worded)).when(plain != "", plain.cast("int"))


def scene_marker(line: Column) -> Column:
    """``episode, scene, suffix, tail`` of a scene number; null for other lines, outlines and impossible numbers."""
    part = lambda i: F.regexp_extract(line, SCENE_NUMBER, i)
    ep, sc, tail = part(1), part(2), F.trim(part(4))
    outline = line.rlike(r"^\s*\d{1,3}\s*-\s*\d{1,3}\s*[A-Za-z]?\s*[:：]")
    number = lambda s: F.when(s != "", s).cast("int")
    ok = (ep != "") & episode_number(line).isNull() & ~outline & (F.length(tail) <= MAX_TAIL) & number(ep).between(1, MAX_EPISODE) & number(sc).between(1, MAX_SCENE)
    return F.when(ok, F.struct(number(ep).alias("episode"), number(sc).alias("scene"), part(3).alias("suffix"), tail.alias("tail")))


def bare_heading(line: Column) -> Column:
    """A short line that names a time or place and has no colon."""
    t = F.trim(line)
    action = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(m)) for m in ACTION_MARKS])
    return (t != "") & (F.length(t) <= MAX_HEADING) & ~action & ~t.rlike("[:：]") & episode_number(t).isNull() & scene_marker(t).isNull() & t.rlike(HEADING)


def line_kind(line: Column) -> Column:
    """dialogue, os, vo, action, scene_header or stage_direction; the first rule that fits."""
    t = F.trim(F.coalesce(line, F.lit("")))
    bracketed = t.rlike(r"^[(（\[【].*[)）\]】]$")
    staged = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(w)) for w in STAGE_WORDS])
    return (
        F.when(t == "", "stage_direction")
        .when(t.rlike(SCENE_HEADER), "scene_header")
        .when(t.rlike(OFF_SCREEN), "os")
        .when(t.rlike(VOICE_OVER), "vo")
        .when(t.rlike(DIALOGUE), "dialogue")
        .when(bracketed | staged, "action")
        .otherwise("stage_direction")
    )


def speaker(line: Column) -> Column:
    return F.when(line_kind(line) == "dialogue", F.trim(F.regexp_extract(F.trim(line), DIALOGUE, 1)))


def body(line: Column) -> Column:
    """What is said: the text after the first colon of spoken lines, else the line."""
    t = F.trim(F.coalesce(line, F.lit("")))
    after = F.trim(F.regexp_extract(t, r"^[^：:]*[：:](.*)$", 1))
    spoken = line_kind(line).isin("os", "vo") & t.rlike("[：:]")
    return F.when(line_kind(line) == "dialogue", F.trim(F.regexp_extract(t, DIALOGUE, 2))).when(spoken, after).otherwise(t)


def cast_list(text: Column, longest: int = 8) -> Column:
    return F.filter(F.split(F.trim(text), r"[、,，;；/\s]+"), lambda p: (p != "") & (F.length(p) <= longest))


def normal_name(name: Column) -> Column:
    """A name without what is in brackets and after a colon."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[（(\[【].*?[)）\]】]", ""), r"[:：].*$", ""))


def real_name(name: Column) -> Column:
    """Whether a name looks like a person's: not generic, not an action, not too long."""
    t = F.trim(name)
    numbered = reduce(lambda a, b: a | b, [t.rlike(p) for p in NUMBERED_NAMES])
    return (t != "") & (F.length(t) <= 8) & ~t.isin(*GENERIC_NAMES) & ~numbered & ~t.rlike(ACTION_NAMES)


def meta_line(line: Column) -> Column:
    """Whether a line tells of the script's structure (heads of scenes, casts, places, empty lines) and is no evidence."""
    t = F.trim(line)
    head = F.left(t, F.lit(4))
    listed = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(w)) for w in META_WORDS]) & head.rlike("[:：]")
    numbered = t.rlike(r"^\d") & (F.left(t, F.lit(6)).contains("场") | head.contains("集") | F.substring(t, 2, 1).isin("-", "－"))
    return (t == "") | listed | F.startswith(t, F.lit("第")) | numbered


def best_quote(text: Column, longest: int = 90) -> Column:
    """``quote, line`` of a scene: its first action line, else its first line that someone says, else its first line that
    isn't structure, else its beginning; cut to ``longest`` characters. Lines are numbered from 1."""

    def judged(line: Column, i: Column) -> Column:
        t = F.trim(line)
        marked = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(m)) for m in QUOTE_MARKS])
        wide, narrow = F.position(F.lit("："), t), F.position(F.lit(":"), t)
        colon = F.when(wide > 0, wide).otherwise(narrow)
        name = F.trim(F.substr(t, F.lit(1), colon - 1))
        said = colon.between(2, 13) & F.length(name).between(1, 6) & ~meta_line(name)
        rank = F.when(meta_line(t), 4).when(marked, 1).when(said, 2).otherwise(3)
        return F.struct(rank.alias("rank"), (i + 1).alias("line"), t.alias("quote"))

    first = F.array_min(F.transform(F.split(text, "\n"), judged))
    found = first["rank"] < 4
    quote = F.when(found, first["quote"]).otherwise(F.trim(text))
    cut = F.when(F.length(quote) > longest, F.concat(F.left(quote, F.lit(longest - 1)), F.lit("…"))).otherwise(quote)
    return F.struct(cut.alias("quote"), F.when(found, first["line"]).otherwise(1).alias("line"))


def keywords(text: Column, most: int = 6) -> Column:
    """The first ``most`` Latin words of three letters or more that aren't stop words, each once whatever its case."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9\-]+"), F.lit(0))
    wanted = F.filter(found, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*KEYWORD_STOPS))
    low = F.transform(wanted, F.lower)
    return F.slice(F.filter(wanted, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def without_question_phrases(text: Column) -> Column:
    for pattern, by in QUESTION_PHRASES:
        text = F.regexp_replace(text, pattern, by)
    return text


def mostly_other_script(text: Column) -> Column:
    """Whether a query is taken as Chinese: three words at most, or 70 % of them not Latin letters alone."""
    words = F.split(text, "[ \\t]+")
    return (F.size(words) <= 3) | (F.size(F.filter(words, lambda w: ~w.rlike("^[a-zA-Z]+$"))) >= 0.7 * F.size(words))


def planner_artifact(question: Column, answer: Column, source: Column, sources: tuple[str, ...]) -> Column:
    """Whether a message belongs to a planner's inner dialogue: by its source, or a plan as JSON that answers a planner's prompt."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))
    plan = F.try_parse_json(answer)
    item = "array<struct<title:string,question:string,depth:string,parent_title:string,parentTitle:string>>"
    items = F.coalesce(F.from_json(F.when(F.trim(answer).startswith("["), answer), item), F.from_json(answer, f"items {item}")["items"])
    whole = lambda x: x["title"].isNotNull() & x["question"].isNotNull() & x["depth"].isNotNull()
    # that an item says whose child it is can't be told from parsed nulls, but from the text
    planned = plan.isNotNull() & (F.size(items) > 0) & F.forall(F.slice(items, 1, 8), whole) & answer.rlike('"parent_title"|"parentTitle"')
    prompt = reduce(lambda a, b: a | b, [low.contains(m) for m in PLANNER_PROMPTS])
    asks = low.contains("parent_title") | low.contains("json") | low.contains("规划") | low.contains("planner")
    return F.coalesce(F.lower(source).isin(*sources), F.lit(False)) | F.coalesce(planned & (prompt | asks), F.lit(False))


def half_width(text: Column) -> Column:
    """Full-width ASCII as half-width."""
    full = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, full, "".join(map(chr, range(0x21, 0x7F))) + " ")


def distinct_characters(text: Column) -> Column:
    return F.size(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""))


def low_information(text: Column, least: int = 30, urls: float = 0.65, words: int = 5, distinct: int = 20, alnum: float = 0.3) -> Column:
    """Why a text says too little (short, url, url_ratio, few_words, few_characters, symbols), or null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    url_chars = F.length(t) - F.length(F.regexp_replace(t, URL, ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    n = F.regexp_count(t, F.lit(r"[\p{L}\p{N}_]+"))
    return (
        F.when(F.length(t) < least, "short")
        .when(t.rlike(rf"^{URL}$"), "url")
        .when(url_chars >= urls * F.length(t), "url_ratio")
        .when((F.length(t) <= 8000) & (n < words), "few_words")
        .when(distinct_characters(t) < distinct, "few_characters")
        .when(letters < alnum * F.length(t), "symbols")
    )


def title_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^([^。！？!?.\n]*[。！？!?.]?)", 1)


def truncated(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def sentences(text: Column) -> Column:
    """Parts after sentence marks followed by space, and lines."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?.])\s+|\n+"), F.trim), lambda s: s != "")


def sliding_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each beginning ``size - overlap`` after the last. Without overlap they are found in one
    pass over the text; ``substr`` counts from the beginning each time."""
    n = F.length(text)
    if not overlap:
        pieces = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda p, i: F.struct((i * size).alias("start"), p.alias("piece")))
        return F.when(n > 0, pieces).otherwise(F.array().cast("array<struct<start:int,piece:string>>"))
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("piece")))).otherwise(
        F.array().cast("array<struct<start:int,piece:string>>")
    )


def numbered(text: Column) -> Column:
    """Lines with their numbers, ``[L1] …``."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit("[L"), (i + 1).cast("string"), F.lit("] "), line)), "\n")


def quote_line(text: Column, quote: Column) -> Column:
    """The line (from 1) where a quote begins: found whole, else by its first 30, else by its first 12 characters."""
    at = F.coalesce(*(F.nullif(F.position(q, text), F.lit(0)) for q in (quote, F.left(quote, F.lit(30)), F.left(quote, F.lit(12)))))
    before = F.substr(text, F.lit(1), at)
    return F.when(quote != "", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def line_range(text: Column, last: Column, longest: int = 20) -> Column:
    """``first, end`` of a range like L3-L9: put in order, inside the text, ``longest`` lines at most."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    a, b = F.try_element_at(numbers, F.lit(1)), F.coalesce(F.try_element_at(numbers, F.lit(2)), F.try_element_at(numbers, F.lit(1)))
    lo = F.greatest(F.lit(1), F.least(last, F.least(a, b)))
    hi = F.greatest(lo, F.least(last, F.greatest(a, b)))
    return F.when(a.isNotNull(), F.struct(lo.alias("first"), F.least(hi, lo + longest - 1).alias("end")))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders in braces replaced; one without a value stays."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("{" + name + "}")))
    return out


def intent_score(text: Column, words: list[str], patterns: list[str], context: float = 0.0) -> Column:
    """Score of an intent: a quarter for each keyword (0.6 at most) and pattern (0.4 at most); negated keywords don't count."""
    low = F.lower(text)
    said = sum(((low.contains(w) & ~low.rlike(rf"(?:not|don't|no)\s+{w}")).cast("int") for w in words), F.lit(0))
    fits = sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))
    return F.least(0.25 * said, F.lit(0.6)) + F.least(0.25 * fits, F.lit(0.4)) + context


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first rule (part of text, class) that fits."""
    out = F.lit(otherwise)
    for part, name in reversed(rules):
        out = F.when(F.contains(text, F.lit(part)), name).otherwise(out)
    return out


def citations(text: Column, most: Column) -> Column:
    """Numbers cited in brackets, full-width ones too, lists split, those out of range left out; in order, distinct."""
    plain = F.translate(text, "【】［］，、", "[][],,")
    groups = F.regexp_extract_all(plain, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.between(1, most)))
