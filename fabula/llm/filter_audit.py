"""Filter interaction audit: what five filters do in each of their 120 orders.

A document's failures are a mask of five bits, and what an order of filters does to a document depends on the mask alone.
Orders stand in lexicographic order. Those that begin with the same prefix are an interval of ranks (the prefix's Lehmer
code is its first rank), so the orders in which a mask is removed at a given step are a few intervals: one for each prefix
of filters that it passes, followed by one that it fails. Counts of masks are added at the intervals' first ranks and
taken away after their last, and running sums across the ranks give every order's figures.

Plan: one scan measures the texts; narrow rows meet their labels by id and then group by text, where the least id tells
copies from their first. A hot text is pre-aggregated to a few rows a task. What is left is at most 32 masks a part, and
the rest moves 600 rows a part.

Edge cases: a null text is an empty one and a null ``part`` an empty string; a document with a null id is never a copy, nor
makes another one a copy; rows of one id and one text are no copies of each other; of several labels of one id any 1
counts; labels of other ids, or of none, count nothing; an empty table has no parts and gives no rows; other columns are
ignored. A text of any length is one row, measured where it is read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Filters and their failure conditions over the measurements (fixed by the contract); the first is bit 0 of a mask.
FILTERS: tuple[tuple[str, str], ...] = (
    ("A", "n_words < 200"),
    ("B", "100 * n_distinct < 50 * n_words"),
    ("C", "100 * n_upper > 3 * n_chars"),
    ("D", "has_symbol"),
    ("E", "is_copy"),
)
NAMES = "".join(name for name, _ in FILTERS)
COPY = "E"  # the one condition that needs other documents
ORDERS = ["".join(p) for p in permutations(NAMES)]
STEPS = len(NAMES)


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, last rank) of the orders that remove ``mask`` at that step, as few as there are."""
    fails, found = {name for bit, name in enumerate(NAMES) if mask >> bit & 1}, []

    def walk(first: int, left: str, step: int) -> None:
        width = reduce(lambda a, b: a * b, range(1, len(left)), 1)  # orders that share one more filter
        for place, name in enumerate(left):
            rank = first + place * width
            if name in fails:
                found.append((step, rank, rank + width - 1))
            else:
                walk(rank, left[:place] + left[place + 1 :], step + 1)

    walk(0, NAMES, 1)
    return found


def interval_table() -> Column:
    """The intervals of every mask, an array by mask; its size is fixed by the number of filters."""
    rows = [[{"step": s, "first": a, "last": b} for s, a, b in intervals(mask)] for mask in range(1 << STEPS)]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<step:int,first:int,last:int>>>")


def measures(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A narrow row for each document: ``id``, ``part``, ``text_hash`` (SHA-256) and ``mask`` without the copies' bit."""
    text = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    measured = text.select("id", "part", "t", words.alias("w")).select(
        "id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("text_hash"),
        F.size("w").alias("n_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).alias("n_upper"),
        F.length("t").alias("n_chars"),
        F.col("t").rlike(r"[#$%&*|]").alias("has_symbol"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << NAMES.index(name))).otherwise(F.lit(0)) for name, rule in FILTERS if name != COPY]
    return measured.select("id", "part", "text_hash", reduce(lambda a, b: a + b, bits).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The ledger of the audit: documents, good ones and toxic ones by part and mask."""
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = measures(docs, id_col, text_col, part_col).join(marked, "id", "left")
    kind = ["text_hash", "part", "mask", "good", "toxic"]
    rows = rows.select("id", "text_hash", "part", "mask", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    by_id = rows.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("id").isNotNull()
    texts = by_id.groupBy(*kind).agg(
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("n"),
        F.min(F.when(named, F.struct("id", "n"))).alias("least"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"),
    )
    least = F.min("least.id").over(Window.partitionBy("text_hash"))  # a row for each part and label of a text
    first = F.when(F.col("least.id") == least, F.col("least.n")).otherwise(0)
    split = texts.select("part", "mask", "good", "toxic", "n", "nameless", first.alias("first"))
    cases = F.array(
        F.struct(F.col("mask"), (F.col("first") + F.col("nameless")).alias("n")),
        F.struct((F.col("mask") + (1 << NAMES.index(COPY))).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    each = split.select("part", "good", "toxic", F.explode(cases).alias("c")).filter("c.n > 0")
    when = lambda c: F.sum(F.when(F.col(c) == 1, F.col("c.n")).otherwise(0)).alias(c)
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), when("good"), when("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """For every part, order and step what is kept and removed there, from ``counts`` as ``mask_counts`` gives them."""
    figures = ("n", "good", "toxic")
    steps = counts.select("part", *figures, F.explode(F.element_at(interval_table(), F.col("mask") + 1)).alias("i"))
    ends = F.array(
        F.struct(F.col("i.first").alias("rank"), *(F.col(c).alias(c) for c in figures)),
        F.struct((F.col("i.last") + 1).alias("rank"), *((-F.col(c)).alias(c) for c in figures)),
    )
    changes = steps.select("part", F.col("i.step").alias("step"), F.explode(ends).alias("e")).select("part", "step", "e.*")
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), *_by_filter())
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"), *(F.lit(0).cast("bigint").alias(c) for c in figures))
    deltas = changes.unionByName(grid).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in figures))
    across = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = deltas.select("part", "step", "rank", *(F.sum(c).over(across).alias(c) for c in figures)).filter(F.col("rank") < len(ORDERS))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1)
    named = sums.select("*", order.alias("filter_order")).withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    down = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = named.join(parts, "part").select("*", F.sum("n").over(down).alias("gone"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))
    return full.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def _by_filter() -> list[Column]:
    """Maps by filter: documents that fail it, and those that fail it alone."""
    maps = []
    for name, holds in (("fails", lambda b: F.getbit("mask", F.lit(b)) == 1), ("alone", lambda b: F.col("mask") == 1 << b)):
        sums = ((F.lit(x), F.sum(F.when(holds(b), F.col("n")).otherwise(0))) for b, x in enumerate(NAMES))
        maps.append(F.create_map(*(c for pair in sums for c in pair)).alias(name))
    return maps


def sql() -> str:
    """The audit of tables ``documents`` and ``labels`` in DuckDB's SQL, each order applied to each mask."""
    letters = f"(SELECT unnest(string_split('{','.join(NAMES)}', ',')) AS x)"
    order = " || ".join(f"{t}.x" for t in "vwxyz")
    clash = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate("vwxyz") for b in "vwxyz"[:i])
    bit = lambda x: f"(1 << (instr('{NAMES}', {x}) - 1))"
    prefix = " + ".join(f"CASE WHEN {k} < step THEN {bit(f'substr(o, {k}, 1)')} ELSE 0 END" for k in range(1, STEPS))
    mask = " + ".join(f"CASE WHEN {rule} THEN {1 << b} ELSE 0 END" for b, (_, rule) in enumerate(FILTERS))
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents), least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, part, len(ws) AS n_words, len(list_distinct(ws)) AS n_distinct, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) AS n_chars,
  regexp_matches(t, '[#$%&*|]') AS has_symbol, coalesce(doc_id > first, FALSE) AS is_copy FROM w JOIN least USING (t)),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, {mask} AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT {order} AS o FROM {letters} v, {letters} w, {letters} x, {letters} y, {letters} z WHERE {clash}),
s AS (SELECT o, step, substr(o, step, 1) AS f, {prefix} AS earlier FROM o, (SELECT unnest(range(1, {STEPS + 1})) AS step)),
r AS (SELECT part, o AS filter_order, step::INT AS step, f, sum(n) FILTER ((mask & (earlier | {bit('f')})) = 0) AS kept,
  sum(n) FILTER ((mask & {bit('f')}) <> 0 AND (mask & earlier) = 0) AS removed, sum(n) FILTER ((mask & {bit('f')}) <> 0 AND (mask & earlier) <> 0) AS redundant,
  sum(n) FILTER (mask = {bit('f')}) AS unique_fails, sum(good) FILTER ((mask & {bit('f')}) <> 0 AND (mask & earlier) = 0) AS good_lost,
  sum(toxic) FILTER ((mask & {bit('f')}) <> 0 AND (mask & earlier) = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
