"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

``plan`` says how many words of every document a mix takes:

1. Sizes are counted in the one scan of the texts; what follows moves narrow rows.
2. Sources share ``share`` times all words by their weights; a target stops at ``limit`` times its source's size and the
   excess goes to the others by weight. The level at which that settles takes one aggregate over the table of sources a
   round, and a round only ever stops more of them.
3. Targets are dealt as equal blocks of words: each block goes to the source with the highest quotient ``target / (2 k + 1)``,
   ``k`` being its blocks so far. No block is a row: a divisor a little too large and one a little too small bracket
   every source's number, so only the few quotients between them are ranked.
4. A source's documents are dealt to shards of about ``shard_words`` by a seeded digest, and its blocks to its shards by
   the same apportionment over the shards' sizes. So a source that holds a third of all rows is as many shards as it needs.
5. In a shard, documents stand in the order of their digests and its blocks are taken from a seeded block on, round and
   round. Whole rounds repeat every document; the rest is a range of words of some documents.

Ranks over whole tables (``ranked``) come from sorted ranges and counts of the ranges before, never from one task.

Edge cases: a null source is a source of its own, in the last place; a null or empty text has size 0 and nothing is taken
from it; documents of one id are documents of their own, and equal rows share a digest, so that it doesn't matter which
of them is taken; an empty table gives an empty plan; other columns are ignored. A text of any length is one row, counted
where it is read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix, and the most that is taken of a source, a shard or a document, as multiples of what there is.
SHARE, LIMIT = 1.5, 2
#: Words in a block. A source misses its target by about half a block.
BLOCK = 8
#: Words in a shard, about; the documents of a shard are ordered in one task.
SHARD_WORDS = 1 << 20
SEED = "mixture-1"


def number(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def digest(seed: str, id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """A narrow row for each document: ``id``, ``source``, ``size`` in words and ``key``, a seeded number."""
    return df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        number(digest(seed, id_col, text_col)).alias("key"),
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 on in ``order``, which should be total. Ranges of rows are sorted by
    tasks, and the ranges' counts say how many come before each."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = materialise(ranges.select("*", F.spark_partition_id().alias("_range"), here.alias("_here")), "ranked")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = held.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return found.select(*df.columns, (F.col("_before") + F.col("_here")).alias(name))


def level(sources: DataFrame, share: float) -> float:
    """The words a unit of weight gets once no target is above its cap (``cap`` and ``weight`` are columns)."""
    total = sources.agg((F.lit(share) * F.coalesce(F.sum("size"), F.lit(0))).alias("t")).first()["t"]
    found, stopped = 0.0, -1
    over = F.lit(False)
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("caps"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("rest"),
            F.coalesce(F.sum(F.when(over, 1)), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == stopped or not row["rest"]:
            return found if row["rest"] else float("inf")
        found, stopped = (total - row["caps"]) / row["rest"], row["n"]
        over = F.col("cap") < F.lit(found) * F.col("weight")


def apportion(df: DataFrame, group: str, key: str, weight: str, seats: str, name: str) -> DataFrame:
    """``df`` with ``name``: of the ``seats`` of each group (same in all its rows) those that each row gets by the highest
    quotients ``weight / (2 k + 1)``. Of equal quotients that of the least ``key`` comes first; (group, key) is a row's.

    With n rows that weigh W, the divisor ``W / (seats - n/2 - 1)`` gives away too few seats and ``W / (seats + n/2 + 1)``
    enough. Seats by the first are certain; between the two there are about two candidates a row, which are ranked."""
    totals = df.groupBy(group).agg(F.sum(F.col(weight).cast("double")).alias("_w"), (F.count(F.lit(1)) / 2 + 1).alias("_half"))
    w = F.col(weight).cast("double")
    by = lambda n: F.when((F.col("_w") > 0) & (n > 0), F.floor(w * n / F.col("_w") + 0.5)).otherwise(0).cast("bigint")
    near = df.join(totals, group).select(
        *df.columns, by(F.col(seats) - F.col("_half")).alias("_sure"), F.when(w > 0, by(F.col(seats) + F.col("_half"))).otherwise(0).alias("_most")
    )
    near = materialise(near, "seats")
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k")
    asked = near.filter(F.col("_most") > F.col("_sure")).select(group, key, weight, seat)
    asked = asked.select(group, key, (F.col(weight).cast("double") / (2 * F.col("_k") - 1)).alias("_q"), "_k")
    places = ranked(asked, [F.col(group), F.col("_q").desc(), F.col(key), F.col("_k")], "_place")
    first = places.groupBy(group).agg(F.min("_place").alias("_first"))
    free = near.groupBy(group).agg((F.max(seats) - F.sum("_sure")).alias("_free"))
    won = places.join(first, group).join(free, group).filter(F.col("_place") - F.col("_first") < F.col("_free"))
    more = won.groupBy(group, key).agg(F.count(F.lit(1)).alias("_more"))
    out = near.join(more, [group, key], "left")
    return out.select(*df.columns, (F.col("_sure") + F.coalesce(F.col("_more"), F.lit(0))).alias(name))


def targets(sized: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """A row for each source: its place ``r``, ``source_size``, ``cap`` and ``target``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"))
    pattern = F.element_at(F.array(*map(F.lit, weights)), (F.col("r") % len(weights) + 1).cast("int"))
    sources = ranked(sums, [F.col("source").asc_nulls_last()], "r")
    sources = materialise(sources.select("*", pattern.alias("weight"), (limit * F.col("size")).alias("cap")), "sources")
    target = F.least(F.col("cap").cast("double"), F.lit(level(sources, share)) * F.col("weight"))
    return sources.select("r", "source", F.col("size").alias("source_size"), "cap", target.alias("target"))


def plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """A row for each document: ``id``, ``source``, ``size``, ``source_size``, ``target`` (its source's words), ``taken``
    (words, repeats counted), ``rounds`` (times that it is taken whole), ``ranges`` (words taken once more, from ``first``
    to before ``end``), ``shard`` and ``key``. The tables of sources and shards are small next to the documents; Spark
    broadcasts them as far as their written size allows, and else joins by a shuffle."""
    sized = materialise(sizes(df, id_col, text_col, source_col, seed), "sizes")
    found = materialise(targets(sized, weights, share, limit), "targets")
    words = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    blocks = F.lit(math.floor(min(share, limit) * words / block + 0.5))
    found = apportion(found.select("*", F.lit(0).alias("all"), blocks.alias("seats")), "all", "r", "target", "seats", "quota")
    found = materialise(found.drop("all", "seats"), "quotas")

    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    placed = sized.join(found, sized["source"].eqNullSafe(found["source"])).select(
        "id", sized["source"], "size", "key", "source_size", "target", "r", "quota", (F.col("key") % n_shards).alias("shard")
    )
    shards = placed.groupBy("r", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("seats"))
    dealt = apportion(shards, "r", "shard", "words", "seats", "won").select(
        "r", "shard", "words", F.least(F.col("won") * block, limit * F.col("words")).alias("given")
    )
    dealt = materialise(dealt, "shards")

    spots = F.greatest(F.lit(1), F.ceil(F.col("words") / block))
    start = number(F.md5(F.concat_ws("|", F.lit(seed), F.lit("start"), "r", "shard"))) % spots * block
    before = F.sum("size").over(Window.partitionBy("r", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = placed.join(dealt, ["r", "shard"]).select("*", before.alias("at"), start.alias("start"))
    whole = F.when(F.col("words") > 0, F.expr("given div words")).otherwise(0)
    rows = rows.withColumn("rounds", whole.cast("bigint")).withColumn("rest", F.col("given") - F.col("rounds") * F.col("words"))
    cuts = [(F.col("start"), F.least(F.col("start") + F.col("rest"), F.col("words"))), (F.lit(0), F.col("start") + F.col("rest") - F.col("words"))]
    ends = [(F.greatest(F.lit(0), a - F.col("at")), F.least(F.col("size"), b - F.col("at"))) for a, b in cuts]
    ranges = F.filter(F.array(*(F.struct(a.cast("bigint").alias("first"), b.cast("bigint").alias("end")) for a, b in ends)), lambda x: x["end"] > x["first"])
    rows = rows.withColumn("ranges", ranges)
    extra = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return rows.select(
        "id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + extra).alias("taken"), "rounds", "ranges", "shard", "key"
    )


def mixed(df: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The mix itself: ``id``, ``copy`` and ``text``, a row for each time that a document is taken. Whole copies are the
    text as it is, ranges are its words joined by a space. Only what is taken is joined with the texts."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), number(digest(seed, id_col, text_col)).alias("key")).dropDuplicates(["id", "key"])
    wholes = F.transform(F.filter(F.sequence(F.lit(0), F.col("rounds")), lambda k: k > 0), lambda _: F.struct(F.lit(0).cast("bigint").alias("first"), F.col("size").alias("end")))
    taken = planned.filter("taken > 0").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "size", F.posexplode(F.concat(wholes, "ranges")).alias("copy", "cut"))
    found = taken.join(rows, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), (F.col("cut.first") + 1).cast("int"), (F.col("cut.end") - F.col("cut.first")).cast("int"))
    is_whole = (F.col("cut.first") == 0) & (F.col("cut.end") == F.col("size"))
    return found.select("id", "copy", F.when(is_whole, F.col("text")).otherwise(F.array_join(words, " ")).alias("text"))


def report(planned: DataFrame) -> DataFrame:
    """What became of each source: documents, words, target and words taken."""
    return planned.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    )


def sql(weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> str:
    """The plan of table ``documents`` in DuckDB's SQL, every quotient written out."""
    number = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    weight = reduce(lambda rest, kw: f"CASE WHEN r % {len(weights)} = {kw[0]} THEN {kw[1]} ELSE {rest} END", enumerate(weights), "0")
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  {number(f"concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))")} AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
v AS (SELECT *, {weight} AS w, {limit} * n AS cap FROM s),
l AS (SELECT cap, w, ({share} * sum(n) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lam, row_number() OVER (ORDER BY cap / w, r) AS k
  FROM v WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT v.*, least(cap::DOUBLE, (SELECT lam FROM l WHERE cap >= lam * w ORDER BY k LIMIT 1)::DOUBLE * w) AS target FROM v),
q AS (SELECT r, target / (2 * k - 1) AS q, k FROM (SELECT r, target, unnest(range(1, (ceil(target / {block}) + (SELECT count(*) FROM t) + 2)::BIGINT)) AS k FROM t WHERE target > 0)),
won AS (SELECT r, count(*) AS seats FROM (SELECT r, row_number() OVER (ORDER BY q DESC, r, k) AS place FROM q) WHERE place <= (SELECT floor({min(share, limit)} * sum(n) / {block} + 0.5) FROM t) GROUP BY 1),
p AS (SELECT doc_id, d.source, size, n AS source_size, target, t.r, coalesce(seats, 0) AS seats, key, key % greatest(1, ceil(n / {shard_words})::BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.r = t.r),
h AS (SELECT r, shard, sum(size)::BIGINT AS words, max(seats) AS seats FROM p GROUP BY 1, 2),
hq AS (SELECT r, shard, seats, words::DOUBLE / (2 * k - 1) AS q, k FROM (SELECT *, unnest(range(1, (seats * words / sum(words) OVER (PARTITION BY r) + count(*) OVER (PARTITION BY r) + 3)::BIGINT)) AS k FROM h WHERE words > 0)),
hw AS (SELECT r, shard, count(*) AS won FROM (SELECT r, shard, seats, row_number() OVER (PARTITION BY r ORDER BY q DESC, shard, k) AS place FROM hq) WHERE place <= seats GROUP BY 1, 2),
g AS (SELECT h.r, h.shard, words, least(coalesce(won, 0) * {block}, {limit} * words)::BIGINT AS given,
  {number(f"concat_ws('|', '{seed}', 'start', h.r::VARCHAR, h.shard::VARCHAR)")} % greatest(1, ceil(words / {block})::BIGINT) * {block} AS start FROM h LEFT JOIN hw ON hw.r = h.r AND hw.shard = h.shard),
x AS (SELECT p.*, words, given, start, CASE WHEN words > 0 THEN given // words ELSE 0 END AS rounds, CASE WHEN words > 0 THEN given % words ELSE 0 END AS rest,
  (sum(size) OVER (PARTITION BY p.r, p.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS spot FROM p JOIN g ON g.r = p.r AND g.shard = p.shard)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, least(start + rest, words) - spot) - greatest(0, start - spot))
  + greatest(0, least(size, start + rest - words - spot) - greatest(0, -spot)))::BIGINT AS taken, source, rounds::BIGINT AS rounds, shard FROM x"""
