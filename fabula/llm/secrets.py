"""Secret scans with multipart credential linking, on DataFrame functions only.

Three kinds of strong spans are always reported: assignments, access identifiers and long hexadecimal runs. Weaker parts
of a credential (identifiers by prefix, mixed random-looking strings, endpoints) are candidates, reported only where
complementary parts co-occur: an identifier or a secret when the other is within SCOPE code points, an endpoint when
both are. Parts meet in an interval join: they are pre-aggregated to one row for each document, class and tile of SCOPE
code points, candidates probe their own tile and its neighbours, and no pair of spans is ever listed.

Plan: one scan finds the matches. ``regexp_extract_all`` gives the matched strings, ``split`` the gaps between them (read
only where something matched), and lengths added up in order are the positions. What is found is written as a table;
the rest handles spans, not texts. A document's number in that table tells rows apart, so ids may repeat.

Edge cases: a null or empty text has no spans; a null id stays null; equal rows give equal rows; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import materialise

#: Fixed by the contract: pattern, group whose length counts, and least length. An AKIA identifier or a run of hex digits
#: that is long enough matches as a whole either way, so the least length is part of those patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: Candidates of the method.
WEAK_ID_PREFIXES = ("AKIA", "ASIA", "AIDA", "AROA", "AGPA")
WEAK_ID = rf"(?<![A-Za-z0-9])(?:{'|'.join(WEAK_ID_PREFIXES)})[A-Z0-9]{{8,}}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?:https?|s3|jdbc:[a-z]+)://[^\s"'<>,;)\]]{4,}"""
#: Order of kinds at one start, and each kind's class of part.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
SCOPE = 256


def _found(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """For each match in order the code points of the gap before it and of itself, and whether the group is long enough."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    long = (lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least) if group else lambda m: F.lit(True)
    each = F.transform(
        F.arrays_zip(gaps.alias("g"), matches.alias("m")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("len"), F.coalesce(long(x["m"]), F.lit(False)).alias("ok")),
    )
    return F.when(F.size(matches) > 0, F.slice(each, F.lit(1), F.size(matches)))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``id`` and for each kind what ``_found`` gives, null where there is nothing. Written as a table."""
    text, any_of = F.col("t"), lambda xs: reduce(lambda a, b: a | b, xs)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    has_id = any_of([F.contains(text, F.lit(p)) for p in WEAK_ID_PREFIXES])
    columns = {
        "assign": _found(text, ASSIGN, 2, ASSIGN_LEAST),
        "access": F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS)),
        "hex": _found(text, HEX),
        # a candidate needs an identifier somewhere
        "weak_id": F.when(has_id, _found(text, WEAK_ID)),
        "weak_secret": F.when(has_id, _found(text, WEAK_SECRET)),
        "endpoint": F.when(has_id, _found(text, ENDPOINT)),
    }
    found = rows.select(F.monotonically_increasing_id().alias("row"), "id", *(c.alias(k) for k, c in columns.items()))
    return materialise(found, "matches")


def _positions(found: DataFrame) -> DataFrame:
    """``row, kind, rank, start, end`` of every match that is long enough."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.col(k).alias("at")) for i, k in enumerate(KINDS)))
    rows = (
        found.filter(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in KINDS]))
        .select("row", F.explode(each).alias("x"))
        .select("row", "x.kind", "x.rank", F.posexplode("x.at").alias("i", "m"))
    )
    so_far = Window.partitionBy("row", "rank").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)
    return rows.select("row", "kind", "rank", "m.ok", (end - F.col("m.len")).alias("start"), end.alias("end")).filter("ok").drop("ok")


def _apart(spans: DataFrame) -> DataFrame:
    """``spans`` without candidates that overlap a strong span."""
    strong, order = F.col("rank") < len(BASE), ["start", "rank"]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    ended, begins = F.max(F.when(strong, F.col("end"))).over(before), F.min(F.when(strong, F.col("start"))).over(after)
    marked = spans.withColumn("a", F.coalesce(ended, F.lit(0))).withColumn("b", begins)
    clear = (F.col("a") <= F.col("start")) & (F.col("b").isNull() | (F.col("b") >= F.col("end")))
    return marked.filter(strong | clear).drop("a", "b")


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The candidates among ``spans`` whose complementary parts start within ``scope`` code points of them."""
    part = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("kind"))
    rows = spans.withColumn("part", part).withColumn("tile", F.floor(F.col("start") / scope))
    tiles = (
        rows.filter("part <> 'endpoint'")
        .groupBy("row", "tile", "part")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
        .select("row", "tile", F.col("part").alias("other"), "first", "last")
    )
    weak = rows.filter(F.col("rank") >= len(BASE))
    probes = weak.select("*", F.explode(F.array(*(F.col("tile") + d for d in (-1, 0, 1)))).alias("at"))
    met = (
        probes.alias("p")
        .join(tiles.alias("t"), (F.col("p.row") == F.col("t.row")) & (F.col("p.at") == F.col("t.tile")))
        .filter("p.part <> t.other AND (p.at = p.tile OR p.at < p.tile AND t.last >= p.start - {0} OR p.at > p.tile AND t.first <= p.start + {0})".format(scope))
    )
    needed = F.when(F.col("part") == "endpoint", 2).otherwise(1)
    keys = [F.col(f"p.{c}").alias(c) for c in ("row", "kind", "rank", "start", "end", "part")]
    return met.select(*keys, "t.other").groupBy("row", "kind", "rank", "start", "end", "part").agg(
        F.count_distinct("other").alias("n")
    ).filter(F.col("n") >= needed).select("row", "kind", "rank", "start", "end")


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row of ``df``: ``id`` and ``spans``, an array of ``(start, rank, end, kind)`` in order; code points,
    end exclusive."""
    found = scan(df, id_col, text_col)
    spans = _apart(_positions(found))
    reported = spans.filter(F.col("rank") < len(BASE)).unionByName(link(spans, scope))
    grouped = reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return found.select("row", "id").join(grouped, "row", "left").select("id", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(
            s["end"] > acc["at"],
            F.concat(
                acc["out"],
                F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit("")),
            ),
        ).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
