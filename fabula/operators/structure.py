"""Structure of documents: scripts into episodes and scenes, intervals repaired, texts chunked, blocks merged.

What follows from markers is windows over lines dealt by script. What depends on decisions made before (greedy folds) is a
small function for one group, run in batches; a group is one document or episode.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as tx
from fabula.operators.relational import slices

# ---- scripts


def segment_scripts(lines: DataFrame) -> DataFrame:
    """Lines (script_id, pos, line) with ``episode``, ``scene_no``, ``scene``: which scene each belongs to. No line is lost.

    Episodes begin at their markers; where a scene's number names another episode than the marker before, or there is
    none, the number's episode counts. Scenes begin at scene numbers; an episode (what lies between two episode markers)
    without any begins one at each bare heading, and one without these is a scene. Lines before the first marker are
    scene 0 of their script."""
    in_order = Window.partitionBy("script_id").orderBy("pos")
    rows = lines.select(
        "script_id", "pos", "line", tx.episode_number(F.col("line")).alias("_ep"), tx.scene_marker(F.col("line")).alias("_sc"), tx.bare_heading(F.col("line")).alias("_head")
    )
    rows = rows.withColumn("_part", F.count("_ep").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = F.max(F.col("_sc").isNotNull()).over(Window.partitionBy("script_id", "_part"))
    rows = rows.withColumn("_starts", F.when(numbered, F.col("_sc").isNotNull()).otherwise(F.col("_head")))
    rows = rows.withColumn("_cut", F.col("_starts") | F.col("_ep").isNotNull())
    last = in_order.rowsBetween(Window.unboundedPreceding, 0)
    episode = F.last(F.coalesce("_ep", "_sc.episode"), ignorenulls=True).over(last)
    number = F.last(F.when(F.col("_cut"), F.when(F.col("_sc").isNotNull(), F.concat_ws("-", "_sc.episode", F.concat(F.col("_sc.scene").cast("string"), "_sc.suffix"))).otherwise("")), ignorenulls=True).over(last)
    scene = F.sum(F.col("_cut").cast("int")).over(in_order)
    return rows.select("script_id", "pos", "line", episode.alias("episode"), F.coalesce(number, F.lit("1-1")).alias("scene_no"), F.coalesce(scene, F.lit(0)).alias("scene"))


def scenes_of(segmented: DataFrame) -> DataFrame:
    """The scenes of segmented lines: first and last position, number of lines, text in order."""
    return segmented.groupBy("script_id", "scene").agg(
        F.first("episode").alias("episode"), F.first("scene_no").alias("scene_no"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )


def script_lines(lines: DataFrame) -> DataFrame:
    """Lines with their kind, speaker and what is said."""
    line = F.col("line")
    return lines.withColumns({"kind": tx.line_kind(line), "speaker": tx.speaker(line), "body": tx.body(line)})


def repair_intervals(spans: Sequence[tuple[object, object]], first: int, last: int) -> list[tuple[int, int]]:
    """Intervals put right so that they cover [first, last] without gap or overlap, in order.

    Those that aren't numbers or lie outside are dropped, others are clamped and sorted, each begins after the end of
    the one before, and then ends where the next one begins; the outer ends are the bounds."""
    whole = []
    for a, b in spans:
        try:
            a, b = max(first, int(a)), min(last, int(b))
        except (TypeError, ValueError):
            continue
        if a <= b:
            whole.append((a, b))
    kept: list[list[int]] = []
    for a, b in sorted(whole):
        a = max(a, kept[-1][1] + 1) if kept else a
        if a <= b:
            kept.append([a, b])
    for x, y in zip(kept, kept[1:], strict=False):
        x[1] = y[0] - 1
    if kept:
        kept[0][0], kept[-1][1] = first, last
    return [(a, b) for a, b in kept]


def repaired(spans: DataFrame) -> DataFrame:
    """``script_id, episode_no, first, last`` with ``spans`` (array of structs start, end, as text): the repaired intervals."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                found = repair_intervals([(s["start"], s["end"]) for s in r.spans], r.first, r.last)
                out += [(r.script_id, r.episode_no, i, a, b) for i, (a, b) in enumerate(found)]
            yield pd.DataFrame(out, columns=["script_id", "episode_no", "idx", "start", "end"])

    schema = "script_id bigint, episode_no bigint, idx bigint, start bigint, end bigint"
    return spans.select("script_id", "episode_no", "first", "last", "spans").mapInPandas(run, schema)


def reference_groups(entries: DataFrame, size: int = 25) -> DataFrame:
    """Reference entries (doc_id, pos, text) in groups of ``size``, titled by the range of numbers."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = entries.withColumn("_n", n).withColumn("bucket", F.floor((F.col("_n") - 1) / size))
    return rows.groupBy("doc_id", "bucket").agg(
        F.concat(F.lit("References "), F.min("_n").cast("string"), F.lit("-"), F.max("_n").cast("string")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )


def attach_to_text(blocks: DataFrame, kind: str) -> DataFrame:
    """Blocks (doc_id, pos, type) of a kind with the text block they belong to: the last one before, else the next."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    at = F.when(F.col("type") == "text", F.col("pos"))
    before = F.last(at, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return blocks.withColumn("owner", F.coalesce(before, after)).filter(F.col("type") == kind)


# ---- chunks


def recursive_chunks(text: str, target: int, overlap: int, back: int = 120, ahead: int = 80) -> list[tuple[int, str]]:
    """Pieces of about ``target`` characters: each ends at the last boundary in a window before its target, else at the
    first one after, else at the target; the next begins ``overlap`` before."""
    out, at = [], 0
    while at < len(text):
        end = at + target
        if end >= len(text):
            end = len(text)
        else:
            ends = [m.end() for m in re.finditer(r"\n|[。！？!?.]\s?", text[max(at + 1, end - back) : end])]
            more = re.search(r"\n|[。！？!?.]\s?", text[end : end + ahead])
            end = max(at + 1, end - back) + ends[-1] if ends else end + more.end() if more else end
        out.append((at, text[at:end]))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def budget_merge(sections: Sequence[str], budget: int, count: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Sections joined until a chunk is over ``budget``; so a chunk may be over it by a section."""
    out: list[str] = []
    size = 0
    for s in sections:
        if not out or size > budget:
            out.append(s)
            size = count(s)
        else:
            out[-1] += f"\n{s}"
            size += count(s)
    return out


def hash_vector(text: str, size: int = 64) -> list[float]:
    """A deterministic embedding where no model is at hand: counts of hashed words."""
    import zlib

    v = [0.0] * size
    for w in text.lower().split():
        v[zlib.crc32(w.encode()) % size] += 1.0
    return v


def cosine(a: Sequence[float], b: Sequence[float]) -> float:
    """1 for vectors of other lengths or without length, so that nothing is split for want of information."""
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if len(a) == len(b) and na and nb else 1.0


def semantic_chunks(sentences: Sequence[str], target: int, most: int, threshold: float, embed: Callable[[str], Sequence[float]] = hash_vector) -> list[str]:
    """Sentences joined; a new chunk begins where the next would pass ``most``, or ``target`` while it differs from the last."""
    out: list[list[str]] = []
    size, last = 0, ()
    for s in sentences:
        now = embed(s)
        new = not out or size + len(s) > most or (size + len(s) >= target and cosine(last, now) < threshold)
        if new:
            out.append([s])
            size = len(s)
        else:
            out[-1].append(s)
            size += len(s)
        last = now
    return [" ".join(x) for x in out]


def chunked(docs: DataFrame, cut: Callable[[str], list[tuple[int, str]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk, start, piece`` by a function that cuts one text."""

    def run(batches):
        for rows in batches:
            out = [(i, k, a, p) for i, t in zip(rows["i"], rows["t"], strict=True) for k, (a, p) in enumerate(cut(t or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "start", "piece"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id bigint, chunk bigint, start bigint, piece string")


def chunk_route(kind: Column, text: Column, prose: int = 1200, most: int = 4000) -> Column:
    """How a block is chunked: tables, figures and the like are kept whole, long prose is cut by meaning, and what else is
    too long by size."""
    n = F.length(F.trim(text))
    return (
        F.when(kind.isin("table", "figure", "image"), "whole")
        .when(~kind.isin("title", "heading", "code", "equation", "link", "reference", "caption") & (n >= prose), "semantic")
        .when(n <= most, "whole")
        .otherwise("sliding")
    )


def budget_prefix(costs: Column, budget: int) -> Column:
    """Positions (from 0) of items taken in order: one that would pass the budget is left out if something is taken, and
    taking stops once the budget is reached."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, cost: Column) -> Column:
        full = acc["used"] >= budget
        over = (acc["used"] + cost > budget) & (F.size(acc["at"]) > 0)
        take = ~full & ~over
        return F.struct(
            F.when(take, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(take, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i")
        )

    return F.aggregate(F.transform(costs, lambda c: c.cast("bigint")), start, step, lambda acc: acc["at"])


# ---- patterns


#: Families of bullets, each from the outer to the inner level (fixed values).
BULLETS = (
    (
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ),
    (
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ),
    (
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ),
    (
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ),
)
#: What begins like a bullet and is none (fixed values).
NO_BULLETS = (r"0", r"[0-9]+ +[0-9~个只-]", r"[0-9]+\.{2,}")


def is_bullet(line: Column, patterns: Sequence[str]) -> Column:
    """Whether a line begins with one of the patterns and with none of those that only look like a bullet."""
    begins = lambda ps: line.rlike("^(?:" + "|".join(f"(?:{p})" for p in ps) + ")")
    return begins(patterns) & ~begins(NO_BULLETS)


def bullet_family(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """For each document the family of bullets that most lines fit, the first of equals, -1 if none: one aggregation."""
    fits = [F.count_if(is_bullet(F.col("line"), family)) for family in BULLETS]
    counts = lines.groupBy(by).agg(F.array(*fits).alias("n"))
    top = F.array_max("n")
    return counts.select(by, F.when(top > 0, F.array_position("n", top) - 1).otherwise(F.lit(-1)).cast("bigint").alias("family"))


def heading_levels(lines: DataFrame, family: int, by: str = "doc_id") -> DataFrame:
    """Each line's level in a family of bullets: 0 outermost, one more than the number of levels if none fits."""
    level = F.lit(len(BULLETS[family]) + 1)
    for i, p in reversed([*enumerate(BULLETS[family])]):
        level = F.when(is_bullet(F.col("line"), [p]), i).otherwise(level)
    return lines.withColumn("level", level)


# ---- layout


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def common_lengths(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, all pairs moved together. A bit of a pair's row is 0 where
    the subsequence grows with that character of the short text; words of 64 bits, so texts of some hundred characters."""
    n, width = len(short), -(-max(map(len, short), default=0) // 64)
    if not width:
        return np.zeros(n, np.int64)
    number: dict[str, int] = {}
    of = np.array([number.setdefault(x, len(number)) for x in short], np.int64)
    points = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes, lengths = np.array([*map(len, number)], np.int64), np.array([*map(len, long)], np.int64)
    within = lambda counts: np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys, which = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 21 | points(number), return_inverse=True)
    at = within(sizes)
    masks = np.zeros((width, len(keys) + 1), np.uint64)  # the last one is that of characters that the short text doesn't have
    np.bitwise_or.at(masks, (at // 64, which), np.uint64(1) << (at % 64).astype(np.uint64))
    asked = np.repeat(of, lengths) << 21 | points(long)
    place = np.searchsorted(keys, asked)
    place[keys[np.minimum(place, len(keys) - 1)] != asked] = len(keys)
    steps = np.full((int(lengths.max(initial=0)), n), len(keys), np.int64)
    steps[within(lengths), np.repeat(np.arange(n), lengths)] = place
    rows = np.full((width, n), ~np.uint64(0))
    for step in steps:
        carry = None
        for row, mask in zip(rows, masks, strict=True):
            shared = row & mask[step]
            total = row + shared
            over = total < shared
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            row ^= shared
            row |= total
    return 64 * width - np.bitwise_count(rows).sum(0, dtype=np.int64)


#: Pairs of texts that are compared together.
TOGETHER = 1024


def likeliest(docs: Sequence, heads: Sequence[str | None], texts: Sequence[str | None], firsts: Sequence[int | None], least: float) -> list[float]:
    """How like the beginning of a document's snippet a block is, or the block and the next: ``texts`` is both, of which
    ``firsts`` characters are the block. Compared with as much of a block as of a snippet, and some more of two blocks.

    0 where the score is under ``least`` or that of another row of the same document: a ratio counts characters of a common
    subsequence, so the lengths, and then the longest one's length, say how high a score can be at most."""
    out, words, tried = [0.0] * len(heads), {}, []
    find = re.compile("[a-z0-9]{2,}").findall
    for i, (doc, head, text, n) in enumerate(zip(docs, heads, texts, firsts, strict=True)):
        if head is None or text is None:
            continue
        if head not in words:
            words[head] = {*find(head)}
        wanted, size = words[head], max(len(head), 240)
        block = {*find(text[:n])}
        for there, a, b, whole, part in ((block, 0.7, 0.3, 1.0, text[: min(n, size)]), (block.union(find(text[n:])), 0.65, 0.35, 0.98, text[: size + 120])):
            shared = len(wanted & there) / len(wanted | there) if wanted and there else 0.0
            if whole * (a * 2 * min(len(head), len(part)) / (len(head) + len(part)) + b * shared) >= least - 1e-8:
                tried.append((doc, i, head, part, a, b * shared, whole))
    bounds: dict = {}
    for k in range(0, len(tried), TOGETHER):
        some = tried[k : k + TOGETHER]
        for (doc, *t), common in zip(some, common_lengths([t[2] for t in some], [t[3] for t in some]).tolist(), strict=True):
            _, head, part, a, shared, whole = t
            bounds.setdefault(doc, []).append((whole * (a * (2 * common / (len(head) + len(part))) + shared), t))
    for found in bounds.values():
        best = least
        for bound, (i, head, part, a, shared, whole) in sorted(found, key=lambda x: -x[0]):
            if bound < best - 1e-8:
                break
            score = whole * (a * sequence_ratio(head, part) + shared)
            out[i], best = max(out[i], score), max(best, score)
    return out


def layout_match(snippets: DataFrame, blocks: DataFrame, least: float = 0.42) -> DataFrame:
    """``doc_id, pos, score``: the block (doc_id, pos, text) where a document's ``snippet`` begins.

    The first block that holds the snippet's beginning or is held in the snippet, with score 1; else the likeliest, by
    sequence and tokens of the block or of it and the next, if it reaches ``least``. Only blocks of documents without the
    former are compared, and those that can't be the likeliest aren't compared in full."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    by_doc = Window.partitionBy("doc_id")
    rows = blocks.select("doc_id", "pos", plain("text").alias("b"))
    rows = rows.withColumn("both", F.trim(F.concat_ws(" ", "b", F.lead("b").over(by_doc.orderBy("pos"))))).filter("b <> ''")
    asked = snippets.select("doc_id", plain("snippet").alias("s")).filter("s <> ''").withColumn("head", F.left("s", F.lit(160)))
    held = F.when(F.contains("b", "head") | F.contains("s", "b"), F.col("pos"))
    met = rows.join(asked, "doc_id").select("doc_id", "pos", "head", "both", F.length("b").alias("n"), held.alias("held"))
    met = met.withColumn("first", F.min("held").over(by_doc))

    @F.arrow_udf("double")
    def likeness(doc: pa.Array, head: pa.Array, both: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(likeliest(*(c.to_pylist() for c in (doc, head, both, n)), least), pa.float64())

    open_ = lambda c: F.when(F.col("first").isNull(), F.col(c))
    scored = met.select("doc_id", "pos", "first", likeness("doc_id", open_("head"), open_("both"), open_("n")).alias("score"))
    best = scored.groupBy("doc_id").agg(
        F.first("first").alias("first"), F.max_by("pos", F.struct(F.round("score", 9), -F.col("pos"))).alias("pos"), F.max("score").alias("score")
    )
    found = F.col("first").isNotNull()
    return best.filter(found | (F.col("score") >= least)).select("doc_id", F.coalesce("first", "pos").alias("pos"), F.when(found, 1.0).otherwise(F.col("score")).alias("score"))


def routed_chunks(blocks: DataFrame, prose: int, most: int, size: int, overlap: int, cut: Callable[[str], list[tuple[int, str]]]) -> DataFrame:
    """``doc_id, pos, route, chunk, piece`` of blocks (doc_id, pos, kind, text): each is chunked as its route says.

    Blocks kept whole and those cut by size are expressions; those cut by meaning go through ``cut``, a megabyte of texts at a time."""
    rows = blocks.withColumn("route", chunk_route(F.col("kind"), F.col("text"), prose, most)).filter(F.trim("text") != "")
    whole = rows.filter("route = 'whole'").select("doc_id", "pos", "route", F.lit(0).cast("bigint").alias("chunk"), F.trim("text").alias("piece"))
    slid = rows.filter("route = 'sliding'").select("doc_id", "pos", "route", F.posexplode(tx.sliding_chunks(F.col("text"), size, overlap)).alias("chunk", "c"))
    slid = slid.select("doc_id", "pos", "route", F.col("chunk").cast("bigint").alias("chunk"), "c.piece")

    names = ["doc_id", "pos", "route", "chunk", "piece"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"]):
                each = zip(*(part.column(c).to_pylist() for c in ("doc_id", "pos", "text")), strict=True)
                out = [(d, p, "semantic", k, piece) for d, p, t in each for k, (_, piece) in enumerate(cut(t))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], names)

    meant = rows.filter("route = 'semantic'").select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, pos bigint, route string, chunk bigint, piece string")
    return whole.unionByName(slid).unionByName(meant)
