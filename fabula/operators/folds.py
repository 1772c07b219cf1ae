"""Folds over a document's blocks in order: what becomes of a block depends on what was decided before.

Blocks stream past sorted by document and place. A fold holds what it needs of the current document, a block or a growing
window, and never a document's list; windows only see the blocks that can matter to them, found by an interval join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.operators.structure import sequence_ratio

# fixed values: kinds of blocks that are joined, beginnings of those that belong to what follows, and thresholds
TEXTUAL = ("paragraph", "section", "subsection", "abstract", "title", "authors")
LEADING = ("•", "-", "(", ")", "Fig", "Table")
SHORT = 40
ENOUGH, ALIGNED = 0.9, 0.45
TOO_MUCH, LOST, MISSES = 1.15, 0.32, 2


def merge_short_blocks(blocks: DataFrame, least: int = SHORT) -> DataFrame:
    """``doc_id, pos, kind, text, joined`` of blocks (doc_id, pos, kind, text, whole): a textual block of fewer than ``least``
    characters that isn't to be kept ``whole`` is joined, by a space, to the last block kept if that is textual; one that
    begins like a bullet or caption is joined to the next block if that is textual. ``joined`` counts what a block took in.
    Blocks without text go. The order of a document is that of ``pos``; equal places go by kind and text."""
    schema = "doc_id bigint, pos bigint, kind string, text string, joined bigint"
    rows = blocks.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), "kind", "text", F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folded = _short_blocks_joined(_with_next(batches), least)
        yield from _in_batches(folded, ["doc_id", "pos", "kind", "text", "joined"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "kind", "text").mapInPandas(run, schema)


def _with_next(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list | None]]:
    """Each block with the next of its document, or None; what is done to the next one is seen when its turn comes."""
    held = None
    for batch in batches:
        for doc, pos, kind, text, whole in zip(*(batch[c] for c in ("doc_id", "pos", "kind", "text", "whole")), strict=True):
            doc = None if pd.isna(doc) else int(doc)
            block = [doc, None if pd.isna(pos) else int(pos), kind, "" if text is None else text, bool(whole), 0]
            if held is not None:
                yield held, block if block[0] == held[0] else None
            held = block
    if held is not None:
        yield held, None


def _short_blocks_joined(blocks: Iterator[tuple[list, list | None]], least: int) -> Iterator[tuple]:
    kept = None
    for block, after in blocks:
        if kept is not None and kept[0] != block[0]:
            yield from _shown(kept)
            kept = None
        text = block[3].strip()
        if block[2] in TEXTUAL and len(text) < least and not block[4]:
            leads = after is not None and text.startswith(LEADING)
            if leads and after[2] in TEXTUAL:
                _take(after, f"{text} {after[3].strip()}", block)
                continue
            if kept is not None and kept[2] in TEXTUAL:
                own = kept[3].strip()
                _take(kept, f"{text} {own}" if leads else f"{own} {text}", block)
                continue
        if kept is not None:
            yield from _shown(kept)
        kept = block
    if kept is not None:
        yield from _shown(kept)


def _take(block: list, text: str, other: list) -> None:
    block[3] = text.strip()
    block[5] += 1 + other[5]


def _shown(block: list) -> Iterator[tuple]:
    if block[3].strip():
        yield block[0], block[1], block[2], block[3], block[5]


def _in_batches(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def growing_windows(matches: DataFrame, blocks: DataFrame, tile: int = 4096) -> DataFrame:
    """``doc_id, key, first, last, n_blocks, outcome``: the blocks that each match takes in.

    ``matches``: doc_id, key, pos (of the block where it begins), target; ``blocks``: doc_id, pos, text. Blocks without text
    don't count. From its first block on a window grows until it covers ENOUGH of the target and is ALIGNED with it
    (``aligned``); past TOO_MUCH of the target it stops at the second block that finds it LOST (``lost``); else it goes on to
    the document's last block (``end``). Alignment compares as much of the window as of the target, by sequence and tokens,
    so it is settled once the window is as long as the target: only blocks up to that meet their match, by tiles of the
    document's length, and what lies beyond follows from their numbers. A window that covers less than ENOUGH decides
    nothing, so it isn't compared."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    order = Window.partitionBy("doc_id").orderBy("pos")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("doc_id", "pos", plain(F.coalesce("text", F.lit(""))).alias("b"))
    space = F.when(F.col("b") != "", F.length("b") + 1).otherwise(0)
    rows = rows.select("*", F.coalesce(F.sum(space).over(earlier), F.lit(0)).alias("before"), F.coalesce(F.count_if(F.col("b") != "").over(earlier), F.lit(0)).alias("n"))
    asked = matches.select("doc_id", "key", "pos", plain(F.coalesce("target", F.lit(""))).alias("target"))
    begun = asked.join(rows.select("doc_id", "pos", F.col("before").alias("base"), F.col("n").alias("from")), ["doc_id", "pos"])
    reach = F.col("base") + F.lit(TOO_MUCH) * F.greatest(F.length("target"), F.lit(1)) + 1
    tiles = begun.select("doc_id", "key", "target", "base", "from", reach.alias("reach")).withColumn("tile", F.explode(F.sequence((F.col("base") / tile).cast("bigint"), (F.col("reach") / tile).cast("bigint"))))
    texts = rows.filter("b <> ''")
    met = texts.withColumn("tile", (F.col("before") / tile).cast("bigint")).join(tiles, ["doc_id", "tile"]).filter((F.col("before") >= F.col("base")) & (F.col("before") < F.col("reach")))
    dealt = met.select("doc_id", "key", "n", "b", "target", "from").repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "n")
    kinds = {c: matches.schema[c].dataType.simpleString() for c in ("doc_id", "key")}
    stops = dealt.mapInPandas(_grown, f"doc_id {kinds['doc_id']}, key {kinds['key']}, from bigint, stop bigint, outcome string")

    last = texts.groupBy("doc_id").agg(F.max("n").alias("most"))
    found = stops.join(last, "doc_id").withColumn("n", F.least(F.coalesce("stop", "most"), "most"))
    place = texts.select("doc_id", "n", "pos")
    ends = found.join(place.withColumnRenamed("pos", "last"), ["doc_id", "n"]).withColumnRenamed("n", "to")
    starts = place.select("doc_id", F.col("n").alias("from"), F.col("pos").alias("first"))
    out = ends.join(starts, ["doc_id", "from"])
    return out.select("doc_id", "key", "first", "last", (F.col("to") - F.col("from") + 1).alias("n_blocks"), F.when(F.coalesce("stop", F.lit(0)) > F.col("most"), "end").otherwise(F.col("outcome")).alias("outcome"))


def alignment(target: str, window: str) -> float:
    n = min(len(target), len(window))
    a, b = target[:n], window[:n]
    x, y = ({t for t in _words(s) if len(t) >= 2} for s in (a, b))
    shared = len(x & y) / len(x | y) if x and y else 0.0
    return 0.7 * sequence_ratio(a, b) + 0.3 * shared


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each match: the number of its last block, or none if it goes on to the end."""

    def rows() -> Iterator[tuple]:
        now, pieces, size, open_, first, target, score = None, [], 0, False, 0, "", None
        for batch in batches:
            for doc, key, n, text, wanted, start in zip(*(batch[c] for c in ("doc_id", "key", "n", "b", "target", "from")), strict=True):
                if (doc, key) != now:
                    if open_:
                        yield (*now, first, None, "end")
                    now, pieces, size, open_, first, target, score = (doc, key), [], 0, True, int(start), wanted, None
                if not open_:
                    continue
                settled = score is not None and size >= len(target)
                pieces.append(text)
                size += len(text) + (len(pieces) > 1)
                covered = size / max(len(target), 1)
                if covered < ENOUGH:
                    continue
                if not settled:
                    score = alignment(target, " ".join(pieces))
                if covered >= ENOUGH and score >= ALIGNED:
                    open_ = False
                    yield (*now, first, int(n), "aligned")
                elif covered >= TOO_MUCH and score < LOST:
                    open_ = False
                    yield (*now, first, int(n) + MISSES - 1, "lost")
        if open_:
            yield (*now, first, None, "end")

    for part in _in_batches(rows(), ["doc_id", "key", "from", "stop", "outcome"]):
        yield part.astype({"stop": "Int64"})
