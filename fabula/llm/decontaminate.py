"""Benchmark decontamination by template windows.

A text becomes template tokens: words without surrounding punctuation, where numbers, units after a number and
capitalised names are typed placeholders. Windows of WINDOW tokens are hashed, in this form and in plain lower case, and
documents' windows are hash-joined with the benchmark's. Where windows meet, the values in their slots must map
consistently: one benchmark value to one document value over all matches of a placement of an item in a document. A
template window with a value that doesn't is no match; plain windows match whatever the slots of others are. So a question
asked again with other numbers or names is caught, a verbatim one with an edit too, and a chance meeting of templates isn't.

Plan: one scan of the documents. A bitmap of BITS bits, whatever the benchmark's size, passes the windows that may be in
the benchmark. Both sides are then a row for each text and distinct window, with where its template windows stand, and
these rows meet in the exact join, which is salted, since one item may be leaked into a third of all documents. So a text
that repeats a window n times and an item that repeats it m times meet in one row, not in n x m. A document and an item go
on if the windows that they share could cover enough of the item, and only then are placements looked at, some hundred
at a time.

Edge cases: null or empty texts and items have no windows; an item of fewer than WINDOW tokens is one window of all its
tokens; an item of fewer than ``least`` tokens is never reported (``skipped_items`` lists those, ``least=1`` skips none that
has a token); rows that share an id, a null one too, are different documents or different items, each with rows of its own,
but equal rows are reported once; a text of any length is one row of windows, of which only those that may be in the
benchmark are kept; empty tables give an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import slices, small_batches, texts

WINDOW = 8
#: A template window needs so many tokens that aren't placeholders.
LITERALS = 4
#: An item is leaked into a document if so large a part of its tokens is covered by plain windows and those with consistent slots.
COVERAGE = 0.5
#: Items of fewer tokens are in too many texts by chance. A parameter; 1 looks for all that have a token.
LEAST = 3
#: Placements of an item in a document that are judged at once.
SHIFTS = 512
#: Bytes of words that are numbered anew each time, not held.
LONG = 256
BITS = 23
SALTS = 8
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years k c f hz khz mhz ghz w kw j kj v a pa usd eur gbp dollar dollars euro euros cent cents percent % mile miles meter meters metre metres gram grams pound pounds inch inches foot feet".split())
NUMBER, UNIT, NAME = "\x01number", "\x01unit", "\x01name"
_EDGES = " \t.,;:!?\"'()[]{}<>|*#&…«»„“”‘’¿¡-–—_/\\~^=+`"
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WINDOWS = "id bigint, h bigint, pos int, slots array<string>"
DOCUMENT_WINDOWS = f"{WINDOWS}, k bigint"


class Tokens(dict):
    """Numbers words; for each number the hash of its plain and its template token and what it is. 0 is no token."""

    def __init__(self):
        super().__init__()
        self.plain, self.template, self.kind, self.value = [0], [0], [0], [""]

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace").strip(_EDGES)
        if not text:
            self[word] = 0
            return 0
        low = text.lower()
        digits = sum(c.isdigit() for c in text)
        kind = 1 if digits and 2 * digits >= len(text) else 3 if text[0].isupper() else 2 if low in UNITS else 0
        code = len(self.kind)
        if len(word) <= LONG:
            self[word] = code
        shown = NUMBER if kind == 1 else NAME if kind == 3 else low
        self.plain.append(xxhash.xxh64_intdigest(low))
        self.template.append(xxhash.xxh64_intdigest(shown))
        self.kind.append(kind)
        self.value.append(low)
        return code


def window_hashes(tokens: np.ndarray, width: int, family: int) -> np.ndarray:
    """A hash of each ``width`` tokens in a row."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = tokens[:n].copy()
    for j in range(1, width):
        h = h * _PRIME + tokens[j : n + j]
    h ^= np.uint64(xxhash.xxh64_intdigest(f"{family}:{width}"))
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


class Templates:
    """Template windows of texts. ``widths``: the window lengths looked for; ``passing``: a bitmap of hashes, or None."""

    def __init__(self, widths: list[int] | None = None, passing: np.ndarray | None = None):
        self.widths, self.passing, self.codes = widths, passing, Tokens()
        self.unit = xxhash.xxh64_intdigest(UNIT)

    def of(self, raws: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, list[str | None]]]]]:
        """For each text the number of tokens and ``(width, hash, position, slots)`` of each window that passes."""
        if len(self.codes.kind) > 200_000:
            self.codes = Tokens()
        found = [x.split() for x in raws]
        all_ = [np.fromiter(map(self.codes.__getitem__, x), np.int64, len(x)) for x in found]
        c = self.codes
        tables = np.array(c.plain, np.uint64), np.array(c.template, np.uint64), np.array(c.kind)
        for codes in all_:
            codes = codes[codes > 0]
            yield len(codes), self._windows(codes, *tables)

    def _windows(self, codes: np.ndarray, plain: np.ndarray, template: np.ndarray, kinds: np.ndarray) -> list:
        kind = kinds[codes]
        is_unit = np.zeros(len(codes), bool)
        is_unit[1:] = (kind[1:] == 2) & (kind[:-1] == 1)
        slot = (kind == 1) | (kind == 3) | is_unit
        shown = np.where(is_unit, np.uint64(self.unit), template[codes])
        found = []
        for width in self.widths or [min(WINDOW, len(codes))]:
            for family, tokens in ((0, plain[codes]), (1, shown)):
                h = window_hashes(tokens, width, family)
                if not width or not len(h):
                    continue
                taken = np.ones(len(h), bool) if self.passing is None else self.passing[h >> np.uint64(64 - BITS)]
                for at in np.flatnonzero(taken).tolist():
                    slots: list[str | None] = [None] * width
                    if family:
                        inside = slot[at : at + width]
                        if not inside.any() or width - int(inside.sum()) < min(LITERALS, width):
                            continue  # without slots it is the plain window
                        slots = [self.codes.value[codes[at + j]] if inside[j] else None for j in range(width)]
                    found.append((width, int(h[at].astype(np.int64)), at, slots))
        return found


def _arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "h": pa.int64(), "pos": pa.int32(), "slots": pa.list_(pa.string()), "width": pa.int32(), "tokens": pa.int32(), "k": pa.int64(), "ik": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


def item_windows(items: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """Every window of every item: WINDOWS, ``width``, the item's number of ``tokens`` and ``ik``, the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = Templates(), ["id", "h", "pos", "slots", "width", "tokens", "ik"]
        for batch in slices(batches, "t"):
            rows = []
            for i, k, (n, found) in zip(batch.column("i").to_pylist(), batch.column("k").to_pylist(), made.of(texts(batch.column("t"))), strict=True):
                if n >= least:
                    rows += [(i, h, at, slots, width, n, k) for width, h, at, slots in found]
            if rows:
                yield _arrow(rows, names)

    text = F.col(text_col).cast("string")
    source = items.select(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text).alias("k"), text.alias("t"))
    return source.mapInArrow(run, f"{WINDOWS}, width int, tokens int, ik bigint")


def skipped_items(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``item_id, tokens`` of the items that are never reported: those of fewer than ``least`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Templates()
        for batch in slices(batches, "t"):
            counts = pa.array([n for n, _ in made.of(texts(batch.column("t")))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("i"), counts], ["item_id", "tokens"])

    source = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    return source.mapInArrow(run, "item_id bigint, tokens int").filter(F.col("tokens") < least)


def document_windows(docs: DataFrame, id_col: str, text_col: str, widths: list[int], passing: np.ndarray) -> DataFrame:
    """The documents' windows that the bitmap passes: DOCUMENT_WINDOWS, ``k`` being the hash of the text, which tells rows of
    one id apart."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(passing))  # 2 ** BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = Templates(widths, np.unpackbits(shared.value).astype(bool)), ["id", "h", "pos", "slots", "k"]
        for batch in slices(batches, "t"):
            rows = []
            for i, k, (_, found) in zip(batch.column("i").to_pylist(), batch.column("k").to_pylist(), made.of(texts(batch.column("t"))), strict=True):
                rows += [(i, h, at, slots, k) for _, h, at, slots in found]
                if len(rows) > 10_000:
                    yield _arrow(rows, names)
                    rows = []
            if rows:
                yield _arrow(rows, names)

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text).alias("k"), text.alias("t"))
    return source.mapInArrow(run, DOCUMENT_WINDOWS)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, least: int = LEAST
) -> DataFrame:
    """A row for each document and item that it contains: ``doc_id, item_id, n_windows, covered_tokens, item_tokens,
    coverage, n_slots, reparameterised``."""
    return leaks(docs, items, id_col, text_col, item_col, item_text_col, coverage, least).drop("k", "ik")


def _distinct(windows: DataFrame, *keys: str) -> DataFrame:
    """A row for each of ``keys`` and window ``h``, with the places and slots of template windows (``at``) and the places of
    all (``spots``)."""
    template = F.exists("slots", lambda s: s.isNotNull())
    return windows.groupBy(*keys, "h").agg(F.collect_set(F.when(template, F.struct("pos", "slots"))).alias("at"), F.collect_set("pos").alias("spots"))


def _covered(spots: Column) -> Column:
    """How many tokens the windows of ``width`` at sorted ``spots`` cover."""
    wide = F.col("width")
    return F.aggregate(
        spots,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((x + wide).alias("end"), (acc["n"] + x + wide - F.greatest(acc["end"], x)).alias("n")),
        lambda acc: acc["n"],
    )


def sound_windows(met: list[dict]) -> tuple[list[int], int, bool]:
    """Of template windows that a document and an item share (``own`` and ``item``: places and slots), the item's places that
    some placement finds with consistent slots; the number of different values in the slots of those, benchmark and
    document; and whether any of them differ. A placement is a difference of places."""
    codes: dict[str | None, int] = {}
    number = lambda slots: [codes.setdefault(x, len(codes)) if x is not None else -1 for x in slots]
    kinds, spots, sides = ([], []), ([], []), ([], [])
    for h, both in enumerate(met):
        for side, name in enumerate(("item", "own")):
            rows = sorted({(x["pos"], *number(x["slots"])) for x in both[name]})
            kinds[side].extend([h] * len(rows))
            spots[side].extend(r[0] for r in rows)
            sides[side].extend(r[1:] for r in rows)
    kind, pos = (np.array(x[0], np.int64) for x in (kinds, spots))
    at, a, b = np.array(spots[1], np.int64), np.array(sides[0], np.int64), np.array(sides[1], np.int64)
    span = int(max(at.max(), pos.max())) + 1
    order = np.array(kinds[1], np.int64) * 2 * span + at  # sorted: by window, then place
    found, pairs = np.zeros(len(pos), bool), []
    for low in range(int(at.min() - pos.max()), int(at.max() - pos.min()) + 1, SHIFTS):
        first = np.searchsorted(order, kind * 2 * span + np.clip(pos + low, 0, span))
        n = np.searchsorted(order, kind * 2 * span + np.clip(pos + low + SHIFTS, 0, span)) - first
        i = np.repeat(np.arange(len(pos)), n)
        j = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(i))
        if not len(i):
            continue
        row, column = np.nonzero(a[i] >= 0)
        value = np.stack([at[j[row]] - pos[i[row]], a[i[row], column], b[j[row], column]])
        by = np.lexsort(value[::-1])
        same = (value[:2, by[1:]] == value[:2, by[:-1]]).all(0)
        starts = np.flatnonzero(np.r_[True, ~same])
        other = value[2, by]
        mixed = np.minimum.reduceat(other, starts) != np.maximum.reduceat(other, starts)
        unclear = np.zeros(len(i), bool)
        unclear[row[by[np.repeat(mixed, np.diff(np.r_[starts, len(by)]))]]] = True
        found[i[~unclear]] = True
        pairs.append(np.unique(value[1:, ~unclear[row]], axis=1))
    seen = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), int)
    return sorted(set(pos[found].tolist())), seen.shape[1], bool((seen[0] != seen[1]).any())


def _sound(met: Column) -> Column:
    """``sound_windows`` of a column, as ``spots``, ``slots`` and ``changed``."""

    @F.pandas_udf("struct<spots:array<int>,slots:int,changed:boolean>")
    def sound(rows: pd.Series) -> pd.DataFrame:
        found = [sound_windows(list(x)) if x is not None and len(x) else ([], 0, False) for x in rows]
        return pd.DataFrame(found, columns=["spots", "slots", "changed"])

    return sound(met)


def leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, coverage: float, least: int = LEAST) -> DataFrame:
    """The rows of ``find_leaks`` with ``k`` and ``ik``, the xxhash64 of the document's and of the item's text."""
    small_batches(docs.sparkSession)
    wanted = item_windows(items, item_col, item_text_col, least)
    widths = sorted(r[0] for r in wanted.select("width").distinct().collect())  # WINDOW values at most
    passing = np.zeros(1 << BITS, bool)
    bits = wanted.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("bit")).distinct().toPandas()["bit"]
    passing[bits.to_numpy(dtype=np.int64)] = True
    seen = _distinct(document_windows(docs, id_col, text_col, widths or [WINDOW], passing), "id", "k").drop("spots")
    asked = _distinct(wanted, "id", "ik", "tokens", "width")
    salt = F.pmod(F.xxhash64("id", "k"), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    met = (
        seen.withColumn("salt", salt)
        .alias("d")
        .join(asked.withColumn("salt", copies).alias("i"), ["h", "salt"])
        .select(
            F.col("d.id").alias("doc_id"), "k", F.col("i.id").alias("item_id"), "ik", "tokens", "width",
            F.struct(F.col("d.at").alias("own"), F.col("i.at").alias("item"), F.col("spots")).alias("window"),
        )
    )
    pair = ["doc_id", "k", "item_id", "ik", "tokens", "width"]
    both = met.groupBy(*pair).agg(F.collect_list("window").alias("windows"))
    flat = lambda windows: F.array_sort(F.array_distinct(F.flatten(F.transform(windows, lambda w: w["spots"]))))
    likely = both.filter(_covered(flat(F.col("windows"))) >= coverage * F.col("tokens"))
    plain, templates = F.filter("windows", lambda w: F.size(w["own"]) == 0), F.filter("windows", lambda w: F.size(w["own"]) > 0)
    short = F.transform(templates, lambda w: F.struct(w["own"].alias("own"), w["item"].alias("item")))
    judged = likely.select(*pair, flat(plain).alias("plain"), _sound(short).alias("sound"))
    out = judged.withColumn("spots", F.array_sort(F.array_union("plain", "sound.spots"))).select(
        "doc_id",
        "k",
        "item_id",
        "ik",
        F.size("spots").alias("n_windows"),
        _covered(F.col("spots")).alias("covered_tokens"),
        F.col("tokens").alias("item_tokens"),
        F.col("sound.slots").alias("n_slots"),
        F.col("sound.changed").alias("reparameterised"),
    )
    return out.withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens")).filter(F.col("coverage") >= coverage)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that contain an item; others of the same id, or without one, stay."""
    found = leaks(docs, items, id_col, text_col, item_col, item_text_col, coverage, least).select(F.col("doc_id").alias("_leaked_id"), F.col("k").alias("_leaked_text")).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_leaked_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_leaked_text"))
    return docs.join(found, same, "left_anti")
