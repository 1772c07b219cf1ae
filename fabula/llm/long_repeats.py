"""Long repeats across all texts, by longest-previous-factor arrays: where each string that occurs again starts earlier.

In suffix order the nearest positions before and after a position that come earlier in the texts, its previous and next
smaller ones, give its longest earlier match (``previous_factors``). A position whose match has ``length`` bytes is a
later copy; the earlier ones that it points at are its sources, so the first copy is known too: it stays if only later
copies are to go, and goes if every copy is to.

One suffix array of a whole corpus would have to pass through one machine, so the suffixes are dealt into groups that
can't match each other. In each window of ``short`` bytes the GRAM-byte string of least hash is its anchor; equal windows
have equal anchors at equal places. The windows in a row that share an anchor make a span, with the bytes that its
windows of ``length`` reach. Spans meet by their anchor's hash:

1. Equal spans are one kind, which pre-aggregation counts. A kind that occurs again is a match from end to end, its least
   occurrence the first; an anchor with one kind that occurs once is clear.
2. Kinds that share an anchor and differ go, one occurrence of each, into one group, in whose suffix order the positions
   that begin with ``short`` bytes found twice get their previous factors.
3. An anchor with over GROUP kinds would be a group without bound. There each window is a group of its own: all that is in
   it is equal, so the previous factor of each but the least is the whole window, and counting by digest tells it.

Texts come in order of their (least) id. Ranges are a function of the text, so they are found once for equal texts; a
text that occurs more than once as a whole is settled by its digest. Every step counts with pre-aggregation and joins back
what repeats; texts are shuffled only where a step has something to settle, picked by a bitmap of fixed size.

Edge cases: a null or empty text has no windows, nor has one shorter than ``short``; a text of any length is cut into
blocks of 2 ** 20 bytes for hashing, which overlap, so no window is lost; a null id stays null and comes first; rows that
share an id are different documents; an equal row is another occurrence; an empty table gives an empty result; other
columns of the input are ignored. Digests and hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import materialise, partitions, pick, slices, small_batches, texts

LENGTH, SHORT = 400, 256
#: Bytes of an anchor, a quarter of ``short`` at most.
GRAM = 64
#: Kinds of spans that meet in one suffix order.
GROUP = 4096
#: Positions that are compared at once.
CHUNK = 50_000
SALTS = 16
#: What a code says of windows: a window of ``short`` bytes that occurs again, one of ``length``, one with an earlier match.
NEAR, AGAIN, LATER = 0, 1, 2
_BLOCK_BITS = 20
_POWER, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xC2B2AE3D27D4EB4F)


# ---- one byte string ------------------------------------------------------------------------------------------------


def suffix_array(data: bytes) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    rank, k = np.frombuffer(data, np.uint8).astype(np.int64), 1
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= 2 * n:
            break
    return order


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position its previous and next smaller positions in suffix order (-1: none) and how much it shares with
    them. ``order``: the positions 0 to n - 1 in suffix order; ``common``: what each shares with the one before it there.

    Positions wait on a stack as long as smaller ones than theirs haven't come; the least of what lies between two
    suffixes is what they share."""
    n = len(order)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack: list[tuple[int, int]] = []
    for p, c in zip([*order.tolist(), -1], [*common.tolist(), 0], strict=True):
        while stack and stack[-1][0] > p:
            q, shared = stack.pop()
            after[q], right[q] = p, c
            c = min(c, shared)
        if p >= 0:
            if stack:
                before[p], left[p] = stack[-1][0], c
            stack.append((p, c))
    return before, left, after, right


def lpf(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest factor that also starts earlier, and where (-1: nowhere)."""
    order = suffix_array(data)
    common, at, k = np.zeros(len(data), np.int64), np.argsort(order), 0
    for i in range(len(data)):  # a suffix shares one byte less with its neighbour than the one before it did, or more
        k = max(k - 1, 0)
        if at[i]:
            j = order[at[i] - 1]
            while max(i, j) + k < len(data) and data[i + k] == data[j + k]:
                k += 1
            common[at[i]] = k
        else:
            k = 0
    before, left, after, right = previous_factors(order, common)
    return np.maximum(left, right), np.where(left + right == 0, -1, np.where(left >= right, before, after))


def later_copies(data: bytes, length: int) -> list[tuple[int, int]]:
    """Runs of bytes that are in a string of ``length`` or more bytes which also starts earlier: all copies but the first."""
    lengths, _ = lpf(data)
    return merge([(i, i + n) for i, n in enumerate(lengths.tolist()) if n >= length])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as runs; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---- anchors --------------------------------------------------------------------------------------------------------


@lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd number and of its inverse modulo 2 ** 64."""
    values = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
    ones = np.ones(1, np.uint64)
    powers = [np.cumprod(np.concatenate([ones, np.full(n, p, np.uint64)])) for p in (_POWER, pow(_POWER, -1, 1 << 64))]
    return values, *powers


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` bytes in a row."""
    values, up, down = _tables((1 << _BLOCK_BITS) + (1 << 12))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def all_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """``gram_hashes`` of a string of any length, in blocks that overlap."""
    step = 1 << _BLOCK_BITS
    parts = [gram_hashes(data[lo : lo + step + k - 1], k) for lo in range(0, max(len(data) - k + 1, 0), step)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    if width == 1:
        return v
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def group_codes(raws: list[bytes], windows: list[int], short: int, length: int) -> list[list[int]]:
    """For each string of a group, in the order of their texts, the codes of its windows: those that occur again in the
    group, and those that start earlier in it. ``windows``: how many windows of ``short`` bytes each has.

    What begins with the same ``short`` bytes is together in suffix order, and only that is compared, CHUNK positions or
    so at a time."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([*map(len, raws)])
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(raws)), windows)
    offset = np.arange(len(own)) - np.repeat(np.cumsum([0, *windows[:-1]]), windows)
    place = (ends - sizes)[own] + offset
    _, group, times = np.unique(all_gram_hashes(data, short)[place], return_inverse=True, return_counts=True)
    live = np.flatnonzero(times[group] > 1)
    live = live[np.argsort(group[live], kind="stable")]
    kind_of, group, later, again = group, group[live], np.zeros(len(own), bool), np.zeros(len(own), bool)
    padded, lo = np.concatenate([data, np.zeros(length, np.uint8)]), 0
    while lo < len(live):
        hi = int(np.searchsorted(group, group[min(lo + CHUNK, len(live)) - 1], side="right"))
        at = np.sort(live[lo:hi])  # in the order of the texts
        later[at], again[at] = _factors(padded, place[at], ends[own[at]], kind_of[at], short, length)
        lo = hi
    near = np.zeros(len(own), bool)
    near[live] = True
    out: list[list[int]] = [[] for _ in raws]
    for kind, which in ((NEAR, near), (AGAIN, again), (LATER, later)):
        k = np.flatnonzero(which)
        if len(k):
            w, j = own[k], offset[k]
            cuts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (j[1:] != j[:-1] + 1)]))
            for x, first, n in zip(w[cuts].tolist(), j[cuts].tolist(), np.diff(cuts, append=len(w)).tolist(), strict=True):
                out[x].append(code(first, n, kind))
    return out


def _factors(data: np.ndarray, place: np.ndarray, end: np.ndarray, group: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the positions ``place`` have a previous factor of ``length`` bytes, and which have one or are one. Strings end
    at ``end``; what is in one ``group`` begins with the same ``short`` bytes."""
    width = length - short
    rest = np.minimum(end - place - short, width)
    again = np.zeros(len(place), bool)
    if not width:
        order = np.lexsort((np.arange(len(place)), group))
        common = np.where(group[order[:-1]] == group[order[1:]], short, 0)
    else:
        tail = data[(place + short)[:, None] + np.arange(width)]
        tail[np.arange(width) >= rest[:, None]] = 0
        order = np.lexsort((np.arange(len(place)), rest, tail.view(f"S{width}").ravel(), group))
        a, b = order[:-1], order[1:]
        differ = tail[a] != tail[b]
        same = np.where(differ.any(1), differ.argmax(1), width)
        common = np.where(group[a] == group[b], short + np.minimum(same, np.minimum(rest[a], rest[b])), 0)
    before, left, after, right = previous_factors(order, np.concatenate([[0], common]))
    later = np.maximum(left, right) >= length
    again[later] = True
    for source, shared in ((before, left), (after, right)):
        again[source[shared >= length]] = True
    return later, again


def code(first: int, n: int, kind: int) -> int:
    """``n`` windows of a kind, from the window ``first`` on, in one number."""
    return first << 20 | n << 2 | kind


def anchors(raw: bytes, k: int, short: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first window, number of windows, hash of the anchor, digest of the span)`` of each span of windows of ``short``
    bytes. A span has ``short - k + 1`` windows at most."""
    data, width, end = np.frombuffer(raw, np.uint8), short - k + 1, len(raw) - short + 1
    step, low = (1 << _BLOCK_BITS) - short, np.uint64((1 << _BLOCK_BITS) - 1)
    for lo in range(0, end, step):
        hi = min(end, lo + step)
        h = gram_hashes(data[lo : hi - 1 + short], k)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(v, width) & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        hashes = h[at[cuts[:-1]]].view(np.int64).tolist()
        for a, b, x in zip(cuts[:-1].tolist(), cuts[1:].tolist(), hashes, strict=True):
            digest = hashlib.blake2b(raw[lo + a : lo + b - 1 + length], digest_size=8).digest()
            yield lo + a, b - a, x, int.from_bytes(digest, "little", signed=True)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def spans_of(docs: DataFrame, k: int, short: int, length: int) -> DataFrame:
    """``o, k, at, h, s`` of the spans of texts ``i, k, t``: id, text, place, anchor and span; ``at`` is the first window
    and, in the low 16 bits, the number of windows. Equal texts of one task count once."""
    schema = pa.schema([(c, pa.int64()) for c in ("o", "k", "at", "h", "s")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [], set()
        for batch in slices(batches, "t"):
            for i, key, raw in zip(batch.column("i").to_pylist(), batch.column("k").to_pylist(), texts(batch.column("t")), strict=True):
                if len(raw) < short or key in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                for first, n, h, s in anchors(raw, k, short, length):
                    found.append((i, key, first << 16 | n, h, s))
                    if len(found) >= 50_000:
                        yield _batch(found, schema)
                        found.clear()
            if found:
                yield _batch(found, schema)
                found.clear()

    return docs.select("i", "k", "t").mapInArrow(run, "o bigint, k bigint, at bigint, h bigint, s bigint")


def open_strings(docs: DataFrame, kinds: DataFrame, length: int, short: int, group: int) -> DataFrame:
    """``h, s, o, k, at, windows, many, raw``: the bytes of kinds that share their anchor with others; ``many``: over
    ``group`` kinds do. Written as a table."""
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(several, "h").select("first.k", F.struct("h", "s", "first.o", "first.at", (F.col("kinds") > group).alias("many")).alias("x"))
    todo = materialise(wanted.groupBy("k").agg(F.collect_list("x").alias("todo")), "todo")
    one = pick(docs.select("k", "t"), "k", todo).groupBy("k").agg(F.first("t").alias("t")).join(todo, "k")
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("o", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("windows", pa.int64()), ("many", pa.bool_()), ("raw", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            found = []
            for key, raw, todo in zip(batch.column("k").to_pylist(), texts(batch.column("t")), batch.column("todo").to_pylist(), strict=True):
                for x in todo:
                    first, n = x["at"] >> 16, x["at"] & 0xFFFF
                    found.append((x["h"], x["s"], x["o"], key, x["at"], n, x["many"], raw[first : first + n - 1 + length]))
                    if len(found) >= 10_000:
                        yield _batch(found, schema)
                        found.clear()
            if found:
                yield _batch(found, schema)

    made = one.mapInArrow(cut, "h bigint, s bigint, o bigint, k bigint, at bigint, windows bigint, many boolean, raw binary")
    return materialise(made, "strings")


def codes_in_groups(strings: DataFrame, n: int, short: int, length: int) -> DataFrame:
    """``h, s, codes`` from the previous factors in each group."""
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("codes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solved() -> list[tuple]:
            found = zip(held, group_codes([x[2] for x in held], [x[1] for x in held], short, length), strict=True)
            return [(at, x[0], c) for x, c in found if c]

        for batch in slices(batches, "raw"):
            out = []
            for h, s, w, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "windows", "raw")), strict=True):
                if h != at:
                    out += solved() if len(held) > 1 else []
                    at, held = h, []
                held.append((s, w, raw))
            if out:
                yield _batch(out, schema)
        if len(held) > 1 and (out := solved()):
            yield _batch(out, schema)

    dealt = strings.filter("NOT many").repartition(n, "h").sortWithinPartitions("h", "o", "k", "at")
    return dealt.select("h", "s", "windows", "raw").mapInArrow(run, "h bigint, s bigint, codes array<bigint>")


def codes_of_windows(strings: DataFrame, short: int, length: int) -> DataFrame:
    """``h, s, codes`` where each window is a group of its own."""
    names = ("h", "s", "o", "k", "at", "g", "w", "near")
    schema = pa.schema([(c, pa.int64()) for c in names[:-1]] + [("near", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw", 1 << 18):
            for h, s, o, k, at, w, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "o", "k", "at", "windows", "raw")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                for size, near in ((short, True), (length, False)):
                    m = min(w, len(raw) - size + 1)
                    if m > 0:
                        same = [pa.array([x] * m, pa.int64()) for x in (h, s, o, k)]
                        places = pa.array((np.int64(at >> 16) + np.arange(m)), pa.int64())
                        hashes = pa.array(gram_hashes(data, size).view(np.int64)[:m])
                        yield pa.RecordBatch.from_arrays([*same, places, hashes, pa.array(np.arange(m)), pa.array([near] * m)], schema=schema)

    windows = strings.filter("many").select("h", "s", "o", "k", "at", "windows", "raw")
    rows = windows.mapInArrow(run, "h bigint, s bigint, o bigint, k bigint, at bigint, g bigint, w bigint, near boolean")
    rows = materialise(rows, "windows")
    groups = rows.groupBy("h", "near", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "k", "at")).alias("least")).filter("n > 1")
    met = rows.join(groups, ["h", "near", "g"])
    first = (F.col("k") == F.col("least.k")) & (F.col("at") == F.col("least.at"))
    one = lambda kind: F.shiftleft("w", 20) + F.lit(1 << 2 | kind)
    codes = F.when(F.col("near"), F.array(one(NEAR))).when(first, F.array(one(AGAIN))).otherwise(F.array(one(AGAIN), one(LATER)))
    return met.groupBy("h", "s").agg(F.flatten(F.collect_list(codes)).alias("codes"))


def codes_of_texts(docs: DataFrame, length: int, short: int, gram: int, group: int) -> DataFrame:
    """``k, codes`` of every text ``i, k, t`` in which something occurs again. Written as a table."""
    spans = materialise(spans_of(docs, gram, short, length), "spans")
    kinds = materialise(spans.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "k", "at")).alias("first")), "kinds")
    strings = open_strings(docs, kinds, length, short, group)
    found = codes_in_groups(strings, partitions(docs.sparkSession), short, length).unionByName(codes_of_windows(strings, short, length))
    settled = materialise(kinds.join(materialise(found, "codes"), ["h", "s"], "left").filter("n > 1 OR codes IS NOT NULL"), "settled")
    here, n = F.shiftright("at", 16), F.col("at").bitwiseAND(0xFFFF)
    whole = lambda kind: F.shiftleft(here, 20) + F.shiftleft(n, 2) + F.lit(kind)
    none = F.array().cast("array<bigint>")
    own = F.transform(F.coalesce("codes", none), lambda c: c + F.shiftleft(here, 20))
    later = F.filter(own, lambda c: c.bitwiseAND(3) == LATER)
    first = (F.col("k") == F.col("first.k")) & (F.col("at") == F.col("first.at"))
    several = F.concat(F.array(whole(NEAR), whole(AGAIN)), F.when(first, later).otherwise(F.array(whole(LATER))))
    codes = spans.select("k", "at", "h", "s").join(settled, ["h", "s"]).select("k", F.when(F.col("n") > 1, several).otherwise(own).alias("codes"))
    return materialise(codes.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes")), "ranges")


def covered(codes: list[int], kind: int, size: int, total: int) -> list[tuple[int, int]]:
    """The runs of bytes that a kind's windows of ``size`` bytes cover in a text of ``total`` bytes."""
    spans = []
    for c in codes:
        if c & 3 == kind:
            first = c >> 20
            end = min(first + (c >> 2 & 0x3FFFF), total - size + 1)  # windows that reach beyond the text aren't any
            if end > first:
                spans.append((first, end - 1 + size))
    return merge(spans)


RUNS = "array<struct<first:bigint,end:bigint>>"


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int | None = None, group: int = GROUP) -> DataFrame:
    """A row for each row of ``df``: ``id, n_bytes, runs, kept, sha256, later, n_near, longest``.

    ``runs``: the maximal runs (array of ``first, end``) of bytes that are in a string of ``length`` bytes which starts
    elsewhere too; ``kept``: the other bytes, joined, null if that is the whole text, and ``sha256`` their digest.
    ``later``: the runs that have an earlier match, those to remove if the first copy is to stay. ``n_near``: bytes in
    strings of ``short`` bytes that start elsewhere too; ``longest``: the longest run of these."""
    small_batches(df.sparkSession)
    short = short or min(length, max(4, SHORT * length // LENGTH))
    gram = max(1, min(GRAM, short // 4))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("bigint").alias("i"), t.alias("t")).withColumn("k", F.xxhash64("t"))
    meta = docs.select("i", "k", F.octet_length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("sha"))
    meta = materialise(meta.withColumn("row", F.monotonically_increasing_id()), "texts")
    copies = meta.filter(F.col("n") >= short).groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("i", "row")).alias("first")).filter("c > 1")
    copies = materialise(copies.select("k", F.col("first.row").alias("first")), "copies")
    per_text = codes_of_texts(docs, length, short, gram, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        listed = lambda spans: [{"first": a, "end": b} for a, b in spans]
        for batch in slices(batches, "t"):
            out = []
            for key, raw, codes in zip(batch.column("k").to_pylist(), texts(batch.column("t")), batch.column("codes").to_pylist(), strict=True):
                runs = covered(codes, AGAIN, length, len(raw))
                near = [b - a for a, b in merge(covered(codes, NEAR, short, len(raw)) + runs)]
                edges = [0, *(x for ab in runs for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((key, listed(runs), kept if runs else None, hashlib.sha256(kept).hexdigest(), listed(covered(codes, LATER, length, len(raw))), sum(near), max(near, default=0)))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), kind, pa.binary(), pa.string(), kind, pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "runs", "kept", "sha256", "later", "n_near", "longest"])

    schema = f"k bigint, runs {RUNS}, kept binary, sha256 string, later {RUNS}, n_near bigint, longest bigint"
    one = pick(docs.select("k", "t"), "k", per_text).groupBy("k").agg(F.first("t").alias("t")).join(per_text, "k")
    some = materialise(one.select("k", "t", "codes").mapInArrow(run, schema), "cut")
    none = F.array().cast(RUNS)
    later_of = copies.join(some.select("k", F.col("later").alias("first_later")), "k", "left")
    flagged = (
        meta.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        .join(later_of.withColumns({"copy": F.lit(True), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))}), ["k", "salt"], "left")
        .select("i", "k", "n", "sha", "copy", (F.col("row") == F.col("first")).alias("is_first"), "first_later")
    )
    zero = F.lit(0).cast("bigint")
    singles = flagged.filter("copy IS NULL").join(some, "k", "left").select(
        "i", "n", F.coalesce("runs", none).alias("runs"), "kept", F.coalesce("sha256", "sha").alias("sha256"),
        F.coalesce("later", none).alias("later"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("longest", zero).alias("longest"),
    )
    whole = F.array(F.struct(zero.alias("first"), F.col("n").alias("end"))).cast(RUNS)
    long = F.col("n") >= length
    again = flagged.filter("copy").select(
        "i", "n", F.when(long, whole).otherwise(none).alias("runs"), F.when(long, F.lit(b"")).alias("kept"),
        F.when(long, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("sha256"),
        F.when(F.col("is_first"), F.coalesce("first_later", none)).when(long, whole).otherwise(none).alias("later"),
        F.col("n").alias("n_near"), F.col("n").alias("longest"),
    )
    return singles.unionByName(again).withColumnsRenamed({"i": "id", "n": "n_bytes"})
