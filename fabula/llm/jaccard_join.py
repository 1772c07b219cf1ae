"""N-gram Jaccard join: which documents' shingle sets overlap by a Jaccard similarity of ``percent`` (85 % unless said
otherwise) or more, and the components that these links make. No link between different sets is lost.

1. Ranks. Tasks send sorted hashes, packed, to ranges of the hash space, which count in how many documents each shingle
   occurs. Two bitmaps of fixed size, broadcast, tell those in few documents from those in more and in many.
2. Signatures. A second scan gives each document the size of its set, a digest of the set (equal sets are one class from
   here on), a hashed bitmap of the set, and its prefix.
3. Prefixes. All sets are ordered alike, by rank, so that frequent shingles come last. Two sets of sizes n and m that link share a shingle
   among the first ``n - ceil(percent n) + 1`` of either, so only those shingles are posted, and only where the places
   that it has in both sets allow a link. The order changes how many meet, never which links are found.
4. Blocks. Each class goes once, with its text, to a block of its most crowded bucket, where sets meet exactly and links
   that connect are kept. Two turns of this, dealt differently, join large groups of near copies without listing pairs.
5. Tiles. What is left are buckets whose classes are in different components. A bucket is cut by set size into bands and
   those into tiles; tiles of neighbouring bands meet in a group of bounded size. Of two sets of different components, the
   places of the shared shingle bound the overlap from above, and so do bit counts of the bitmaps. Crowded buckets do this
   and 6 with a few classes of each component first: two large components that link become one there, so their classes
   needn't all be paired when every posting is taken.
6. Exact check. Partners' sets, sorted arrays of 64-bit hashes computed again from the texts, are streamed past each
   other and intersected. Links give components by alternating small and large stars.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle has is one shingle; a null id is a document like others but never a component's id if there is
another; rows that share an id are different documents of one component if they link; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import materialise, partitions, pick, slices, small_batches, texts

NGRAM, PERCENT = 4, 85
#: Bits of the bitmaps that rank shingles by frequency.
SLOTS = 1 << 27
#: In buckets of so many classes each posting is judged by all others.
FEW = 64
#: How often blocks of about so many shingles are dealt, and about how many classes a tile has.
TURNS, BLOCK, TILE = 2, 65_536, 256
#: Where a bucket has over CROWD classes of one component, its components meet by BRIDGES classes each before all do.
CROWD, BRIDGES = 64, 8
#: How many partners a class meets in one group of the exact check.
PER_GROUP = 500
#: Bytes of text whose sets a task holds at once.
SLICE = 1 << 20
SALTS = 16
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class WordHashes(dict):
    """Numbers words; ``values`` has their hashes. Long words are numbered anew each time and not held."""

    LIMIT, LONG = 1 << 17, 256

    def __init__(self):
        super().__init__()
        self.values, self.n = np.zeros(self.LIMIT, np.uint64), 0

    def clear(self) -> None:
        super().clear()
        self.n = 0

    def __missing__(self, word: bytes) -> int:
        code = self.n
        self.n += 1
        if code >= len(self.values):  # only within one batch
            self.values = np.concatenate([self.values, np.zeros(len(self.values), np.uint64)])
        self.values[code] = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONG:
            self[word] = code
        return code


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[0]
    h = (h ^ (h >> np.uint64(29))) * _M[1]
    return h ^ (h >> np.uint64(32))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc += h[j : len(h) - width + 1 + j] * _M[j]
    return _mix(acc)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(raws: list[bytes], words: WordHashes, ngram: int = NGRAM) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct ``ngram``-word shingles, A-Z in lower case."""
    if words.n >= words.LIMIT:
        words.clear()
    found = [x.lower().split() for x in raws]
    codes = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
    h = words.values[codes]
    all_, at, out = _windows(h, ngram) if len(h) >= ngram else h[:0], 0, []
    for n in map(len, found):
        own = all_[at : at + n - ngram + 1] if n >= ngram else _windows(h[at : at + n], n) if n else h[:0]
        out.append(_distinct(own))
        at += n
    return out


def shingle_set(raw: bytes, words: WordHashes, ngram: int = NGRAM) -> np.ndarray:
    return shingle_sets([raw], words, ngram)[0]


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of size n with any set that it links with."""
    return -(-percent * n // 100)


def links(n: int, m: int, shared: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def alone(n: int, percent: int = PERCENT) -> bool:
    """Whether sets of size n link with equal sets only."""
    return least_overlap(n, percent) == n and not links(n, n + 1, n, percent)


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of a power of two bits, twice the set's size at least. It travels with each of a class's postings that are
    left to the tiles, so it is small; pairs that it lets pass are counted and then compared exactly."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(8)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, size: int, to: int) -> int:
    """The bitmap of ``size`` bits as one of ``to`` bits; both are powers of two."""
    while size > to:
        size //= 2
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


def overlap_bound(n: int, a: tuple[int, int], m: int, b: tuple[int, int]) -> int:
    """What two sets of sizes n and m, with bitmaps (bits, size), may share at most."""
    size = min(a[1], b[1])
    x, y = fold(*a, size), fold(*b, size)
    both = x & y
    return min(n - (x ^ both).bit_count(), m - (y ^ both).bit_count())


def _scan(docs: DataFrame, run, schema: str) -> DataFrame:
    return docs.select(F.col("i"), F.col("t")).mapInArrow(run, schema)


def class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _place(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of the hash space and the low half of each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)


class Ranks:
    """How frequent shingles are, in bitmaps of SLOTS bits, whatever the corpus: 0, 1 and 2 for those in few, more and many
    documents. Two shingles of one slot rank alike, which is no harm: sets need only agree on the order."""

    def __init__(self, ranges: int):
        self.ranges, self.width = ranges, max(8, SLOTS // ranges // 8 * 8)
        self.bitmaps: list[np.ndarray] = []

    def slots(self, low: np.ndarray) -> np.ndarray:
        """Places in a range's part of the bitmap."""
        return (low.astype(np.uint64) * np.uint64(self.width)) >> np.uint64(32)

    def add(self, parts: list[tuple[int, bytes]]) -> None:
        bits = np.zeros(self.ranges * self.width // 8, np.uint8)
        for r, data in parts:
            bits[r * self.width // 8 : (r + 1) * self.width // 8] = np.frombuffer(data, np.uint8)
        self.bitmaps.append(bits)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        r, low = _place(hashes, self.ranges)
        slot = r * np.uint64(self.width) + self.slots(low)
        byte, bit = (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)
        out = np.zeros(len(hashes), np.uint8)
        for bits in self.bitmaps:
            out += (bits[byte] >> bit) & 1
        return out


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the byte planes of their differences, compressed."""
    planes = np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def learn_ranks(docs: DataFrame, ranges: int, ngram: int = NGRAM, percent: int = PERCENT) -> Ranks:
    """Counts in how many documents each shingle occurs and ranks them: 1 from the least power of two on that leaves an eighth
    of the slots taken at most, 2 from sixteen times as many on."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHashes(), [], 0

        def packed() -> pa.RecordBatch:
            r, low = _place(np.concatenate(held), ranges)
            slots = np.sort((r << np.uint64(32)) | low)
            cuts = np.searchsorted(slots, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
            rows = [(r, int(b - a), _pack((slots[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32))) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["r", "n", "data"])

        for batch in slices(batches, "t", SLICE):
            for s in shingle_sets(texts(batch.column("t")), words, ngram):
                if len(s) and not alone(len(s), percent):
                    held.append(s)
                    size += len(s)
            if size > 1_500_000:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ranks = None, [], Ranks(ranges)

        def counted() -> Iterator[pa.RecordBatch]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            slots = ranks.slots(values).astype(np.int64)
            for level in range(1, int(n.max()).bit_length()):
                bits = np.zeros(ranks.width, bool)
                bits[slots[n >= 1 << level]] = True
                row = [at], [level], [int(bits.sum())], [np.packbits(bits, bitorder="little").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["r", "level", "taken", "bits"])

        for batch in batches:
            for r, n, data in zip(*(batch.column(c).to_pylist() for c in ("r", "n", "data")), strict=True):
                if r != at and held:
                    yield from counted()
                    held = []
                at = r
                held.append(_unpack(data, n))
        if held:
            yield from counted()

    sent = _scan(docs, send, "r int, n int, data binary").repartition(ranges, "r").sortWithinPartitions("r")
    levels = materialise(sent.mapInArrow(count, "r int, level int, taken bigint, bits binary"), "frequent")
    taken = {x["level"]: x["taken"] for x in levels.groupBy("level").agg(F.sum("taken").alias("taken")).collect()}
    ranks = Ranks(ranges)
    first = min((k for k, n in taken.items() if n <= SLOTS / 8), default=None)
    for level in (first, first + 4) if first is not None else ():
        ranks.add([(x["r"], bytes(x["bits"])) for x in levels.filter(F.col("level") == level).select("r", "bits").collect()])
    return ranks


def signatures(docs: DataFrame, ranks: Ranks, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``i, h, n, cls, sig, toks, cold`` of each document: hash of its text, set size, class (null for an empty set), bitmap,
    and the shingles of its prefix, of which the first ``cold`` aren't frequent. A task gives a class's bitmap and prefix
    once as long as it remembers the class. Written as a table."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks, seen = WordHashes(), shared.value, set()

        def prefix(s: np.ndarray, c: int | None) -> tuple[bytes | None, np.ndarray | None, int]:
            n = len(s)
            if not n or alone(n, percent) or c in seen:
                return None, None, 0
            if len(seen) > 100_000:
                seen.clear()
            seen.add(c)
            rank = ranks.of(s)
            taken = n - least_overlap(n, percent) + 1
            order = np.argsort(rank, kind="stable")[:taken]
            return signature(s), s[order].view(np.int64), int((rank[order] < 2).sum())

        for batch in slices(batches, "t", SLICE):
            sets = shingle_sets(texts(batch.column("t")), words, ngram)
            classes = [class_of(s) if len(s) else None for s in sets]
            sigs, toks, cold = zip(*(prefix(s, c) for s, c in zip(sets, classes, strict=True)), strict=True)
            columns = [
                batch.column("i"), batch.column("h"), pa.array([*map(len, sets)], pa.int64()), pa.array(classes, pa.int64()),
                pa.array(sigs, pa.binary()), pa.array(toks, pa.list_(pa.int64())), pa.array(cold, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["i", "h", "n", "cls", "sig", "toks", "cold"])

    schema = "i bigint, h bigint, n bigint, cls bigint, sig binary, toks array<bigint>, cold int"
    return materialise(docs.select("i", "t", F.xxhash64("t").alias("h")).mapInArrow(run, schema), "signatures")


def shared_postings(signed: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """``tok, cls, n, pos``: the distinct postings that may be the first common shingle of two classes that link, by the
    places it has in both (``allowed``). Frequent shingles aren't gathered and all stay, as do those of buckets of over
    FEW classes. Written as a table."""
    posted = signed.filter("toks IS NOT NULL").select("cls", F.col("n").cast("int").alias("n"), "cold", F.posexplode("toks").alias("pos", "tok"))
    bucket = Window.partitionBy("tok").orderBy("cls")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = posted.filter("pos < cold").repartition(n, "tok").select(
        "tok", "cls", "n", "pos", F.lag("cls").over(bucket).alias("before"), F.first("cls").over(whole).alias("lo"), F.last("cls").over(whole).alias("hi")
    )
    rare = rare.filter("lo <> hi AND (before IS NULL OR before <> cls)").select("tok", "cls", "n", "pos", F.row_number().over(bucket).alias("r"))
    some = F.when(F.col("r") <= FEW, F.struct("cls", "n", "pos"))
    rare = rare.select("*", F.max("r").over(whole).alias("m"), F.collect_list(some).over(whole).alias("bucket"))
    least = f"({percent} * (n + x.n) + {99 + percent}) div {100 + percent}"
    meets = f"x -> x.cls <> cls AND n - pos >= {least} AND x.n - x.pos >= {least} AND 100 * least(n, x.n) >= {percent} * greatest(n, x.n)"
    rare = rare.filter(f"m > {FEW} OR exists(bucket, {meets})").select("tok", "cls", "n", "pos")
    frequent = posted.filter("pos >= cold").select("tok", "cls", "n", "pos").distinct()
    return materialise(rare.unionByName(frequent), "postings")


def open_postings(postings: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``tok, cls, n, pos, comp`` of the buckets that hold more than one component, and those buckets' ``tok, m, big, k``: m
    classes, k of them in the component ``big``, the largest. Both written as tables."""
    rows = postings.withColumn("comp", F.col("cls")) if labels is None else postings.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = rows.select("tok", "cls", "n", "pos", "comp")
    parts = rows.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k"))
    ends = parts.groupBy("tok").agg(F.sum("k").alias("m"), F.max_by("comp", F.struct("k", "comp")).alias("big"), F.max("k").alias("k"))
    ends = materialise(ends.filter("m > k"), "buckets")
    return materialise(rows.join(ends.select("tok"), "tok", "left_semi"), "open"), ends


def candidate_texts(docs: DataFrame, signed: DataFrame, postings: DataFrame) -> DataFrame:
    """``cls, t``: one text of each class with shared postings. Equal texts of a task meet before they are shuffled. Written
    as a table."""
    wanted = signed.filter("toks IS NOT NULL").join(postings.select("cls").distinct(), "cls", "left_semi")
    wanted = materialise(wanted.groupBy("cls").agg(F.min("h").alias("h")), "wanted")
    keyed = docs.select(F.xxhash64("t").alias("h"), "t")
    some = pick(keyed, "h", wanted).groupBy("h").agg(F.first("t").alias("t"))
    return materialise(some.join(wanted, "h").select("cls", "t"), "candidates")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share, by a product of the incidence matrix of those in two sets or more."""
    all_ = np.concatenate(sets)
    _, at, times = np.unique(all_, return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    several = times[at] > 1
    if not several.any():
        return np.zeros((len(sets), len(sets)), np.int64)
    _, column = np.unique(at[several], return_inverse=True)
    own, columns, total = own[several], int(column.max()) + 1, np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 20) // len(sets))
    for lo in range(0, columns, width):
        inside = (column >= lo) & (column < lo + width)
        part = np.zeros((len(sets), min(width, columns - lo)), np.float32)  # sums of ones are exact up to 2 ** 24
        part[own[inside], column[inside] - lo] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def forest(linked: np.ndarray, comps: list[int]) -> list[tuple[int, int]]:
    """Links that connect what ``linked`` (a symmetric matrix) connects beside what is in one component already."""
    parent: dict[int, int] = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        x, y = root(comps[a]), root(comps[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def block_links(postings: DataFrame, ends: DataFrame, candidates: DataFrame, n: int, turn: int, ngram: int, percent: int) -> DataFrame:
    """Links ``a, b`` found in blocks, enough to connect what links in a block. Written as a table.

    Each class goes, with its text, to one block of its most crowded bucket. Blocks are dealt by a hash that differs from
    turn to turn and hold about BLOCK shingles and TILE classes at most, so a bucket of any size is compared in time in proportion to it. This
    only joins large groups early, to leave few components to the tiles, which miss nothing."""
    crowded = postings.join(ends.select("tok", "m"), "tok").groupBy("cls").agg(
        F.max_by("tok", F.struct("m", "tok")).alias("home"), F.first("n").alias("n"), F.first("comp").alias("comp")
    )
    crowded = materialise(crowded, "homes")
    dealt_to = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count(F.lit(1)) / TILE)).cast("int")
    blocks = crowded.groupBy("home").agg(dealt_to.alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    if turn:
        blocks = blocks.filter("g > 1")  # a bucket of one block has been through
    dealt = crowded.join(blocks.select("home", "g"), "home").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("g")).cast("int"))
    rows = dealt.select("home", "block", "cls", "comp").join(candidates, "cls").repartition(n, "home", "block").sortWithinPartitions("home", "block", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key, held = WordHashes(), None, []

        def found() -> Iterator[pa.RecordBatch]:
            if len({comp for _, comp, _ in held}) < 2:
                return
            sets = [s for _, _, s in held]
            sizes, shared = np.array([*map(len, sets)]), shared_counts(sets)
            linked = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
            out = [(held[a][0], held[b][0]) for a, b in forest(linked, [comp for _, comp, _ in held])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        for batch in slices(batches, "t", SLICE):
            sets = shingle_sets(texts(batch.column("t")), words, ngram)
            for home, block, cls, comp, s in zip(*(batch.column(c).to_pylist() for c in ("home", "block", "cls", "comp")), sets, strict=True):
                if (home, block) != key:
                    yield from found()
                    key, held = (home, block), []
                held.append((cls, comp, s))
        yield from found()

    return materialise(rows.mapInArrow(run, "a bigint, b bigint"), "block-links")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``cls, comp`` for every class of the edges ``a, b``; ``comp`` is the component's least class.

    Alternates large stars (neighbours above a node are tied to its least neighbour) and small stars (those below) until all
    are stars; each step is written as a table, so that none is planned or computed again inside the next."""
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    ends = F.inline(F.array(F.struct(F.col("u").alias("w"), F.col("v").alias("m"), F.lit(1).alias("up")), F.struct(F.col("v").alias("w"), F.col("v").alias("m"), F.lit(0).alias("up"))))
    for _ in range(max_rounds):
        # a node's least neighbour, if that is below it, and how often it is an edge's upper and lower end
        nodes = materialise(now.select(ends).groupBy("w").agg(F.min("m").alias("m"), F.sum("up").alias("ups"), F.sum(1 - F.col("up")).alias("downs")), "nodes")
        if nodes.filter("ups > 1 OR (ups = 1 AND downs > 0)").isEmpty():
            break
        large = now.join(nodes.select(F.col("w").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).distinct()
        large = materialise(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        now = materialise(tied.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ones = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("cls"), "comp")
    return materialise(ones.unionByName(now.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()).groupBy("cls").agg(F.min("comp").alias("comp")), "components")


def allowed(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes n and m may link if ``at`` and ``to`` are the places of their first common shingle: what comes
    before it is in one of them only."""
    least = -(-percent * (n + m) // (100 + percent))
    return (n - at >= least) & (m - to >= least)


def tile_pairs(postings: DataFrame, ends: DataFrame, signed: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """``a < b``: distinct pairs of classes of different components that may link by the places of a shingle in their
    prefixes and by their bitmaps. Written as a table.

    The classes of a bucket's largest component make passive tiles, the others active ones; both hold classes of like size,
    about TILE of them. An active tile meets all tiles of like sizes, passive ones don't meet each other."""
    one = signed.filter("toks IS NOT NULL").groupBy("cls").agg(F.first("sig").alias("sig"))
    band = F.floor(F.log("n") / (1e-6 - math.log(percent / 100))).cast("int")  # sets two bands apart can't link
    rows = postings.join(ends.select("tok", "big"), "tok").withColumns({"active": F.col("comp") != F.col("big"), "band": band})
    bands = rows.groupBy("tok", "band", "active").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("g"))
    of = lambda name, where: bands.filter(where).select("tok", F.col("band").alias(f"{name}_band"), F.col("g").alias(f"{name}_g"))
    # pairs of bands with an active side; the first is active, and if both are, the lower
    x, y = of("x", "active"), bands.select("tok", F.col("band").alias("y_band"), F.col("g").alias("y_g"), F.col("active").alias("y_active"))
    near = x.join(y, "tok").filter((F.abs(F.col("x_band") - F.col("y_band")) <= 1) & (~F.col("y_active") | (F.col("x_band") <= F.col("y_band"))))
    near = materialise(near, "bands")
    tile = lambda g: F.pmod(F.xxhash64("cls"), F.col(g)).cast("int")
    key = ["tok", "x_band", "y_band", "y_active"]
    all_of = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    first = rows.filter("active").join(near.withColumnRenamed("x_band", "band"), ["tok", "band"]).withColumn("x_band", F.col("band"))
    first = first.select(*key, tile("x_g").alias("p"), all_of("y_g").alias("q"), "cls", "n", "pos", "comp", F.lit(0).alias("side"))
    second = rows.withColumn("y_active", F.col("active")).join(near.withColumn("band", F.col("y_band")), ["tok", "band", "y_active"])
    second = second.select(*key, all_of("x_g").alias("p"), tile("y_g").alias("q"), "cls", "n", "pos", "comp", F.lit(1).alias("side"))
    both = first.unionByName(second).filter("NOT y_active OR x_band < y_band OR p <= q")  # a band with itself: half of its tiles
    met = both.join(one, "cls").repartition(n, *key, "p", "q").sortWithinPartitions(*key, "p", "q", "side", "cls")
    names = [*key, "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, ([], []), set()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
            found.clear()
            return out

        def compare() -> Iterator[pa.RecordBatch]:
            xs, ys = held
            if not xs or not ys:
                return
            cls, size, pos, comp = (np.array([r[k] for r in ys], np.int64) for k in range(4))
            for a, n, place, own, bits in xs:
                ok = allowed(np.int64(n), np.int64(place), size, pos, percent) & (comp != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                for k in np.flatnonzero(ok).tolist():
                    _, m, _, _, others = ys[k]
                    if links(n, m, overlap_bound(n, bits, m, others), percent):
                        b = ys[k][0]
                        found.add((a, b) if a < b else (b, a))
                if len(found) > 50_000:
                    yield batch_of()

        for batch in slices(batches, "sig", SLICE):
            for *group, side, cls, n, pos, comp, sig in zip(*(batch.column(c).to_pylist() for c in (*names, "side", "cls", "n", "pos", "comp", "sig")), strict=True):
                if group != at:
                    yield from compare()
                    at, held = group, ([], [])
                held[side].append((cls, n, pos, comp, (int.from_bytes(sig, "little"), 8 * len(sig))))
        yield from compare()
        if found:
            yield batch_of()

    return materialise(met.select(*names, "side", "cls", "n", "pos", "comp", "sig").mapInArrow(run, "a bigint, b bigint").distinct(), "tile-pairs")


def bridge_postings(postings: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each component BRIDGES postings, other ones in each bucket, for buckets that hold over CROWD classes of one
    component. Written as a table. Links found among these only spare work, as all postings are taken afterwards."""
    dealt = Window.partitionBy("tok", "comp").orderBy(F.xxhash64("tok", "cls"), "cls")
    crowded = postings.join(ends.filter(F.col("k") > CROWD).select("tok"), "tok", "left_semi")
    return materialise(crowded.withColumn("r", F.row_number().over(dealt)).filter(F.col("r") <= BRIDGES).drop("r"), "bridges")


def verify(candidates: DataFrame, pairs: DataFrame, n: int, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` of classes that link, by intersection of their sorted arrays. Written as a table.

    ``a``'s text comes first in its group and ``b``'s stream past it; sets are computed there, texts being smaller than
    sets. A class with many partners is copied to several groups."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).cast("int").alias("g"))
    seconds = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("g")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("cls"))
    firsts = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("cls"))
    rows = firsts.unionByName(seconds).join(candidates, "cls").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role", "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mine = WordHashes(), None
        for batch in slices(batches, "t", SLICE):
            out, sets = [], shingle_sets(texts(batch.column("t")), words, ngram)
            for a, role, cls, s in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "cls")), sets, strict=True):
                if role == 0:
                    mine = s
                    continue
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                if links(len(mine), len(s), int((mine[at] == s).sum()), percent):
                    out.append((a, cls))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return materialise(rows.select("a", "role", "cls", "t").mapInArrow(compare, "a bigint, b bigint"), "links")


def class_links(docs: DataFrame, signed: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` between classes, enough to connect all that link."""
    n = partitions(docs.sparkSession)
    postings, ends = open_postings(shared_postings(signed, n, percent), None)
    candidates, found = candidate_texts(docs, signed, postings), None
    for turn in range(TURNS):
        more = block_links(postings, ends, candidates, n, turn, ngram, percent)
        found = more if found is None else found.unionByName(more)
        postings, ends = open_postings(postings.drop("comp"), components(found))
    some = bridge_postings(postings, ends)
    if not some.isEmpty():
        theirs = signed.join(some.select("cls").distinct(), "cls", "left_semi")
        found = found.unionByName(verify(candidates, tile_pairs(some, ends, theirs, n, percent), n, ngram, percent))
        postings, ends = open_postings(postings.drop("comp"), components(found))
    return found.unionByName(verify(candidates, tile_pairs(postings, ends, signed, n, percent), n, ngram, percent))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, hash_col: str | None = None, group_col: str | None = None) -> DataFrame:
    """A row for each row of ``df``: ``doc_id, n_shingles, component_id`` and, if named, ``hash_col``, the xxhash64 of its
    text, which tells rows of one id apart, and ``group_col``, a number of its component, null if it has but this row."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    signed = signatures(docs, learn_ranks(docs, partitions(df.sparkSession), ngram, percent), ngram, percent)
    labels = components(class_links(docs, signed, ngram, percent))
    classes = signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("k"))
    tied = classes.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = tied.groupBy("comp").agg(F.min("least").alias("component"), F.sum("k").alias("k")).filter("k > 1").select("comp", "component")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    answers = tied.join(least, "comp").select("cls", "component", "comp", copies)
    salted = signed.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
    return salted.join(answers, ["cls", "salt"], "left").select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "i").alias("component_id"), *([F.col("h").alias(hash_col)] if hash_col else []),
        *([F.col("comp").alias(group_col)] if group_col else []),
    )
