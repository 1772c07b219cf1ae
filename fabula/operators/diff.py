"""Differences of two texts: shortest edit scripts, counts, unified hunks and previews.

``edits`` is the O(ND) search from both ends for a point on a shortest path, so it holds two arrays over diagonals and no
trace of the search, and goes on with the halves. Equal ends are cut off first and units that the other side doesn't have
are set aside; neither changes the number of edits. ``anchored`` also splits at units that both sides have once, the
longest run of them that both have in one order: for long texts of which most differs, and no longer the shortest script.
All diagonals of a step are moved together.

A pair is one row and is compared in its task; pairs are what Spark deals.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators.relational import slices

# fixed values: the mark between windows of a preview, characters of a preview, and lines of context that are tried
ELLIPSIS = "\n% --- 省略未改动内容 ---\n"
PREVIEW_CHARS = 20000
CONTEXTS = (120, 80, 40, 20, 10)

Edit = tuple[int, int, int, int]  # units [a, b) of the first become units [c, d) of the second


def _steps(v: np.ndarray, d: int, zero: int, n: int, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moves the furthest points of the diagonals that d edits reach (those of d - 1 are in ``v``); returns the diagonals.
    ``a`` and ``b`` are padded by RUN units that equal nothing, so that runs of equal units are followed RUN at a time."""
    k = np.arange(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2)
    before, after = v[zero + k - 1], v[zero + k + 1]
    right = np.where((before >= 0) & (before < n), before + 1, -1)
    down = np.where((after >= 0) & (after - k <= m), after, -1)
    x = np.maximum(right, down)  # -1 where no step leads
    live = np.flatnonzero(x >= 0)
    live = live[a[x[live]] == b[x[live] - k[live]]]
    while len(live):
        here, there = x[live, None] + _RUN, (x[live] - k[live])[:, None] + _RUN
        differ = a[here] != b[there]
        x[live] += np.where(differ.any(1), differ.argmax(1), RUN)
        live = live[~differ.any(1)]
    v[zero + k] = x
    return k


RUN = 48
_RUN = np.arange(RUN)


def _halfway(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point on a shortest path, about halfway."""
    n, m = len(a), len(b)
    zero = n + m + 2
    ahead, back = np.full(2 * zero + 1, -1, np.int64), np.full(2 * zero + 1, -1, np.int64)
    ahead[zero + 1] = back[zero + 1] = 0
    padded = lambda side, other: np.r_[side, np.full(RUN + 1, other)]
    forwards, backwards = (padded(a, -1), padded(b, -2)), (padded(a[::-1], -1), padded(b[::-1], -2))
    delta = n - m
    for d in range((n + m + 1) // 2 + 1):
        k = _steps(ahead, d, zero, n, m, *forwards)
        if delta % 2:
            near = k[np.abs(delta - k) <= d - 1]
            met = near[(ahead[zero + near] >= 0) & (back[zero + delta - near] >= 0) & (ahead[zero + near] + back[zero + delta - near] >= n)]
            if len(met):
                x = int(ahead[zero + met[0]])
                return x, x - int(met[0])
        k = _steps(back, d, zero, n, m, *backwards)
        if not delta % 2:
            near = k[np.abs(delta - k) <= d]
            met = near[(back[zero + near] >= 0) & (ahead[zero + delta - near] >= 0) & (back[zero + near] + ahead[zero + delta - near] >= n)]
            if len(met):
                x = int(back[zero + met[0]])
                return n - x, m - (x - int(met[0]))
    raise AssertionError("two searches that cover everything meet")


#: Products of lengths up to which a table of the longest common subsequences is quicker than the search.
SMALL = 2500


def _small(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence, by the whole table. A row of it is a number whose bit j is 0 where the
    subsequence grows with unit j of ``b``."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    whole = row = (1 << len(b)) - 1
    table = [row]
    for x in a:
        shared = row & at.get(x, 0)
        row = ((row + shared) | (row - shared)) & whole
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif (table[i - 1] & (1 << j) - 1).bit_count() <= (table[i] & (1 << j - 1) - 1).bit_count() + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _short(old: list, new: list) -> list[tuple[int, int]] | None:
    """The pairs of places that a shortest script keeps, if a table is all that it takes: most lines are short, and arrays cost
    more than they do."""
    shared = set(old).intersection(new)
    here, there = ([i for i, x in enumerate(side) if x in shared] for side in (old, new))
    a, b = [old[i] for i in here], [new[j] for j in there]
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = len(a) - tail, len(b) - tail
    if (x - head) * (y - head) > SMALL:
        return None
    inner = [(here[head + i], there[head + j]) for i, j in _small(a[head:x], b[head:y])] if x > head and y > head else []
    return [*zip(here[:head], there[:head], strict=True), *inner, *zip(here[x:], there[y:], strict=True)]


def _matches(a: np.ndarray, b: np.ndarray, at: int, to: int, out: list[tuple[int, int]]) -> None:
    """Appends the pairs of places that a shortest script keeps, in order."""
    todo = [(a, b, at, to)]
    while todo:
        a, b, at, to = todo.pop()
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        out += [(at + i, to + i) for i in range(head)]
        a, b, at, to = a[head:], b[head:], at + head, to + head
        n = min(len(a), len(b))
        if not n:
            continue
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        if tail:  # comes after what lies before it
            todo.append((a[len(a) - tail :], b[len(b) - tail :], at + len(a) - tail, to + len(b) - tail))
            a, b = a[: len(a) - tail], b[: len(b) - tail]
        if len(a) and len(b) and len(a) * len(b) <= SMALL:
            out += [(at + i, to + j) for i, j in _small(a.tolist(), b.tolist())]
        elif len(a) and len(b):
            x, y = _halfway(a, b)
            todo.append((a[x:], b[y:], at + x, to + y))
            todo.append((a[:x], b[:y], at, to))


def anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of units that are in each side once: the longest run of them that both have in one order."""
    once = []
    for side in (a, b):
        units, first, counts = np.unique(side, return_index=True, return_counts=True)
        once.append(dict(zip(units[counts == 1].tolist(), first[counts == 1].tolist(), strict=True)))
    shared = sorted((once[0][u], once[1][u]) for u in once[0].keys() & once[1].keys())
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = [-1] * len(shared)
    for i, (_, j) in enumerate(shared):
        k = bisect_left(ends, j)
        before[i] = at[k - 1] if k else -1
        ends[k : k + 1], at[k : k + 1] = [j], [i]
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(shared[i])
        i = before[i]
    return run[::-1]


def _long(old: list, new: list, anchored: bool) -> list[tuple[int, int]]:
    """The pairs of places that a script keeps, by the search."""
    codes: dict = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (old, new))
    kept: list[tuple[int, int]] = []
    splits = [*(anchors(a, b) if anchored else []), (len(a), len(b))]
    i = j = 0
    for x, y in splits:
        part, other = a[i:x], b[j:y]
        here, there = np.flatnonzero(np.isin(part, other)), np.flatnonzero(np.isin(other, part))
        found: list[tuple[int, int]] = []
        _matches(part[here], other[there], 0, 0, found)
        kept += [(i + int(here[p]), j + int(there[q])) for p, q in found]
        if (x, y) != (len(a), len(b)):
            kept.append((x, y))
        i, j = x + 1, y + 1
    return kept


def edits(old: list, new: list, anchored: bool = False) -> list[Edit]:
    """The edits of a shortest script from ``old`` to ``new``, in order and with units kept between any two."""
    kept = None if anchored else _short(old, new)
    if kept is None:
        kept = _long(old, new, anchored)
    out, i, j = [], 0, 0
    for x, y in [*kept, (len(old), len(new))]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def counts(found: list[Edit]) -> tuple[int, int]:
    """Units added and removed."""
    return sum(d - c for _, _, c, d in found), sum(b - a for a, b, _, _ in found)


def hunks(old: list[str], new: list[str], found: list[Edit], context: int = 3) -> str:
    """A unified diff without file names: edits no more than twice the context apart share a hunk."""
    groups: list[list[Edit]] = []
    for e in found:
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for group in groups:
        (a, _, c, _), (_, b, _, d) = group[0], group[-1]
        lead, trail = min(context, a), min(context, len(old) - b)
        spans = [(a - lead, b + trail), (c - lead, d + trail)]
        shown = [f"{x + (y > x)},{y - x}" if y - x != 1 else f"{x + 1}" for x, y in spans]
        out.append(f"@@ -{shown[0]} +{shown[1]} @@")
        at = a - lead
        for i, x, j, y in group:
            out += [" " + line for line in old[at:i]] + ["-" + line for line in old[i:x]] + ["+" + line for line in new[j:y]]
            at = x
        out += [" " + line for line in old[at : at + trail]]
    return "\n".join(out)


def windows(lines: list[str], spans: list[tuple[int, int]], context: int) -> str:
    """Lines around ``spans``, windows that touch joined."""
    found: list[list[int]] = []
    for first, end in sorted(spans):
        first, end = max(0, first - context), min(len(lines), end + context)
        if found and first <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([first, end])
    if not found:
        return "\n".join(lines[: 2 * context])
    return ELLIPSIS.join("\n".join(lines[a:b]) for a, b in found)


def middle_out(text: str, most: int) -> str:
    """A text's beginning and end where it is longer than ``most``."""
    return text if len(text) <= most else f"{text[: most // 2]}{ELLIPSIS}{text[-(most - most // 2) :]}"


def preview(old: str, new: str, found: list[Edit], most: int = PREVIEW_CHARS) -> tuple[str, str, bool]:
    """Both texts as they are if neither is longer than ``most``; else what lies around their edits, with as many lines of
    context as fit; else their beginnings and ends. And whether anything was left out."""
    if max(len(old), len(new)) <= most:
        return old, new, False
    lines = old.splitlines(), new.splitlines()
    spans = [(a, b) for a, b, _, _ in found], [(c, d) for _, _, c, d in found]
    for context in CONTEXTS:
        shown = [windows(x, y, context) for x, y in zip(lines, spans, strict=True)]
        if max(map(len, shown)) <= most:
            return *shown, True
    return middle_out(old, most), middle_out(new, most), True


SCHEMA = "added bigint, removed bigint, unified string, old_preview string, new_preview string, truncated boolean"


def line_diffs(pairs: DataFrame, old: str, new: str, context: int = 3, most: int = PREVIEW_CHARS, anchored: bool = False) -> DataFrame:
    """``pairs`` with the columns of SCHEMA; a null text is an empty one. A task holds the results of a megabyte of texts."""
    names, kinds = [c.split()[0] for c in SCHEMA.split(", ")], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, (old, new)):
                rows = []
                for x, y in zip(part.column(old), part.column(new), strict=True):
                    x, y = x.as_py() or "", y.as_py() or ""
                    lines = x.splitlines(), y.splitlines()
                    found = edits(*lines, anchored=anchored)
                    rows.append((*counts(found), hunks(*lines, found, context), *preview(x, y, found, most)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(compare, f"{given}, {SCHEMA}")


def word_changes(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``changes``: each edit of the texts' words as what went and what came, and its place in words."""

    kind = pa.struct([("at", pa.int32()), ("went", pa.string()), ("came", pa.string())])

    @F.arrow_udf("array<struct<at:int,went:string,came:string>>")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        ends, places, went, came = [0], [], [], []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = (x or "").split(), (y or "").split()
            for i, p, j, q in edits(x, y):
                places.append(i)
                went.append(" ".join(x[i:p]))
                came.append(" ".join(y[j:q]))
            ends.append(len(places))
        changes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((places, went, came), kind, strict=True)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), changes)

    return pairs.withColumn("changes", compare(old, new))
