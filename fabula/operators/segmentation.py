"""Words in runs of letters without spaces, by a dictionary: longest matches from both ends, and a search where they differ.

A dictionary is a table of terms with frequencies, at most MOST_TERMS of them, as it goes with every task; ``dictionary``
makes one of the most frequent words of a corpus. A run is cut by the longest term at each place from the front, and from
the back. Places at which both cut divide it into stretches; where both agree on a stretch that is its cut, and else the
most probable cut of the stretch is (terms are independent, and a character that no term begins at is a term of its own).
The search goes over a stretch's places and terms' lengths, so it is bounded by both.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.operators.relational import slices

MOST_TERMS = 200_000


def dictionary(words: DataFrame, most: int = MOST_TERMS, least: int = 2) -> DataFrame:
    """``term, freq``: the ``most`` most frequent of the words (term) that occur ``least`` times, ties by term."""
    counts = words.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    return counts.filter(F.col("freq") >= least).orderBy(F.desc("freq"), "term").limit(most)


class Trie:
    """Terms by their characters, in both directions, with their log probabilities."""

    def __init__(self, terms: dict[str, float]):
        total = math.log(sum(terms.values()) or 1.0)
        self.weight = {t: math.log(f) - total for t, f in terms.items() if t and f > 0}
        self.unknown = min(self.weight.values(), default=0.0) - math.log(10)
        self.forward: dict = {}
        self.backward: dict = {}
        for term in self.weight:
            for root, order in ((self.forward, term), (self.backward, term[::-1])):
                node = root
                for c in order:
                    node = node.setdefault(c, {})
                node[""] = self.weight[term]

    def from_front(self, run: str) -> list[int]:
        """Ends of the longest matches."""
        ends, at, n, root = [], 0, len(run), self.forward
        while at < n:
            node, k, end = root, at, at + 1
            while k < n:
                node = node.get(run[k])
                if node is None:
                    break
                k += 1
                if "" in node:
                    end = k
            at = end
            ends.append(at)
        return ends

    def from_back(self, run: str) -> list[int]:
        ends, at, root = [], len(run), self.backward
        while at > 0:
            ends.append(at)
            node, k, start = root, at, at - 1
            while k > 0:
                node = node.get(run[k - 1])
                if node is None:
                    break
                k -= 1
                if "" in node:
                    start = k
            at = start
        return ends[::-1]

    def best(self, run: str, whole: bool = True) -> list[int] | None:
        """Ends of the most probable cut, of equal ones that of fewer terms and then of the longer first term. With ``whole``
        false the run itself isn't a term and unknown characters aren't allowed."""
        n, root, unknown = len(run), self.forward, self.unknown
        scores, terms, to = [0.0] * (n + 1), [0] * (n + 1), [n] * (n + 1)  # of the rest of the run from a place on; to: -1 if it has no cut
        for at in range(n - 1, -1, -1):
            node, k, top, fewest, end, single = root, at, 0.0, 0, -1, False
            last = n if whole or at else n - 1
            while k < last:
                node = node.get(run[k])
                if node is None:
                    break
                k += 1
                w = node.get("")
                if w is None:
                    continue
                single = single or k == at + 1
                if to[k] < 0:
                    continue
                w += scores[k]
                if end < 0 or w > top or (w == top and terms[k] <= fewest):
                    top, fewest, end = w, terms[k], k
            if whole and not single and to[at + 1] >= 0:
                w = scores[at + 1] + unknown
                if end < 0 or w > top or (w == top and terms[at + 1] < fewest):
                    top, fewest, end = w, terms[at + 1], at + 1
            scores[at], terms[at], to[at] = top, fewest + 1, end
        if to[0] < 0:
            return None
        ends, at = [], 0
        while at < n:
            at = to[at]
            ends.append(at)
        return ends

    def cut(self, run: str) -> tuple[list[str], list[str]]:
        """The terms of a run, and the stretches for which both directions differed."""
        front, back = self.from_front(run), self.from_back(run)
        out, unclear, start, i, j, p, q = [], [], 0, 0, 0, 0, 0
        while i < len(front):
            if front[i] != back[j]:
                if front[i] < back[j]:
                    i += 1
                else:
                    j += 1
                continue
            end, i, j = front[i], i + 1, j + 1
            a, b, p, q = front[p:i], back[q:j], i, j
            if a != b:
                stretch = run[start:end]
                unclear.append(stretch)
                a = [start + x for x in self.best(stretch)]
            for x in a:
                out.append(run[start:x])
                start = x
        return out, unclear

    def fine(self, term: str) -> list[str]:
        """A term cut into smaller ones of the dictionary, or itself if it can't be."""
        ends = self.best(term, whole=False) if len(term) > 1 else None
        return [term[a:b] for a, b in zip([0, *ends], ends, strict=False)] if ends else [term]


#: The trie that a worker made last, by its dictionary's name, and terms that it has cut further: tasks that a worker runs one
#: after the other share them.
_TRIES: dict[str, tuple[Trie, dict[str, list[str]]]] = {}


def _of_worker(name: str, table: Broadcast) -> tuple[Trie, dict[str, list[str]]]:
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(table.value), {}
    return _TRIES[name]


def segmented(df: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """``df`` with ``tokens`` (the run's terms), ``fine`` (those cut further) and ``unclear`` (stretches that were searched) of
    ``column``; a null run has none. ``terms``: term, freq, MOST_TERMS at most; more are an error, not cut off."""
    rows = terms.select("term", F.col("freq").cast("double").alias("freq")).limit(MOST_TERMS + 1).toPandas()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a dictionary of more than {MOST_TERMS} terms doesn't go with every task")
    table = df.sparkSession.sparkContext.broadcast(dict(zip(rows["term"], rows["freq"], strict=True)))
    names, name = df.columns, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = _of_worker(name, table)
        for part in (part for batch in batches for part in slices(batch, [column])):
            found = [trie.cut(x or "") for x in part.column(column).to_pylist()]
            fine = []
            for tokens, _ in found:
                pieces = []
                for t in tokens:
                    if t not in held:
                        if len(held) > MOST_TERMS:
                            held.clear()
                        held[t] = trie.fine(t)
                    pieces += held[t]
                fine.append(pieces)
            lists = [pa.array(x, pa.list_(pa.string())) for x in ([t for t, _ in found], fine, [u for _, u in found])]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*names, "tokens", "fine", "unclear"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, tokens array<string>, fine array<string>, unclear array<string>")
