"""Chunkers as table functions for SQL: beside a row by ``LATERAL``, or over a partitioned table.

``register`` makes ``recursive_chunks(text, target, overlap)``, ``sliding_chunks(text, size, overlap)`` and
``semantic_chunks(text, target, most, threshold)`` known to a session, each with rows ``chunk, start, piece`` (``start`` in
characters; in sentences for cuts by meaning), and ``budget_merge(TABLE(…) PARTITION BY doc_id ORDER BY pos)`` over columns
``doc_id, pos, text, budget``, which joins the texts of a partition until a chunk is over its budget of words. That one
streams: it holds the chunk that it is filling. A null text has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from fabula.operators import structure

PIECES = "chunk int, start int, piece string"
#: Ends of sentences and lines, as ``fabula.functions.text.sentences`` has them.
SENTENCE_ENDS = re.compile(r"(?<=[。！？!?.])\s+|\n+")


class RecursiveChunks:
    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        for k, (start, piece) in enumerate(structure.recursive_chunks(text or "", target, overlap)):
            yield k, start, piece


class SlidingChunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        n = len(text or "")
        for k, start in enumerate(range(0, max(n - overlap, 1), size - overlap) if n else ()):
            yield k, start, text[start : start + size]


class SemanticChunks:
    def eval(self, text: str, target: int, most: int, threshold: float) -> Iterator[tuple[int, int, str]]:
        sentences = [s for s in SENTENCE_ENDS.split(text or "") if s.strip()]
        for k, piece in enumerate(structure.semantic_chunks(sentences, target, most, threshold)):
            yield k, k, piece


class BudgetMerge:
    def __init__(self) -> None:
        self.doc, self.chunk, self.parts, self.size, self.first, self.last = None, 0, [], 0, None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc = row["doc_id"]
        if row["text"] is None:
            return
        if self.parts and self.size > row["budget"]:
            yield self._filled()
            self.chunk, self.parts, self.size = self.chunk + 1, [], 0
        if not self.parts:
            self.first = row["pos"]
        self.parts.append(row["text"])
        self.size += len(row["text"].split())
        self.last = row["pos"]

    def terminate(self) -> Iterator[tuple]:
        if self.parts:
            yield self._filled()

    def _filled(self) -> tuple:
        return self.doc, self.chunk, self.first, self.last, "\n".join(self.parts)


FUNCTIONS = {
    "recursive_chunks": udtf(RecursiveChunks, returnType=PIECES),
    "sliding_chunks": udtf(SlidingChunks, returnType=PIECES),
    "semantic_chunks": udtf(SemanticChunks, returnType=PIECES),
    "budget_merge": udtf(BudgetMerge, returnType="doc_id bigint, chunk int, first bigint, last bigint, piece string"),
}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
