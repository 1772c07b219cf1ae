"""Byte-level BPE over Arrow batches: ids by a rank file, code point offsets of every token, and exact decoding.

A rank file lists byte strings with their ranks. ``tokenizer`` turns it into a model of the tokenizers library: each
byte becomes a printable character, and every way to put a token together from two others is a merge of the token's
rank. Each batch is cut into pieces by the pattern, the library encodes the pieces that the worker doesn't hold yet, and
the texts' ids are put together from pieces. Decoding looks the ids up in the byte table; ``Decoder`` does so for a
stream of ids, where a character may be split between tokens.

Plan: a scan and narrow Arrow steps, no shuffle. Memory is bounded by a batch's slice and the piece cache.

Edge cases: a null or empty text has no ids and decodes to nothing; equal rows give equal rows; an empty table gives an
empty result; columns other than ``keep`` are ignored, and clashing names are avoided by internal ones.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import give_back, slices, small_batches, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_PIECES = 120_000
#: Bytes of pieces that aren't held: those would fill a worker.
LONG = 256
#: Bytes of text that are cut into pieces at once; each piece is an object some ten times its size.
SLICE = 1 << 19


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(1)
def byte_characters() -> tuple[str, ...]:
    """For each byte a printable character: itself where it is one, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(free)) for b in range(256))


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def byte_table(path: str) -> tuple[bytes, ...]:
    """The bytes of each id; an id without a token has none."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tuple(table)


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizers library's model of a rank file; it takes one piece of the pattern at a time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, chars = load_ranks(path), byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


@lru_cache(4)
def pattern_of(pattern: str):
    import regex

    return regex.compile(pattern)


class Encoder:
    """Encodes texts; holds the ids of the pieces seen last, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str | None = None, cached: int = CACHED_PIECES):
        import public_tokenizers

        self.find = pattern_of(pattern or public_tokenizers.PATTERN).findall
        self.model, self.cached, self.held = tokenizer(path), cached, {}
        load_ranks.cache_clear()  # the model has them now
        give_back()

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        pieces = [self.find(x) for x in batch]
        held = self.held
        missing = list({p for x in pieces for p in x if p not in held})
        if len(held) + len(missing) > self.cached:
            held.clear()
            missing = list({p for x in pieces for p in x})
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            for piece, e in zip(part, self.model.encode_batch(part, add_special_tokens=False), strict=True):
                held[piece] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join(map(held.__getitem__, x)) for x in pieces]
        for piece in missing:
            if len(piece) > LONG:
                del held[piece]
        return out


def token_offsets(raw: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each token touches, end exclusive. Tokens that split a character both get the whole of it."""
    if not len(ids):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    ends = np.cumsum(lengths[ids])
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # the code point of each byte
    return at[ends - lengths[ids]].astype(np.int32), (at[ends - 1] + 1).astype(np.int32)


class Decoder:
    """Decodes a stream of ids; holds the bytes of an unfinished character until its rest comes."""

    def __init__(self, path: str, errors: str = "replace"):
        self.table = byte_table(path)
        self.rest = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.rest.decode(b"".join(map(self.table.__getitem__, ids)), final)


def _kept(df: DataFrame, keep: tuple[str, ...], **more: str) -> tuple[DataFrame, list[str], str]:
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), *(F.col(c).alias(n) for n, c in more.items()))
    kinds = [f"{n} {source.schema[n].dataType.simpleString()}" for n in names]
    return source, names, ", ".join([*kinds, ""])


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``keep`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and, on demand, ``starts`` and ``ends``:
    arrays with the code points where each token starts and ends."""
    small_batches(df.sparkSession)
    source, names, kinds = _kept(df, keep, t=text_col)
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = Encoder(path, pattern), np.array([*map(len, byte_table(path))]) if offsets else None
        for batch in slices(batches, "t", SLICE):
            raw = texts(batch.column("t"))
            ids = encoder.encode_batch([x.decode("utf-8", "replace") for x in raw])
            out = [*(batch.column(n) for n in names), pa.array(ids, pa.binary())]
            if offsets:
                both = [token_offsets(x, np.frombuffer(i, "<u4"), lengths) for x, i in zip(raw, ids, strict=True)]
                out += [pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, [*names, "ids", *["starts", "ends"][: 2 * offsets]])

    more = ", starts array<int>, ends array<int>" if offsets else ""
    out = source.mapInArrow(run, f"{kinds}ids binary{more}")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *out.columns[len(keep) :])


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None) -> DataFrame:
    """``keep`` and the ids with ``decoded``: the bytes that the ids stand for."""
    small_batches(df.sparkSession)
    source, names, kinds = _kept(df, keep, i=ids_col)
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = byte_table(path).__getitem__
        load_ranks.cache_clear()
        for batch in slices(batches, "i", SLICE):
            raw = [b"".join(map(look, np.frombuffer(x, "<u4").tolist())) for x in texts(batch.column("i"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    out = source.mapInArrow(run, f"{kinds}i binary, decoded binary")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("i").alias(ids_col), "decoded")
