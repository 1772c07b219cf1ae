"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often corpus-wide.

Both tokenizers cut a space and the text into tokens whose bytes, joined, are the space and the text. Where tokens of both
end at one byte a group ends; in a group of p and q tokens p + q - 1 pairs overlap, each of which is a link.

Pairs are kept in inverted bitmaps. A container holds up to 65,535 documents of one task, numbered from 0. For every pair
it has a compressed bitmap of the documents that hold it (plane 0) and planes of multiplicity: plane p has the documents
in whose number of further links of the pair bit p - 1 is set. A bitmap is a list of 16-bit places or, where that is
longer, one bit a document. The pieces of a container, batch by batch and slice by slice of long texts, are OR-merged
before it is written (a document's multiplicities are added up first).

1. One pass over the texts writes the containers: a row for each document and one for each bitmap.
2. Popcounts of plane 0 add up to a pair's documents and weighted popcounts to its links, pre-aggregated in each task.
   The highest number of a token of the second vocabulary is a window over its pairs: at most as many as the first
   vocabulary has tokens.
3. (pair, container), two numbers, meet the pairs' scores and go back to their containers, whose postings return them to
   the documents. A container with its scores is bounded by ``ENTRIES``, whatever the corpus, and so is any group.

Both tokenizers must never look across a space between two characters that aren't white space; ``load`` checks that of
the second vocabulary, and the first splits there by its pattern. So texts are cut there, and a slice's words are encoded once.

Edge cases: a null or empty text, one that isn't valid UTF-8 and one whose joined tokens differ from it have no tokens,
zeros and an empty digest; rows of one id, null ids too, are documents of their own; an empty table gives an empty
result; other columns are ignored. A long text is aligned a slice at a time; a word of any length is one slice.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import Codes, give_back, materialise, slices, small_batches

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Where a text may be cut: the space belongs to what follows, as the second tokenizer puts one before its text.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text aligned at once, each distinct word once.
SLICE = 1 << 21
#: Words that go to the tokenizers as one text.
TOGETHER = 64
#: Bitmap entries (documents by pair) and documents of a container, at most but for the last slice's.
ENTRIES, PLACES = 4_000_000, (1 << 16) - 1
#: Bits of a token's id in a pair, and of a document's place.
ID_BITS, PLACE_BITS = 22, 16


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


@lru_cache(1)
def load(a_path: str, b_path: str):
    """Both libraries' models and the bytes of every token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    from fabula.llm.byte_bpe import byte_characters

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    entries = a.get_vocab()
    a_bytes = [b""] * (max(entries.values(), default=-1) + 1)
    for token, k in entries.items():
        plain = all(c in byte_of for c in token)
        a_bytes[k] = bytes(byte_of[c] for c in token) if plain else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for k in range(len(b)):
        piece = b.id_to_piece(k)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode())
        if re.search("[^ ] ", b_bytes[-1].decode("utf-8", "replace")):
            raise ValueError(f"a piece with a space inside: {piece!r}; texts can't be cut at spaces")
    if max(len(b_bytes), len(a_bytes)) >> ID_BITS:
        raise ValueError("a vocabulary of more than four million tokens")
    return a, a_bytes, b, b_bytes


class Table:
    """What distinct words say, laid out for texts that are lists of their numbers: ``sums`` (tokens of each tokenizer and
    groups), parts of the digest text, pairs; ``known`` is false where the tokens' bytes aren't those of the word."""

    def __init__(self, known: np.ndarray, sums: np.ndarray, codes: np.ndarray, pairs: np.ndarray, shown: list[str]):
        self.known, self.sums, self.shown = known, sums, shown
        sizes = sums[:, 0] + sums[:, 1], sums[:, 0] + sums[:, 1] - sums[:, 2]  # p + q - 1 links in each group
        self.parts = [(values, n, np.cumsum(n) - n) for values, n in zip((codes, pairs), sizes, strict=True)]

    def gathered(self, words: np.ndarray, which: int) -> np.ndarray:
        values, sizes, starts = self.parts[which]
        n = sizes[words]
        return values[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def text(self, words: np.ndarray) -> str:
        """The groups of a text, each followed by its mark."""
        return "".join(map(self.shown.__getitem__, self.gathered(words, 0).tolist()))

    def entries(self, words: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        """A document's pairs with their numbers of links, as keys of a container."""
        found, counts = np.unique(self.gathered(words, 1), return_counts=True)
        return found << PLACE_BITS | place, counts


class Aligner:
    """Aligns texts by their distinct words. ``shown`` has the parts of the digest text: ids with what follows them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes, self.b, self.b_bytes = load(a_path, b_path)
        self.lengths = [np.array([*map(len, table)], np.int64) for table in (self.a_bytes, self.b_bytes)]
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.shown = [f"{k}{mark}" for size, marks in ((n, ",|"), (m, ",;")) for mark in marks for k in range(size)]

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], Table]:
        """Each text as numbers of words, and the table of those."""
        codes = Codes()
        split = [CUT.split(x) for x in texts]
        # only the ends of texts may be white space, which mustn't stand beside other words
        edge = {w for words in split for w in (words[0], words[-1]) if w[:1].isspace() or w[-1:].isspace()}
        for w in edge:
            codes[w]
        numbers = [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)) for words in split]
        words = list(codes)
        found = [self._aligned(words[: len(edge)], 1)] if edge else []
        found += [self._aligned(words[k : k + 8192], TOGETHER) for k in range(len(edge), len(words), 8192)]
        return numbers, Table(*(np.concatenate([x[k] for x in found]) for k in range(4)), self.shown)

    def _tokens(self, words: list[str], together: int) -> tuple[list[list[int]], bool]:
        """Ids of words by both tokenizers, one list each, and whether both have the words' bytes. Words side by side are what
        their texts were cut into, and fewer calls."""
        texts = [" ".join(words[k : k + together]) for k in range(0, len(words), together)]
        first = self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)
        flat = [[i for x in first for i in x.ids], [i for x in self.b.encode(texts, num_threads=1) for i in x]]
        raw = "".join(" " + x for x in texts).encode()
        return flat, all(b"".join(map(table.__getitem__, ids)) == raw for table, ids in zip((self.a_bytes, self.b_bytes), flat, strict=True))

    def _aligned(self, words: list[str], together: int) -> tuple[np.ndarray, ...]:
        """Known or not, sums, codes and pairs of words. They are laid end to end, where the ends of both tokenizers' tokens cut
        each other's tokens. What lies between two cuts is in one token of each: a link."""
        flat, sound = self._tokens(words, together)
        if not sound:
            known = np.array([self._tokens([w], 1)[1] for w in words])
            good = [w for w, ok in zip(words, known, strict=True) if ok]
            sums = np.zeros((len(words), 3), np.int64)
            if len(good) == len(words):
                raise AssertionError("words that stand side by side are encoded otherwise than alone")
            if not good:
                return known, sums, np.zeros(0, np.int32), np.zeros(0, np.int64)
            _, sums[known], codes, pairs = self._aligned(good, together)
            return known, sums, codes, pairs
        ids = [np.array(x, np.int64) for x in flat]
        ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids, strict=True)]
        common = [y[np.searchsorted(y, x)] == x for x, y in (ends, ends[::-1])]  # the last tokens of groups
        cuts = np.sort(np.concatenate([ends[0], ends[1][~common[1]]]), kind="stable")
        i, j = (np.searchsorted(e, cuts) for e in ends)
        pairs = ids[0][i] << ID_BITS | ids[1][j]
        group = [np.cumsum(c) - c for c in common]
        n, m = len(self.a_bytes), len(self.b_bytes)
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int32)
        before = np.searchsorted(group[1], group[0]), np.searchsorted(group[0], group[1], side="right")
        codes[np.arange(len(ids[0])) + before[0]] = ids[0] + n * common[0]
        codes[np.arange(len(ids[1])) + before[1]] = ids[1] + 2 * n + m * common[1]
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        at = [np.searchsorted(e, word_ends, side="right") for e in (*ends, ends[0][common[0]])]
        return np.ones(len(words), bool), np.stack([np.diff(x, prepend=0) for x in at], axis=1), codes, pairs


#: What a document without tokens has.
NONE = (0, 0, 0, 0, "")


def readable(column: pa.Array) -> list[str]:
    """Each value as text; a null and bytes that aren't UTF-8 count as empty."""
    out = []
    for raw in column.cast(pa.binary()).to_pylist():
        try:
            out.append((raw or b"").decode())
        except UnicodeDecodeError:
            out.append("")
    return out


def parts(text: str) -> Iterator[str]:
    """A text in slices that end where it may be cut."""
    at = 0
    while len(text) - at > SLICE:
        cut = CUT.search(text, at + SLICE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Container:
    """Collects the pairs of documents and gives rows of documents and of bitmaps."""

    def __init__(self, number: int):
        self.number, self.documents, self.pieces, self.entries = number, 0, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pieces.append((keys, counts))
        self.entries += len(keys)

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Pair, plane, whether it is dense, and bytes of every bitmap."""
        keys, counts = merged(self.pieces)
        pairs, places, width = keys >> PLACE_BITS, (keys & PLACES).astype("<u2"), (self.documents + 7) // 8
        found, more = [], counts - 1
        bits = int(more.max(initial=0)).bit_length()
        for plane, chosen in enumerate([counts > 0, *((more >> p & 1).astype(bool) for p in range(bits))]):
            p, d = pairs[chosen], places[chosen]
            if not len(p):
                continue
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            sizes = np.diff(np.r_[starts, len(p)])
            dense = 2 * sizes > width
            found.append((p[starts], np.full(len(starts), plane, np.int32), dense, bitmap_bytes(d, starts, sizes, dense, width)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), pa.array([], pa.binary())
        return (*(np.concatenate([x[k] for x in found]) for k in range(3)), pa.concat_arrays([x[3] for x in found]))


def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The OR of sorted pieces: every key once, with its counts added up."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([x[0] for x in pieces])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([x[1] for x in pieces])[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def bitmap_bytes(places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, dense: np.ndarray, width: int) -> pa.Array:
    """One value for each bitmap: its places of 16 bits, or ``width`` bytes of bits."""
    lengths = np.where(dense, width, 2 * sizes)
    ends = np.cumsum(lengths)
    data = np.zeros(int(ends[-1]), np.uint8)
    sparse = np.repeat(~dense, sizes)
    raw = places[sparse].view(np.uint8)
    at = np.repeat((ends - lengths)[~dense], 2 * sizes[~dense])
    if len(raw):
        within = np.arange(len(raw)) - np.repeat(np.cumsum(2 * sizes[~dense]) - 2 * sizes[~dense], 2 * sizes[~dense])
        data[at + within] = raw
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(8 * width, bool)
        bits[places[starts[k] : starts[k] + sizes[k]]] = True
        data[ends[k] - width : ends[k]] = np.packbits(bits)
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


DIGEST = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BITMAP = "pair bigint, plane int, dense boolean, bits binary"


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The containers: rows of documents (``place`` isn't null; ``id`` and digests) and of bitmaps (``pair`` isn't null)."""
    small_batches(df.sparkSession)
    source, (a_path, b_path) = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), paths or default_paths()
    schema = f"container bigint, place int, id {source.schema['id'].dataType.simpleString()}, {DIGEST}, {BITMAP}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, base = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        held = Container(base)
        for batch in slices(batches, "t", SLICE):
            if held.entries > ENTRIES or held.documents + batch.num_rows > PLACES:
                yield from _bitmap_rows(held, names, types)
                held = Container(held.number + 1)
            texts = [*enumerate(readable(batch.column("t")))]
            rows = dict(_documents(aligner, held, [(k, x) for k, x in texts if 0 < len(x) <= SLICE]))
            rows |= {k: _long_document(aligner, held, k, x) for k, x in texts if len(x) > SLICE}
            columns = list(zip(*(rows.get(k, NONE) for k in range(batch.num_rows)), strict=True))
            places = np.arange(held.documents, held.documents + batch.num_rows)
            held.documents += batch.num_rows
            filled = {"container": np.full(batch.num_rows, held.number), "place": places, "id": batch.column("id")}
            filled |= dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True))
            yield _rows(names, types, batch.num_rows, filled)
        yield from _bitmap_rows(held, names, types)
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, types = arrow.names, arrow.types
    return source.mapInArrow(run, schema)


def _rows(names: list[str], types: list[pa.DataType], n: int, filled: dict) -> pa.RecordBatch:
    column = lambda x, t: (x if x.type == t else x.cast(t)) if isinstance(x, pa.Array) else pa.array(x, t)
    return pa.RecordBatch.from_arrays([column(filled[c], t) if c in filled else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)


def _bitmap_rows(held: Container, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    pairs, planes, dense, bits = held.bitmaps()
    for k in range(0, len(pairs), 20_000):
        cut = slice(k, k + 20_000)
        n = len(pairs[cut])
        filled = {"container": np.full(n, held.number), "pair": pairs[cut], "plane": planes[cut], "dense": dense[cut], "bits": bits[k : k + 20_000]}
        yield _rows(names, types, n, filled)


def _documents(aligner: Aligner, held: Container, texts: list[tuple[int, str]]) -> Iterator[tuple[int, tuple]]:
    """Digest rows of texts of a slice together, by their place in the batch; their pairs go to the container."""
    if not texts:
        return
    numbers, table = aligner.align([text for _, text in texts])
    for (k, _), words in zip(texts, numbers, strict=True):
        if not table.known[words].all():
            continue
        n_a, n_b, n_groups = table.sums[words].sum(0).tolist()
        digest = hashlib.sha256(table.text(words)[:-1].encode()).hexdigest()
        held.add(*table.entries(words, held.documents + k))
        yield k, (n_a, n_b, n_groups, n_a + n_b - n_groups, digest)


def _long_document(aligner: Aligner, held: Container, k: int, text: str) -> tuple:
    """The digest row of a text of several slices."""
    total, digest, found = np.zeros(3, np.int64), hashlib.sha256(), []
    for n, part in enumerate(parts(text)):
        (words,), table = aligner.align([part])
        if not table.known.all():
            return NONE
        total += table.sums[words].sum(0)
        digest.update((";" * (n > 0) + table.text(words)[:-1]).encode())
        found.append(table.entries(words, held.documents + k))
        if len(found) > 16:
            found = [merged(found)]
    held.add(*merged(found))
    n_a, n_b, n_groups = total.tolist()
    return n_a, n_b, n_groups, n_a + n_b - n_groups, digest.hexdigest()


def pair_counts(found: DataFrame) -> DataFrame:
    """For each pair of ``postings``: ids ``a`` and ``b``, ``n_docs``, ``n_links`` and ``best`` (no pair of its ``b`` has
    more links)."""
    ones = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise((F.octet_length("bits") / 2).cast("bigint"))
    worth = F.when(F.col("plane") == 0, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    sums = found.filter("pair IS NOT NULL").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, ones)).alias("n_docs"), F.sum(ones * worth).alias("n_links")
    )
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    rows = sums.select("pair", F.shiftright("pair", ID_BITS).alias("a"), b.alias("b"), "n_docs", "n_links")
    return rows.select("*", (F.col("n_links") == F.max("n_links").over(Window.partitionBy("b"))).alias("best"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """For each document ``id``, tokens ``n_a`` and ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the
    best of its ``b``), ``count_sum`` (over links, the links of their pairs) and ``groups_sha256``."""
    found = materialise(postings(df, id_col, text_col, paths), "alignment")
    scores = pair_counts(found).select("pair", "n_links", "best")
    wanted = found.filter("plane = 0").select(F.col("container").alias("box"), "pair").join(scores, "pair").select("box", F.col("pair").alias("code"), "n_links", "best")
    schema = f"id {found.schema['id'].dataType.simpleString()}, {DIGEST}, n_best bigint, count_sum bigint"
    return found.groupBy("container").cogroup(wanted.groupBy("box")).applyInArrow(_scored, schema)


def _scored(rows: pa.Table, scores: pa.Table) -> pa.Table:
    """A container's documents with what its postings return to them."""
    import pyarrow.compute as pc

    docs, maps = rows.filter(pc.is_valid(rows["place"])), rows.filter(pc.is_valid(rows["pair"]))
    n = docs.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = scores["code"].to_numpy()
    order = np.argsort(pairs)
    at = order[np.searchsorted(pairs[order], maps["pair"].to_numpy())]
    plane = maps["plane"].to_numpy().astype(np.int64)
    worth = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
    links, is_best = worth * scores["n_links"].to_numpy()[at], worth * scores["best"].to_numpy()[at]
    dense = maps["dense"].to_numpy()
    bits = maps["bits"].combine_chunks()
    for k in np.flatnonzero(dense).tolist():
        places = np.flatnonzero(np.unpackbits(np.frombuffer(bits[k].as_py(), np.uint8)))
        total[places] += links[k]
        best[places] += is_best[k]
    sparse = bits.filter(pa.array(~dense))
    sizes = (pc.binary_length(sparse).to_numpy() // 2).astype(np.int64)
    places = np.frombuffer(b"".join(sparse.to_pylist()), "<u2")
    np.add.at(total, places, np.repeat(links[~dense], sizes))
    np.add.at(best, places, np.repeat(is_best[~dense], sizes))
    kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    where = docs["place"].to_numpy()
    return kept.append_column("n_best", pa.array(best[where])).append_column("count_sum", pa.array(total[where]))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The alignments themselves: ``id`` and ``groups``, the text of a document's groups as ``a,a|b;a|b,b``, in rows of
    one slice of its text (``part`` from 0 on). A document without tokens has one row without groups."""
    small_batches(df.sparkSession)
    source, (a_path, b_path) = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in slices(batches, "t", SLICE):
            at, number, shown = [], [], []
            for k, text in enumerate(readable(batch.column("t"))):
                made = []
                for part in parts(text) if text else ():
                    (words,), table = aligner.align([part])
                    if not table.known.all():
                        made = []
                        break
                    made.append(table.text(words)[:-1])
                at += [k] * max(1, len(made))
                number += range(max(1, len(made)))
                shown += made or [""]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(shown)], ["id", "part", "groups"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, part int, groups string")
