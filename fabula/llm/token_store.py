"""Token ids in Arrow files of fixed-size lists.

A store is a set of shards. A shard is an Arrow IPC file whose record batches hold ``ROWS`` sequences of ``seq_len``
ids as a fixed-size list, beside a list of bits of the same length, the mask: 1 for an id, 0 for the padding that fills
the last sequence. So id ``i`` of a shard is in batch ``i // (ROWS * seq_len)``, at a known place, and a memory map
reads it without a copy. Beside each shard a second file has its documents: id, first position and number of ids. The
manifest, a table with a row for each shard, gives the order of the shards.

Documents are put in ascending order by ranges of their id: the bounds are quantiles of the id column alone, each range
is a shard or more, and a task writes its ranges one after the other, a record batch at a time. A file is written under
a name of its own and then moved, so a task that runs twice leaves one complete file.

Edge cases: a null or empty text has the end id alone; a null id comes first; rows of one id are ordered by their ids;
an empty table gives a manifest without rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.common import materialise, new_folder, partitions, slices, small_batches, texts

VOCABULARY = "word_bpe_49k.json"
#: Sequences in a record batch, and ids in a shard before the next document begins a new one.
ROWS, SHARD_IDS = 64, 32 << 20
CACHED_WORDS = 1_800_000
#: Bytes of words that aren't held for the next batch: those would fill a worker.
LONG = 256
MANIFEST = "bucket int, part int, path string, ids bigint, sequences bigint, documents bigint"


@lru_cache(2)
def vocabulary(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def looks_at_words_alone(path: str) -> bool:
    """Whether a vocabulary file says that letters become lower case, words are parted at white space, letters, digits and
    other marks are pieces of their own, and a word's last token is marked."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    parts = lambda x, name: [y for z in [x or {}] for y in (z.get(name) or [z])]
    normal = {x.get("type") for x in parts(found.get("normalizer"), "normalizers")}
    cut = {x.get("type") for x in parts(found.get("pre_tokenizer"), "pretokenizers")}
    model = found.get("model") or {}
    return "Lowercase" in normal and "Split" in cut and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix")


def encode_words(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """``b``: how many of the ascending ``bounds`` are below the document's id; ``d``: the id; ``ids`` (binary:
    little-endian, of 16 bits if the vocabulary allows) with ``end_id`` last.

    A vocabulary that drops white space, lower-cases and never looks across words (``looks_at_words_alone``) gives a text
    the ids of its words, and the library encodes each word that the worker doesn't hold yet. Words that differ in A-Z only
    are one, but for those that have an added token's text in any case: it looks for these tokens before it lower-cases.
    With any other vocabulary the library encodes whole texts."""
    dtype, by_word = id_type(path), looks_at_words_alone(path)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a vocabulary that looks at more than one word."""
        model = vocabulary(path)
        for batch in slices(batches, "t"):
            found = model.encode_batch([x.decode("utf-8", "replace") for x in texts(batch.column("t"))], add_special_tokens=False)
            ids = [np.array([*e.ids, *([] if end_id is None else [end_id])], dtype).tobytes() for e in found]
            d = batch.column("d").fill_null(np.iinfo(np.int64).min).to_numpy()
            b = np.searchsorted(np.array(bounds, np.int64), d).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column("d"), pa.array(ids, pa.binary())], ["b", "d", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordIds(path, dtype)
        end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        for batch in slices(batches, "t"):
            words = [held.split(x) for x in texts(batch.column("t"))]
            held.learn(words)
            ids = [b"".join(map(held.__getitem__, x)) + end for x in words]
            held.forget()
            d = batch.column("d").fill_null(np.iinfo(np.int64).min).to_numpy()
            b = np.searchsorted(np.array(bounds, np.int64), d).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column("d"), pa.array(ids, pa.binary())], ["b", "d", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).mapInArrow(run if by_word else run_whole, "b int, d bigint, ids binary")


class WordIds(dict):
    """Ids of words, as bytes; holds CACHED_WORDS of them or those of one batch."""

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.model, self.dtype, self.long = vocabulary(path), dtype, []
        self.last = np.zeros(self.model.get_vocab_size(), bool)
        self.last[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.added)

    def split(self, text: bytes) -> list[bytes]:
        """The words of a text, A-Z in lower case but in words that have an added token's text in any case."""
        low = text.lower()
        if not self.added or self.mark not in low or not any(t in low for t in self.added):
            return low.split()
        return [w if any(t in x for t in self.added) else x for w, x in zip(text.split(), low.split(), strict=True)]

    def forget(self) -> None:
        for w in self.long:
            self.pop(w, None)

    def learn(self, words: list[list[bytes]]) -> None:
        distinct = set(chain.from_iterable(words))
        missing = distinct.difference(self)
        if len(self) + len(missing) > CACHED_WORDS:
            self.clear()
            missing = distinct
        self.long = [w for w in missing if len(w) > LONG]
        self.long += [w.rstrip(_MARKS) for w in self.long]
        # the vocabulary parts letters and digits from the marks after them, so those have ids of their own
        ends = {w: base for w in missing if w[-1:] in _MARKS and (base := w.rstrip(_MARKS)) and base[-1:].isalnum()}
        plain = missing.difference(ends)
        plain.update(x for x in (*ends.values(), *(w[len(b) :] for w, b in ends.items())) if x not in self)
        asked = [(w, w.decode("utf-8", "replace")) for w in plain]
        self._encode_joined([x for x in asked if x[1].isalpha()])
        self._encode_each([x for x in asked if not x[1].isalpha()])
        self.update((w, self[b] + self[w[len(b) :]]) for w, b in ends.items())


    def _encode_each(self, words: list[tuple[bytes, str]]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            found = self.model.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            self.update((w, np.array(e.ids, self.dtype).tobytes()) for (w, _), e in zip(part, found, strict=True))

    def _encode_joined(self, words: list[tuple[bytes, str]]) -> None:
        """Words of letters alone, many in one text: each is one piece, whose last token is marked as a word's end."""
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            ids = np.array(self.model.encode(" ".join([t for _, t in part]), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._encode_each(part)
                continue
            data, width = ids.tobytes(), ids.itemsize
            cuts = [0, *(ends * width).tolist()]
            self.update((w, data[a:b]) for (w, _), a, b in zip(part, cuts, cuts[1:], strict=False))


#: Marks that never join with a letter or digit before them.
_MARKS = b".,;:!?"


def id_type(path: str) -> str:
    return "<u2" if vocabulary(path).get_vocab_size() <= 1 << 16 else "<u4"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; ``close`` moves it to its place and returns its row of the manifest."""

    def __init__(self, folder: str, bucket: int, part: int, seq_len: int, dtype: str):
        self.files, self.base = filesystem(folder)
        self.name, self.key, self.seq_len, self.dtype = f"{folder}/shard-{bucket:06d}-{part:04d}.arrow", (bucket, part), seq_len, dtype
        self.to = f"{self.base}/shard-{bucket:06d}-{part:04d}.arrow"
        self.temp = f"{self.to}.{uuid.uuid4().hex}"
        width = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema(
            [("ids", pa.list_(width, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))],
            metadata={"layout": json.dumps({"seq_len": seq_len, "rows": ROWS})},
        )
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files.create_dir(self.base, recursive=True)
        self.out = [self.files.open_output_stream(self.temp + x) for x in ("", ".docs")]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, self.places), strict=True)]
        self.waiting, self.held, self.docs = [], 0, []
        self.ids = self.sequences = self.documents = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.ids, len(ids)))
        self.ids, self.held, self.documents = self.ids + len(ids), self.held + len(ids), self.documents + 1
        self.waiting.append(ids)
        if self.held >= ROWS * self.seq_len:
            self._flush()
        if len(self.docs) >= 10_000:
            self._places()

    def _flush(self, last: bool = False) -> None:
        flat, whole = np.concatenate([np.zeros(0, self.dtype), *self.waiting]), ROWS * self.seq_len
        n = len(flat) if last else len(flat) // whole * whole
        for k in range(0, n, whole):
            part = flat[k : min(k + whole, n)]
            rows = -(-len(part) // self.seq_len)
            mask = np.arange(rows * self.seq_len) < len(part)
            full = np.zeros(rows * self.seq_len, self.dtype)
            full[: len(part)] = part
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (full, mask)]
            self.writers[0].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.sequences += rows
        self.waiting, self.held = [flat[n:].copy()], len(flat) - n

    def _places(self) -> None:
        if self.docs:
            columns = [pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)]
            self.writers[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.places))
            self.docs = []

    def close(self) -> tuple:
        self._flush(last=True)
        self._places()
        for x in (*self.writers, *self.out):
            x.close()
        self.files.move(self.temp + ".docs", self.to + ".docs")
        self.files.move(self.temp, self.to)
        return *self.key, self.name, self.ids, self.sequences, self.documents


def write_store(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, seq_len: int = 2048) -> DataFrame:
    """Encodes the texts, writes the store into ``folder`` and returns its manifest, which is itself a written table.

    ``start`` in the manifest is the number of ids in all shards before."""
    small_batches(df.sparkSession)
    spark = df.sparkSession
    n, dtype = 3 * partitions(spark), id_type(path)
    points = [k / n for k in range(1, n)]
    bounds = df.agg(F.percentile_approx(F.col(id_col).cast("bigint"), points, 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    encoded = encode_words(df, id_col, text_col, path, end_id, bounds)
    ordered = encoded.repartition(n, "b").sortWithinPartitions("b", "d", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in slices(batches, "ids"):
            for b, d, ids in zip(batch.column("b").to_pylist(), batch.column("d").to_pylist(), texts(batch.column("ids")), strict=True):
                if writer and (b != writer.key[0] or writer.ids >= SHARD_IDS):
                    done.append(writer.close())
                    writer = ShardWriter(folder, b, writer.key[1] + 1 if b == writer.key[0] else 0, seq_len, dtype)
                writer = writer or ShardWriter(folder, b, 0, seq_len, dtype)
                writer.add(d, np.frombuffer(ids, dtype))
        if writer:
            done.append(writer.close())
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "part", "path", "ids", "sequences", "documents"])

    manifest = materialise(ordered.select("b", "d", "ids").mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class ShardReader:
    """Random access to a shard: ``ids(i, n)`` gives n ids from position i, as a view where they lie in one batch."""

    def __init__(self, path: str):
        files, at = filesystem(path)
        local = files.type_name == "local"
        self.source = [pa.memory_map(at + x) if local else files.open_input_file(at + x) for x in ("", ".docs")]
        self.file, self.docs = map(pa.ipc.open_file, self.source)
        layout = json.loads(self.file.schema.metadata[b"layout"])
        self.seq_len, self.span, self.held = layout["seq_len"], layout["rows"] * layout["seq_len"], (-1, None)

    def _batch(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            batch = self.file.get_batch(k)
            self.held = (k, batch.column(0).flatten().to_numpy(zero_copy_only=True))
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence ``k`` of the shard and its mask."""
        batch, row = self.file.get_batch(k * self.seq_len // self.span), k % (self.span // self.seq_len)
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, at = divmod(start, self.span)
            part = self._batch(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u2"), *parts])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns), strict=True)

    def masked(self) -> int:
        """Ids under the mask."""
        return sum(self.file.get_batch(k).column(1).flatten().true_count for k in range(self.file.num_record_batches))

    def close(self) -> None:
        for x in self.source:
            x.close()


def read_store(manifest: DataFrame) -> DataFrame:
    """A row for each document, read from the files: ``doc_id, start, n_tokens, ids_crc32`` and its ``sequence``, the
    number of its first sequence in its shard. A shard whose mask doesn't match the manifest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "ids")), strict=True):
                reader = ShardReader(path)
                if reader.masked() != ids:
                    raise ValueError(f"{path}: {reader.masked()} ids under the mask, {ids} in the manifest")
                rows = []
                for d, at, n in reader.documents():
                    crc = zlib.crc32(reader.ids(at, n).astype("<u4").tobytes())
                    rows.append((d, base + at, n, crc, at // reader.seq_len))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
                reader.held = (-1, None)

    spread = manifest.select("path", "start", "ids").repartition(2 * partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, sequence bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "sequence"])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def store_folder(spark) -> str:
    return new_folder(spark, "tokens")
