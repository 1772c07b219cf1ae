"""Quality rules as a ledger of bits.

``ledger`` evaluates every rule once for every document and stores the measurements with a 64-bit mask of failures. A
policy is a versioned set of rules, so applying one, or comparing many, is a bit operation over the ledger and never
reads a text again; ``ablations`` counts from the distinct masks what each rule alone decides.

Plan: one scan, a narrow ``mapInArrow`` per batch of documents, no shuffle. Only ``ablations`` shuffles, a row for each
distinct mask and task.

Edge cases: a null or empty text has no words and fails ``few_words``; a null id stays null; equal rows give equal rows;
an empty table gives an empty ledger; other columns of the input are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import ASCII_SPACE, Codes, slices, small_batches, texts

#: Characters counted as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit, name and condition over the measurements. A bit is never given another meaning; new rules take new bits.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 14 * n_words"),
    (6, "upper_case", "n_words >= 10 AND 2 * n_upper > word_chars"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version: a document is kept if none of the policy's rules failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "upper_case"),
}

CODE_BITS = 21  # three word codes fit in 63 bits
#: Bytes of texts whose words are held at once, about; numbers of words needn't outlive a text.
HELD = 16 << 20


def mask_of(names: tuple[str, ...]) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return reduce(lambda m, name: m | 1 << bits[name], names, 0)


def repeated_window_words(codes: np.ndarray) -> int:
    """Words inside windows of three words that occur twice or more in the text, all occurrences included."""
    if len(codes) < 4:
        return 0
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    if int(codes.max()) >> CODE_BITS:  # a text of more than two million distinct words
        a, b, c = np.unique((a << 31) | b, return_inverse=True)[1], 0, c
        keys = (a << 31) | c
    else:
        keys = (a << 2 * CODE_BITS) | (b << CODE_BITS) | c
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.searchsorted(twice, keys)
    hit = twice[np.minimum(at, len(twice) - 1)] == keys
    covered = np.zeros(len(codes), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def measure(raw: bytes, codes: Codes) -> tuple[int, ...]:
    """The measurements of one text, as in MEASURES. ``codes`` numbers words and may be shared between texts."""
    text, words = raw.decode("utf-8", "replace"), raw.split()
    if len(codes) + len(words) >> CODE_BITS:
        codes.clear()
    numbers = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(ASCII_SPACE)]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, ASCII_SPACE))),
        sum(map(text.count, SYMBOLS)),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_window_words(numbers),
    )


def measurements(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with the measurements of ``text_col``, one row for each row."""
    names = [f"k{i}" for i in range(len(keep))]
    source, text = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True))), "t"
    if text_col in keep:
        text = names[keep.index(text_col)]
    else:
        source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = Codes(), 0
        for batch in slices(batches, text):
            rows = []
            for x in texts(batch.column(text)):
                if held > HELD:  # however long its words are
                    codes.clear()
                    held = 0
                rows.append(measure(x, codes))
                held += len(x)
            found = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, *MEASURES])

    kinds = [f"{n} {source.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*kinds, *(f"{m} bigint" for m in MEASURES)])
    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *MEASURES)


def fail_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint") for bit, _, rule in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every rule evaluated once: ``keep``, the measurements and ``fail_bits``."""
    small_batches(df.sparkSession)
    return measurements(df, text_col, keep).withColumn("fail_bits", fail_bits())


def apply_policy(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and ``policy`` by the policy of that version."""
    failed = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask_of(names)).cast("bigint")) != 0
    return ledger_df.select(
        "*",
        failed(BASE).alias("base_failed"),
        (~failed((*BASE, *POLICIES[version]))).alias("kept"),
        F.lit(version).alias("policy"),
    )


def ablations(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, documents that only it fails (``kept`` would grow by so many
    without it), and ``co_failed``, the bits that ever fail together with it."""
    mask = mask_of(POLICIES[version])
    masks = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = [(bit, name) for bit, name, _ in RULES if mask >> bit & 1]
    each = F.explode(
        F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("bigint").alias("b")) for bit, name in rules))
    )
    rows = masks.select("m", "n", each.alias("r")).filter(F.col("m").bitwiseAND(F.col("r.b")) != 0)
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("failed"),
        F.sum(F.when(F.col("m") == F.col("r.b"), F.col("n")).otherwise(0)).alias("only_failed"),
        F.bit_or("m").alias("co_failed"),
    )
