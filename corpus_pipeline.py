"""A pipeline from raw documents to token ids: STAGES in order, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
What a stage returns is written as Parquet and read again as the next one's documents.

All stages: rows are told apart by id and text, so rows that share an id, a null one too, are different documents; a null
text counts as an empty one and stays null where it is kept; texts of any length are worked on whole, one being in memory
at a time; other columns of the input are dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import byte_bpe, decontaminate, jaccard_join, quality_rules, secrets
from fabula.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are near duplicates if their shingles of so many words have so high a Jaccard similarity, in per cent.
DUPLICATE_NGRAM, DUPLICATE_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules keeps; a null or empty text has no words and goes."""
    ledger = quality_rules.ledger(docs.select(COLUMNS), keep=tuple(COLUMNS))
    return quality_rules.apply_policy(ledger, "v1").filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document: that of the least id, of equal ids that of the least hash, and of
    equal rows one. Documents without words are nobody's duplicates, so all stay."""
    found = jaccard_join.join(docs, ngram=DUPLICATE_NGRAM, percent=DUPLICATE_PERCENT, hash_col="_h", group_col="_c").filter("_c IS NOT NULL")
    groups = found.groupBy("_c", F.col("doc_id").alias("_id"), "_h").agg(F.count(F.lit(1)).alias("_n"))
    groups = materialise(groups, "groups")
    first = groups.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_h")).alias("_least"))
    is_first = F.col("_id").eqNullSafe(F.col("_least._id")) & (F.col("_h") == F.col("_least._h"))
    marked = groups.join(first, "_c").select("_id", "_h", is_first.alias("_first"), (F.col("_n") > 1).alias("_again"))
    marked = materialise(marked.filter("NOT _first OR _again"), "marked")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    rest = docs.select(COLUMNS).join(marked.select("_id", "_h"), same, "left_anti")
    again = docs.select(COLUMNS).join(marked.filter("_first").select("_id", "_h"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(again)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; each row is judged by itself. Without items all stay."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the spans of secrets replaced by a mark; ``n_chars`` follows. A text without any is as it was."""
    keyed = docs.select(*COLUMNS, F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")).alias("_key"))
    spans = secrets.find_spans(keyed, "_key").filter(F.size("spans") > 0)
    spans = spans.groupBy(F.col("id.i").alias("_i"), F.col("id.h").alias("_h")).agg(F.first("spans").alias("_spans"))
    joined = keyed.join(spans, F.col("_key.i").eqNullSafe(F.col("_i")) & (F.col("_key.h") == F.col("_h")), "left")
    redacted = joined.withColumn("new", F.when(F.col("_spans").isNotNull(), secrets.redact(F.col("text"), F.col("_spans"))))
    return redacted.select(
        "doc_id",
        F.coalesce("new", "text").alias("text"),
        "lang",
        "source",
        F.when(F.col("new").isNotNull(), F.length("new").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def byte_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (``ids``: little-endian unsigned 32-bit integers), decoded again as a check; a
    null or empty text has none."""
    out = byte_bpe.decode(byte_bpe.encode(docs, keep=tuple(COLUMNS)), keep=tuple(COLUMNS))
    exact = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return out.select(
        *COLUMNS, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), exact.alias("decodes")
    )


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secret_spans),
    ("byte-level BPE", byte_tokens),
]

#: Bit masks, links and components might be SQL; byte-pair merges are not, so the whole is tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
