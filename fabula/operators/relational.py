"""Relational operators that take more than one built-in call."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps no more than n rows of a group in a task (window group limit)."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``by``, with partial aggregation in place of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``target`` with ``changes``; the higher ``version`` of a key wins, and a change wins a tie."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(rows, keys, [version, "_new"]).drop("_new")


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps as one; the new one wins a key. Works under any policy for doubled keys."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, width: int) -> DataFrame:
    """Points in spans (both ends included) of the same key. Spans are listed in the tiles of ``width`` that they touch, so
    this is a hash or merge join on key and tile and never a loop over all pairs."""
    tiles = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    listed = spans.filter(F.col(first) <= F.col(last)).withColumn("_tile", F.explode(tiles))
    tiled = points.withColumn("_tile", F.floor(F.col(at) / width))
    return tiled.join(listed, [key, "_tile"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("_tile")


def keep_edges(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges both ends of which are nodes."""
    return edges.join(nodes.select(F.col(node).alias(src)), src, "left_semi").join(nodes.select(F.col(node).alias(dst)), dst, "left_semi")


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """The cells of ``grid`` that ``done`` holds fewer than ``expected`` times, and how many are missing."""
    counts = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = grid.join(counts, list(keys), "left").withColumn("missing", F.lit(expected) - F.coalesce("_n", F.lit(0)))
    return rows.filter("missing > 0").drop("_n")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values (dim, value) added and removed by dimension; one of each in a dimension is a relabelling."""
    a, b = old.select("dim", "value").distinct(), new.select("dim", "value").distinct()
    rows = b.subtract(a).withColumn("kind", F.lit("add_value")).unionByName(a.subtract(b).withColumn("kind", F.lit("remove_value")))
    n = rows.groupBy("dim").agg(F.count_if(F.col("kind") == "add_value").alias("added"), F.count_if(F.col("kind") == "remove_value").alias("removed"))
    relabel = (F.col("added") == 1) & (F.col("removed") == 1)
    return rows.join(n, "dim").select("dim", "value", F.when(relabel, "relabel").otherwise(F.col("kind")).alias("kind"))


def compatible(changes: DataFrame, mode: str) -> DataFrame:
    """Changes that a compatibility mode (BACKWARD, FORWARD, FULL, NONE) doesn't allow."""
    allowed = {"BACKWARD": ["add_dim", "add_value"], "FORWARD": ["remove_dim", "remove_value"], "FULL": [], "NONE": None}[mode]
    return changes.limit(0) if allowed is None else changes.filter(~F.col("kind").isin(*allowed)) if allowed else changes


def inherit(parent: DataFrame, child: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The child's rows, and the parent's whose key the child doesn't have."""
    return child.unionByName(parent.join(child.select(*keys), list(keys), "left_anti"))


def first_of(parts: Sequence[tuple[DataFrame, str]], key: str, name: str) -> DataFrame:
    """For each key the value of the first frame, in order, that has one: parts are (frame with key and value, value)."""
    found = reduce(lambda a, b: a.join(b, key, "full"), [df.select(key, F.col(v).alias(f"_v{i}")) for i, (df, v) in enumerate(parts)])
    return found.select(key, F.coalesce(*(f"_v{i}" for i in range(len(parts)))).alias(name), F.coalesce(*(F.when(F.col(f"_v{i}").isNotNull(), i) for i in range(len(parts)))).alias("source"))


@functools.cache
def _local_folder(application: str) -> str:
    """One temporary folder for an application; the setting itself can't be changed while Spark runs."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``; where none is set, in local mode only, a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/fabula-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there, so that what several readers share is computed once
    and outlives any executor."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, texts: Sequence[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``texts`` have some ``most`` bytes, or one row."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in texts)
    at = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
