"""A vector index of lists around centroids.

``fit`` learns centroids from a seeded sample of at most ``sample`` rows, the only thing that is bounded; ``assign`` puts
every row into the list of its nearest centroid, and ``write`` stores a folder for each list. A search looks at the
``probes`` lists that are nearest to a query, so it reads those folders and no others. ``recall`` measures it against the
exact neighbours.

Queries may be as many as rows, so nothing of them is broadcast: queries and rows meet by list. A list is dealt to parts of
about ``PART`` rows each, whatever share of all rows it has, and a part meets its queries in blocks of a matrix product. A
part hands on its k best of each query, so that the last ranking sees ``k * probes`` rows a query and part.

Vectors are compared by cosine; a null vector, or one without length, is in no list and found by nobody.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, ROUNDS, SEED = 40_000, 12, 7
#: The part of the nearest rows that the number of probed lists is chosen for, on the sample.
TARGET = 0.96
#: Lists for n rows: their square root, so that lists grow as slowly as their number, up to what a sample can tell apart.
MOST_LISTS = 4096
PART, BLOCK = 50_000, 512


def number_of_lists(n: int) -> int:
    return max(1, min(MOST_LISTS, math.isqrt(n)))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, vec) whose vector has a direction."""
    return vectors.filter("vec IS NOT NULL AND exists(vec, x -> x <> 0) AND NOT exists(vec, x -> x IS NULL OR isnan(x))")


def sampled(vectors: DataFrame, sample: int, seed: int) -> np.ndarray:
    """The unit vectors of the ``sample`` usable rows that a seeded hash puts first."""
    rows = usable(vectors).select("id", "vec").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vec").toPandas()["vec"]
    return unit(np.stack(rows.to_numpy())) if len(rows) else np.zeros((0, 0), np.float32)


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Unit centroids (one a row) by k-means on the sphere over a sample."""
    points = sampled(vectors, sample, seed)
    if not len(points):
        return points
    wanted = min(lists or number_of_lists(usable(vectors).count()), len(points))
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), wanted, replace=False))]
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        empty = ~sums.any(1)
        sums[empty] = points[rng.choice(len(points), int(empty.sum()))]
        centres = unit(sums)
    return centres


def tuned_probes(vectors: DataFrame, centres: np.ndarray, k: int = 10, target: float = TARGET, sample: int = SAMPLE, queries: int = 400, seed: int = SEED) -> int:
    """The fewest lists that hold ``target`` of the ``k`` nearest of sampled queries among the sample. Vectors that lie in
    clusters need few, vectors without any structure about half of all lists; of a larger table a query's nearest are
    nearer, and found no worse."""
    points = sampled(vectors, sample, seed)
    if not len(points) or not len(centres):
        return 1
    home, asked = nearest(points, centres), points[:queries]
    top = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :k]
    places = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(places, home[top], axis=1).ravel())
    return int(needed[math.ceil(target * len(needed)) - 1]) + 1


def unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(points[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(points), 4096)] or [np.zeros(0, int)])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.float32)


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``list, id, vec`` (of length 1) of every usable row. The centroids, MOST_LISTS vectors at most, go with the tasks."""
    rows = usable(vectors).select("id", F.col("vec").cast("array<float>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = unit(matrix(batch.column("vec")))
                near = nearest(points, centres).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("id"), pa.array(list(points), pa.list_(pa.float32()))], ["list", "id", "vec"])

    return rows.mapInArrow(run, f"list int, id {kind}, vec array<float>")


def write(index: DataFrame, path: str, parts: int = 4) -> None:
    """Stores the lists, each as ``parts`` files at most."""
    dealt = index.repartition("list", F.pmod(F.xxhash64("id"), F.lit(parts)))
    dealt.write.partitionBy("list").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """The stored lists, or those named: the folders of others aren't read."""
    index = spark.read.parquet(path)
    return index if lists is None else index.filter(F.col("list").isin(lists))


def probes_of(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``qid, list, q``: queries (qid, vec) by the ``probes`` lists that are nearest to each."""
    rows = usable(queries).select("qid", F.col("vec").cast("array<float>").alias("vec"))
    kind = rows.schema["qid"].dataType.simpleString()
    n = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            if batch.num_rows and n:
                points = unit(matrix(batch.column("vec")))
                near = np.argpartition(-(points @ centres.T), n - 1, axis=1)[:, :n].astype(np.int32)
                each = pa.array(np.repeat(np.arange(len(points)), n))
                vecs = pa.array(list(points), pa.list_(pa.float32())).take(each)
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(each), pa.array(near.ravel()), vecs], ["qid", "list", "q"])

    return rows.mapInArrow(run, f"qid {kind}, list int, q array<float>")


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 16) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` best rows of the probed lists of each query, ties by id."""
    asked = probes_of(queries, centres, probes)
    parts = index.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).cast("int").alias("parts"))
    number: Column = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = index.join(F.broadcast(parts), "list").select(F.col("list").alias("l"), number.alias("p"), "id", "vec")  # MOST_LISTS rows
    each = asked.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "q")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (index, "id"))}

    def best(found: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, points, out = found["id"].combine_chunks(), matrix(found["vec"]), []
        if found.num_rows and wanted.num_rows:
            asked_for, order = matrix(wanted["q"]), np.argsort(np.array(ids.to_pylist(), object))
            points, ids = points[order], ids.take(pa.array(order))  # equal scores go by id
            for at in range(0, wanted.num_rows, BLOCK):
                scores = asked_for[at : at + BLOCK] @ points.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                of = np.repeat(np.arange(at, at + len(scores)), top.shape[1])
                out.append((of, top.ravel(), np.take_along_axis(scores, top, 1).ravel()))
        of, at, scores = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, int) for i in range(3))
        qids = wanted["qid"].combine_chunks().take(pa.array(of, pa.int64()))
        return pa.table({"qid": qids, "id": ids.take(pa.array(at, pa.int64())), "score": pa.array(scores, pa.float64())})

    met = rows.groupBy("l", "p").cogroup(each.groupBy("list", "part")).applyInArrow(best, f"qid {kinds['qid']}, id {kinds['id']}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid, hits, wanted``: how many of a query's exact neighbours (qid, id) were found."""
    marked = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return marked.groupBy("qid").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("wanted"))
