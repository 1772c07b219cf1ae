"""A positional inverted index and what it answers by itself: conjunctions, alternatives, phrases and cover density.

``build`` gives a posting for each document and term: the document's length and where the term stands. Texts are tokenised
where they are read and a document's postings are made in one step, so building shuffles nothing; ``write_index`` deals
them to buckets of terms, sorted by term, and ``read_index`` reads the buckets of the terms that are asked for.

A query is a list of units, each a phrase of one token or more. A cover is a shortest stretch of a document that satisfies
the query: every unit (``all``) or any unit (``any``), none of whose parts does. Each cover adds ``WEIGHT / (1 + noise)`` to
the document's rank, ``noise`` being its positions that no token of the query stands at. The covers of a document come from
one sweep over its merged positions: at the end of each unit the last start of every unit is known, and the earliest (or,
for ``any``, the latest) of these starts a cover if it lies after the start of the cover before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a position counts in the rank if no weights are given.
WEIGHT = 0.1
BUCKETS = 64
TOKEN = r"[\p{L}\p{N}]+"
#: Characters of texts that are tokenised at once.
SLICE = 1 << 20
POSTING = "term string, len bigint, positions array<int>"


def build(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, len, positions`` (from 1) of every document; one without tokens has no posting. A null id is an id."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    return source.mapInArrow(_postings, f"id {source.schema['id'].dataType.simpleString()}, {POSTING}")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    find = regex.compile(TOKEN).findall
    for batch in batches:
        rows: list[tuple[int, str, int, list[int]]] = []
        held = 0
        for k, text in enumerate(batch.column("text")):
            places: dict[str, list[int]] = {}
            words = find(text.as_py() or "")
            for at, word in enumerate(words, 1):
                places.setdefault(word, []).append(at)
            rows += [(k, term, len(words), at) for term, at in places.items()]
            held += len(words)
            if held > SLICE // 8:
                yield _batch(batch.column("id"), rows)
                rows, held = [], 0
        if rows:
            yield _batch(batch.column("id"), rows)


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    of, terms, lens, places = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [ids.take(pa.array(of, pa.int64())), pa.array(terms, pa.string()), pa.array(lens, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["id", "term", "len", "positions"])


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = BUCKETS, parts: int = 8) -> None:
    """Writes postings by bucket. A bucket is ``parts`` files by document, so that no term, however frequent, is one task's."""
    dealt = index.withColumn("bucket", bucket(F.col("term"), buckets))
    dealt = dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of ``terms``, a stated list: only their buckets are listed, and of those only row groups with a term."""
    index = spark.read.parquet(path)
    if not terms:
        return index.filter(F.lit(False)).drop("bucket")
    hashes = spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(bucket(F.col("t"), buckets)).distinct()
    wanted = [r[0] for r in hashes.collect()]  # as many as buckets at most
    return index.filter(F.col("bucket").isin(wanted) & F.col("term").isin([*terms])).drop("bucket")


def query_tokens(queries: DataFrame) -> DataFrame:
    """``qid, term`` of queries (qid, units), distinct."""
    return queries.select("qid", F.explode(F.array_distinct(F.flatten("units"))).alias("term"))


def matched(queries: DataFrame, index: DataFrame, every: bool) -> DataFrame:
    """``qid, units, id, found`` (map of term to positions): documents with all tokens of a query, or with some.

    Queries are few and postings many: those of the queries' terms are picked first, and only they are grouped."""
    asked = query_tokens(queries)
    need = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("_need")).join(queries, "qid")
    hits = index.join(asked, "term").groupBy("qid", "id").agg(F.collect_list(F.struct("term", "positions")).alias("_found"))
    rows = hits.join(need, "qid")
    if every:
        rows = rows.filter(F.size("_found") == F.col("_need"))
    return rows.select("qid", "units", "id", F.map_from_entries("_found").alias("found"))


def ends_of(unit: Column, found: Column) -> Column:
    """The positions at which a phrase ends: those of its last token that its other tokens precede, each in its place."""
    none = F.array().cast("array<int>")
    shifted = F.transform(unit, lambda term, k: F.transform(F.coalesce(F.try_element_at(found, term), none), lambda p: p + F.size(unit) - 1 - k))
    return F.aggregate(F.slice(shifted, 2, F.size(unit)), F.element_at(shifted, 1), lambda a, b: F.array_intersect(a, b))


def covers(rows: DataFrame, every: bool = True) -> DataFrame:
    """``rows`` of ``matched`` with ``covers``: structs of first and last position and ``noise``, in order.

    Events are the positions of tokens, each followed by the units that end there. The tokens of a phrase stand side by
    side, so a unit of w tokens that ends at the n-th token begins at the (n - w + 1)-th."""
    event = "array<struct<pos:int,unit:int,width:int>>"
    spots = F.array_distinct(F.flatten(F.map_values("found")))
    tokens = F.transform(spots, lambda p: F.struct(p.alias("pos"), F.lit(-1).alias("unit"), F.lit(0).alias("width"))).cast(event)
    ends = F.flatten(
        F.transform(
            F.col("units"),
            lambda unit, u: F.transform(ends_of(unit, F.col("found")), lambda p: F.struct(p.alias("pos"), u.cast("int").alias("unit"), F.size(unit).alias("width"))),
        )
    ).cast(event)
    rows = rows.withColumn("_spots", F.array_sort(spots)).withColumn("_events", F.array_sort(F.concat(tokens, ends)))
    pick = F.array_min if every else F.array_max
    start = lambda acc: pick(acc["last"])
    closes = lambda acc: acc["fresh"] & (start(acc) > acc["before"])

    def closed(acc: Column) -> Column:
        """The state with the cover that ends at the token before, if there is one."""
        first = F.get(F.col("_spots"), start(acc) - 1)
        last = F.get(F.col("_spots"), acc["n"] - 1)
        cover = F.struct(first.alias("first"), last.alias("last"), (last - first - (acc["n"] - start(acc))).alias("noise"))
        return F.when(closes(acc), F.concat(acc["covers"], F.array(cover))).otherwise(acc["covers"])

    state = "struct<n:int,before:int,fresh:boolean,last:array<int>,covers:array<struct<first:int,last:int,noise:int>>>"

    def step(acc: Column, x: Column) -> Column:
        token = F.struct(
            (acc["n"] + 1).alias("n"),
            F.when(closes(acc), start(acc)).otherwise(acc["before"]).alias("before"),
            F.lit(False).alias("fresh"),
            acc["last"].alias("last"),
            closed(acc).alias("covers"),
        )
        unit = F.struct(
            acc["n"].alias("n"),
            acc["before"].alias("before"),
            F.lit(True).alias("fresh"),
            F.transform(acc["last"], lambda v, u: F.when(u == x["unit"], acc["n"] - x["width"] + 1).otherwise(v)).alias("last"),
            acc["covers"].alias("covers"),
        )
        return F.when(x["unit"] < 0, token.cast(state)).otherwise(unit.cast(state))

    begin = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("before"), F.lit(False).alias("fresh"), F.transform("units", lambda _: F.lit(0)).alias("last"), F.array().alias("covers")
    ).cast(state)
    return rows.withColumn("covers", F.aggregate("_events", begin, step, closed)).drop("_spots", "_events")


def cover_density(queries: DataFrame, index: DataFrame, every: bool = True, weight: float = WEIGHT) -> DataFrame:
    """``qid, id, score, n_covers, first, last`` (of the tightest cover, the earliest of equals) of the documents that satisfy
    queries (qid, units: array of arrays of tokens). A query without units is satisfied by none."""
    rows = covers(matched(queries, index, every), every).filter(F.size("covers") > 0)
    score = F.aggregate("covers", F.lit(0.0), lambda n, c: n + F.lit(weight) / (1 + c["noise"]))
    tightest = F.array_min(F.transform("covers", lambda c: F.struct(c["noise"].alias("noise"), c["first"].alias("first"), c["last"].alias("last"))))
    return rows.select("qid", "id", score.alias("score"), F.size("covers").cast("bigint").alias("n_covers"), tightest["first"].alias("first"), tightest["last"].alias("last"))
