"""Parents and children written in one commit: readers see both tables of a write, or neither.

A write puts its two tables into a folder of its own and then writes one row into the table of commits. Readers go by that
table, so what a failed write left behind is never read; and as a commit is one small file that appears by a rename, there
is no moment at which a parent is seen without its children. Writes don't wait for each other.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "commit string, at timestamp, n_parents bigint, n_children bigint"


class Families:
    """Tables of parents and children below ``path``."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, parents: DataFrame, children: DataFrame, check: tuple[str, str] | None = None) -> str:
        """Adds both tables and returns the commit's name. ``check``: the parents' key and the children's; a child without a
        parent in the same write is an error, and nothing is committed."""
        spark, name = parents.sparkSession, uuid.uuid4().hex
        place = f"{self.path}/data/{name}"
        parents.write.parquet(f"{place}/parents")
        children.write.parquet(f"{place}/children")
        stored = {side: spark.read.parquet(f"{place}/{side}") for side in ("parents", "children")}
        if check:
            lost = stored["children"].join(stored["parents"].select(F.col(check[0]).alias("_key")), F.col(check[1]) == F.col("_key"), "left_anti")
            if not lost.isEmpty():
                raise ValueError("children without a parent")
        counts = [F.lit(stored[side].count()).alias(f"n_{side}") for side in ("parents", "children")]
        row = spark.range(1).coalesce(1).select(F.lit(name).alias("commit"), F.current_timestamp().alias("at"), *counts)
        row.write.mode("append").parquet(f"{self.path}/commits")
        return name

    def commits(self, spark: SparkSession) -> DataFrame:
        """The commits: COMMIT."""
        try:
            return spark.read.schema(COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException:  # nothing was committed yet
            return spark.createDataFrame([], COMMIT)

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Parents and children of all commits at this moment."""
        names = sorted(r["commit"] for r in self.commits(spark).select("commit").collect())  # one short name a write
        if not names:
            raise ValueError(f"nothing was committed to {self.path}")
        sides = [spark.read.parquet(*(f"{self.path}/data/{n}/{side}" for n in names)) for side in ("parents", "children")]
        return sides[0], sides[1]

    def compact(self, spark: SparkSession) -> str:
        """All commits as one, in a new place: returns it. Readers of this one aren't disturbed."""
        merged = Families(f"{self.path}-{uuid.uuid4().hex}")
        merged.write(*self.read(spark))
        return merged.path
