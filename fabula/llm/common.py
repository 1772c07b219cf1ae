"""Helpers that the operators of this subpackage share.

``materialise`` cuts a plan's lineage with a Parquet table in the folder named by ``spark.checkpoint.dir``: the files
outlive any executor, and what was computed once isn't computed again by each reader.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word, where an operator's contract says so, is a run of anything but these six bytes; ``bytes.split()`` without an
#: argument splits on exactly them.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


@functools.cache
def _local_folder(application: str) -> str:
    """One temporary folder for an application; the setting itself can't be changed while Spark runs."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a temporary one is made, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/fabula-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read from there."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows of texts that go to Python at once, at most; a batch is held there and on its way there.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches of them are to have few rows. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in pieces of about ``max_bytes`` of ``column`` (one row at least), so that
    Python objects are never made for more than that at once. What they took is given back to the system when the batches
    end, as workers live on."""
    for batch in batches:
        k, size = 0, 0
        for i, n in enumerate(byte_lengths(batch.column(column))):
            if i > k and size + n > max_bytes:
                yield batch.slice(k, i - k)
                k, size = i, 0
            size += n
        if k < batch.num_rows:
            yield batch.slice(k)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


class Codes(dict):
    """Numbers what it is asked for in the order of asking."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


#: Bits of the bitmap by which ``pick`` passes rows; its size doesn't depend on the data.
PICK_BITS = 24


def pick(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (bigint or null) may be among those of ``wanted``: all of those and few others.

    An exact join follows; this only keeps it from shuffling the texts of rows that cannot match. Tasks make the bitmap's
    256 parts, so that many bytes, whatever the data, reach the driver and are broadcast."""
    import numpy as np
    from pyspark.sql import functions as F

    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - PICK_BITS).cast("int")
    per_part = (1 << PICK_BITS) // 256

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("s").to_numpy()
            for p in np.unique(slots // per_part).tolist():
                found.setdefault(p, np.zeros(per_part, bool))[slots[slots // per_part == p] % per_part] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()])], ["_part", "_bits"])

    dealt = wanted.select(slot.alias("s")).repartition(min(256, partitions(df.sparkSession)), (F.col("s") / per_part).cast("int"))
    rows = df.sparkSession.createDataFrame(dealt.mapInArrow(bitmaps, "_part int, _bits binary").collect(), "_part int, _bits binary")
    place = F.col("_slot") % per_part
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    asked = df.withColumn("_slot", slot).withColumn("_part", (F.col("_slot") / per_part).cast("int"))
    met = asked.join(F.broadcast(rows), "_part")
    return met.filter(F.getbit(byte, 7 - place % 8) == 1).select(*df.columns)
