"""Event streams of runs: replay buffers, completion, progress, quotas. Each has a batch form and a streaming form.

Streaming state is held for each run (or key) alone, so it is dealt by key and bounded by what a run may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

RING = 4096
TTL_SECONDS = 600
MAX_RUNS = 256


def replay(frames: DataFrame, cursor: DataFrame) -> DataFrame:
    """Frames (run_id, seq, …) after each run's cursor (run_id, seen), in order of their number."""
    rows = frames.join(cursor, "run_id").filter(F.col("seq") > F.col("seen"))
    return rows.drop("seen").orderBy("run_id", "seq")


def ring(frames: DataFrame, size: int = RING) -> DataFrame:
    """The last ``size`` frames of each run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    return frames.withColumn("_p", place).filter(F.col("_p") <= size).drop("_p")


def alive(frames: DataFrame, now: str, ttl: int = TTL_SECONDS, most: int = MAX_RUNS, done: str = "done") -> DataFrame:
    """Runs that aren't complete and had a frame in the last ``ttl`` seconds, the ``most`` latest of them."""
    runs = frames.groupBy("run_id").agg(F.max("ts").alias("latest"), F.max((F.col("frame") == done).cast("int")).alias("complete"), F.count(F.lit(1)).alias("frames"))
    idle = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))
    return runs.filter((F.col("complete") == 0) & (idle <= ttl)).orderBy(F.desc("latest"), "run_id").limit(most).select("run_id", "latest", "frames")


def byte_quota(rows: DataFrame, keys: list[str], size: str, limit: int, order: list[str], id_col: str) -> DataFrame:
    """Which items pass a limit on bytes in their window: one that would pass it is refused and uses up nothing, so this is
    a fold in order over a window's items, not a running sum. Rows stream past in order; what is held is one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, 0
        for batch in batches:
            accepted = []
            for *now, n in zip(*(batch[c] for c in [*keys, "_size"]), strict=True):
                if now != key:
                    key, used = now, 0
                ok = used + n <= limit
                used += n if ok else 0
                accepted.append(ok)
            yield pd.DataFrame({id_col: batch["_id"], "accepted": accepted})

    dealt = rows.select(*keys, *order, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"), F.col(id_col).cast("bigint").alias("_id"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{id_col} bigint, accepted boolean")


class RingProcessor(StatefulProcessor):
    """Keeps the last frames of each run and passes each new one on with how many are held; a frame ``done`` ends the run and
    frees its state. Frames that were seen are not passed again, so a restart repeats nothing."""

    STATE = StructType([StructField("seq", LongType()), StructField("frame", StringType())])
    OUTPUT = StructType([StructField("run_id", LongType()), StructField("seq", LongType()), StructField("frame", StringType()), StructField("held", LongType())])

    def __init__(self, size: int = RING, done: str = "done", ttl_ms: int = TTL_SECONDS * 1000):
        self.size, self.done, self.ttl_ms = size, done, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", self.STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.frames.get()] if self.frames.exists() else []
        new = sorted((int(s), f) for part in rows for s, f in zip(part["seq"], part["frame"], strict=True))
        last, out, over = held[-1][0] if held else -1, [], False
        for seq, frame in new:
            if seq <= last:
                continue
            held = [*held, (seq, frame)][-self.size :]
            last = seq
            out.append((key[0], seq, frame, len(held)))
            over = over or frame == self.done
        if over or not held:
            self.frames.clear()
        else:
            self.frames.put(held)
        yield pd.DataFrame(out, columns=["run_id", "seq", "frame", "held"])

    def close(self) -> None:
        pass


def ring_stream(frames: DataFrame, **options) -> DataFrame:
    """The streaming form of the replay buffer over frames (run_id, seq, frame)."""
    made = RingProcessor(**options)
    return frames.groupBy("run_id").transformWithStateInPandas(made, outputStructType=RingProcessor.OUTPUT, outputMode="append", timeMode="processingTime")


def latest_progress(frames: DataFrame) -> DataFrame:
    """The latest state of each run's stages; for streams use output mode update."""
    return frames.groupBy("run_id", "stage").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("updates"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Counts and sums by event-time window, with late events up to ``late``. ``ts`` becomes a timestamp, as watermarks need."""
    rows = events.withColumn("ts", F.col("ts").cast(TimestampType()))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", window), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *(keys or []), "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of a key: events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast(TimestampType()))
    rows = rows.withWatermark("ts", gap) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), "n")
