"""Live forms of quotas, of runs that go idle and of replay: state by key with timers, a bounded table, a source with cursors.

Windows of quotas are those of a clock: ``processing`` counts by the time at which a batch is handled, ``event`` by the
rows' own time. Both hold one number for each key and open window; processing-time timers let go of it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fabula.streaming.runs import MAX_RUNS, TTL_SECONDS, byte_quota

# ---- quotas


def window_start(ts, seconds: int):
    """The first millisecond of a time's window, as a column."""
    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    return millis - F.pmod(millis, F.lit(1000 * seconds))


def window_quota(rows: DataFrame, key: str, ts: str, size: str | None, limit: int, seconds: int, id_col: str) -> DataFrame:
    """``id_col, accepted``: which rows pass a limit on their number (``size`` None) or sizes in tumbling windows of a key. A
    refused row uses up nothing. The batch form; rows of a window are taken by time and id."""
    cost = F.col(size).cast("bigint") if size else F.lit(1).cast("bigint")
    dealt = rows.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(id_col), cost.alias("_cost"), window_start(ts, seconds).alias("_window"))
    return byte_quota(dealt, ["_key", "_window"], "_cost", limit, ["_ts", id_col], id_col)


class QuotaProcessor(StatefulProcessor):
    """The streaming form: rows (key, ts, id, cost) of a batch by time and id, each accepted or not."""

    OUTPUT = "key bigint, id bigint, window bigint, accepted boolean"

    def __init__(self, limit: int, seconds: int, clock: str = "processing"):
        if clock not in ("processing", "event"):
            raise ValueError(clock)
        self.limit, self.millis, self.clock = limit, 1000 * seconds, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "window bigint", "used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = sorted((int(t), int(i), int(c)) for part in rows for t, i, c in zip(part["ts"], part["id"], part["cost"], strict=True))
        held: dict[int, int] = {}
        out = []
        for at, i, cost in batch:
            at = now if self.clock == "processing" else at
            window = at - at % self.millis
            if window not in held:
                held[window] = int(self.used.getValue((window,))[0]) if self.used.containsKey((window,)) else 0
                if not self.used.containsKey((window,)):
                    self.handle.registerTimer(now - now % self.millis + self.millis)
            ok = held[window] + cost <= self.limit
            held[window] += cost if ok else 0
            out.append((int(key[0]), i, window, ok))
        for window, used in held.items():
            self.used.updateValue((window,), (used,))
        yield pd.DataFrame(out, columns=["key", "id", "window", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A window of the processing clock is over; of the event clock all but the latest two are let go."""
        now = timerValues.getCurrentProcessingTimeInMs()
        windows = sorted(int(w[0]) for w in self.used.keys())
        over = [w for w in windows if w + self.millis <= now] if self.clock == "processing" else windows[:-2]
        for window in over:
            self.used.removeKey((window,))
        yield pd.DataFrame([], columns=["key", "id", "window", "accepted"])

    def close(self) -> None:
        pass


def quota_stream(rows: DataFrame, key: str, ts: str, size: str | None, limit: int, seconds: int, id_col: str, clock: str = "processing") -> DataFrame:
    """QuotaProcessor.OUTPUT for a stream of rows."""
    cost = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if size else F.lit(1).cast("bigint")
    shaped = rows.select(F.col(key).cast("bigint").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts"), F.col(id_col).cast("bigint").alias("id"), cost.alias("cost"))
    return shaped.groupBy("key").transformWithStateInPandas(QuotaProcessor(limit, seconds, clock), outputStructType=StructType.fromDDL(QuotaProcessor.OUTPUT), outputMode="append", timeMode="processingTime")


# ---- runs that go idle


class IdleProcessor(StatefulProcessor):
    """Tells of each run when it is active (``alive``, with the frames so far), complete (``done``) or has had no frame for
    ``ttl`` seconds (``idle``); with either of the latter its state goes."""

    OUTPUT = "run_id bigint, state string, latest bigint, frames bigint"

    def __init__(self, ttl: int = TTL_SECONDS, done: str = "done"):
        self.ttl, self.done = 1000 * ttl, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "latest bigint, frames bigint, timer bigint")

    def _told(self, key, state: str, latest: int, frames: int) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), state, latest, frames)], columns=["run_id", "state", "latest", "frames"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        _, frames, timer = self.run.get() if self.run.exists() else (0, 0, 0)
        new = [f for part in rows for f in part["frame"]]
        if timer:
            self.handle.deleteTimer(timer)
        frames = int(frames) + len(new)
        if self.done in new:
            self.run.clear()
            yield self._told(key, "done", now, frames)
            return
        self.run.update((now, frames, now + self.ttl))
        self.handle.registerTimer(now + self.ttl)
        yield self._told(key, "alive", now, frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        latest, frames, _ = self.run.get()
        self.run.clear()
        yield self._told(key, "idle", int(latest), int(frames))

    def close(self) -> None:
        pass


def idle_stream(frames: DataFrame, ttl: int = TTL_SECONDS, done: str = "done") -> DataFrame:
    """IdleProcessor.OUTPUT for a stream of frames (run_id, frame)."""
    rows = frames.select(F.col("run_id").cast("bigint").alias("run_id"), "frame")
    return rows.groupBy("run_id").transformWithStateInPandas(IdleProcessor(ttl, done), outputStructType=StructType.fromDDL(IdleProcessor.OUTPUT), outputMode="append", timeMode="processingTime")


class LiveRuns:
    """The table of live runs, ``most`` at most, the oldest going first: the sink (``foreachBatch``) of ``idle_stream``.

    A batch's table is written beside the last one, under the batch's number, from that of the batch before; so a batch that
    is handled again after a restart gives the same table. A row without a run marks that a table is there even if no run
    is live. A table has ``most`` rows at most, so ranking it with a batch's runs keeps so many rows of each task."""

    SCHEMA = "run_id bigint, latest bigint, frames bigint"

    def __init__(self, path: str, most: int = MAX_RUNS):
        self.path, self.most = path.rstrip("/"), most

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The latest table, or that of the last batch ``before`` a number."""
        empty = spark.createDataFrame([], self.SCHEMA)
        try:
            tables = spark.read.schema(f"{self.SCHEMA}, batch bigint").parquet(self.path)
        except AnalysisException:  # no batch was written yet
            return empty
        tables = tables if before is None else tables.filter(F.col("batch") < before)
        latest = tables.agg(F.max("batch")).first()[0]
        return empty if latest is None else tables.filter((F.col("batch") == latest) & F.col("run_id").isNotNull()).drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = batch.groupBy("run_id").agg(F.max_by(F.struct("state", "latest", "frames"), F.struct("latest", "frames", "state")).alias("t"))
        old = self.read(spark, number).join(told.select("run_id"), "run_id", "left_anti")
        new = told.filter("t.state = 'alive'").select("run_id", "t.latest", "t.frames")
        kept = old.unionByName(new).orderBy(F.desc("latest"), "run_id").limit(self.most)
        marker = spark.range(1).select(*(F.lit(None).cast("bigint").alias(c) for c in ("run_id", "latest", "frames")))
        kept.unionByName(marker).write.mode("overwrite").parquet(f"{self.path}/batch={number}")


# ---- replay


class FramePart(InputPartition):
    def __init__(self, run: str, after: int, upto: int):
        self.run, self.after, self.upto = run, after, upto


class FrameReader(DataSourceStreamReader):
    """Frames (run_id, seq, frame) of a Parquet folder for named runs, each from behind its cursor. Offsets are the cursors, so
    a stream that is started again goes on where its checkpoint says. Only cursors pass through the driver; a run's new
    frames are one task's rows, read with the filter pushed down."""

    def __init__(self, options: dict[str, str]):
        self.path, self.cursors = options["path"], {str(k): int(v) for k, v in json.loads(options["cursors"]).items()}

    def _rows(self, columns: list[str], test):
        import pyarrow.dataset as ds
        from pyarrow.lib import ArrowInvalid

        path = self.path.removeprefix("file://")
        try:
            return ds.dataset(path, format="parquet", exclude_invalid_files=True).scanner(columns=columns, filter=test).to_batches()
        except (FileNotFoundError, ArrowInvalid):
            return []

    def initialOffset(self) -> dict:
        return self.cursors

    def latestOffset(self) -> dict:
        import pyarrow.compute as pc

        found = dict(self.cursors)
        for batch in self._rows(["run_id", "seq"], pc.field("run_id").isin([int(r) for r in found])):
            for run, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[str(run)] = max(found[str(run)], seq)
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FramePart(run, start.get(run, -1), upto) for run, upto in end.items() if upto > start.get(run, -1)]

    def read(self, partition: FramePart):
        import pyarrow.compute as pc

        test = (pc.field("run_id") == int(partition.run)) & (pc.field("seq") > partition.after) & (pc.field("seq") <= partition.upto)
        for batch in self._rows(["run_id", "seq", "frame"], test):
            yield batch.sort_by("seq")

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Format ``run_frames``; options ``path`` and ``cursors`` (JSON: run to the last number seen)."""

    @classmethod
    def name(cls) -> str:
        return "run_frames"

    def schema(self) -> str:
        return "run_id bigint, seq bigint, frame string"

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def frame_stream(spark: SparkSession, path: str, cursors: dict[int, int]) -> DataFrame:
    """A stream of the frames behind each run's cursor."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("run_frames").option("path", path).option("cursors", json.dumps(cursors)).load()


def until_idle(query, seconds: float, poll: float = 0.2) -> None:
    """Waits for a streaming query until no row has come for ``seconds``; every row that comes puts the deadline off."""
    deadline, seen = time.monotonic() + seconds, -1
    while query.isActive and time.monotonic() < deadline:
        rows = sum(p.numInputRows for p in query.recentProgress[-1:])
        number = query.lastProgress.batchId if query.lastProgress else -1
        if rows and number != seen:
            deadline, seen = time.monotonic() + seconds, number
        time.sleep(poll)
    query.stop()
