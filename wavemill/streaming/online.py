"""Structured Streaming extensions (survey 2.13): ours, no parity is claimed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window; later rows than `late` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def early_stop_monitor(losses: DataFrame, run: str = "run", margin: float = 1e-4, patience: int = 2, forget_after_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """T04, W07 online: a row for each new loss of a run until it stops; state is five numbers a run.

    Losses of a micro-batch are taken in order of their epoch. One that comes after a later epoch was
    taken is marked `late` and not counted. A run without losses for so long is forgotten. `losses` has
    run (string), epoch, loss."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            best_epoch, best, misses, stopped, last = state.get if state.exists else (0, float("inf"), 0, 0, -1)
            for epoch, loss in pd.concat(list(batches)).sort_values("epoch")[["epoch", "loss"]].itertuples(index=False):
                if stopped:
                    break
                late = int(epoch) <= last
                if not late:
                    better = loss + margin < best
                    best_epoch, best, misses = (int(epoch), float(loss), 0) if better else (best_epoch, best, misses + 1)
                    stopped, last = int(epoch) if misses >= patience else 0, int(epoch)
                out.append((key[0], int(epoch), best_epoch, best, bool(stopped), late))
            state.update((best_epoch, best, misses, stopped, last))
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(out, columns=[run, "epoch", "best_epoch", "best", "stopped", "late"])

    schema = f"{run} string, epoch long, best_epoch long, best double, stopped boolean, late boolean"
    return losses.groupBy(run).applyInPandasWithState(step, schema, "best_epoch long, best double, misses long, stopped long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class _EntityWindows(StatefulProcessor):
    """State of an entity: its origin (and whether that is certain), rows of an uncertain origin by time, open windows by number.

    The origin is the earliest time, so it is certain only once the watermark has reached it: no earlier row
    can be accepted after that. Until then rows are kept by time, which is as long as rows may be late. Then
    they, and later rows, are counted in windows, and a window leaves when the watermark reaches its end.
    Each call to the state store is a message to the JVM, so rows go there as one list, windows that are over
    when their rows are counted never go there, and open windows come as one map."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.origin = handle.getValueState("origin", "origin long, certain boolean")
        self.early = handle.getListState("early", "at long, n long, total double")
        self.open = handle.getMapState("open", "window_id long", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        times, of = np.unique(batch["at"].to_numpy(), return_inverse=True)
        new = zip(times.tolist(), np.bincount(of).tolist(), np.bincount(of, batch["value"].to_numpy()).tolist(), strict=True)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), list(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key, watermark: int, new: list[tuple[int, int, float]]) -> Iterator[pd.DataFrame]:
        now, windows, stored = watermark * 1000, {}, set()
        known = self.origin.get() if new == [] or self.origin.exists() else None
        origin, certain = known or (new[0][0], False)  # new rows are in order of time
        if certain:
            windows = {k[0]: tuple(v) for k, v in self.open.iterator()}
            stored = set(windows)
        else:
            origin = min([origin, *(at for at, _, _ in new[:1])])
            if origin > now:
                self.early.appendList(new)
                self.origin.update((origin, False))
                self.handle.registerTimer(-(-origin // 1000))
                return
            if known:
                new = [*self.early.get(), *new]
                self.early.clear()
            self.origin.update((origin, True))
        changed = set()
        for at, n, total in new:
            k = (at - origin) // self.width
            old = windows.get(k, (0, 0.0))
            windows[k] = (old[0] + n, old[1] + total)
            changed.add(k)
        done = sorted(k for k in windows if origin + (k + 1) * self.width <= now)
        for k in done:
            if k in stored:
                self.open.removeKey((k,))
        for k in changed.difference(done):
            self.open.updateValue((k,), windows[k])
        if len(done) < len(windows):
            self.handle.registerTimer(-(-(origin + (min(windows.keys() - set(done)) + 1) * self.width) // 1000))
        if done:
            yield pd.DataFrame([(key[0], k, *windows[k]) for k in done], columns=["entity", "window_id", "n", "total"])

    def close(self) -> None:
        pass


def entity_windows_online(events: DataFrame, entity: str, ts: str, value: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """T02, W01 online: entity, window_id, n, total for each window whose end the watermark has reached; windows are
    counted from each entity's own first time. Rows later than `late` are dropped before they get here
    (`late_rows` counts them). Rows without entity or time are left out, a null value counts as 0 in the total."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(entity).alias("entity"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value")).where("entity is not null and ts is not null")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kind = rows.schema["entity"].dataType.simpleString()
    out = rows.groupBy("entity").transformWithStateInPandas(_EntityWindows(int(seconds * 1_000_000)), f"entity {kind}, window_id long, n long, total double", "append", "EventTime")
    return out.withColumnRenamed("entity", entity)


def late_rows(query: StreamingQuery) -> int:
    """How many rows of the recent micro-batches came too late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def score_once(predictions: DataFrame, scored: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Scored rows of new files, each exactly once, also if a batch is run again after a crash.

    A batch writes its own folder, then a line of the ledger. One whose line is there is skipped; one that
    failed before its line writes the same folder again. `scored_rows` reads what the ledger names."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        done = ledger(spark, target).where((F.col("query") == query) & (F.col("batch") == number))
        if done.isEmpty():
            scored(batch).write.mode("overwrite").parquet(f"{target}/rows/{query}/{number}")
            _enter(spark, target, query, number)

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _enter(spark: SparkSession, target: str, query: str, number: int) -> None:
    spark.createDataFrame([(query, number)], LEDGER).coalesce(1).write.mode("append").parquet(f"{target}/ledger")


LEDGER = "query string, batch long"


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """query and batch of what is in the target for good."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{target}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scored_rows(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of all batches that the ledger names; none before the first."""
    folders = [f"{target}/rows/{r['query']}/{r['batch']}" for r in ledger(spark, target).toLocalIterator()]
    return spark.read.parquet(*folders) if folders else None


def score_incrementally(predictions: DataFrame, scored, target: str, checkpoint: str):
    """Appends scored rows of new files; a restart goes on where the checkpoint says."""
    return scored(predictions).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
