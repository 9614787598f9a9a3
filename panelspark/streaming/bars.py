"""Structured Streaming over ticks: closed bars, deduplication, merges into a table, stateful means."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelspark.operators.merge import upsert_larger


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The driver's events as a stream of ticks; the time becomes a timestamp, as watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return raw.select(F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("px"), "event_id", "event_type")


def session_bars(ticks: DataFrame, late: str = "1 hour", start: str = "7 hours") -> DataFrame:
    """Daily session bars; in append mode a bar comes once its session is closed and `late` is over, as an open period is not written."""
    key = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy("item_id", F.window("ts", "1 day", "1 day", start)).agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"), F.count("*").alias("obs")
    )
    return bars.select("item_id", F.col("window.start").alias("opened"), "open", "high", "low", "close", "obs")


def activity(ticks: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of an item's ticks without a pause longer than `gap`."""
    s = ticks.withWatermark("ts", late).groupBy("item_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("item_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def deduplicated(ticks: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merge_into(path: str, keys: list[str], size: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table of versions; a batch that is run again writes its version again."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), size).alias("_v")).select(*keys, "_v.*")
        if epoch:
            new = upsert_larger(batch.sparkSession.read.parquet(f"{path}/{epoch - 1}"), new, keys, size)
        new.write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write


def running_mean(ticks: DataFrame, alpha: float) -> DataFrame:
    """The recursive mean of each item's prices, event by event, kept in the state store between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for x in rows["px"]:
            if x == x:
                mean = x if mean is None else mean + alpha * (x - mean)
            out.append(mean)
        if mean is not None:
            state.update((float(mean),))
        yield pd.DataFrame({"item_id": key[0], "event_id": rows["event_id"].to_numpy(), "mean": out})

    return ticks.select("item_id", "ts", "event_id", "px").groupBy("item_id").applyInPandasWithState(step, "item_id string, event_id long, mean double", "mean double", "append", GroupStateTimeout.NoTimeout)


class OrderedMean(StatefulProcessor):
    """Holds an item's events back until the watermark has passed them, then folds them in order of (ts, event_id).

    State: the events that wait, packed into bytes as each batch brings them, and the mean so far. One timer an item, at its earliest waiting event; when it
    expires all events up to the watermark are folded and handed on, and the timer is set to the next one that waits.
    """

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.mean = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([_packed(frame) for frame in rows])
        self.waiting.appendValue((new.tobytes(),))
        self._set_timer(int(new["ts"].min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(bytes(r[0]) for r in self.waiting.get()), EVENT)
        held = held[np.lexsort((held["event_id"], held["ts"]))]
        n = int(np.searchsorted(held["ts"] // 1000, until, "right"))
        due, rest = held[:n], held[n:]
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._set_timer(int(rest["ts"][0]) // 1000)
        else:
            self.waiting.clear()
        before = self.mean.get()
        mean = before[0] if before is not None else None
        out = []
        for x in due["px"].tolist():
            if x == x:
                mean = x if mean is None else mean + self.alpha * (x - mean)
            out.append(mean)
        if mean is not None:
            self.mean.update((mean,))
        if n:
            yield pd.DataFrame({"item_id": key[0], "event_id": due["event_id"], "mean": pd.array(out, "Float64")})

    def _set_timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            if t <= at:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


EVENT = np.dtype([("ts", "<i8"), ("event_id", "<i8"), ("px", "<f8")])  # ts in microseconds


def _packed(frame: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(frame), EVENT)
    out["ts"] = frame["ts"].to_numpy("datetime64[us]").astype(np.int64)
    out["event_id"], out["px"] = frame["event_id"].to_numpy(), frame["px"].to_numpy(float, na_value=np.nan)
    return out


def ordered_mean(ticks: DataFrame, alpha: float, late: str = "1 hour") -> DataFrame:
    """running_mean for events that come out of order by less than `late`: the mean of the events in order of time, whatever the order they came in.

    An event's mean comes once the watermark has passed it; what is later than that is dropped, as watermarks do. Needs the RocksDB state store.
    """
    rows = ticks.select("item_id", "ts", "event_id", "px").withWatermark("ts", late)
    return rows.groupBy("item_id").transformWithStateInPandas(OrderedMean(alpha), "item_id string, event_id long, mean double", "append", "eventTime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drain(stream: DataFrame, base: str, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote, as a table in the shared folder `base`. conf: settings for this query alone."""
    session, before = stream.sparkSession, {}
    for k, v in (conf or {}).items():
        before[k] = session.conf.get(k, None)
        session.conf.set(k, v)
    try:
        return _drained(stream, base, mode)
    finally:
        for k, v in before.items():
            session.conf.unset(k) if v is None else session.conf.set(k, v)


def _drained(stream: DataFrame, base: str, mode: str) -> DataFrame:
    run = f"{base}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{run}/state").format("parquet").option("path", f"{run}/out").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/out")


def drain_into(stream: DataFrame, base: str, keys: list[str], size: str) -> DataFrame:
    run = f"{base}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{run}/state").foreachBatch(merge_into(f"{run}/table", keys, size)).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{run}/table/{q.lastProgress['batchId']}")
