"""Recording and release journals as keyed state of a stream, dropped by timers once a run is silent.

The state of a run is one short row however many events it has.  A timer on
event time, set past the run's last event, clears it, so that state follows the
runs that are open and not all that have ever been.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
TERMINAL = ("promote", "rollback")


def _frame(**columns: list) -> pd.DataFrame:
    """A frame of plain objects, which the writer turns into the stream's own types."""
    return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})


class _Expiring(StatefulProcessor):
    """A state of two numbers: ``value`` and the time of the key's last event, cleared ``idle_ms`` after it."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "value long, last long")

    def before(self, rows: Iterator[pd.DataFrame], *order: str) -> tuple[pd.DataFrame, int]:
        """The key's rows of this batch in order, and its value before them (0 for a new key)."""
        batch = pd.concat(list(rows)).sort_values(list(order), kind="stable")
        return batch, self.state.get()[0] if self.state.exists() else 0

    def after(self, value: int, last: pd.Timestamp) -> None:
        """Keep the value and put the key's timer behind its last event."""
        known = self.state.get()[1] if self.state.exists() else None
        now = int(last.timestamp() * 1000)
        if known is not None:
            self.handle.deleteTimer(known + self.idle_ms)
            now = max(now, known)
        self.state.update((value, now))
        self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class SpanCap(_Expiring):
    """ok for a run's first spans, limited for those past the cap; the state counts them."""

    def __init__(self, max_spans: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.max_spans = max_spans

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, seen = self.before(rows, "ts", "event_id")
        n = range(seen + 1, seen + len(batch) + 1)
        self.after(seen + len(batch), batch["ts"].iloc[-1])
        yield _frame(run_id=[key[0]] * len(batch), event_id=batch["event_id"].to_list(), recorded=["ok" if i <= self.max_spans else "limited" for i in n])


class Lifecycle(_Expiring):
    """Observations of a release up to its first terminal decision; the state says whether there was one."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, done = self.before(rows, "ts", "event_id")
        end = batch["action"].isin(TERMINAL).to_numpy()
        first = int(end.argmax()) + 1 if end.any() else len(batch)
        self.after(int(bool(done) or bool(end.any())), batch["ts"].iloc[-1])
        live = batch.iloc[: 0 if done else first]
        yield _frame(release_id=[key[0]] * len(live), event_id=live["event_id"].to_list(), action=live["action"].to_list())


def capped(events: DataFrame, max_spans: int, lateness: str = "1 hour", idle_ms: int = 7 * DAY_MS) -> DataFrame:
    """(run_id, event_id, recorded) of a stream of (run_id, event_id, ts): each run's spans past the cap are limited.

    In a batch a run's spans are counted in the order of time and id.  A run
    that is silent for ``idle_ms`` is closed; spans after that start it anew.
    """
    keyed = events.withWatermark("ts", lateness).groupBy("run_id")
    kind = events.schema["run_id"].dataType.simpleString()
    return keyed.transformWithStateInPandas(SpanCap(max_spans, idle_ms), f"run_id {kind}, event_id long, recorded string", "append", "EventTime")


def lifecycle(observed: DataFrame, lateness: str = "1 hour", idle_ms: int = 7 * DAY_MS) -> DataFrame:
    """(release_id, event_id, action) of a stream of (release_id, event_id, ts, action): what counts for each release."""
    keyed = observed.withWatermark("ts", lateness).groupBy("release_id")
    kind = observed.schema["release_id"].dataType.simpleString()
    return keyed.transformWithStateInPandas(Lifecycle(idle_ms), f"release_id {kind}, event_id long, action string", "append", "EventTime")


def drained(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run an appending stream over all that is there now; its rows are a table in the shared folder.

    With ``checkpoint`` and ``out`` of an earlier call the stream goes on where it ended.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out, provider = out or f"{base}/rows", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(out)
