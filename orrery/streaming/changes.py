"""File events: debounce into batches, and incremental maintenance by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from concurrent.futures import Future
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, key: str, ts: str, gap: str, value: str, *, watermark: str | None = None) -> DataFrame:
    """(``key``, ``start``, ``end``, ``n_events``, ``changed``): one batch for each run of events without a gap.

    The same plan runs on a table and on a stream; a stream needs a watermark to let batches close.
    """
    if watermark:
        events = events.withWatermark(ts, watermark)
    window = F.session_window(F.col(ts), gap).alias("w")
    rows = events.groupBy(window, F.col(key)).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set(value)).alias("changed"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "changed")


def maintain(
    stream: DataFrame, index_paths: Callable[[list[str] | DataFrame], object], checkpoint: str, *, path: str = "path", once: bool = False, as_table: bool = False, reconcile: Callable[[], object] | None = None
) -> StreamingQuery:
    """Index the distinct paths of every micro-batch. A failed batch is run again from the checkpoint; indexing is idempotent.

    With ``as_table`` the paths are handed on as a table and never come to the driver. ``reconcile`` runs once before the stream: what
    changed while nobody watched is then indexed first.
    """

    def flush(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct()
        if as_table:
            if not paths.isEmpty():
                index_paths(paths)
        elif listed := [r[0] for r in paths.orderBy("path").collect()]:
            index_paths(listed)

    if reconcile is not None:
        reconcile()
    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


class SingleFlight:
    """Calls with one key that overlap share one run and its outcome; nothing is kept once it has ended."""

    def __init__(self) -> None:
        self._lock = Lock()
        self._running: dict[Hashable, Future] = {}

    def run(self, key: Hashable, call: Callable[[], object]) -> object:
        with self._lock:
            joined = self._running.get(key)
            own = None if joined else self._running.setdefault(key, Future())
        if joined:
            return joined.result()
        try:
            own.set_result(call())
        except BaseException as error:
            own.set_exception(error)
        finally:
            with self._lock:
                del self._running[key]
        return own.result()


def event_types(df: DataFrame) -> DataFrame:
    """Moves count for both of their paths; other events for their one."""
    return df.select(F.explode(F.when(F.col("kind") == "moved", F.array("src", "dst")).otherwise(F.array("src"))).alias("path"), "kind", "ts").filter("path IS NOT NULL")
