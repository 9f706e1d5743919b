"""Keeping an index fresh from a stream of changed files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

DIRTY_LIMIT, IDLE_SECONDS = 20, 2.0


class DirtySet:
    """M1-M3 for one process: the set of changed files; ``flush`` gets them at the limit, after a quiet time, or on demand."""

    def __init__(self, flush: Callable[[list[str]], None], limit: int = DIRTY_LIMIT, idle: float = IDLE_SECONDS):
        self._flush, self.limit, self.idle = flush, limit, idle
        self.files: set[str] = set()
        self.last: float | None = None

    def mark(self, path: str, now: float) -> bool:
        self.files.add(path)
        self.last = now
        return self.flush() if len(self.files) >= self.limit else False

    def flush_if_idle(self, now: float) -> bool:
        return self.flush() if self.files and self.last is not None and now - self.last >= self.idle else False

    def flush(self) -> bool:
        if not self.files:
            return False
        files, self.files = sorted(self.files), set()
        self._flush(files)
        return True


def threshold_flushes(events: DataFrame, key: str, time: str, item: str, limit: int = DIRTY_LIMIT, order: str = "event_id") -> DataFrame:
    """M1, batch twin: (key, flush, items, flushed_at): after how many events of each key ``limit`` different items were dirty.

    The counter starts anew at each flush, so a key's events are read in order; they stream through one task key by
    key and only the open set is held. What is left at the end is a last, smaller flush.
    """
    kind = dict(events.dtypes)[key]
    when = dict(events.dtypes)[time]
    schema = f"`{key}` {kind}, flush int, items int, flushed_at {when}"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, dirty, last = None, 0, set(), None
        for batch in batches:
            out = []
            for k, t, i in zip(batch[key], batch[time], batch[item]):
                if k != current:
                    if dirty:
                        out.append((current, number, len(dirty), last))
                    current, number, dirty = k, 0, set()
                dirty.add(i)
                last = t
                if len(dirty) >= limit:
                    out.append((k, number, len(dirty), t))
                    number, dirty = number + 1, set()
            yield pd.DataFrame(out, columns=[key, "flush", "items", "flushed_at"])
        if dirty:
            yield pd.DataFrame([(current, number, len(dirty), last)], columns=[key, "flush", "items", "flushed_at"])

    rows = events.filter(F.col(key).isNotNull()).select(key, time, item, order)
    return rows.repartition(key).sortWithinPartitions(key, time, order).drop(order).mapInPandas(run, schema)


def idle_sessions(events: DataFrame, key: str, time: str, gap: str = "2 seconds", watermark: str = "10 minutes") -> DataFrame:
    """M2 on a stream: (key, first_at, last_at, events) per session that ended; late events beyond the watermark are dropped."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, watermark)
        .groupBy(key, F.session_window(time, gap).alias("s"))
        .agg(F.count("*").alias("events"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
        .select(key, "first_at", "last_at", "events")
    )


class WatchSource(DataSource):
    """A stream of (path, modified_at) of the files below ``path`` that were written since the last batch.

    Registered as ``lodeseam_watch``; the offset is the newest modification time seen, so nothing is kept per file and
    a restarted query goes on where it was. Deletions leave no trace on a file system; whoever deletes names the path.
    """

    @classmethod
    def name(cls) -> str:
        return "lodeseam_watch"

    def schema(self) -> str:
        return "path string, modified_at double"

    def simpleStreamReader(self, schema) -> "_WatchReader":
        return _WatchReader(self.options["path"], float(self.options.get("since", 0)))


class _WatchReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, since: float):
        self.root, self.since = root, since

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def _written(self, after: float, until: float) -> list[tuple[str, float]]:
        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    at = os.stat(path).st_mtime
                except OSError:
                    continue
                if after < at <= until:
                    found.append((path, at))
        return sorted(found)

    def read(self, start: dict):
        found = self._written(start["at"], float("inf"))
        return iter(found), {"at": max((at for _, at in found), default=start["at"])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._written(start["at"], end["at"]))


def watched_files(spark: SparkSession, root: str, since: float = 0.0) -> DataFrame:
    """The stream of files below a folder of this machine that are written from now on, or since a time."""
    spark.dataSource.register(WatchSource)
    return spark.readStream.format(WatchSource.name()).option("since", str(since)).load(root)


def refresh_index(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, interval: str = "2 seconds") -> StreamingQuery:
    """M4-M6: each micro-batch of changed paths, without repeats, goes to ``apply(paths, batch_id)``.

    ``apply`` must be idempotent by batch_id, since a batch may be given again after a failure.
    """
    writer = changes.writeStream.foreachBatch(lambda batch, number: apply(batch.select("path").distinct(), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def dirty_flushes(events: DataFrame, key: str, item: str, limit: int = DIRTY_LIMIT, idle_ms: int = int(IDLE_SECONDS * 1000)) -> DataFrame:
    """M1, M2, M7 on a stream: (key, items, reason): each key's dirty set when it reaches the limit or was quiet for a while.

    The set is keyed state that survives restarts; a processing-time timer flushes quiet keys. Null keys and items are
    passed over.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        dirty = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out.append((k[0], sorted(dirty), "idle"))
            dirty = []
        else:
            seen = set(dirty)
            for batch in batches:
                for value in batch[item]:
                    seen.add(value)
                    if len(seen) >= limit:
                        out.append((k[0], sorted(seen), "limit"))
                        seen = set()
            dirty = sorted(seen)
        if dirty:
            state.update((dirty,))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "items", "reason"])

    rows = events.filter(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, F.col(item).cast("string").alias(item))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, items array<string>, reason string", "dirty array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
