"""Changes as streams: bursts of events, upserts of changed files, queries after each burst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.cache import ModuleCache
from ..sources.tree import contents, listings


def bursts(events: DataFrame, time: str = "ts", key: str = "path", gap: str = "300 milliseconds", by: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """(by..., start, stop, n, keys): runs of events with no pause of ``gap`` between them.

    The same plan serves a batch and a stream; a stream gets a watermark of ``gap`` unless
    another is named, emits a burst once it is over, and drops events later than that.
    """
    if events.isStreaming:
        events = events.withWatermark(time, watermark or gap)
    w = F.session_window(time, gap).alias("w")
    # A stream's session windows need a key, so all rows share one where none is named; a
    # literal would be folded away.
    out = events.groupBy(w, *(by or [F.pmod(F.hash(key), F.lit(1)).alias("__all")])).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("keys"))
    return out.select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "keys")


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, by: list[str] | None = None, watermark: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(time, watermark)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(*(by or []), F.col("w.start").alias("start"), "n")


def upsert(triples: DataFrame, changed: DataFrame) -> DataFrame:
    """The store with all triples of the changed files replaced by their new ones."""
    files = changed.select("file").distinct()
    return triples.join(files, "file", "left_anti").select(triples.columns).unionByName(changed.where("subject IS NOT NULL"), allowMissingColumns=True)


def watch(spark: SparkSession, folder: str, checkpoint: str, on_files: Callable[[DataFrame, int], None], available_now: bool = True, files_per_trigger: int = 1000) -> StreamingQuery:
    """Calls ``on_files`` with each batch of new source files (path, mtime, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    named = files.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))
    w = named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_files)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


class _Files(StatefulProcessor):
    """Remembers size and mtime of a path.  Each listing that holds the path puts off a timer just
    behind the listing's time; once a later listing has passed without it, the timer tells its end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "size long, mtime timestamp, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("seen").iloc[-1]
        if key[0] == "":
            return
        timer = int(pd.Timestamp(last["seen"]).timestamp() * 1000) + 1
        old = self.known.get() if self.known.exists() else None
        if old:
            self.handle.deleteTimer(old[2])
        self.handle.registerTimer(timer)
        mtime = pd.Timestamp(last["mtime"]).to_pydatetime()
        self.known.update((int(last["size"]), mtime, timer))
        if old is None or old[0] != last["size"] or pd.Timestamp(old[1]) != pd.Timestamp(last["mtime"]):
            yield pd.DataFrame({"path": [key[0]], "mtime": [last["mtime"]], "change": ["added" if old is None else "changed"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        yield pd.DataFrame({"path": [key[0]], "mtime": [pd.Timestamp(0)], "change": ["deleted"]})

    def close(self) -> None:
        pass


def changes(listed: DataFrame) -> DataFrame:
    """(path, mtime, change) from a stream of whole listings: added, changed or deleted."""
    session = listed.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = listed.withWatermark("seen", "0 seconds")
    return seen.groupBy("path").transformWithStateInPandas(_Files(), "path string, mtime timestamp, change string", "update", "eventtime")


def watch_tree(spark: SparkSession, root: str, checkpoint: str, cache: ModuleCache, parse: Callable[[DataFrame], DataFrame], ignore: list[str] | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, every: str = "1 second") -> StreamingQuery:
    """Keeps ``cache`` equal to a fresh build of ``root`` while files are added, changed and deleted.

    ``parse`` takes (path, mtime, content) of added and changed files and returns rows for the
    cache.  A batch that is run again after a failure leaves the same rows.  Only changed files
    are read.
    """
    def apply(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        gone = batch.where("change = 'deleted'").select("path")
        read = contents(batch.where("change <> 'deleted'").select("path", "mtime"), root)
        if not batch.isEmpty():
            cache.versions.commit([("put", parse(read.where("content IS NOT NULL"))), ("gone", gone)])
        if on_batch:
            on_batch(batch, n)
        batch.unpersist()

    w = changes(listings(spark, root, ignore)).writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(apply)
    return w.trigger(processingTime=every).start()
