"""Streams: webhook events from files, incremental merging of extractions, windowed counts, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from scriptorium.sources.merge_store import Merge, MergeStore, newest
from scriptorium.sources.readers import webhook_events


def webhook_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Publication events from a folder of JSON files, one a file."""
    return webhook_events(spark.readStream.format("text").option("wholetext", "true").load(folder))


def known_events(events: DataFrame, journals: DataFrame, late: str = "1 hour", time: str = "at", ids: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events with the journal's record, each event once however often it is sent again within `late`; journals: journal and further columns.

    Replays are told by their ids alone, and state older than the watermark is dropped. The journals are a static side,
    joined anew in each batch; events of unknown journals stay, without a record.
    """
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(ids))
    return once.join(journals, "journal", "left")


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", version: str = "version", merge: Merge | None = None, buckets: int = 64, name: str = "stream") -> StreamingQuery:
    """Merge each batch into the MergeStore at path: the newest version of a key, or what `merge(stored, batch)` gives.

    A batch rewrites the buckets of its keys alone. The store's ledger names the last batch of this stream (`name`), so a
    batch that is run again after a failure isn't merged twice, even by rules that add up.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        MergeStore(batch.sparkSession, path, key, buckets).merge(batch, merge or newest([key], version), batch_id, name)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n: tumbling windows over event time, with a watermark (an extension: reports over the stream)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


class Progress(StreamingQueryListener):
    """Calls back with (batch id, rows) after each batch."""

    def __init__(self, callback: Callable[[int, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
