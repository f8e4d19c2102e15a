"""Summaries of event-time windows that appear once, when the window is closed, and lose no late row.

A stateful aggregation in append mode drops rows behind the watermark without a
trace. Here every micro-batch writes the moments of its windows; the watermark is the
newest time of all earlier batches less the delay, as in Structured Streaming. A batch
emits the windows that its own newest time closes, and keeps apart the rows whose
window was closed before it. All writes carry the batch's name, so replays change nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import summary
from ..session import observed
from ..sources.tables import StoredTable
from .streams import for_each

BOUNDS = ["window_start", "window_end"]
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class WindowFolder:
    """What a window stream keeps below one path: moments, its clock, late rows and closed windows."""

    def __init__(self, spark: SparkSession, path: str):
        bounds = ", ".join(f"{c} timestamp" for c in BOUNDS)
        self.parts = StoredTable(spark, f"{path}/parts", f"{bounds}, {schema.SIGNAL_PARTS}", day="window_end")
        self.clock = StoredTable(spark, f"{path}/clock", "newest bigint")
        self.late = StoredTable(spark, f"{path}/late", f"{schema.LATE_SIGNALS}, {bounds}, watermark timestamp")
        self.spark, self.closed_path = spark, f"{path}/closed"

    def closed(self) -> DataFrame:
        """The summaries of closed windows, each once."""
        return self.spark.read.parquet(self.closed_path).drop("batch")

    def late_rows(self) -> DataFrame:
        """Rows that came after their window was closed, with that window and the watermark they met."""
        return self.late.read()


def start_windows(
    signals: DataFrame, path: str, checkpoint: str, delay: timedelta = timedelta(hours=1),
    width: timedelta = timedelta(hours=1), **trigger,
) -> StreamingQuery:
    """Summaries of windows of `width`, `delay` after the newest time seen; see `WindowFolder` for what it writes.

    A window is open until a batch's newest time is `delay` behind its end. The
    batches after that one meet it closed. Only days with open windows are read.
    """
    folder = WindowFolder(signals.sparkSession, path)
    span = f"{int(width.total_seconds())} seconds"

    def save(batch: DataFrame, owner: str) -> None:
        number, _ = folder.clock.place(owner)
        # One number: the newest time of all earlier batches, in microseconds.
        before = folder.clock.read(before=number).agg(F.max("newest").alias("t")).first().t
        window = F.window("ts", span)
        timed = batch.withColumns({"window_start": window.start, "window_end": window.end}).persist()
        try:
            late = F.coalesce(F.col("window_end") <= _mark(before, delay), F.lit(False))
            newest = Observation()
            seen = timed.observe(newest, F.max(F.unix_micros("ts")).alias("newest"))
            folder.parts.append(summary.signal_parts(seen.filter(~late), BOUNDS), owner)
            behind = timed.filter(late).withColumn("watermark", _mark(before, delay))
            folder.late.append(behind, owner)
        finally:
            timed.unpersist()
        now = max((t for t in (before, observed(newest).get("newest")) if t is not None), default=None)
        known = folder.parts.read(since=None if before is None else _EPOCH + timedelta(microseconds=before) - delay)
        open_before = F.coalesce(F.col("window_end") > _mark(before, delay), F.lit(True))
        ended = known.filter(open_before & (F.col("window_end") <= _mark(now, delay)))
        closed = summary.merge_signal_parts(ended, group_by=BOUNDS)
        closed.write.mode("overwrite").parquet(f"{folder.closed_path}/batch={owner.rpartition('.')[2]}")
        folder.clock.append(folder.spark.createDataFrame([(now,)], "newest bigint"), owner)

    return for_each(signals, save, checkpoint, trigger)


def _mark(newest: int | None, delay: timedelta) -> Column:
    """The watermark after a newest time; null, which nothing is behind of, before the first."""
    if newest is None:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.lit(newest - delay // timedelta(microseconds=1)))
