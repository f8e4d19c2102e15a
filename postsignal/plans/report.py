"""Reports over stored posts and signals: statistics, charts' frames, documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from ..operators import filters, frames, linking, ranking, summary
from ..session import scratch_path


def statistics(posts: DataFrame, signals: DataFrame, as_of: Column | datetime, top: int = 10) -> DataFrame:
    """The statistics answer as one JSON document."""
    stats = summary.corpus_stats(posts, signals, filters.since(as_of, 24))
    return summary.stats_document(stats, ranking.top_values(posts, "hashtags", top))


def chart_frames(
    posts: DataFrame, signals: DataFrame, key: str = "content_hash", max_points: int = frames.MAX_POINTS
) -> dict[str, DataFrame]:
    """The data of the four charts; fails when no post has a signal."""
    spark, path = posts.sparkSession, scratch_path(posts.sparkSession, "chart")
    # Stored once: the charts read it several times.
    frames.plot_frame(linking.join_signals(posts.select(key, "ts"), signals, key), key).write.parquet(path)
    frame = spark.read.parquet(path)
    if frame.isEmpty():
        raise ValueError("no post has a signal yet: there is nothing to draw")
    return {
        "signal_over_time": frames.signal_over_time(frame, key, max_points),
        "sentiment_distribution": summary.label_shares(frame),
        "engagement_vs_sentiment": frames.engagement_vs_sentiment(frame, key, max_points),
        "signal_aggregation": frames.signal_summary_long(summary.stored_signal_summary(signals)),
    }
