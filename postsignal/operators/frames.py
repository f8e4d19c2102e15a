"""The frames behind the four charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .sampling import IndexedRows, global_index, rolling_mean, rolling_window, systematic_sample

MAX_POINTS = 10_000


def plot_frame(joined: DataFrame, *keep: str) -> DataFrame:
    """Scores with missing values as 0 and a missing label as neutral."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    label = F.coalesce(F.nullif(F.col("sentiment_label"), F.lit("")), F.lit("neutral"))
    return joined.select(
        *keep, "ts", zero("composite_signal"), zero("sentiment_score"),
        label.alias("sentiment_label"), zero("engagement_score"),
    )


def sampled_frame(frame: DataFrame, key: str, max_points: int = MAX_POINTS) -> IndexedRows:
    return systematic_sample(global_index(frame, ["ts", key]), max_points)


def signal_over_time(frame: DataFrame, key: str, max_points: int = MAX_POINTS) -> DataFrame:
    """Sampled signal with its rolling mean over the sampled points."""
    sample = sampled_frame(frame.select("ts", key, "composite_signal"), key, max_points)
    return rolling_mean(sample, "composite_signal", rolling_window(sample.count)).drop("idx")


def engagement_vs_sentiment(frame: DataFrame, key: str, max_points: int = MAX_POINTS) -> DataFrame:
    sample = sampled_frame(frame.select("ts", key, "sentiment_score", "engagement_score"), key, max_points)
    return sample.rows.select(key, "sentiment_score", "engagement_score")


def signal_summary_long(summary: DataFrame) -> DataFrame:
    """A one-row signal summary as (panel, metric, value) rows."""
    mean, lower, upper = (
        F.col(c) for c in ("mean_signal", "confidence_interval_lower", "confidence_interval_upper")
    )
    labels = [c for c in summary.columns if c.endswith("_posts") and c != "total_posts"]
    cells = [
        ("interval", "mean_signal", mean),
        ("interval", "error_low", mean - lower),
        ("interval", "error_high", upper - mean),
        *[("labels", c.removesuffix("_posts"), F.col(c)) for c in labels],
        ("means", "mean_signal", mean),
        ("means", "mean_sentiment", F.col("mean_sentiment")),
        ("means", "mean_engagement", F.col("mean_engagement")),
        ("size", "total_posts", F.col("total_posts")),
    ]
    row = lambda p, m, v: F.struct(
        F.lit(p).alias("panel"), F.lit(m).alias("metric"), v.cast("double").alias("value")
    )
    return summary.select(F.inline(F.array(*[row(*c) for c in cells])))
