"""Aggregates over scored posts. All are partial + final hash aggregations."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from . import moments

LABELS = ("positive", "negative", "neutral")
MINIMUM_VOLUME = 2000


def z_score(level: float = 0.95) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def interval(value: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Aggregate columns (lower, upper): mean ± z·std/√n, population std, nulls ignored.

    No values give (0, 0).
    """
    margin = F.lit(z_score(level)) * F.stddev_pop(value) / F.sqrt(F.count(value))
    zero = F.lit(0.0)
    return F.coalesce(F.avg(value) - margin, zero), F.coalesce(F.avg(value) + margin, zero)


def confidence_interval(
    df: DataFrame, column: str, level: float = 0.95, group_by: tuple[str, ...] = ()
) -> DataFrame:
    lower, upper = interval(F.col(column), level)
    return df.groupBy(*group_by).agg(
        F.count(column).alias("n"), lower.alias("lower_bound"), upper.alias("upper_bound")
    )


def aggregate_signals(
    signals: DataFrame, level: float = 0.95, group_by: tuple[str, ...] | list = (),
    labels: tuple[str, ...] = LABELS,
) -> DataFrame:
    """Mean, spread and interval of the signal, means of its parts, label counts."""
    lower, upper = interval(F.col("composite_signal"), level)
    return signals.groupBy(*group_by).agg(
        F.avg("composite_signal").alias("mean_signal"),
        F.stddev_pop("composite_signal").alias("std_signal"),
        lower.alias("confidence_interval_lower"),
        upper.alias("confidence_interval_upper"),
        F.avg("sentiment_score").alias("mean_sentiment"),
        F.avg("engagement_score").alias("mean_engagement"),
        F.count("*").alias("total_posts"),
        *[F.count_if(F.col("sentiment_label") == v).alias(f"{v}_posts") for v in labels],
    )


def zero_for_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def stored_signal_summary(signals: DataFrame, level: float = 0.95) -> DataFrame:
    """`aggregate_signals` of a stored table, where missing means read as 0."""
    return zero_for_null(
        aggregate_signals(signals, level), "mean_signal", "std_signal", "mean_sentiment", "mean_engagement"
    )


_MOMENTS = ("composite_signal", "sentiment_score", "engagement_score")


def signal_parts(
    signals: DataFrame, group_by: list | tuple = (), labels: tuple[str, ...] = LABELS, sign: int = 1
) -> DataFrame:
    """What `aggregate_signals` needs of some rows, as parts that `merge_signal_parts` puts together."""
    counts = {"total_posts": F.lit(True)}
    counts |= {f"{v}_posts": F.col("sentiment_label") == v for v in labels}
    return moments.parts(signals, _MOMENTS, group_by, counts, sign)


def merge_signal_parts(
    stored: DataFrame, level: float = 0.95, group_by: tuple[str, ...] | list[str] = (), labels: tuple[str, ...] = LABELS
) -> DataFrame:
    """`aggregate_signals` of all rows behind the parts, without reading the rows."""
    counted = ("total_posts", *[f"{v}_posts" for v in labels])
    merged = moments.merge(stored, _MOMENTS, group_by, counted)
    lower, upper = moments.interval("composite_signal", z_score(level))
    return merged.select(
        *group_by, F.col("composite_signal_mean").alias("mean_signal"),
        moments.spread("composite_signal").alias("std_signal"),
        lower.alias("confidence_interval_lower"), upper.alias("confidence_interval_upper"),
        F.col("sentiment_score_mean").alias("mean_sentiment"), F.col("engagement_score_mean").alias("mean_engagement"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counted],
    )


def label_counts(signals: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return signals.groupBy(label).agg(F.count("*").alias("n"))


def label_shares(signals: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Label counts with their percentage, one decimal; few rows after counting."""
    counted = label_counts(signals, label)
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 1))


def corpus_stats(posts: DataFrame, signals: DataFrame, recent: Column) -> DataFrame:
    """Totals and averages of the two tables, one row.

    `recent` is the condition on a post for being counted as recent.
    """
    post_stats = posts.agg(
        F.count("*").alias("total_posts"),
        F.count_if(recent).alias("recent_posts_24h"),
        F.avg("likes").alias("avg_likes"),
        F.avg("retweets").alias("avg_retweets"),
        F.max("likes").alias("max_likes"),
    )
    signal_stats = signals.agg(
        F.struct(
            F.count("*").alias("total_signals"),
            F.avg("composite_signal").alias("avg_signal"),
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.avg("engagement_score").alias("avg_engagement"),
        )
    )
    return post_stats.withColumn("_s", signal_stats.scalar()).select("*", "_s.*").drop("_s")


def volume_check(posts: DataFrame, minimum: int = MINIMUM_VOLUME) -> DataFrame:
    return posts.agg(
        F.count("*").alias("collected"),
        F.lit(minimum).cast("bigint").alias("minimum"),
        (F.count("*") < minimum).alias("below_minimum"),
    )


def counts_as_map(counted: DataFrame, name: str, count: str = "n") -> Column:
    """A name -> count table of bounded size as one map value."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("o"), name, count)))
    pairs = F.transform(entries, lambda e: F.struct(e[name], e[count]))
    return counted.agg(F.map_from_entries(pairs)).scalar()


# Keys of the two answer documents are those their readers know.


def stats_document(stats: DataFrame, top_tags: DataFrame, tag: str = "hashtag") -> DataFrame:
    """The corpus statistics as one nested JSON document.

    `top_tags` is a top-k report, so the map stays small.
    """
    return stats.select(
        F.to_json(
            F.struct(
                F.col("total_posts").alias("total_tweets"),
                "total_signals",
                F.col("recent_posts_24h").alias("recent_tweets_24h"),
                F.struct("avg_likes", "avg_retweets", "max_likes").alias("engagement_stats"),
                F.struct("avg_signal", "avg_sentiment", "avg_engagement").alias("signal_stats"),
                counts_as_map(top_tags, tag).alias("top_hashtags"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )


def analysis_document(aggregated: DataFrame, saved: Column | None = None) -> DataFrame:
    """An `aggregate_signals` row as the nested analysis answer.

    `saved` is the number of stored signals, all posts by default.
    """
    total = F.col("total_posts")
    label_columns = [c for c in aggregated.columns if c.endswith("_posts") and c != "total_posts"]
    distribution = F.struct(*[F.col(c).alias(c.removesuffix("_posts")) for c in label_columns])
    scalars = [c for c in aggregated.columns if not c.endswith("_posts")]
    signals = F.struct(
        *scalars, total.alias("total_tweets"), distribution.alias("sentiment_distribution")
    )
    return aggregated.select(
        F.to_json(
            F.struct(
                F.lit("success").alias("status"),
                (total if saved is None else saved).alias("tweets_analyzed"),
                total.alias("total_tweets_processed"),
                signals.alias("aggregated_signals"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )
