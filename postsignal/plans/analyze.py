"""Analysing stored posts: look-back, scores, vectors, stored signals, summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.lexicon import ScoringConfig
from ..functions.scoring import analyze_posts
from ..functions.values import as_column
from ..operators import filters, ranking, summary, textvec
from ..sources.tables import Generation, StoredTable, post_store


def signal_store(spark: SparkSession, path: str) -> StoredTable:
    """The stored signals: one per post, each with the time it was first made; a folder per day of the posts."""
    return StoredTable(
        spark, path, schema.SIGNALS, key="content_hash", keep_old=("processed_at",), day="ts"
    )


def signal_moments(spark: SparkSession, path: str) -> StoredTable:
    """The moments of the stored signals, a row or two per write."""
    return StoredTable(spark, path, schema.SIGNAL_PARTS)


def store_signals(
    table: StoredTable, signals: DataFrame, owner: str | None = None, moments: StoredTable | None = None,
    unique: bool = False,
) -> Generation:
    """Upsert signals and, in `moments`, what the write adds to and takes from the stored summary.

    Signals of a key that is stored are taken out of the summary again. They lie in the
    days of the batch, since a post's time stays what it was when it was stored, and only
    these days are read. A replay under the same owner replaces both writes. Signals of posts from
    the post store are `unique` by their key.
    """
    made = table.upsert(signals, owner=owner, unique=unique)
    if moments is not None:
        written = table.generation(made)
        # One date per day of the batch.
        days = [r.day for r in written.select(F.to_date("ts").alias("day")).distinct().collect()]
        old = table.read(before=made.number, days=days)
        gone = old.join(written.select("content_hash"), "content_hash", "left_semi")
        change = summary.signal_parts(written).unionByName(summary.signal_parts(gone, sign=-1))
        moments.append(change, made.owner)
    return made


def stored_summary(moments: StoredTable, level: float = 0.95) -> DataFrame:
    """The summary of all stored signals from their moments: no signal is read."""
    merged = summary.merge_signal_parts(moments.read(), level)
    return summary.zero_for_null(merged, "mean_signal", "std_signal", "mean_sentiment", "mean_engagement")


def choose_posts(
    posts: DataFrame, as_of: Column | datetime, hours: str | int = "24", limit: str | int | None = None,
    key: str = "content_hash",
) -> DataFrame:
    """Posts of the look-back window, newest first up to `limit`."""
    chosen = filters.lookback(posts, hours, as_of)
    n = ranking.parse_limit(limit)
    return chosen if n is None else ranking.newest(chosen, n, key=key)


def build_signals(
    posts: DataFrame, processed_at: Column | datetime | None, vectors: textvec.TextVectors | None = None,
    config: ScoringConfig | None = None,
) -> DataFrame:
    """One signal row per post; without fitted vectors the vector is empty.

    `processed_at` None stamps the time of the batch or query that runs.
    """
    scored = analyze_posts(posts, config)
    if vectors is None:
        scored = scored.withColumn("tfidf", F.array().cast("array<double>"))
    else:
        scored = vectors.transform(scored)
    return _processed(scored, processed_at)


def _processed(scored: DataFrame, at: Column | datetime | None) -> DataFrame:
    return scored.withColumn("processed_at", as_column(at).cast("timestamp"))


def run_analysis(
    spark: SparkSession, posts_path: str, signals_path: str, as_of: datetime,
    hours: str | int = "24", limit: str | int | None = None, fit_vectors: bool = True,
    vector_config: textvec.VectorConfig | None = None, moments_path: str | None = None,
) -> DataFrame:
    """Score the chosen posts, upsert their signals, and return the one-row summary.

    With `moments_path`, the moments of all stored signals are kept there.
    """
    window = filters.parse_lookback(hours)
    posts = post_store(spark, posts_path).read(since=None if window is None else as_of - timedelta(hours=window))
    chosen = choose_posts(posts, as_of, hours, limit)
    if chosen.isEmpty():
        raise ValueError(f"nothing to analyse within hours={hours!r}; hours=\"all\" takes the whole store")
    if fit_vectors:
        # Chosen and split into words once; the vectors carry all that scoring needs.
        _, vectors = textvec.fit_transform(chosen, chosen.columns, config=vector_config)
        signals = _processed(analyze_posts(vectors), as_of)
    else:
        signals = build_signals(chosen, as_of)
    table = signal_store(spark, signals_path)
    # The rows just written are read back, so nothing is scored twice.
    moments = signal_moments(spark, moments_path) if moments_path else None
    made = store_signals(table, signals, moments=moments)
    return summary.aggregate_signals(table.generation(made))
