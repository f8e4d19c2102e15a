"""Structured Streaming forms of collecting, de-duplicating, scoring and summing.

Every query takes a checkpoint folder on shared storage; sinks are files written
per micro-batch under the batch's number, so a replayed batch replaces itself.
"""

from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import as_column, utc
from ..operators import summary
from ..operators.filters import reject_reason
from ..operators.textvec import TextVectors
from ..plans.analyze import build_signals, signal_moments, signal_store, store_signals
from ..plans.collect import Stored, clean_posts, judge_posts, store_judged
from ..sources import run_ledger
from ..sources.search_results import examine_search_pages, flatten_search_pages, read_page_stream
from ..sources.tables import Generation, StoredTable, post_store, refused_store

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(pages: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """Search pages to clean posts, row by row. Posts without a time get `as_of`, by default their batch's time."""
    as_of = as_column(as_of)
    return clean_posts(flatten_search_pages(pages, as_of), as_of)


def examine(pages: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """Search pages to judged posts: with `reason` null for good ones, else with what was read in `raw`."""
    as_of = as_column(as_of)
    return judge_posts(examine_search_pages(pages, as_of), as_of)


def start_ingest(posts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append clean posts to a Parquet folder."""
    writer = posts.writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(trigger)).start()


def dedupe_within(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bounded-state de-duplication: a hash is remembered for `delay` of event time."""
    return posts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def start_unique(posts: DataFrame, path: str, checkpoint: str, delay: str = "1 day", **trigger) -> StreamingQuery:
    """Append the first post of every hash within `delay` of event time to a Parquet folder.

    The hashes are held by Spark's RocksDB state store, on the executors' disks and
    with its changes in the checkpoint folder, and are evicted behind the watermark:
    what is held grows with the posts of twice the `delay`, not with the stream. Posts older
    than the watermark are dropped; `state_report` counts them.
    """
    spark = posts.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps what it was started with
    try:
        return start_ingest(dedupe_within(posts, delay), path, checkpoint, **trigger)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def state_report(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: state rows held, bytes held, and rows dropped behind the watermark."""
    return [
        {
            "batch": p["batchId"], "held": s["numRowsTotal"], "bytes": s["memoryUsedBytes"],
            "dropped": s["numRowsDroppedByWatermark"],
        }
        for p in query.recentProgress for s in p["stateOperators"]
    ]


def start_store(
    posts: DataFrame, table_path: str, ledger_path: str | None, checkpoint: str, refused_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Store what is new in every batch, whoever stored the rest; a ledger run per batch.

    A post is new if neither its hash nor its id is stored or came earlier in
    the batch. `posts` come from `examine` or `ingest`. Every batch has two sinks: good posts go
    to the store, refused posts and pages with their reason to `refused_path`. `seen` counts
    the batch's different good posts, `inserted` those stored, and the run's notes
    list the refused by reason.
    """
    spark = posts.sparkSession

    def store(batch: DataFrame, owner: str) -> Stored:
        refused = refused_store(spark, refused_path) if refused_path else None
        return store_judged(post_store(spark, table_path), _judged(batch), ["ts", "tweet_id"], owner, refused)

    return for_each(posts, _recorded(spark, store, ledger_path), checkpoint, trigger)


def start_signals(
    posts: DataFrame, posts_path: str, signals_path: str, as_of: datetime | None, checkpoint: str,
    lookback_hours: int | None = None, ledger_path: str | None = None, refused_path: str | None = None,
    vectors: TextVectors | None = None, moments_path: str | None = None, **trigger,
) -> StreamingQuery:
    """Store each batch's new posts as `start_store` does, score them and upsert their signals.

    Only posts new to the store are scored: a later copy of a stored text keeps
    the stored post's time and signal. With `lookback_hours`, the whole window before a
    batch's time is scored anew instead, whoever stored the posts; only the window's days
    are read. What the query has scored itself since it was started would get the same
    signal again, so it is left out until another writer changes the signals or the posts.
    Replays give the same tables. `as_of` None stamps each
    batch with its own time. `vectors` is a fitted model (see `textvec.load`); without one,
    vectors are empty. With `moments_path`, the moments of all stored signals are kept there.
    """
    spark = posts.sparkSession
    window = _Window()

    def score(batch: DataFrame, owner: str) -> Stored:
        table, signals = post_store(spark, posts_path), signal_store(spark, signals_path)
        refused = refused_store(spark, refused_path) if refused_path else None
        stored = store_judged(table, _judged(batch), ["ts", "tweet_id"], owner, refused)
        now = as_of or datetime.now(timezone.utc)
        if lookback_hours is None:
            chosen = table.generation(stored.generation)
        else:
            chosen = window.unscored(table, signals, utc(now) - timedelta(hours=lookback_hours))
        moments = signal_moments(spark, moments_path) if moments_path else None
        # The post store has a hash once.
        made = store_signals(signals, build_signals(chosen, now, vectors), owner, moments, unique=True)
        if lookback_hours is not None:
            window.done(signals, made)
        return stored

    return for_each(posts, _recorded(spark, score, ledger_path), checkpoint, trigger)


class _Window:
    """What of a look-back window one start of a signal stream has scored: names and times of writes, no rows."""

    def __init__(self):
        self.posts: dict[Generation, int] = {}
        self.signals: dict[Generation, int] = {}
        self.reading: dict[Generation, int] = {}
        self.since: datetime | None = None

    def unscored(self, posts: StoredTable, signals: StoredTable, since: datetime) -> DataFrame:
        """The window's posts, without those of writes that are scored and unchanged.

        All of them, if another has written signals since, or the window reaches further back.
        """
        stored = signals.commits()
        if stored != self.signals or self.since is None or since < self.since:
            self.posts = {}
        self.signals, self.since, self.reading = stored, since, posts.commits()
        same = frozenset(g for g, time in self.posts.items() if self.reading.get(g) == time)
        return posts.read(since=since, without=same)

    def done(self, signals: StoredTable, made: Generation) -> None:
        """What `unscored` gave is stored in `made`."""
        # Another's write in the meantime is not taken in, so that the next batch scores the whole window.
        self.posts, self.signals = self.reading, {**self.signals, made: signals.commits()[made]}


def _judged(batch: DataFrame) -> DataFrame:
    return batch if "reason" in batch.columns else batch.withColumn("reason", reject_reason())


def _recorded(spark: SparkSession, action, ledger_path: str | None):
    """The action on a persisted batch, with a ledger run: running, then completed or failed."""

    def run(batch: DataFrame, owner: str) -> None:
        started = datetime.now(timezone.utc)
        note = lambda *state, **more: ledger_path and run_ledger.record_run(
            spark, ledger_path, owner, started, *state, **more
        )
        note()
        batch.persist()
        try:
            done = action(batch, owner)
        except Exception as error:
            note("failed", datetime.now(timezone.utc), errors=[str(error)])
            raise
        finally:
            batch.unpersist()
        note("completed", datetime.now(timezone.utc), seen=done.seen, inserted=done.inserted, errors=done.notes)

    return run


def hourly(signals: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Signal summary per time window; rows later than the watermark are dropped in append mode."""
    timed = signals.withWatermark("ts", delay) if signals.isStreaming else signals
    grouped = summary.aggregate_signals(timed, group_by=[F.window("ts", width)])
    return grouped.withColumn("hour", F.col("window.start")).drop("window")


def start_summary(aggregated: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write a windowed summary; each batch has its own folder.

    In append mode all folders together are the result, in complete mode the
    last one is.
    """

    def save(batch: DataFrame, owner: str) -> None:
        number = owner.rpartition(".")[2]
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return for_each(aggregated, save, checkpoint, trigger, mode)


def last_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest batch folder of a complete-mode summary."""
    batches = spark.read.parquet(path)
    return batches.filter(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")


def _trigger(trigger: dict) -> dict:
    return trigger or {"availableNow": True}


def for_each(df: DataFrame, action, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    """Run `action(batch, owner)` per micro-batch.

    The owner is the query's lasting id and the batch's number: the same for a
    replay, and another's for every other stream, new checkpoints included.
    """
    started, name = threading.Event(), []

    def run(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        action(batch, f"{name[0]}.{batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(run)
    query = writer.option("checkpointLocation", checkpoint).trigger(**_trigger(trigger)).start()
    name.append(str(query.id))
    started.set()
    return query
