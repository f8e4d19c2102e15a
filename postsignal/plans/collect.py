"""Collecting posts: raw rows to clean, unique, stored posts."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import text, values
from ..operators import filters, summary
from ..operators.dedupe import dedupe_by_hash
from ..session import observed, scratch_path
from ..sources import run_ledger
from ..sources.tables import Generation, StoredTable, post_store, refused_store

COUNTERS = ("likes", "retweets", "replies")


def clean_posts(raw: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Cleaned text, lists, counters, times, hash and stamp; rows empty after cleaning are dropped.

    Extra columns (an arrival key) pass through. Text counters are parsed,
    numeric ones truncated; an unreadable one is null (see `judge_posts`).
    """
    return _stamped(filters.nonempty(_cleaned(raw)), as_of)


def judge_posts(raw: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Clean posts and, beside them, what is refused: `reason` is null for a good post.

    A `refused` column, as from `examine_search_pages`, goes before the post's own
    faults. Posts that are empty after cleaning are neither good nor refused. What was read
    stays in `raw` for refused rows only: a good post's text is not kept twice.
    """
    early = F.col("refused") if "refused" in raw.columns else F.lit(None).cast("string")
    cleaned = _cleaned(raw).filter((F.col("content") != "") | early.isNotNull())
    judged = _stamped(cleaned, as_of)
    judged = judged.withColumn("reason", F.coalesce(early, filters.reject_reason())).drop("refused")
    if "raw" not in judged.columns:
        return judged
    return judged.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def _cleaned(raw: DataFrame) -> DataFrame:
    # One pass through Python cleans all four columns.
    return raw.withColumns(
        {
            "content": text.clean_text(F.col("content")),
            "username": text.clean_text(F.coalesce("username", F.lit("unknown"))),
            "mentions": text.clean_list(F.col("mentions")),
            "hashtags": text.clean_list(F.col("hashtags")),
        }
    )


def _stamped(cleaned: DataFrame, as_of: Column | datetime) -> DataFrame:
    types = dict(cleaned.dtypes)
    count = lambda c: (values.coerce_count if types[c] == "string" else values.truncate_count)(F.col(c))
    time = values.normalize_timestamp if types["ts"] == "string" else _known_time
    return cleaned.withColumns(
        {
            "ts": time(F.col("ts"), as_of),
            **{c: count(c) for c in COUNTERS},
            "content_hash": text.content_hash(F.col("content")),
            "scraped_at": values.as_column(as_of).cast("timestamp"),
        }
    )


def _known_time(ts: Column, as_of: Column | datetime) -> Column:
    return F.coalesce(ts.cast("timestamp"), values.as_column(as_of).cast("timestamp"))


def process_posts(raw: DataFrame, as_of: Column | datetime, order_by: list) -> tuple[DataFrame, DataFrame]:
    """(unique clean posts, rejected rows with a reason).

    Bad rows are rejected before de-duplication, so they cannot hide a good copy.
    """
    good, bad = filters.split_rejects(clean_posts(raw, as_of), filters.reject_reason())
    return dedupe_by_hash(good, order_by), bad


class Stored(NamedTuple):
    """What a write did: different clean posts, those new to the store, and refused rows by reason."""

    generation: Generation
    seen: int
    inserted: int
    refused: dict[str, int]

    @property
    def notes(self) -> list[str]:
        return [f"{reason}: {n}" for reason, n in sorted(self.refused.items()) if n]


def store_judged(
    table: StoredTable, judged: DataFrame, order_by: list, owner: str, refused: StoredTable | None = None,
    as_of: Column | datetime | None = None,
) -> Stored:
    """Put judged posts into the post store, and what is refused into `refused`, both under one owner.

    `judged` is read several times, so it is stored or persisted. All figures are
    observed by the write of the posts itself: nothing is read again to count.
    """
    if refused is not None:
        raw = F.coalesce("raw.line", F.to_json("raw.p")) if "raw" in judged.columns else F.to_json(F.struct("*"))
        bad = judged.filter("reason is not null").select(
            "reason", raw.alias("raw"), values.as_column(as_of).cast("timestamp").alias("refused_at")
        )
        refused.append(bad, owner)
    reasons, seen, inserted = (Observation() for _ in range(3))
    each = [F.count_if(F.col("reason") == reason).alias(reason) for reason in filters.REASONS]
    watched = judged.observe(reasons, *each)
    good = lambda df: df.filter("reason is null").drop("reason")
    one = F.count(F.lit(1)).alias("n")
    posts = dedupe_by_hash(good(watched), order_by).observe(seen, one)
    made = table.insert(posts, order_by, owner, among=good(judged), watch=lambda df: df.observe(inserted, one))
    return Stored(made, observed(seen).get("n", 0), observed(inserted).get("n", 0), observed(reasons))


def run_collection(
    spark: SparkSession, raw: DataFrame, posts_path: str, ledger_path: str, order_by: list,
    as_of: datetime | None = None, run_id: str | None = None, minimum: int = summary.MINIMUM_VOLUME,
    refused_path: str | None = None,
) -> dict:
    """Process raw posts into the post store and record the run in the ledger.

    `seen` counts the unique clean posts and `inserted` those stored: neither their hash
    nor their id was stored before or came earlier. The ledger
    lists the rejected rows by reason, and a volume below `minimum`; the rows
    themselves go to `refused_path`, if given. A failed run is recorded with its
    error and raised again. The judged posts are written once, so nothing upstream
    runs twice.
    """
    started = as_of or _now()
    run_id = run_id or uuid.uuid4().hex
    run_ledger.record_run(spark, ledger_path, run_id, started)
    try:
        staged_path = scratch_path(spark, "collected")
        judged = judge_posts(raw, started)
        judged.write.parquet(staged_path)
        refused = refused_store(spark, refused_path) if refused_path else None
        staged = spark.read.schema(judged.schema).parquet(staged_path)
        stored = store_judged(post_store(spark, posts_path), staged, order_by, run_id, refused, started)
        notes = stored.notes
        if stored.seen < minimum:
            notes.append(f"volume {stored.seen} below {minimum}")
    except Exception as error:
        run_ledger.record_run(
            spark, ledger_path, run_id, started, "failed", as_of or _now(), errors=[str(error)]
        )
        raise
    counts = {"seen": stored.seen, "inserted": stored.inserted}
    run_ledger.record_run(
        spark, ledger_path, run_id, started, "completed", as_of or _now(), errors=notes, **counts
    )
    return {"run_id": run_id, "generation": stored.generation.number, **counts}


def _now() -> datetime:
    return datetime.now(timezone.utc)
