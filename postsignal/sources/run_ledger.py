"""Ledger of collection runs: one appended row per state change."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.values import utc

STATUSES = ("running", "completed", "failed")


def record_run(
    spark: SparkSession, path: str, run_id: str, started_at: datetime, status: str = "running",
    completed_at: datetime | None = None, seen: int = 0, inserted: int = 0,
    errors: list[str] | None = None,
) -> None:
    if status not in STATUSES:
        raise ValueError(f"unknown run status: {status}")
    ended = None if completed_at is None else utc(completed_at)
    row = (run_id, utc(started_at), ended, status, seen, inserted, errors or [])
    one = spark.createDataFrame([row], schema.RUNS)
    one.coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of each run, newest run first."""
    rows = spark.read.schema(schema.RUNS).parquet(path)
    return newest_first(latest_state(rows))


def latest_state(rows: DataFrame) -> DataFrame:
    """A finished state wins over `running`."""
    state = F.struct(*[c for c in rows.columns if c != "run_id"])
    rank = F.struct(F.col("completed_at").isNotNull(), F.col("completed_at"))
    return rows.groupBy("run_id").agg(F.max_by(state, rank).alias("s")).select("run_id", "s.*")


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id")
