"""Keyed writes as DataFrame operations: insert-if-absent, upsert, cascade, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import first_per_group


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order_by: list) -> DataFrame:
    """Rows of `batch` (first per key) whose key `target` lacks.

    The target is first reduced to the keys the batch holds. Spark broadcasts
    the batch's keys when they are small enough, and then a huge target is
    scanned for one column and not shuffled.
    """
    unique = first_per_group(batch, [key], order_by)
    # One row per key on the right, so that many copies of one text do not meet.
    stored = target.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return unique.join(stored, key, "left_anti").select(*batch.columns)


def upsert(
    target: DataFrame, batch: DataFrame, key: str, keep_old: tuple[str, ...] = ()
) -> DataFrame:
    """`target` with the rows of `batch` replacing or joining its own, by key.

    `target` has unique keys; of rows in `batch` that share a key, the last counts
    (see `last_per_key`). One full outer join, so each side is shuffled once.
    `keep_old` columns keep the target's value where it has one.
    """
    batch = last_per_key(batch, key)
    joined = target.alias("t").join(
        batch.withColumn("_in_batch", F.lit(True)).alias("b"), key, "full_outer"
    )

    def pick(c: str):
        if c == key:
            return F.col(key)
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}")
        if c in keep_old:
            return F.coalesce(old, new).alias(c)
        return F.when(F.col("_in_batch"), new).otherwise(old).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def last_per_key(batch: DataFrame, key: str, order_by: list | None = None) -> DataFrame:
    """One row per key: the last by the order columns, then by all other columns.

    Rows are reduced map-side, so a key with very many rows is no hot group.
    """
    others = [c for c in batch.columns if c != key]
    sortable = [c for c in others if "map<" not in dict(batch.dtypes)[c]]
    order = F.struct(*(order_by or []), *sortable)
    last = batch.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return last.select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in batch.columns])


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children that still have a parent."""
    return children.join(parents.select(key), key, "left_semi")


def unique_id_guard(
    batch: DataFrame, id_column: str, key: str, order_by: list, target: DataFrame | None = None
) -> DataFrame:
    """Drop rows whose id was seen before; null ids never clash.

    Rows without an id form groups of one, spread by key, so many nulls do not
    land in one task.
    """
    own = F.when(F.col(id_column).isNull(), F.col(key))
    kept = first_per_group(
        batch.withColumn("_own", own), [id_column, "_own"], order_by
    ).drop("_own")
    if target is None:
        return kept
    taken = target.select(F.col(id_column).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    join_id = F.coalesce(F.col(id_column), F.concat(F.lit("\0"), F.col(key).cast("string")))
    return kept.join(taken, join_id == F.col("_id"), "left_anti")
