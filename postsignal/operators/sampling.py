"""Global row index, systematic and random samples, rolling mean.

None of these sorts in one task: a global order is range-partitioned, written
once, and numbered by partition offset plus position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path

_POSITION = (1 << 33) - 1


class IndexedRows:
    """Rows in a global order with `idx` = 0 … n-1, kept in a scratch table."""

    def __init__(self, rows: DataFrame, count: int):
        self.rows, self.count = rows, count


def global_index(df: DataFrame, order_by: list[str], partitions: int | None = None) -> IndexedRows:
    """Number the rows in the order of `order_by`, which must be unique.

    Range bounds come from a sample, so they may differ when the plan runs
    again; the ordered rows are therefore written once to the shared scratch
    folder, and everything else reads that table. Sampling reads the input once
    more, so it should be a stored table, or cheap. With a unique order the ranges
    stay even, however many rows share one time. The offsets are one row per
    range partition (`partitions`), whatever the number of rows.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    (
        df.repartitionByRange(parts, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION)),
            }
        )
        .write.parquet(path)
    )
    staged = spark.read.parquet(path)
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_size")).collect()
    total, starts = 0, []
    for part, size in sorted((r["_part"], r["_size"]) for r in sizes):
        starts.append((part, total))
        total += size
    offsets = spark.createDataFrame(starts, "_part int, _start bigint")
    # One small row per range partition.
    rows = (
        staged.join(F.broadcast(offsets), "_part")
        .withColumn("idx", F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )
    return IndexedRows(rows, total)


def systematic_sample(indexed: IndexedRows, max_points: int) -> IndexedRows:
    """Every step-th row in order, step = n div max_points; all rows up to max_points.

    The sample holds between max_points and 2 * max_points rows, renumbered.
    """
    step = max(indexed.count // max_points, 1) if indexed.count > max_points else 1
    kept = indexed.rows.filter(F.col("idx") % step == 0).withColumn(
        "idx", (F.col("idx") / step).cast("bigint")
    )
    return IndexedRows(kept, -(-indexed.count // step))


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed and keys.

    Rows rank by an MD5 of key and seed; every task keeps a heap of n, in one pass.
    """
    rank = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_rank", rank).orderBy("_rank", key).limit(n).drop("_rank")


def rolling_window(n: int) -> int | None:
    """Rolling window of a series of n points: a tenth of it, at most 100, none up to 100 points."""
    return min(100, n // 10) if n > 100 else None


def rolling_mean(
    indexed: IndexedRows, value: str, window: int | None, partition_by: tuple[str, ...] = (),
    block: int = 100_000, output: str = "rolling_mean",
) -> DataFrame:
    """Mean of the trailing `window` rows, null until that many were seen.

    The index is cut into equal blocks, and the last window-1 rows of a block
    are also sent to the next one, so each block is computed alone. With
    `partition_by` the rows must be ordered by those columns first; a group may
    span any number of blocks.
    """
    rows = indexed.rows
    if window is None:
        return rows.withColumn(output, F.lit(None).cast("double"))
    block = max(block, window)
    home = F.floor(F.col("idx") / block)
    in_halo = F.col("idx") % block > block - window
    blocks = F.when(in_halo, F.array(home, home + 1)).otherwise(F.array(home))
    spread = rows.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_block", *partition_by).orderBy("idx").rowsBetween(1 - window, 0)
    mean = F.when(F.count(value).over(w) == window, F.avg(value).over(w))
    own = F.col("_block") == home
    return spread.withColumn(output, mean).filter(own).drop("_block")
