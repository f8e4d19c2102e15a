"""Mergeable moments: counts, means and squared deviations kept per part and put together later.

A part is one row: per column its count `_n`, mean `_mean` and sum of squared
deviations `_m2`, nulls ignored, and per named condition its number of rows. Parts
of disjoint rows merge into the part of all of them, and rows that are gone
count as a part with the sign -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parts(
    df: DataFrame, columns: tuple[str, ...], group_by: list | tuple = (), counts: dict[str, Column] | None = None,
    sign: int = 1,
) -> DataFrame:
    """The moments of `columns` and the row counts of conditions, per group; one partial aggregation."""
    made = [F.count_if(condition).alias(name) for name, condition in (counts or {}).items()]
    for c in columns:
        number = F.count(c)
        made += [
            number.alias(f"{c}_n"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"),
            F.coalesce(F.var_pop(c) * number, F.lit(0.0)).alias(f"{c}_m2"),
        ]
    return df.groupBy(*group_by).agg(*made).withColumn("sign", F.lit(sign))


def merge(
    stored: DataFrame, columns: tuple[str, ...], group_by: list[str] | tuple[str, ...] = (),
    counts: tuple[str, ...] = (),
) -> DataFrame:
    """The moments of all parts together, per group.

    Deviations are shifted to the common mean, which is found first, so that large
    means cost no digits. Parts are few rows: one per write and group.
    """
    keys = list(group_by)
    total = lambda c: F.sum(F.col("sign") * F.col(c))
    means = stored.groupBy(*keys).agg(
        *[(F.try_divide(total_of(c), total(f"{c}_n"))).alias(f"_{c}") for c in columns]
    )
    if keys:
        named = means.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        both = stored.join(named, same)
    else:
        both = stored.withColumns({f"_{c}": means.select(f"_{c}").scalar() for c in columns})
    agged = [total(name).cast("bigint").alias(name) for name in counts]
    for c in columns:
        off = F.col(f"{c}_mean") - F.col(f"_{c}")
        squared = F.col(f"{c}_m2") + F.col(f"{c}_n") * off * off
        agged += [
            F.coalesce(total(f"{c}_n"), F.lit(0)).cast("bigint").alias(f"{c}_n"), F.max(f"_{c}").alias(f"{c}_mean"),
            F.greatest(F.sum(F.col("sign") * squared), F.lit(0.0)).alias(f"{c}_m2"),
        ]
    return both.groupBy(*keys).agg(*agged)


def total_of(column: str) -> Column:
    """The signed sum of a column's values."""
    return F.sum(F.col("sign") * F.col(f"{column}_n") * F.col(f"{column}_mean"))


def spread(column: str) -> Column:
    """Population standard deviation of a merged column; null without values."""
    return F.sqrt(F.try_divide(F.col(f"{column}_m2"), F.col(f"{column}_n")))


def interval(column: str, z: float) -> tuple[Column, Column]:
    """(lower, upper) of a merged column's mean: mean ± z·std/√n; no values give (0, 0)."""
    margin = F.lit(z) * spread(column) / F.sqrt(F.col(f"{column}_n"))
    mean, zero = F.col(f"{column}_mean"), F.lit(0.0)
    return F.coalesce(mean - margin, zero), F.coalesce(mean + margin, zero)
