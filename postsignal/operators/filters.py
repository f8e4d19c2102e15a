"""Row filters: emptiness, recency, rejects, search and facets."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.values import as_column


def nonempty(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(F.col(content) != "")


def newest_time(df: DataFrame, ts: str = "ts") -> Column:
    """The newest time of a table as a scalar subquery: no collect, no cross join."""
    return df.agg(F.max(ts)).scalar()


def since(as_of: Column | datetime, hours: int, ts: str = "ts") -> Column:
    """Condition: not older than `hours` before `as_of`."""
    return F.col(ts) >= as_column(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))


def parse_lookback(value: str | int) -> int | None:
    """Look-back parameter in hours; `0`, `all` and `''` mean everything."""
    if str(value) in ("0", "all", ""):
        return None
    try:
        return int(value)
    except ValueError:
        raise ValueError(
            f"cannot read {value!r} as a look-back: give whole hours, or one of 0, all and the empty text for no limit"
        ) from None


def lookback(df: DataFrame, hours: str | int, as_of: Column | datetime, ts: str = "ts") -> DataFrame:
    window = parse_lookback(hours)
    return df if window is None else df.filter(since(as_of, window, ts))


def reject_reason(counts: tuple[str, ...] = ("likes", "retweets", "replies")) -> Column:
    """Why the post table would refuse a row whose counters were coerced; null if it would not."""
    reason = F.lit(None).cast("string")
    checks = [(F.col(c).isNull(), f"bad {c}") for c in counts] + [
        (F.col("mentions").isNull() | F.col("hashtags").isNull(), "no list"),
        (F.length("username") > schema.MAX_USERNAME, "username too long"),
        (F.length("tweet_id") > schema.MAX_ID, "id too long"),
        (F.length("url") > schema.MAX_URL, "url too long"),
    ]
    for bad, why in reversed(checks):
        reason = F.when(bad, F.lit(why)).otherwise(reason)
    return reason


#: Every reason that `reject_reason` gives, and those of pages and posts that cannot be read at all.
REASONS = (
    "bad likes", "bad retweets", "bad replies", "no list", "username too long", "id too long", "url too long",
    "unreadable page", "bad time",
)


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `reason`)."""
    judged = df.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    return good, judged.filter(F.col("reason").isNotNull())


def search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Every word and quoted phrase of the query occurs, in any case, in at least one of the fields."""
    words = [phrase or word for _, phrase, word in re.findall(r"""(["'])(.+?)\1(?=\s|$)|(\S+)""", query.lower())]
    if not words:
        return df
    hit = lambda word: reduce(or_, [F.contains(F.lower(F.col(f)), F.lit(word)) for f in fields])
    return df.filter(reduce(and_, [hit(w) for w in words]))


def date_facets(as_of: Column, ts: str = "ts") -> dict[str, Column]:
    """The listing's date choices, as conditions relative to the day of `as_of`."""
    t = F.col(ts)
    day, month, year = (F.date_trunc(u, as_of).cast("timestamp_ntz") for u in ("day", "month", "year"))
    t = t.cast("timestamp_ntz")
    tomorrow = day + F.make_dt_interval(F.lit(1))
    return {
        "today": (t >= day) & (t < tomorrow),
        "past_7_days": (t >= day - F.make_dt_interval(F.lit(7))) & (t < tomorrow),
        "this_month": (t >= month) & (t < month + F.make_ym_interval(F.lit(0), F.lit(1))),
        "this_year": (t >= year) & (t < year + F.make_ym_interval(F.lit(1))),
    }


def facet_dates(df: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Rows behind each date choice, one pass over the table."""
    facets = date_facets(as_of, ts)
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in facets.items()])
    return counts.unpivot([], list(facets), "facet", "n")


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
