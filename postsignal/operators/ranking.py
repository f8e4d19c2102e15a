"""First rows, top rows per group, pages and topic choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Number of lanes a hot group is split over before its final ranking.
LANES = 256


def _ranked(df: DataFrame, keys: list, order_by: list, n: int) -> DataFrame:
    # A row_number filter lets Spark keep only the first n rows of each group
    # inside every map task, before the shuffle.
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_per_group(df: DataFrame, keys: list, order_by: list) -> DataFrame:
    """The first row of each group; copies are cut to one per task before the shuffle."""
    return _ranked(df, keys, order_by, 1)


def top_per_group(df: DataFrame, keys: list, order_by: list, n: int, lanes: int = LANES) -> DataFrame:
    """The first n rows of each group, exact, for few and possibly huge groups.

    Each map task works in one lane and sends at most n rows of a group; lanes
    are ranked apart, so no task ever holds a whole hot group.
    """
    laned = df.withColumn("_lane", F.spark_partition_id() % lanes)
    return _ranked(_ranked(laned, [*keys, "_lane"], order_by, n).drop("_lane"), keys, order_by, n)


def newest(df: DataFrame, n: int, ts: str = "ts", key: str = "content_hash") -> DataFrame:
    """The newest n rows: every task keeps a heap of n."""
    return df.orderBy(F.desc(ts), F.asc(key)).limit(n)


def page(df: DataFrame, order_by: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a totally ordered listing."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size)


def parse_limit(value: str | int | None) -> int | None:
    """`None` and `''` mean no limit; other text must be a whole number."""
    if value is None or value == "":
        return None
    try:
        return int(value)
    except ValueError:
        raise ValueError(f"cannot read {value!r} as a number of rows") from None


def explode_present(df: DataFrame, array: Column, output: str) -> DataFrame:
    """One row per non-null element.

    A plain explode first filters on the array's size, which computes a costly
    array expression a second time; the outer form does not.
    """
    return df.withColumn(output, F.explode_outer(array)).filter(F.col(output).isNotNull())


def top_values(
    df: DataFrame, column: str = "hashtags", n: int = 10, ts: str = "ts", output: str = "hashtag"
) -> DataFrame:
    """Most frequent elements of an array column.

    Ties go to the element seen last in time, then by name. Counting is
    partially aggregated, so a hot element costs one row per task.
    """
    counted = (
        explode_present(df.select(ts, column), F.col(column), output)
        .groupBy(output)
        .agg(F.count("*").alias("n"), F.max(ts).alias("_last"))
    )
    return counted.orderBy(F.desc("n"), F.desc("_last"), output).limit(n).select(output, "n")


def with_topics(
    posts: DataFrame, topics: list[str], content: str = "content", hashtags: str = "hashtags",
    lang: str = "lang", tiers: tuple[str, ...] = ("en_tag", "tag", "phrase"),
) -> DataFrame:
    """One row per post and topic it matches, with the first tier it matches in.

    Tiers: `en_tag` English posts with the tag, `tag` posts with the tag,
    `phrase` posts with the literal `#tag` anywhere in the text.
    """
    lowered = F.transform(hashtags, F.lower)

    def tier_of(topic: str) -> Column:
        tagged = F.array_contains(lowered, topic.lower())
        tests = {
            "en_tag": tagged & (F.col(lang) == "en"),
            "tag": tagged,
            "phrase": F.contains(F.lower(F.col(content)), F.lit("#" + topic.lower())),
        }
        return F.coalesce(*[F.when(tests[t], F.lit(i + 1)) for i, t in enumerate(tiers)])

    matches = F.array(*[F.struct(F.lit(t).alias("topic"), tier_of(t).alias("tier")) for t in topics])
    found = F.filter(matches, lambda m: m.tier.isNotNull())
    return explode_present(posts, found, "_m").select("*", "_m.topic", "_m.tier").drop("_m")


def select_topics(
    matched: DataFrame, recent: Column | None = None, recency_first: bool = False
) -> DataFrame:
    """Per topic, the posts of its first non-empty tier; tiers include earlier ones.

    `recent` filters the result, or with `recency_first` also what counts as
    non-empty. The tier table has one row per topic; Spark broadcasts it if it is small.
    """
    pool = matched.filter(recent) if recent is not None and recency_first else matched
    best = pool.groupBy("topic").agg(F.min("tier").alias("_best"))
    chosen = matched if recent is None else matched.filter(recent)
    return chosen.join(best, "topic").filter(F.col("tier") <= F.col("_best")).drop("_best")
