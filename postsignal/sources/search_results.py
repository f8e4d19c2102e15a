"""Nested search results to post rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import text, values


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON page per line; unknown keys are ignored, and a line that is no page is kept in `unreadable`."""
    return _tolerant(spark.read).json(path)


def read_page_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The pages of a folder as a stream, read as `read_search_pages` reads them."""
    reader = _tolerant(spark.readStream)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _tolerant(reader):
    reader = reader.schema(f"{schema.SEARCH_PAGE}, unreadable string")
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable")


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """The lines that could not be read, for the run's notes. Reads the files once more for these lines only."""
    return pages.filter(F.col("unreadable").isNotNull()).select("data", "unreadable")


def _created(c: Column, as_of: Column | datetime) -> Column:
    missing = c.isNull() | (c == "")
    return F.when(missing, values.as_column(as_of).cast("timestamp")).otherwise(values.parse_iso(c))


def flatten_search_pages(pages: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row per post; authors are looked up in the users of the same page.

    The lookup stays inside the row, so nothing is shuffled. A page that also
    carries `errors` still yields its posts. A post whose time is present but
    unreadable is dropped; a missing time becomes `as_of`. Counters read as text
    are null where they are unreadable.
    """
    flat = examine_search_pages(pages, as_of).filter(F.col("refused").isNull()).drop("raw", "refused")
    text_read = [c for c, kind in flat.dtypes if kind == "string" and c in ("likes", "retweets", "replies")]
    return flat.withColumns({c: values.coerce_count(F.col(c)) for c in text_read})


def examine_search_pages(pages: DataFrame, as_of: Column | datetime) -> DataFrame:
    """As `flatten_search_pages`, with all that was read: `refused` says why a row is no post.

    `raw` is the post or the line as it was read. Counters keep the type they were read in.
    """
    line = F.col("unreadable") if "unreadable" in pages.columns else F.lit(None).cast("string")
    post = pages.select(
        F.explode_outer(F.when(line.isNull(), F.col("data"))).alias("p"), F.col("includes.users").alias("users"),
        line.alias("line"),
    ).filter(F.col("p").isNotNull() | F.col("line").isNotNull())
    author = F.get(F.filter("users", lambda u: u.id == F.col("p.author_id")), 0)


    def metric(name: str) -> Column:
        read = F.col(f"p.public_metrics.{name}")
        return F.coalesce(read, F.lit("0").cast(dict(post.select(read).dtypes)[name]))

    content = F.coalesce(F.col("p.text"), F.lit(""))
    flat = post.select(
        F.coalesce(author.username, F.lit("unknown")).alias("username"),
        _created(F.col("p.created_at"), as_of).alias("ts"),
        content.alias("content"),
        metric("like_count").alias("likes"),
        metric("retweet_count").alias("retweets"),
        metric("reply_count").alias("replies"),
        text.mentions(content).alias("mentions"),
        text.hashtags(content).alias("hashtags"),
        F.col("p.id").alias("tweet_id"),
        values.link_by_id(F.col("p.id")).alias("url"),
        text.content_hash(content).alias("content_hash"),
        F.struct("line", "p").alias("raw"),
    )
    why = F.when(F.col("raw.line").isNotNull(), F.lit("unreadable page")).when(F.col("ts").isNull(), F.lit("bad time"))
    return flat.withColumn("refused", why)


def normalize_alt_posts(raw: DataFrame, as_of: Column | datetime) -> DataFrame:
    """The alternative client's flat shape; it has neither a post id nor a hash."""
    count = lambda *names: F.coalesce(*[F.col(n) for n in names], F.lit(0).cast("bigint"))
    content = F.coalesce("full_text", "text")
    username = F.coalesce("screen_name", F.lit("unknown"))
    created = F.when(F.col("created_at").isNull(), values.as_column(as_of).cast("timestamp"))
    return raw.select(
        username.alias("username"),
        created.otherwise(values.parse_iso(F.col("created_at"))).alias("ts"),
        content.alias("content"),
        count("retweet_count").alias("retweets"),
        count("favorite_count", "like_count").alias("likes"),
        count("reply_count").alias("replies"),
        text.hashtags(content).alias("hashtags"),
        text.mentions(content).alias("mentions"),
        values.link_by_user(username, F.col("id")).alias("url"),
    ).filter(F.col("ts").isNotNull() & F.col("content").isNotNull())
