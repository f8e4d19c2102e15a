"""Posts, result pages and stores derived from the `documents` and `events` tables.

Each document becomes one post; its counters, author and time come from the
event of the same number. Suffixes depend only on the text length, so exact
copies of a document stay exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scoring, text
from ..session import ensure_small_batches, ensure_utc, scratch_path

TOPICS = ["nifty50", "sensex", "intraday", "banknifty"]

# Plain SQL understood by both engines.
TAG_SQL = """
    case cast(n_chars % 8 as int) when 0 then 'nifty50' when 1 then 'Sensex' when 2 then 'intraday'
      when 3 then 'banknifty' when 4 then 'options' when 5 then 'nifty50 #sensex' when 6 then 'gold'
      else 'results' end"""
CALL_SQL = """
    case cast(n_chars % 11 as int) when 0 then ' buy the breakout!' when 1 then ' strong rally, book profit'
      when 2 then ' sell now, crash ahead!!' when 3 then ' weak close, short it'
      when 4 then ' bullish but resistance near?' when 5 then ' long above support?'
      when 6 then ' bearish breakdown' when 7 then ' will it fall?' else '' end"""
CONTENT_SQL = f"""
    concat(text, ' #', {TAG_SQL},
      case when n_chars % 3 = 0 then concat(' @desk', cast(n_chars % 50 as {{text}})) else '' end,
      case when n_chars % 5 = 0 then concat(' @fund', cast(n_chars % 7 as {{text}})) else '' end,
      {CALL_SQL}, ' target ', cast(n_chars as {{text}}), case when n_chars % 4 = 0 then '.5' else '' end)"""


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_small_batches(ensure_utc(spark))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    factor = F.get_json_object("props", "$.k").cast("bigint")
    return documents.join(events, documents.doc_id == events.event_id).select(
        F.col("doc_id").alias("post_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        "ts",
        "lang",
        "n_chars",
        F.expr(CONTENT_SQL.format(text="string")).alias("content"),
        (factor * (F.col("n_chars") % 13)).cast("bigint").alias("likes"),
        F.floor("value").cast("bigint").alias("retweets"),
        (F.col("user_id") % 20).cast("bigint").alias("replies"),
        # Clients that name posts by language and length reuse ids; without a language the length is the id.
        F.when(
            F.col("n_chars") % 10 != 0, F.concat(F.coalesce("lang", F.lit("")), F.col("n_chars").cast("string"))
        ).alias("tweet_id"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).withColumns(
        {"hashtags": text.hashtags(F.col("content")), "mentions": text.mentions(F.col("content"))}
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.analyze_posts(tagged(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "post_id", "ts", "sentiment_score", "sentiment_label", "engagement_score", "composite_signal"
    )


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The newest post time as a scalar subquery; it reads three narrow columns."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    matched = events.join(documents, events.event_id == documents.doc_id, "left_semi")
    return matched.agg(F.max("ts")).scalar()


def search_pages(
    source: DataFrame, size: int = 100, id: Column | None = None, created: Column | None = None
) -> DataFrame:
    """Posts as search-result pages of `size` posts, in the order of their ids.

    `id` and `created` stand for the post's number and time, if given.
    """
    number = F.substring_index("username", "_", -1)
    user = F.struct(
        number.alias("id"), F.col("username"), F.concat(F.lit("Name "), number).alias("name")
    )
    metrics = F.when(
        F.col("post_id") % 23 != 0,
        F.struct(
            F.col("likes").alias("like_count"),
            F.col("retweets").alias("retweet_count"),
            F.col("replies").alias("reply_count"),
        ),
    )
    post = F.struct(
        (F.col("post_id").cast("string") if id is None else id).alias("id"),
        F.col("content").alias("text"),
        number.alias("author_id"),
        "lang",
        (iso_time() if created is None else created).alias("created_at"),
        metrics.alias("public_metrics"),
    )
    listed = F.when(~number.endswith("0"), user)
    pages = source.groupBy((F.col("post_id") / size).cast("bigint").alias("page")).agg(
        F.array_sort(F.collect_list(post)).alias("data"),
        F.array_sort(F.collect_set(listed)).alias("users"),
    )
    failed = F.array(F.struct(F.lit("partial result").alias("message")))
    return pages.select(
        "data",
        F.struct("users").alias("includes"),
        F.struct(F.concat(F.lit("p"), (F.col("page") + 1).cast("string")).alias("next_token")).alias("meta"),
        F.when(F.col("page") == 2, failed).alias("errors"),
    )


def iso_time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def damaged_pages(source: DataFrame) -> DataFrame:
    """Lines of pages with unreadable counters and times, over-long names and ids, and lines that break off."""
    every = lambda n: F.col("post_id") % n == 0
    bad = source.withColumns(
        {
            "likes": F.when(every(17), F.lit("n/a")).otherwise(F.col("likes").cast("string")),
            "username": F.when(
                every(37), F.concat(F.repeat(F.lit("x"), F.lit(300)), F.lit("_90000"), F.substring_index("username", "_", -1))
            ).otherwise(F.col("username")),
        }
    )
    number = F.col("post_id").cast("string")
    pages = search_pages(
        bad, id=F.when(every(29), F.repeat(number, F.lit(300))).otherwise(number),
        created=F.when(every(31), F.lit("soon")).otherwise(iso_time()),
    )
    line = F.to_json(F.struct("data", "includes", "meta", "errors"))
    broken = F.regexp_extract("meta.next_token", r"(\d+)", 1).cast("bigint") % 3 == 2
    return pages.select(F.explode(F.when(broken, F.array(line, F.substring(line, 1, 60))).otherwise(F.array(line))).alias("value"))


#: Hours of posts in one wave of pages, waves, and how many waves late some posts are.
WAVE_HOURS, WAVES, LATE_WAVES = 12, 6, 2


def waves(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """Pages in waves by their posts' hours; some posts come two waves late. The posts are joined once, for all waves."""
    path, source = scratch_path(spark, "waves"), posts(spark, sf_dir)
    first = source.agg(F.min("ts")).scalar().cast("date")
    hours = F.date_diff(F.to_date("ts"), first) * 24 + F.hour("ts")
    wave = F.floor(hours / WAVE_HOURS) + F.when(F.col("post_id") % 13 == 0, LATE_WAVES).otherwise(0)
    sorted_out = source.withColumn("wave", F.least(wave, F.lit(WAVES - 1)).cast("int"))
    sorted_out.write.partitionBy("wave").parquet(path)
    stored = spark.read.schema(sorted_out.schema).parquet(path)
    for n in range(WAVES):
        yield search_pages(stored.filter(F.col("wave") == n))


_page_folders: dict[tuple, str] = {}


def search_page_folder(spark: SparkSession, sf_dir: str, pages_per_file: int = 4) -> str:
    """Folder of JSON pages, written once per session from the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, pages_per_file)
    if key not in _page_folders:
        path = scratch_path(spark, "pages")
        pages = search_pages(posts(spark, sf_dir))
        pages.write.option("maxRecordsPerFile", pages_per_file).json(path)
        _page_folders[key] = path
    return _page_folders[key]


def alt_posts(source: DataFrame) -> DataFrame:
    """Posts in the alternative client's shape."""
    odd = F.col("post_id") % 2 == 1
    third = F.col("post_id") % 3 == 0
    return source.select(
        F.col("post_id").cast("string").alias("id"),
        F.when(~odd, F.col("content")).alias("full_text"),
        F.when(odd, F.col("content")).alias("text"),
        F.col("username").alias("screen_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("retweets").alias("retweet_count"),
        F.when(~third, F.col("likes")).alias("favorite_count"),
        F.when(third & (F.col("post_id") % 15 != 0), F.col("likes")).alias("like_count"),
        F.col("replies").alias("reply_count"),
    )


def raw_counters(source: DataFrame) -> DataFrame:
    """Counters as text, some unreadable, some absent."""
    likes = (
        F.when(F.col("post_id") % 17 == 0, F.lit("n/a"))
        .when(F.col("post_id") % 19 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("likes").cast("string"))
    )
    return source.withColumns(
        {
            "likes": likes,
            "retweets": F.col("retweets").cast("string"),
            "replies": F.concat(F.lit(" "), F.col("replies").cast("string")),
        }
    )
