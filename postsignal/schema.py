"""Table and document schemas, declared once as DDL strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

POSTS = """
    username string, ts timestamp, content string,
    likes bigint, retweets bigint, replies bigint,
    mentions array<string>, hashtags array<string>,
    tweet_id string, url string, content_hash string, scraped_at timestamp
"""

SIGNALS = """
    content_hash string, ts timestamp, tfidf array<double>,
    sentiment_score double, sentiment_label string, engagement_score double,
    custom_features struct<
        text_length: bigint, word_count: bigint, hashtag_count: bigint,
        has_market_hashtag: bigint, mention_count: bigint, number_count: bigint,
        has_large_number: bigint, question_count: bigint, exclamation_count: bigint>,
    composite_signal double, processed_at timestamp
"""

RUNS = """
    run_id string, started_at timestamp, completed_at timestamp, status string,
    seen bigint, inserted bigint, errors array<string>
"""

# Moments of signals per write, and per window: see operators/moments.py.
SIGNAL_PARTS = """
    total_posts bigint, positive_posts bigint, negative_posts bigint, neutral_posts bigint,
    composite_signal_n bigint, composite_signal_mean double, composite_signal_m2 double,
    sentiment_score_n bigint, sentiment_score_mean double, sentiment_score_m2 double,
    engagement_score_n bigint, engagement_score_mean double, engagement_score_m2 double, sign int
"""

LATE_SIGNALS = """
    content_hash string, ts timestamp, sentiment_score double, sentiment_label string,
    engagement_score double, composite_signal double
"""

# What was refused: a post as JSON or the line of a page, and why.
REFUSED = "reason string, raw string, refused_at timestamp"

# One page of search results, as returned by the search API. Counters are read as
# text, so that an unreadable one refuses its post and not the page.
SEARCH_PAGE = """
    data array<struct<
        id: string, text: string, author_id: string, lang: string, created_at: string,
        public_metrics: struct<like_count: string, retweet_count: string, reply_count: string>>>,
    includes struct<users: array<struct<id: string, username: string, name: string>>>,
    meta struct<next_token: string>,
    errors array<struct<message: string>>
"""

# One post, as returned by the alternative client.
ALT_POST = """
    id string, full_text string, text string, screen_name string, created_at string,
    retweet_count bigint, favorite_count bigint, like_count bigint, reply_count bigint
"""

# Longest values the post table takes; longer ones reject the row.
MAX_USERNAME = 255
MAX_ID = 255
MAX_URL = 500


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select and cast to the columns of a schema, in its order."""
    return df.to(StructType.fromDDL(ddl))
