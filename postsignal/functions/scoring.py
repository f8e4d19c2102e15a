"""Column functions that turn a post into scores, features and a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text
from .lexicon import EngagementWeights, Lexicon, ScoringConfig, SignalWeights


def keyword_hits(content: str, keywords: tuple[str, ...]) -> Column:
    """How many distinct keywords occur in a text column as substrings, any case.

    Written as SQL text: one call to the JVM instead of several per keyword.
    """
    quoted = ["'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in keywords]
    tests = [f"cast(contains(lower(`{content}`), {k}) as bigint)" for k in quoted]
    return F.expr(" + ".join(tests or ["0L"]))


def sentiment_score(bullish: Column, bearish: Column) -> Column:
    """(bullish - bearish) / (bullish + bearish) in [-1, 1]; 0 without any hit."""
    total = bullish + bearish
    ratio = F.try_divide(bullish - bearish, total).cast("double")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))


def sentiment_label(score: Column, cut: float = 0.2) -> Column:
    return (
        F.when(score > F.lit(cut), "positive")
        .when(score < F.lit(-cut), "negative")
        .otherwise("neutral")
    )


def engagement_score(
    likes: Column, retweets: Column, replies: Column, weights: EngagementWeights | None = None
) -> Column:
    """Weighted interactions on a log scale, 1 at `weights.cap` and above."""
    w = weights or EngagementWeights()
    weighted = likes * F.lit(w.likes) + retweets * F.lit(w.retweets) + replies * F.lit(w.replies)
    scaled = F.log1p(weighted) / F.log1p(F.lit(w.cap))
    return F.when(weighted == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), scaled))


FEATURES = (
    "text_length", "word_count", "hashtag_count", "has_market_hashtag", "mention_count",
    "number_count", "has_large_number", "question_count", "exclamation_count",
)


def has_market_hashtag(hashtags: Column, market_tags: tuple[str, ...]) -> Column:
    return F.exists(hashtags, lambda h: F.lower(h).isin(*market_tags))


def custom_features(
    content: Column, mentions: Column, hashtags: Column, market_tags: tuple[str, ...],
    numbers: Column | None = None,
) -> Column:
    """Struct of the nine integer features in `FEATURES`.

    `numbers` may name a column holding `text.numbers` of the content, which is
    needed twice.
    """
    nums = text.numbers(content) if numbers is None else numbers
    values = {
        "text_length": F.length(content),
        "word_count": text.word_count(content),
        "hashtag_count": F.size(hashtags),
        "has_market_hashtag": has_market_hashtag(hashtags, market_tags),
        "mention_count": F.size(mentions),
        "number_count": F.size(nums),
        "has_large_number": F.exists(nums, lambda n: F.coalesce(text.as_number(n) > 1000, F.lit(False))),
        "question_count": text.occurrences(content, "?"),
        "exclamation_count": text.occurrences(content, "!"),
    }
    return F.struct(*[values[f].cast("bigint").alias(f) for f in FEATURES])


def composite_signal(
    sentiment: Column,
    engagement: Column,
    has_market_tag: Column,
    mention_count: Column,
    weights: SignalWeights | None = None,
) -> Column:
    w = weights or SignalWeights()
    custom = has_market_tag * F.lit(w.market_tag) + F.least(
        mention_count / F.lit(w.mention_cap), F.lit(1.0)
    ) * F.lit(w.mentions)
    return (
        sentiment * F.lit(w.sentiment)
        + engagement * F.lit(w.engagement)
        + custom * F.lit(w.custom)
    )


def with_sentiment(df: DataFrame, lexicon: Lexicon | None = None, content: str = "content") -> DataFrame:
    """Add `bullish_hits`, `bearish_hits`, `sentiment_score`, `sentiment_label`."""
    lex = lexicon or Lexicon()
    return (
        df.withColumns(
            {
                "bullish_hits": keyword_hits(content, lex.bullish),
                "bearish_hits": keyword_hits(content, lex.bearish),
            }
        )
        .withColumn("sentiment_score", sentiment_score(F.col("bullish_hits"), F.col("bearish_hits")))
        .withColumn("sentiment_label", sentiment_label(F.col("sentiment_score"), lex.label_cut))
    )


def analyze_posts(df: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """Score each post in place: a narrow projection, no shuffle.

    Expects `content`, `likes`, `retweets`, `replies`, `mentions`, `hashtags`;
    a missing value counts as empty text, no list or 0.
    """
    cfg = config or ScoringConfig()
    none = F.array().cast("array<string>")
    usable = df.withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            **{n: F.coalesce(F.col(n), F.lit(0)) for n in ("likes", "retweets", "replies")},
            **{n: F.coalesce(F.col(n), none) for n in ("mentions", "hashtags")},
        }
    )
    found = usable.withColumn("_numbers", text.numbers(F.col("content")))
    scored = with_sentiment(found, cfg.lexicon).withColumns(
        {
            "engagement_score": engagement_score(
                F.col("likes"), F.col("retweets"), F.col("replies"), cfg.engagement
            ),
            "custom_features": custom_features(
                F.col("content"), F.col("mentions"), F.col("hashtags"), cfg.market_tags, F.col("_numbers")
            ),
        }
    )
    # Not taken out of `custom_features`: a query of signals alone then computes no other feature.
    signal = composite_signal(
        F.col("sentiment_score"),
        F.col("engagement_score"),
        has_market_hashtag(F.col("hashtags"), cfg.market_tags).cast("bigint"),
        F.size("mentions").cast("bigint"),
        cfg.signal,
    )
    return scored.withColumn("composite_signal", signal).drop("bullish_hits", "bearish_hits", "_numbers")
