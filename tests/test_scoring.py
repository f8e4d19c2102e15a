import math

import pytest
from postsignal.functions import scoring
from postsignal.functions.lexicon import ScoringConfig
from postsignal.operators import summary


def score(spark, content="", likes=0, retweets=0, replies=0, mentions=(), hashtags=()):
    row = [(content, likes, retweets, replies, list(mentions), list(hashtags))]
    ddl = "content string, likes bigint, retweets bigint, replies bigint, mentions array<string>, hashtags array<string>"
    return scoring.analyze_posts(spark.createDataFrame(row, ddl)).first()


@pytest.mark.parametrize(
    "content, value, label",
    [
        ("support", 1.0, "positive"),
        ("breakdown", -1.0, "negative"),
        ("nothing here", 0.0, "neutral"),
        ("buy gain rally sell crash", 0.2, "neutral"),
        ("BULLISH", 1.0, "positive"),
    ],
)
def test_sentiment(spark, content, value, label):
    found = score(spark, content)
    assert found.sentiment_score == pytest.approx(value)
    assert found.sentiment_label == label


def test_substring_hits_count_each_keyword_once(spark):
    df = spark.createDataFrame([("support support bullish",)], "content string")
    row = scoring.with_sentiment(df).first()
    assert (row.bullish_hits, row.bearish_hits) == (4, 0)


def test_engagement(spark):
    assert score(spark).engagement_score == 0.0
    assert score(spark, likes=10_000_000).engagement_score == 1.0
    found = score(spark, likes=10, retweets=5, replies=2).engagement_score
    assert found == pytest.approx(math.log1p(23) / math.log1p(100_000))


def test_features(spark):
    f = score(spark, "1,200 up? 1001. wow!!", mentions=["a"], hashtags=["Nifty50", "x"]).custom_features
    assert (f.text_length, f.word_count, f.hashtag_count, f.mention_count) == (21, 4, 2, 1)
    assert (f.has_market_hashtag, f.number_count, f.has_large_number) == (1, 3, 1)
    assert (f.question_count, f.exclamation_count) == (1, 2)
    small = score(spark, "1,200").custom_features
    assert (small.number_count, small.has_large_number, small.has_market_hashtag) == (2, 0, 0)


def test_composite_caps_mentions(spark):
    found = score(spark, mentions=list("abcdefg"), hashtags=["sensex"])
    assert found.composite_signal == pytest.approx(0.2 * 0.2)


def test_missing_values_count_as_empty(spark):
    df = spark.createDataFrame(
        [(None, None, 1, None, None, None)],
        "content string, likes bigint, retweets bigint, replies bigint, mentions array<string>, hashtags array<string>",
    )
    row = scoring.analyze_posts(df).first()
    assert row.sentiment_label == "neutral" and row.custom_features.word_count == 0


def test_other_lexicon(spark):
    from postsignal.functions.lexicon import Lexicon

    df = spark.createDataFrame([("moon soon",)], "content string")
    row = scoring.with_sentiment(df, Lexicon(("moon",), ("gloom",))).first()
    assert row.sentiment_score == 1.0
    quoted = spark.createDataFrame([("it's a \\ b",)], "content string")
    row = scoring.with_sentiment(quoted, Lexicon(("it's", "a \\ b", "it''s"), ())).first()
    assert (row.bullish_hits, row.bearish_hits) == (2, 0)
    assert ScoringConfig().market_tags == ("nifty50", "sensex", "intraday", "banknifty")


def test_confidence_interval(spark):
    one = spark.createDataFrame([(0.3,)], "x double")
    none = one.filter("x > 1")
    row = summary.confidence_interval(one, "x").first()
    assert (row.lower_bound, row.upper_bound) == (0.3, 0.3)
    row = summary.confidence_interval(none, "x").first()
    assert (row.n, row.lower_bound, row.upper_bound) == (0, 0.0, 0.0)
    two = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    row = summary.confidence_interval(two, "x").first()
    margin = 1.959963984540054 / math.sqrt(2)
    assert (row.lower_bound, row.upper_bound) == pytest.approx((2 - margin, 2 + margin))


def test_empty_summary(spark):
    ddl = "composite_signal double, sentiment_score double, engagement_score double, sentiment_label string"
    row = summary.stored_signal_summary(spark.createDataFrame([], ddl)).first()
    assert row.total_posts == 0 and row.mean_signal == 0.0 and row.confidence_interval_upper == 0.0


def test_analysis_document(spark):
    import json

    ddl = "composite_signal double, sentiment_score double, engagement_score double, sentiment_label string"
    rows = [(0.5, 1.0, 0.0, "positive"), (-0.5, -1.0, 0.0, "negative")]
    aggregated = summary.aggregate_signals(spark.createDataFrame(rows, ddl))
    answer = json.loads(summary.analysis_document(aggregated).first().document)
    assert answer["tweets_analyzed"] == answer["total_tweets_processed"] == 2
    assert answer["aggregated_signals"]["sentiment_distribution"] == {"positive": 1, "negative": 1, "neutral": 0}
    assert answer["aggregated_signals"]["mean_signal"] == 0.0


def test_signals_alone_compute_no_other_feature(spark):
    """`word_count` and `numbers` are patterns over whole texts; the signal needs neither."""
    ddl = "content string, likes bigint, retweets bigint, replies bigint, mentions array<string>, hashtags array<string>"
    posts = spark.createDataFrame([("buy 1200 now", 1, 2, 3, ["a"], ["Sensex"]), (None, None, None, None, None, None)], ddl)
    scored = scoring.analyze_posts(posts)
    plan = scored.select("composite_signal")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan
    features = scored.select("composite_signal", "sentiment_score", "engagement_score", "custom_features.*").collect()
    for r in features:
        custom = 0.1 * r.has_market_hashtag + 0.1 * min(r.mention_count / 5, 1)
        assert r.composite_signal == pytest.approx(0.5 * r.sentiment_score + 0.3 * r.engagement_score + 0.2 * custom)
