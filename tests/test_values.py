from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postsignal.functions import values
from postsignal.operators import filters, ranking

NOW = datetime(2025, 1, 1)


def apply(spark, rows, function, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"c {kind}").coalesce(1)
    return [r.r for r in df.select(function(F.col("c")).alias("r")).collect()]


def test_timestamps(spark):
    raw = [
        "2025-11-08T19:18:00Z", "2025-11-08T19:18:00+05:30", "2025-11-08 19:18:00.123456",
        "20251108T191800Z", "2025-11-08", "2025", "junk", None,
    ]
    at = datetime(2025, 11, 8, 19, 18)
    assert apply(spark, raw, lambda c: values.normalize_timestamp(c, NOW).cast("timestamp_ntz")) == [
        at, datetime(2025, 11, 8, 13, 48), at.replace(microsecond=123456), at, datetime(2025, 11, 8), NOW, NOW, NOW,
    ]


def test_iso_forms(spark):
    """All that Python's own parser takes, and nothing else of these."""
    raw = [
        "20251108", "2025-11-08T19", "2025-11-08T1918", "20251108T1918", "2025-11-08T19:18:00+0530",
        "2025-11-08 19:18:00-08", "2025-W45-6", "2025W456", "2025-W45", "2020-W53-7", "2025-11-08T19:18:00.1234567",
        "2025-11-08T191800,5Z", "2025-11-08x19:18", "2025-W53-1", "2025-13-08", "2025-11-08T25:00", "2025-11", "2025-11-08T1",
        "2025-11-08T", "25-11-08", "2025-02-30", "2025-W00-1",
    ]

    def python(text):
        try:
            found = datetime.fromisoformat(text)
        except ValueError:
            return None
        return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found

    got = apply(spark, raw, lambda c: values.parse_iso(c).cast("timestamp_ntz"))
    assert dict(zip(raw, got)) == {t: python(t) for t in raw}


def test_counts(spark):
    raw = [None, "12", " -3 ", "1.5", "n/a", "", "99999999999999999999"]
    assert apply(spark, raw, values.coerce_count) == [0, 12, -3, None, None, None, None]
    assert apply(spark, [None, 1.9, -1.9], values.truncate_count, "double") == [0, 1, -1]


def test_list_codec(spark):
    lists = [[], ["a", "b"], ["a,b"]]
    back = apply(spark, lists, lambda c: values.decode_list(values.encode_list(c)), "array<string>")
    assert back == [[], ["a", "b"], ["a", "b"]]
    assert apply(spark, [None], values.decode_list) == [[]]


def test_links(spark):
    assert apply(spark, ["7"], values.link_by_id) == ["https://twitter.com/i/web/status/7"]
    by_user = lambda c: values.link_by_user(F.lit("u"), c)
    assert apply(spark, ["7", None], by_user) == ["https://twitter.com/u/status/7", None]


def test_lookback_and_limit_parameters():
    assert [filters.parse_lookback(v) for v in ("0", "all", "", "24", 5)] == [None, None, None, 24, 5]
    assert [ranking.parse_limit(v) for v in (None, "", "7", 0)] == [None, None, 7, 0]
    for bad in (filters.parse_lookback, ranking.parse_limit):
        with pytest.raises(ValueError):
            bad("x")
