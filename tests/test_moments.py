"""Mergeable moments against one pass over all rows, and kept summaries over replaced signals."""

import random
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from postsignal.operators import moments, summary
from postsignal.plans import analyze

NOW = datetime(2025, 1, 10)


def rows(rng, n, mean=0.0):
    label = lambda: rng.choice(["positive", "negative", "neutral", None])
    number = lambda: None if rng.random() < 0.1 else mean + rng.gauss(0, 1)
    return [(rng.choice(["a", "b", None]), label(), number(), number(), number()) for _ in range(n)]


DDL = "g string, sentiment_label string, composite_signal double, sentiment_score double, engagement_score double"


@pytest.mark.parametrize("group_by", [[], ["g"]])
@pytest.mark.parametrize("mean", [0.0, 1e9])
def test_parts_merge_to_the_summary_of_all_rows(spark, group_by, mean):
    rng = random.Random(5)
    frames = [spark.createDataFrame(rows(rng, n, mean), DDL) for n in (40, 1, 0, 25)]
    whole = reduce(DataFrame.unionByName, frames)
    kept = reduce(DataFrame.unionByName, [summary.signal_parts(f, group_by) for f in frames])
    key = lambda r: str(r.g) if group_by else ""
    numbers = lambda r: {k: v for k, v in r.asDict().items() if k != "g"}
    got = {key(r): numbers(r) for r in summary.merge_signal_parts(kept, group_by=group_by).collect()}
    want = {key(r): numbers(r) for r in summary.aggregate_signals(whole, group_by=group_by).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6 if mean else 1e-12)


def test_taken_parts_leave_the_rest(spark):
    rng = random.Random(6)
    stay, go = (spark.createDataFrame(rows(rng, n), DDL) for n in (30, 12))
    kept = summary.signal_parts(stay.unionByName(go)).unionByName(summary.signal_parts(go, sign=-1))
    got, want = summary.merge_signal_parts(kept).first(), summary.aggregate_signals(stay).first()
    assert got.asDict() == pytest.approx(want.asDict())


def test_no_parts(spark):
    empty = summary.signal_parts(spark.createDataFrame([], DDL))
    assert summary.merge_signal_parts(empty).first().asDict() == pytest.approx(
        summary.aggregate_signals(spark.createDataFrame([], DDL)).first().asDict()
    )
    assert summary.merge_signal_parts(empty.limit(0)).first().total_posts == 0


def test_kept_summary_follows_replaced_signals_and_replays(spark, tmp_path):
    table = analyze.signal_store(spark, str(tmp_path / "signals"))
    kept = analyze.signal_moments(spark, str(tmp_path / "moments"))

    def signals(values):
        ddl = "content_hash string, ts timestamp, sentiment_score double, sentiment_label string, engagement_score double, composite_signal double"
        made = spark.createDataFrame(
            [(h, NOW - timedelta(days=ord(h) % 3), v, "positive" if v > 0 else "neutral", v / 2, v) for h, v in values.items()], ddl
        )
        return made.withColumns({
            "tfidf": F.array().cast("array<double>"), "processed_at": F.lit(NOW),
            "custom_features": F.lit(None).cast(table.schema["custom_features"].dataType),
        })

    def check():
        got, want = analyze.stored_summary(kept).first(), summary.stored_signal_summary(table.read()).first()
        assert got.asDict() == pytest.approx(want.asDict())

    analyze.store_signals(table, signals({"a": 0.1, "b": 0.5, "c": -0.2}), "first", kept)
    check()
    analyze.store_signals(table, signals({"b": 0.9, "d": 0.0, "a": 0.3}), "second", kept)
    check()
    analyze.store_signals(table, signals({"b": 0.9, "d": 0.0, "a": 0.3}), "second", kept)  # a replay
    check()
    assert analyze.stored_summary(kept).first().total_posts == 4
    days = sorted(p.name for p in (tmp_path / "signals").glob("gen=*second/_day=*"))
    plan = table.read(days=[NOW.date()])._jdf.queryExecution().executedPlan().toString()
    assert len(days) > 1 and "PartitionFilters: [isnotnull(_day" in plan


def test_interval_by_hand(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    merged = moments.merge(moments.parts(df, ("v",)), ("v",))
    lower, upper = moments.interval("v", 2.0)
    row = merged.select("v_n", lower.alias("lower"), upper.alias("upper"), moments.spread("v").alias("s")).first()
    std = float(np.std([1, 2, 4]))
    assert row.v_n == 3 and row.s == pytest.approx(std)
    assert (row.lower, row.upper) == pytest.approx((7 / 3 - 2 * std / 3**0.5, 7 / 3 + 2 * std / 3**0.5))
