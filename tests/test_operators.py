import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsignal import session
from postsignal.operators import dedupe, filters, keyed, ranking, sampling

T0 = datetime(2025, 1, 1)


def series(spark, n, ties=False, parts=3):
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = [(i, T0 if ties else T0 + timedelta(minutes=i), float(i % 7)) for i in order]
    return spark.createDataFrame(rows, "id bigint, ts timestamp, v double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_keep_first_does_not_depend_on_partitions(spark, parts):
    rows = [(i, f"h{i % 3}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "seq int, content_hash string").repartition(parts)
    kept = {(r.content_hash, r.seq) for r in dedupe.dedupe_by_hash(df, ["seq"]).collect()}
    assert kept == {("h0", 3), ("h1", 1), ("h2", 2)}


def test_dedupe_by_content_within_topic(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", "y")]
    df = spark.createDataFrame(rows, "seq int, topic string, content string")
    assert sorted(r.seq for r in dedupe.dedupe_by_content(df, ["seq"], within=("topic",)).collect()) == [1, 3, 4]


def test_insert_if_absent_twice_is_once(spark):
    target = spark.createDataFrame([("a", 0)], "k string, seq int")
    batch = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], "k string, seq int")
    new = keyed.insert_if_absent(target, batch, "k", ["seq"])
    assert sorted(map(tuple, new.collect())) == [("b", 2), ("c", 4)]
    assert keyed.insert_if_absent(target.unionByName(new), batch, "k", ["seq"]).count() == 0


def test_upsert_is_idempotent_and_keeps_creation_time(spark):
    ddl = "k string, v double, at int"
    target = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], ddl)
    batch = spark.createDataFrame([("b", None, 9), ("c", 7.0, 9)], ddl)
    once = keyed.upsert(target, batch, "k", keep_old=("at",))
    assert sorted(map(tuple, once.collect())) == [("a", 1.0, 1), ("b", None, 1), ("c", 7.0, 9)]
    assert sorted(map(tuple, keyed.upsert(once, batch, "k", keep_old=("at",)).collect())) == sorted(
        map(tuple, once.collect())
    )


def test_unique_id_guard_lets_nulls_repeat(spark):
    rows = [(1, "x"), (2, "x"), (3, None), (4, None), (5, "y"), (6, "z")]
    batch = spark.createDataFrame(rows, "seq int, tid string")
    target = spark.createDataFrame([("y",), (None,)], "tid string")
    kept = keyed.unique_id_guard(batch, "tid", "seq", ["seq"], target)
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize("ties", [False, True])
def test_global_index_counts_from_zero(spark, ties):
    indexed = sampling.global_index(series(spark, 101, ties), ["ts", "id"], partitions=6)
    rows = indexed.rows.orderBy("idx").collect()
    assert indexed.count == 101
    assert [r.idx for r in rows] == list(range(101))
    assert [r.id for r in rows] == list(range(101))


@pytest.mark.parametrize("n, size", [(10, 10), (11, 11), (20, 10), (21, 11), (30, 10), (5, 5)])
def test_systematic_sample_sizes(spark, n, size):
    sample = sampling.systematic_sample(sampling.global_index(series(spark, n), ["ts", "id"]), 10)
    ids = [r.id for r in sample.rows.orderBy("idx").collect()]
    assert sample.count == len(ids) == size
    step = max(n // 10, 1) if n > 10 else 1
    assert ids == list(range(0, n, step))


def test_random_sample_is_exact_and_repeatable(spark):
    import hashlib

    n = 3000
    df = spark.range(n)
    expected = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:40]
    for parts in (1, 7):
        got = [r.id for r in sampling.random_sample(df.repartition(parts), 40, "id").collect()]
        assert sorted(got) == sorted(expected)
    assert sampling.random_sample(spark.range(5), 40, "id").count() == 5


def test_rolling_window_sizes():
    assert [sampling.rolling_window(n) for n in (100, 101, 999, 5000)] == [None, 10, 99, 100]


@pytest.mark.parametrize("block", [10, 17, 1000])
def test_rolling_mean_across_blocks(spark, block):
    n, w = 95, 10
    indexed = sampling.global_index(series(spark, n), ["ts", "id"])
    got = sampling.rolling_mean(indexed, "v", w, block=block).orderBy("idx").collect()
    values = [float(i % 7) for i in range(n)]
    expected = [None if i < w - 1 else sum(values[i - w + 1 : i + 1]) / w for i in range(n)]
    assert [r.rolling_mean for r in got] == pytest.approx(expected)


def test_rolling_mean_by_group_across_blocks(spark):
    df = series(spark, 90).withColumn("g", F.when(F.col("id") < 60, "hot").otherwise("cold"))
    indexed = sampling.global_index(df, ["g", "ts", "id"])
    got = sampling.rolling_mean(indexed, "v", 5, partition_by=("g",), block=8).collect()
    for r in got:
        first = 0 if r.g == "hot" else 60
        values = [float(i % 7) for i in range(first, r.id + 1)][-5:]
        assert r.rolling_mean == (pytest.approx(sum(values) / 5) if len(values) == 5 else None)
    assert len(got) == 90


def test_top_per_group_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 10 else "cold") for i in range(500)]
    df = spark.createDataFrame(rows, "v int, g string").repartition(9)
    top = ranking.top_per_group(df, ["g"], [F.desc("v")], 3, lanes=4).collect()
    assert sorted((r.g, r.v) for r in top) == [
        ("cold", 470), ("cold", 480), ("cold", 490), ("hot", 497), ("hot", 498), ("hot", 499),
    ]


def test_newest_and_pages(spark):
    df = series(spark, 50, parts=6).select("id", "ts")
    assert [r.id for r in ranking.newest(df, 3, key="id").collect()] == [49, 48, 47]
    assert ranking.newest(df, 0, key="id").count() == 0
    page = ranking.page(df, [F.desc("ts"), F.asc("id")], 2, 4)
    assert [r.id for r in page.collect()] == [45, 44, 43, 42]


def topic_posts(spark):
    rows = [
        (1, "en", "#Alpha one", ["Alpha"]), (2, "fr", "#alpha deux", ["alpha"]),
        (3, "fr", "#beta", ["beta"]), (4, "en", "see #gammaX", ["gammaX"]), (5, "en", "none", []),
    ]
    df = spark.createDataFrame(rows, "id int, lang string, content string, hashtags array<string>")
    return df.withColumn("ts", F.lit(T0) + F.make_dt_interval(F.col("id")))


def test_topic_tiers(spark):
    matched = ranking.with_topics(topic_posts(spark), ["alpha", "beta", "gamma"])
    chosen = ranking.select_topics(matched)
    assert sorted((r.topic, r.id) for r in chosen.collect()) == [("alpha", 1), ("beta", 3), ("gamma", 4)]


def test_topic_recency_before_or_after_the_choice(spark):
    matched = ranking.with_topics(topic_posts(spark), ["alpha"])
    recent = F.col("id") > 1
    assert ranking.select_topics(matched, recent).count() == 0
    assert [r.id for r in ranking.select_topics(matched, recent, recency_first=True).collect()] == [2]


def test_alternative_tier_order(spark):
    matched = ranking.with_topics(topic_posts(spark), ["alpha"], tiers=("tag", "en_tag", "phrase"))
    assert sorted(r.id for r in ranking.select_topics(matched).collect()) == [1, 2]


def test_top_values_ties_by_time(spark):
    rows = [(T0, ["a", "b"]), (T0 + timedelta(1), ["b", "c"]), (T0 + timedelta(2), ["a"]), (T0, [])]
    df = spark.createDataFrame(rows, "ts timestamp, hashtags array<string>")
    assert [tuple(r) for r in ranking.top_values(df, n=2).collect()] == [("a", 2), ("b", 2)]


def test_search_needs_every_word(spark):
    rows = [("ann", "Big Rally"), ("bob", "rally"), ("rally", "big")]
    df = spark.createDataFrame(rows, "username string, content string")
    found = filters.search(df, "BIG rally", ["username", "content"])
    assert sorted(r.username for r in found.collect()) == ["ann", "rally"]
    assert filters.search(df, " ", ["username"]).count() == 3


def test_date_facets(spark):
    rows = [(datetime(2025, 3, 15, 1),), (datetime(2025, 3, 9),), (datetime(2025, 3, 1),), (datetime(2025, 1, 2),), (datetime(2024, 12, 31),)]
    df = spark.createDataFrame(rows, "ts timestamp")
    counts = filters.facet_dates(df, F.lit(datetime(2025, 3, 15, 12)))
    assert {r.facet: r.n for r in counts.collect()} == {"today": 1, "past_7_days": 2, "this_month": 3, "this_year": 4}


def test_small_batches_in_a_session_with_sparks_default(spark):
    before = spark.conf.get(session.BATCH_BYTES)
    try:
        for given in ("67108864b", "64m", str(64 << 20), str(session.BATCH)):
            spark.conf.set(session.BATCH_BYTES, given)
            assert session.ensure_small_batches(spark).conf.get(session.BATCH_BYTES) == str(session.BATCH)
    finally:
        spark.conf.set(session.BATCH_BYTES, before)
