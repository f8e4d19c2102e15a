import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postsignal import schema, scratch_path
from postsignal.plans import analyze, collect, queries, report
from postsignal.sources import post_files, run_ledger, search_results, tables
from postsignal.sources.tables import StoredTable, post_store

NOW = datetime(2025, 1, 10)


def raw_posts(spark, rows):
    """Rows of (seq, content, likes, days before NOW)."""
    ddl = "seq int, content string, likes string, ts timestamp"
    df = spark.createDataFrame([(s, c, n, NOW - timedelta(days=d)) for s, c, n, d in rows], ddl)
    from postsignal.functions import text

    return df.select(
        "seq", F.lit("u").alias("username"), "ts", "content", "likes",
        F.lit("1").alias("retweets"), F.lit(None).cast("string").alias("replies"),
        text.mentions(F.col("content")).alias("mentions"), text.hashtags(F.col("content")).alias("hashtags"),
        F.col("seq").cast("string").alias("tweet_id"), F.lit(None).cast("string").alias("url"),
    )


ROWS = [
    (1, "buy #nifty50", "n/a", 0), (2, " buy  #nifty50 ", "5", 0), (3, "sell #gold", "2", 1),
    (4, "\t", "1", 0), (5, "buy #nifty50", "9", 0), (6, "weak close", None, 2),
]


def test_rejected_row_does_not_hide_a_good_copy(spark):
    posts, bad = collect.process_posts(raw_posts(spark, ROWS), NOW, ["seq"])
    assert sorted((r.seq, r.likes) for r in posts.collect()) == [(2, 5), (3, 2), (6, 0)]
    assert [(r.seq, r.reason) for r in bad.collect()] == [(1, "bad likes")]


def test_collect_analyse_report(spark):
    posts_path, signals_path, ledger = (scratch_path(spark, n) for n in ("posts", "signals", "ledger"))
    first = collect.run_collection(spark, raw_posts(spark, ROWS), posts_path, ledger, ["seq"], NOW, "r1")
    assert (first["seen"], first["inserted"]) == (3, 3)
    later = NOW + timedelta(hours=1)
    again = collect.run_collection(
        spark, raw_posts(spark, ROWS + [(7, "rally", "3", 0)]), posts_path, ledger, ["seq"], later, "r2"
    )
    assert (again["seen"], again["inserted"]) == (4, 1)
    runs = run_ledger.read_runs(spark, ledger).collect()
    assert [(r.run_id, r.status, r.seen, r.inserted) for r in runs] == [
        ("r2", "completed", 4, 1), ("r1", "completed", 3, 3),
    ]

    recent = analyze.run_analysis(spark, posts_path, signals_path, NOW, hours="24", fit_vectors=False).first()
    assert (recent.total_posts, recent.positive_posts, recent.negative_posts) == (3, 2, 1)
    everything = analyze.run_analysis(spark, posts_path, signals_path, later, hours="all").first()
    assert everything.total_posts == 4
    table = analyze.signal_store(spark, signals_path)
    stamps = {r.processed_at for r in table.read().filter(F.col("ts") >= NOW - timedelta(days=1)).collect()}
    assert stamps == {NOW}
    assert table.read().count() == 4

    posts = post_store(spark, posts_path).read()
    assert '"total_signals":4' in report.statistics(posts, table.read(), NOW).first().document
    frames = report.chart_frames(posts, table.read())
    assert frames["signal_over_time"].count() == 4
    assert {r.sentiment_label: r.n for r in frames["sentiment_distribution"].collect()} == {"positive": 2, "negative": 2}

    table.retain(posts.filter("content != 'rally'"), "content_hash")
    assert table.read().count() == 3


def test_failed_run_is_recorded(spark):
    ledger = scratch_path(spark, "ledger")
    with pytest.raises(Exception):
        collect.run_collection(
            spark, raw_posts(spark, ROWS).drop("content"), scratch_path(spark, "p"), ledger, ["seq"], NOW, "bad"
        )
    row = run_ledger.read_runs(spark, ledger).first()
    assert row.status == "failed" and row.errors


def test_no_posts_is_an_error(spark):
    with pytest.raises(ValueError):
        analyze.run_analysis(spark, scratch_path(spark, "none"), scratch_path(spark, "s"), NOW)


KV = "k string, ts timestamp, v double"


def kv(spark, *rows):
    return spark.createDataFrame([(k, NOW - timedelta(days=d), v) for k, d, v in rows], KV)


def held(table):
    return sorted((r.k, r.v) for r in table.read().collect())


def test_upsert_repeats_moves_and_replays(spark):
    table = StoredTable(spark, scratch_path(spark, "signals"), KV, key="k", keep_old=("ts",))
    table.upsert(kv(spark, ("a", 0, 1.0), ("b", 1, 1.0), ("a", 0, 0.5)), ["v"])
    assert held(table) == [("a", 1.0), ("b", 1.0)]
    again = kv(spark, ("a", 3, 2.0), ("c", 0, 2.0))
    table.upsert(again, owner="batch")
    assert held(table) == [("a", 2.0), ("b", 1.0), ("c", 2.0)]
    assert {r.k: r.ts for r in table.read().collect()}["a"] == NOW
    # A replay under its own name changes nothing, also after a later write.
    table.upsert(kv(spark, ("c", 0, 3.0)))
    table.upsert(again, owner="batch")
    assert held(table) == [("a", 2.0), ("b", 1.0), ("c", 3.0)]
    table.compact()
    assert held(table) == [("a", 2.0), ("b", 1.0), ("c", 3.0)]


@pytest.mark.parametrize("key", [None, "k"])
def test_retain_deletes(spark, key):
    table = StoredTable(spark, scratch_path(spark, "t"), KV, key=key)
    table.insert_if_absent(kv(spark, ("a", 0, 1.0), ("b", 1, 1.0)), "k", ["k"])
    table.retain(kv(spark, ("a", 0, 0.0)), "k")
    assert held(table) == [("a", 1.0)]
    table.insert_if_absent(kv(spark, ("b", 0, 2.0), ("a", 0, 9.0)), "k", ["k"])
    assert held(table) == [("a", 1.0), ("b", 2.0)]


def test_unfinished_generation_is_not_read(spark):
    path = scratch_path(spark, "posts")
    table = StoredTable(spark, path, "k string")
    df = spark.createDataFrame([("a",)], "k string")
    table.insert_if_absent(df, "k", ["k"])
    # What a job killed before its commit leaves behind.
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        df.withColumn("k", F.lit("z")).write.parquet(f"{path}/gen=0000000001-added-killed")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert [r.k for r in table.read().collect()] == ["a"]


def test_times_are_utc_on_a_driver_elsewhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from datetime import datetime
from postsignal import build_session
from postsignal.functions.values import as_column
from postsignal.sources import run_ledger
spark = build_session("utc", "local[1]", **{{"spark.ui.enabled": "false"}})
run_ledger.record_run(spark, {str(tmp_path / "ledger")!r}, "r", datetime(2025, 1, 10), "completed", datetime(2025, 1, 11))
rows = run_ledger.read_runs(spark, {str(tmp_path / "ledger")!r}).select("started_at", "completed_at")
stamp = spark.range(1).select(as_column(datetime(2025, 1, 10)).cast("string")).first()[0]
print([str(x) for x in rows.selectExpr("cast(started_at as string)", "cast(completed_at as string)").first()], stamp)
"""
    env = {**os.environ, "TZ": "Asia/Kolkata"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "['2025-01-10 00:00:00', '2025-01-11 00:00:00'] 2025-01-10 00:00:00", out.stderr[-800:]


def test_post_files(spark):
    folder = scratch_path(spark, "files")
    posts, _ = collect.process_posts(raw_posts(spark, ROWS), NOW, ["seq"])
    posts = post_files.to_posts(posts)
    path = post_files.write_posts(posts, folder, as_of=NOW, legacy_lists=True)
    assert path.endswith("/tweets_20250110_000000.parquet")
    back = post_files.read_posts(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, posts.collect()))
    assert post_files.write_posts(posts.filter("false"), folder) == ""


def test_search_pages(spark, tmp_path):
    page = (
        '{"data":[{"id":"1","text":"#a @b","author_id":"7","created_at":"2025-01-01T00:00:00Z",'
        '"public_metrics":{"like_count":3}},{"id":"2","author_id":"8"},'
        '{"id":"3","text":"x","created_at":"junk"}],'
        '"includes":{"users":[{"id":"7","username":"u"},{"id":"7","username":"later"}]},'
        '"errors":[{"message":"partial"}]}\n{"meta":{}}\nnot json\n'
    )
    (tmp_path / "p.json").write_text(page)
    pages = search_results.read_search_pages(spark, str(tmp_path))
    assert [r.unreadable for r in search_results.unreadable_pages(pages).collect()] == ["not json"]
    rows = search_results.flatten_search_pages(pages, NOW).orderBy("tweet_id").collect()
    assert [(r.tweet_id, r.username, r.likes, r.replies, r.content) for r in rows] == [
        ("1", "u", 3, 0, "#a @b"), ("2", "unknown", 0, 0, ""),
    ]
    assert rows[0].hashtags == ["a"] and rows[0].mentions == ["b"] and rows[1].ts == NOW
    assert rows[0].url.endswith("/i/web/status/1")


def test_alt_posts(spark):
    rows = [
        ("1", None, "short", "u", "2025-01-01T00:00:00Z", 1, None, 4, 2),
        (None, "full", "short", None, None, None, 9, 4, None),
        ("3", "x", None, "u", "", 0, 0, 0, 0),
    ]
    df = spark.createDataFrame(rows, schema.ALT_POST)
    got = search_results.normalize_alt_posts(df, NOW).orderBy("content").collect()
    assert [(r.content, r.username, r.likes, r.url) for r in got] == [
        ("full", "unknown", 9, None), ("short", "u", 4, "https://twitter.com/u/status/1"),
    ]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from postsignal.session import scratch_root

    conf = {}
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)),
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError):
        scratch_root(fake)
    conf["spark.checkpoint.dir"] = "hdfs://shared/x"
    assert scratch_root(fake) == "hdfs://shared/x"


def test_whole_analysis_stores_vectors(spark, monkeypatch):
    paths, run = [], analyze.run_analysis
    monkeypatch.setattr(analyze, "run_analysis", lambda s, posts, signals, *a, **b: (paths.append(signals), run(s, posts, signals, *a, **b))[1])
    queries.analysis_run(spark, "/root/testdata/sf0.001").collect()
    stored = analyze.signal_store(spark, paths[0]).read()
    assert not stored.isEmpty() and stored.filter(F.size("tfidf") == 0).isEmpty()


def test_a_run_over_pages_notes_what_it_refuses_and_counts_without_a_job(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.json").write_text(
        '{"data":[{"id":"1","text":"buy","created_at":"2025-01-09T00:00:00Z","public_metrics":{"like_count":"x"}},'
        '{"id":"2","text":"buy","created_at":"2025-01-09T00:00:00Z"},{"id":"2","text":"sell","created_at":"2025-01-09T01:00:00Z"}]}\n'
        "broken off\n"
    )
    pages = search_results.read_search_pages(spark, str(tmp_path / "pages"))
    raw = search_results.examine_search_pages(pages, NOW)
    posts, ledger, refused = (str(tmp_path / n) for n in ("posts", "ledger", "refused"))
    done = collect.run_collection(spark, raw, posts, ledger, ["ts", "tweet_id"], NOW, "r", refused_path=refused)
    assert (done["seen"], done["inserted"]) == (2, 1)
    run = run_ledger.read_runs(spark, ledger).first()
    assert run.errors == ["bad likes: 1", "unreadable page: 1", "volume 2 below 2000"]
    kept = {r.reason: r.raw for r in tables.refused_store(spark, refused).read().collect()}
    assert kept["unreadable page"] == "broken off" and '"like_count":"x"' in kept["bad likes"]


def test_counts_come_from_the_write_itself(spark, tmp_path, monkeypatch):
    judged = collect.judge_posts(raw_posts(spark, ROWS), NOW).cache()
    table = tables.post_store(spark, str(tmp_path / "posts"))
    counted = []
    monkeypatch.setattr(type(judged), "count", lambda self: counted.append(self))
    stored = collect.store_judged(table, judged, ["seq"], "r")
    assert (stored.seen, stored.inserted, stored.notes) == (3, 3, ["bad likes: 1"]) and not counted
    again = collect.store_judged(table, judged.limit(0), ["seq"], "nothing")
    assert (again.seen, again.inserted, again.notes) == (0, 0, [])
