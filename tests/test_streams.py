import json
import os
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postsignal import schema, scratch_path
from postsignal.functions.scoring import analyze_posts
from postsignal.operators import keyed, textvec
from postsignal.operators.summary import stored_signal_summary
from postsignal.plans import fixtures, queries
from postsignal.plans.analyze import build_signals, signal_moments, signal_store, store_signals, stored_summary
from postsignal.sources import run_ledger, search_results
from postsignal.sources.tables import post_store, refused_store
from postsignal.streaming import streams, windows

SF_DIR = "/root/testdata/sf0.001"
NOW = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def pages(spark):
    return fixtures.search_page_folder(spark, SF_DIR, 1)


def posts(spark, folder, files=1):
    return streams.ingest(search_results.read_page_stream(spark, folder, files), NOW)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def distinct_posts(spark):
    return fixtures.posts(spark, SF_DIR).select("content").distinct().count()


def test_store_dedupes_over_batches_and_keeps_a_ledger(spark, pages):
    table_path, ledger, state = (scratch_path(spark, n) for n in ("t", "l", "s"))
    finish(streams.start_store(posts(spark, pages), table_path, ledger, state))
    table = post_store(spark, table_path)
    assert table.read().count() == distinct_posts(spark)
    runs = run_ledger.read_runs(spark, ledger)
    sums = runs.agg(F.sum("seen").alias("seen"), F.sum("inserted").alias("inserted")).first()
    assert sums.inserted == distinct_posts(spark) <= sums.seen <= 200
    assert {r.status for r in runs.collect()} == {"completed"}
    # Nothing new: a restart from the same state adds nothing.
    finish(streams.start_store(posts(spark, pages), table_path, ledger, state))
    assert table.read().count() == distinct_posts(spark)


def test_bounded_state_dedupe_over_a_long_delay(spark, pages):
    path, state = scratch_path(spark, "d"), scratch_path(spark, "s")
    unique = streams.dedupe_within(posts(spark, pages, 8), "60 days")
    finish(streams.start_ingest(unique, path, state))
    assert spark.read.parquet(path).count() == distinct_posts(spark)


def test_signals_stream_equals_batch(spark, pages):
    path, state = scratch_path(spark, "g"), scratch_path(spark, "s")
    finish(streams.start_signals(posts(spark, pages), scratch_path(spark, "p"), path, NOW, state))
    stored = signal_store(spark, path).read()
    batch = analyze_posts(fixtures.tagged(spark, SF_DIR)).groupBy("sentiment_label").agg(
        F.count_distinct("content").alias("n")
    )
    counts = lambda df: {r.sentiment_label: r.n for r in df.collect()}
    assert counts(stored.groupBy("sentiment_label").agg(F.count("*").alias("n"))) == counts(batch)


def test_append_mode_emits_closed_windows_once(spark, pages):
    path, state = scratch_path(spark, "h"), scratch_path(spark, "s")
    grouped = streams.hourly(analyze_posts(posts(spark, pages, 8)))
    finish(streams.start_summary(grouped, path, state))
    rows = spark.read.parquet(path)
    complete = streams.hourly(
        fixtures.scored(spark, SF_DIR).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp"))
    )
    newest = complete.agg(F.max("hour")).first()[0]
    hours = [r.hour for r in rows.select("hour").collect()]
    assert len(hours) == len(set(hours))
    assert complete.count() - 3 <= len(hours) < complete.count()
    assert max(hours) <= newest - timedelta(hours=1)


LINES = [
    '{"data":[{"id":"1","text":"buy #nifty50","author_id":"7","created_at":"2024-01-05T10:00:00Z",'
    '"public_metrics":{"like_count":3}},'
    '{"id":"2","text":"sell it","created_at":"2024-01-05T10:00:00Z","public_metrics":{"like_count":"n/a"}},'
    '{"id":"3","text":"hold","created_at":"soon"},{"id":"4","text":" \\t ","created_at":"2024-01-05T10:00:00Z"}],'
    '"includes":{"users":[{"id":"7","username":"u"}]}}',
    "not json",
    '{"data":[{"id":"1","text":"another text","created_at":"2024-01-05T11:00:00Z"},'
    '{"id":"5","text":"buy  #nifty50","created_at":"2024-01-05T11:00:00Z"},'
    '{"id":"6","text":"fine","created_at":"2024-01-05T12:00:00Z"}]}',
]


def started(spark, tmp_path, lines, **more):
    """A store stream over pages, one file each: (posts, refused, runs)."""
    folder = tmp_path / "pages"
    folder.mkdir(exist_ok=True)
    for n, line in enumerate(lines):
        (folder / f"{len(list(folder.iterdir()))}-{n}.json").write_text(line + "\n")
    stream = streams.examine(search_results.read_page_stream(spark, str(folder), 1), NOW)
    paths = [str(tmp_path / n) for n in ("posts", "ledger", "state", "refused")]
    finish(streams.start_store(stream, *paths, **more))
    refused = refused_store(spark, paths[3]).read().collect()
    return post_store(spark, paths[0]), refused, run_ledger.read_runs(spark, paths[1]).collect()


def test_refused_posts_and_pages_are_kept_with_their_reason(spark, tmp_path):
    table, refused, runs = started(spark, tmp_path, LINES[:2])
    assert [r.content for r in table.read().collect()] == ["buy #nifty50"]
    assert sorted((r.reason, ("n/a" in r.raw, "soon" in r.raw, r.raw == "not json")) for r in refused) == [
        ("bad likes", (True, False, False)), ("bad time", (False, True, False)), ("unreadable page", (False, False, True)),
    ]
    assert sorted((r.seen, r.inserted, tuple(r.errors)) for r in runs) == [
        (0, 0, ("unreadable page: 1",)), (1, 1, ("bad likes: 1", "bad time: 1")),
    ]
    # A restart from the same state adds nothing; a new state writes the refused rows of its own batches.
    again = started(spark, tmp_path, [])
    assert len(again[1]) == 3 and table.read().count() == 1


def test_ids_and_hashes_are_unique_over_batches(spark, tmp_path):
    table, _, runs = started(spark, tmp_path, [LINES[0], LINES[2]])
    kept = {(r.tweet_id, r.content) for r in table.read().collect()}
    # Either page may come first: id 1 has one text, and the text of both pages has one id.
    assert len({i for i, _ in kept}) == len({c for _, c in kept}) == len(kept)
    assert ("6", "fine") in kept and len(kept) in (2, 3)
    assert sum(r.inserted for r in runs) == len(kept)


def test_a_text_that_is_stored_takes_no_id(spark, tmp_path):
    table = post_store(spark, str(tmp_path / "t"))
    row = lambda i, c: (i, c, c)
    posts = lambda *rows: conform(spark.createDataFrame([row(*r) for r in rows], "tweet_id string, content string, content_hash string"))
    table.insert(posts(("1", "a"), (None, "b"), (None, "c")), ["content"])
    table.insert(posts(("2", "a"), ("2", "d"), ("1", "e"), (None, "f"), (None, "b")), ["content"])
    assert sorted((r.content, r.tweet_id) for r in table.read().collect()) == [
        ("a", "1"), ("b", None), ("c", None), ("d", "2"), ("f", None),
    ]


def conform(df):
    """The rows with all columns of posts, null where they have none."""
    fields = StructType.fromDDL(schema.POSTS).fields
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_second_batch_reads_only_its_parts_of_the_stored_values(spark, tmp_path):
    table = post_store(spark, str(tmp_path / "t"))
    names = [f"text {n}" for n in range(400)]
    one = lambda texts: conform(spark.createDataFrame([(t, t) for t in texts], "content string, content_hash string"))
    table.insert(one(names), ["content"])
    taken = table.taken("content_hash", one(["text 7", "new"]))
    assert [r.content_hash for r in taken.collect()] == ["text 7"]
    files = spark.read.parquet(f"{table.path}/values").select("value", "of", "part").filter("of = 'content_hash'")
    parts = {r.part for r in files.filter("value in ('text 7')").collect()}
    pushed = re.search(r"PartitionFilters: \[[^\n]*part#\d+ (IN|=) [^\n]*", plan_of(taken)).group(0)
    assert len(parts) == 1 and f"{parts.pop()}" in pushed
    assert files.select("part").distinct().count() > 2


def test_a_look_back_reads_the_days_it_needs(spark, tmp_path):
    table = post_store(spark, str(tmp_path / "t"))
    rows = [(f"t{n}", f"t{n}", NOW - timedelta(hours=12 * n + 1)) for n in range(60)]
    table.insert(conform(spark.createDataFrame(rows, "content string, content_hash string, ts timestamp")), ["ts"])
    recent = table.read(since=NOW - timedelta(hours=24))
    assert sorted(r.content for r in recent.collect()) == ["t0", "t1"]
    plan = plan_of(recent)
    assert re.search(r"PartitionFilters: \[[^\]]*_day#\d+ >= ", plan)
    days = [p.name for p in (tmp_path / "t").glob("gen=*/_day=*")]
    assert len(days) == 30 and len({d for d in days if d >= f"_day={(NOW - timedelta(hours=24)).date()}"}) == 1


def test_state_is_bounded_and_late_posts_are_counted(spark, tmp_path):
    """Posts of ten days, one file a day: a hash is held for the delay of two days, and the watermark is as far behind."""
    folder = tmp_path / "posts"
    folder.mkdir()
    ddl = "content string, content_hash string, ts timestamp"
    for day in range(10):
        at = lambda hour: (NOW + timedelta(days=day, hours=hour)).isoformat()
        texts = [f"{day}-{n}" for n in range(20)] + ["every day"]
        lines = [json.dumps({"content": t, "content_hash": t, "ts": at(n % 20)}) for n, t in enumerate(texts)]
        if day == 9:
            lines.append(json.dumps({"content": "late", "content_hash": "late", "ts": NOW.isoformat()}))
        (folder / f"{day}.json").write_text("\n".join(lines))
        os.utime(folder / f"{day}.json", (1000 + day, 1000 + day))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))
    path = str(tmp_path / "unique")
    query = streams.start_unique(stream, path, str(tmp_path / "state"), "2 days")
    finish(query)
    assert spark.conf.get(streams.STATE_STORE, None) is None
    report = streams.state_report(query)
    assert max(r["held"] for r in report) <= 5 * 21 and sum(r["dropped"] for r in report) == 1
    got = Counter(r.content for r in spark.read.parquet(path).collect())
    assert sum(n for t, n in got.items() if t != "every day") == 200 and "late" not in got
    assert 2 <= got["every day"] < 10


def test_closed_windows_and_late_rows(spark, tmp_path):
    """Windows appear once, when the newest time is an hour behind their end; later rows of theirs are kept apart."""
    folder = tmp_path / "signals"
    folder.mkdir()
    ddl = schema.LATE_SIGNALS
    waves = [[("a", 0), ("b", 30)], [("c", 50), ("d", 130)], [("e", 59), ("f", 70)], [], [("g", 500)]]
    for n, wave in enumerate(waves):
        rows = [
            {"content_hash": h, "ts": (NOW + timedelta(minutes=m)).isoformat(), "sentiment_score": 1.0, "sentiment_label": "positive",
             "engagement_score": 0.5, "composite_signal": m / 100}
            for h, m in wave
        ]
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{n}.json", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))
    path, state = str(tmp_path / "windows"), str(tmp_path / "state")
    finish(windows.start_windows(stream, path, state))
    found = windows.WindowFolder(spark, path)
    closed = {r.window_start: (r.total_posts, round(r.mean_signal, 6), round(r.std_signal, 6)) for r in found.closed().collect()}
    # 130 minutes close the first hour; e comes after that, f does not.
    assert closed == {
        NOW: (3, round((0 + 0.3 + 0.5) / 3, 6), round(float(np.std([0, 0.3, 0.5])), 6)),
        NOW + timedelta(hours=1): (1, 0.7, 0.0), NOW + timedelta(hours=2): (1, 1.3, 0.0),
    }
    assert [(r.content_hash, r.window_end, r.watermark) for r in found.late_rows().collect()] == [
        ("e", NOW + timedelta(hours=1), NOW + timedelta(minutes=70))
    ]
    finish(windows.start_windows(stream, path, state))
    assert found.closed().count() == 3 and found.late_rows().count() == 1


def test_signal_stream_keeps_a_ledger_vectors_and_moments(spark, pages, tmp_path):
    model = textvec.fit(fixtures.posts(spark, SF_DIR), config=textvec.VectorConfig(max_features=40, components=3))
    textvec.save(model, spark, str(tmp_path / "model"))
    paths = {n: str(tmp_path / n) for n in ("posts", "signals", "state", "ledger", "moments")}
    query = streams.start_signals(
        posts(spark, pages, 8), paths["posts"], paths["signals"], NOW, paths["state"], ledger_path=paths["ledger"],
        vectors=textvec.load(spark, str(tmp_path / "model")), moments_path=paths["moments"],
    )
    finish(query)
    stored = signal_store(spark, paths["signals"]).read()
    assert {r.n for r in stored.select(F.size("tfidf").alias("n")).distinct().collect()} == {3}
    runs = run_ledger.read_runs(spark, paths["ledger"])
    assert {r.status for r in runs.collect()} == {"completed"}
    assert runs.agg(F.sum("inserted")).first()[0] == stored.count()
    kept = stored_summary(signal_moments(spark, paths["moments"])).first().asDict()
    assert kept == pytest.approx(stored_signal_summary(stored).first().asDict())


def test_a_window_is_scored_once_per_start_of_a_query(spark, pages, tmp_path):
    paths = [str(tmp_path / n) for n in ("posts", "signals")]
    start = lambda state: finish(streams.start_signals(
        posts(spark, pages, 1), *paths, NOW, str(tmp_path / state), lookback_hours=24 * 60
    ))
    start("state")
    table = signal_store(spark, paths[1])
    written = [table.generation(g).count() for g in table.generations()]
    assert len(written) > 1 and sum(written) == distinct_posts(spark)
    stale = table.read().withColumn("sentiment_score", F.lit(-9.0))
    table.upsert(stale.localCheckpoint(), unique=True)
    start("anew")
    again = table.read()
    assert again.count() == distinct_posts(spark) and again.filter("sentiment_score = -9").isEmpty()


def test_what_others_write_makes_the_whole_window_unscored(spark, tmp_path):
    kept, signals = post_store(spark, str(tmp_path / "posts")), signal_store(spark, str(tmp_path / "signals"))
    post = lambda n: spark.createDataFrame(
        [("u", NOW, f"text {n}", 1, 1, 1, [], [], str(n), None, f"h{n}", NOW)], schema.POSTS
    )
    window, since = streams._Window(), NOW.replace(tzinfo=timezone.utc) - timedelta(hours=24)
    score = lambda since=since: sorted(r.content_hash for r in window.unscored(kept, signals, since).collect())
    done = lambda: window.done(signals, store_signals(signals, build_signals(kept.read(), NOW), unique=True))
    kept.insert(post(1), ["ts"], "run")
    assert score() == ["h1"]
    done()
    assert score() == []
    done()
    kept.insert(post(2), ["ts"], "other")
    assert score() == ["h2"]
    done()
    signals.upsert(build_signals(post(1), NOW))  # another's signals
    assert score() == ["h1", "h2"]
    done()
    kept.insert(post(3), ["ts"], "other")  # replaces what `other` stored
    assert score() == ["h3"]
    done()
    assert score() == [] and score(since - timedelta(hours=1)) == ["h1", "h3"]


def test_signals_of_unique_posts_are_not_grouped_before_they_are_written(spark, tmp_path, monkeypatch):
    grouped = []
    monkeypatch.setattr(keyed, "last_per_key", lambda batch, *more: grouped.append(batch) or batch)
    table = signal_store(spark, str(tmp_path / "signals"))
    signals = spark.createDataFrame([], schema.SIGNALS)
    store_signals(table, signals, unique=True)
    assert not grouped
    store_signals(table, signals)
    assert len(grouped) == 1


def test_a_batch_looks_up_the_parts_of_both_values_at_once(spark, tmp_path):
    table = post_store(spark, str(tmp_path / "posts"))
    batch = spark.createDataFrame([(f"h{n}", f"{n}" if n % 2 else None) for n in range(40)], "content_hash string, tweet_id string")
    found = table.parts(batch)
    assert set(found) == {"content_hash", "tweet_id"} and all(len(set(p)) == len(p) <= 16 for p in found.values())
    assert table.parts(batch.filter("tweet_id is null"), ("tweet_id",)) == {}


def test_the_batch_vectors_of_a_stream_come_from_its_fit(spark, monkeypatch):
    kept, fit = [], textvec.fit_transform
    monkeypatch.setattr(textvec, "fit_transform", lambda df, keep, *a, **k: kept.append(keep) or fit(df, keep, *a, **k))
    made = queries.stream_signal_vectors(spark, SF_DIR)
    assert kept == [["content_hash"]]
    assert made.count() == distinct_posts(spark) and made.filter("off <> 0").isEmpty()


def test_what_was_read_is_kept_for_refused_posts_only(spark, tmp_path):
    (tmp_path / "1.json").write_text("\n".join(LINES))
    judged = streams.examine(search_results.read_search_pages(spark, str(tmp_path)), NOW).collect()
    assert {r.reason is None for r in judged} == {True, False}
    assert all((r.raw is None) == (r.reason is None) for r in judged)


def test_a_failing_batch_is_recorded(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text(LINES[0])
    stream = streams.examine(search_results.read_page_stream(spark, str(tmp_path / "pages")), NOW)
    (tmp_path / "posts").write_text("a file where the store should be")
    ledger = str(tmp_path / "ledger")
    query = streams.start_store(stream, str(tmp_path / "posts"), ledger, str(tmp_path / "state"))
    with pytest.raises(Exception):
        query.awaitTermination()
    run = run_ledger.read_runs(spark, ledger).first()
    assert run.status == "failed" and run.errors


def test_a_filled_folder_is_taken_in_few_batches(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(40):
        post = {"id": str(n), "text": f"text {n}", "created_at": "2024-01-05T10:00:00Z"}
        (folder / f"{n}.json").write_text(json.dumps({"data": [post]}) + "\n")
    stream = streams.ingest(queries._arriving(spark, str(folder)), NOW)
    paths = [str(tmp_path / n) for n in ("posts", "ledger", "state")]
    finish(streams.start_store(stream, *paths))
    assert post_store(spark, paths[0]).read().count() == 40
    assert 1 < run_ledger.read_runs(spark, paths[1]).count() <= queries.BATCHES


def test_waves_are_made_from_posts_joined_once(spark):
    made = list(fixtures.waves(spark, SF_DIR))
    assert len(made) == fixtures.WAVES and not any("Join" in plan_of(pages) for pages in made)
    posts = [pages.select(F.explode("data.id").alias("id")) for pages in made]
    ids = [r.id for frame in posts for r in frame.collect()]
    assert sorted(map(int, ids)) == list(range(200))


def test_a_post_without_a_language_keeps_its_id_and_a_text_is_stored_under_one(spark, tmp_path):
    rows = [(0, "a text", None, 23), (1, "another", "en", 23), (2, "a third", None, 20), (3, "another", "de", 23)]
    for name, kind in (("documents", "doc_id long, text string, lang string, n_chars long"), ("events", None)):
        source = spark.createDataFrame(rows, kind) if kind else spark.read.parquet(f"{SF_DIR}/events.parquet")
        source.write.parquet(str(tmp_path / f"{name}.parquet"))
    ids = {r.post_id: r.tweet_id for r in fixtures.posts(spark, str(tmp_path)).collect()}
    assert ids == {0: "23", 1: "en23", 2: None, 3: "de23"}
    stored = {r.tweet_id for r in queries.stream_id_guard(spark, str(tmp_path)).collect()}
    assert stored in ({"23", None, "en23"}, {"23", None, "de23"})
