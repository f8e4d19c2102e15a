"""Registered queries: every operator over the whole tables of a data folder.

Each takes (spark, sf_dir). Doubles are rounded, arrays joined and times shown
without zone, so results compare exactly with the SQL in `oracle.py`.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import scoring, text, values
from ..functions.lexicon import ScoringConfig
from ..operators import (
    dedupe, filters, frames, keyed, linking, rangefinder, ranking, sampling, summary, textvec,
)
from ..session import scratch_path
from ..sources import post_files, run_ledger, search_results
from ..sources.tables import StoredTable, post_store, refused_store
from ..streaming import streams, windows
from .. import schema
from . import analyze, collect, fixtures, report

MAX_POINTS = 300
TOPIC_CAP = 50
NEWEST = 25
SAMPLE = 100
# Micro-batches that a stream takes a filled folder in, at most.
BATCHES = 6
# Stamp of everything the registered streams write.
STREAM_TIME = datetime(2024, 2, 1)


def r6(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


def joined(name: str, by: str = "|"):
    return F.array_join(name, by).alias(name)


def _stored(df: DataFrame) -> DataFrame:
    """The rows as a table: range partitioning reads its input twice, so it should not be computed."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return collect.clean_posts(fixtures.tagged(spark, sf), fixtures.as_of(spark, sf))


def _older(df: DataFrame, spark: SparkSession, sf: str, hours: int) -> DataFrame:
    return df.filter(~filters.since(fixtures.as_of(spark, sf), hours))


def _newer(df: DataFrame, spark: SparkSession, sf: str, hours: int) -> DataFrame:
    return df.filter(filters.since(fixtures.as_of(spark, sf), hours))


# --- sources and sinks ------------------------------------------------------


def flatten_pages(spark, sf):
    pages = fixtures.search_pages(fixtures.posts(spark, sf))
    flat = search_results.flatten_search_pages(pages, fixtures.as_of(spark, sf))
    return flat.select(
        "tweet_id", "username", ntz("ts"), "likes", "retweets", "replies",
        joined("mentions"), joined("hashtags"), "url", "content_hash",
    )


def author_lookup(spark, sf):
    posts = fixtures.posts(spark, sf).withColumn("author_id", F.substring_index("username", "_", -1))
    users = posts.filter(~F.col("author_id").endswith("0")).select("author_id", "username", "post_id")
    found = linking.author_lookup(posts.drop("username"), users, ["post_id"])
    return found.select("post_id", "author_id", "username")


def normalize_alt(spark, sf):
    raw = fixtures.alt_posts(fixtures.posts(spark, sf))
    flat = search_results.normalize_alt_posts(raw, fixtures.as_of(spark, sf))
    return flat.select(
        "url", "username", ntz("ts"), "likes", "retweets", "replies",
        joined("mentions"), joined("hashtags"), text.content_hash(F.col("content")).alias("content_hash"),
    )


def parquet_roundtrip(spark, sf):
    folder = scratch_path(spark, "posts")
    path = post_files.write_posts(fixtures.tagged(spark, sf), folder, "posts.parquet", legacy_lists=True)
    return post_files.read_posts(spark, path).select(
        "post_id", "ts", "likes", "tweet_id", joined("mentions"), joined("hashtags"),
        F.size("mentions").cast("bigint").alias("n_mentions"),
    )


def list_codec(spark, sf):
    coded = fixtures.tagged(spark, sf).withColumn("encoded", values.encode_list(F.col("mentions")))
    return coded.select(
        "post_id", "encoded", F.size(values.decode_list(F.col("encoded"))).cast("bigint").alias("n_items")
    )


def insert_if_absent(spark, sf):
    posts = _clean(spark, sf).select("post_id", "ts", "content_hash")
    stored = dedupe.dedupe_by_hash(_older(posts, spark, sf, 24), ["post_id"])
    return keyed.insert_if_absent(stored, posts, "content_hash", ["post_id"]).select("post_id", "content_hash")


def upsert_signals(spark, sf):
    base = fixtures.signals(spark, sf).withColumn("processed_at", F.col("ts"))
    stored = _older(base, spark, sf, 24)
    batch = _newer(base, spark, sf, 48).withColumns(
        {"composite_signal": F.col("composite_signal") + 1, "processed_at": fixtures.as_of(spark, sf)}
    )
    merged = keyed.upsert(stored, batch, "post_id", keep_old=("processed_at",))
    return merged.select("post_id", "sentiment_label", r6("engagement_score"), r6("composite_signal"), "processed_at")


def store_insert_twice(spark, sf):
    """Two runs into one stored table, the second with everything."""
    posts = _clean(spark, sf).select("post_id", "ts", "content_hash")
    table = StoredTable(spark, scratch_path(spark, "store"), "post_id bigint, ts timestamp, content_hash string")
    table.insert_if_absent(_older(posts, spark, sf, 24), "content_hash", ["post_id"])
    table.insert_if_absent(posts, "content_hash", ["post_id"])
    return table.read().select("post_id", "content_hash")


def store_upsert(spark, sf):
    """Stored signals replaced by a batch with repeated keys that moves them to other days."""
    ddl = "post_id bigint, ts timestamp, composite_signal double, processed_at timestamp"
    table = StoredTable(spark, scratch_path(spark, "store"), ddl, key="post_id", keep_old=("processed_at",))
    base = fixtures.signals(spark, sf).select("post_id", "ts", "composite_signal", F.col("ts").alias("processed_at"))
    shifted = lambda df, by: df.withColumn("composite_signal", F.col("composite_signal") + by)
    older = _older(base, spark, sf, 24)
    table.upsert(shifted(older, 5).unionByName(older), ["composite_signal"])
    moved = _newer(base, spark, sf, 48).withColumns(
        {"ts": F.col("ts") + F.expr("interval 2 days"), "processed_at": fixtures.as_of(spark, sf)}
    )
    table.upsert(shifted(moved, 1))
    return table.read().select("post_id", ntz("ts"), r6("composite_signal"), ntz("processed_at"))


def store_cascade(spark, sf):
    """Signals of a whole day lose their posts, then new ones arrive."""
    table = StoredTable(spark, scratch_path(spark, "store"), "post_id bigint, day date, composite_signal double")
    rows = fixtures.signals(spark, sf).select("post_id", F.to_date("ts").alias("day"), "composite_signal")
    first = F.col("post_id") % 4 != 0
    table.insert_if_absent(rows.filter(first), "post_id", ["post_id"])
    last = F.to_date(fixtures.as_of(spark, sf))
    table.retain(fixtures.posts(spark, sf).filter(F.to_date("ts") != last).select("post_id"), "post_id")
    table.insert_if_absent(rows.filter(~first), "post_id", ["post_id"])
    return table.read().select("post_id", "day", r6("composite_signal"))


def unique_id_guard(spark, sf):
    posts = fixtures.posts(spark, sf).select("post_id", "ts", "tweet_id")
    kept = keyed.unique_id_guard(
        _newer(posts, spark, sf, 24), "tweet_id", "post_id", ["post_id"], _older(posts, spark, sf, 24)
    )
    return kept.select("post_id", "tweet_id")


def cascade_signals(spark, sf):
    kept = dedupe.dedupe_by_hash(_clean(spark, sf).select("post_id", "content_hash"), ["post_id"])
    return keyed.cascade(fixtures.signals(spark, sf), kept, "post_id").select("post_id", r6("composite_signal"))


def collection_run(spark, sf):
    """A collection of raw posts, as the ledger tells it."""
    raw = fixtures.raw_counters(fixtures.tagged(spark, sf)).withColumn("url", F.lit(None).cast("string"))
    posts, ledger = scratch_path(spark, "posts"), scratch_path(spark, "ledger")
    collect.run_collection(spark, raw, posts, ledger, ["post_id"], STREAM_TIME, "run")
    return run_ledger.read_runs(spark, ledger).select(
        "run_id", ntz("started_at"), "status", "seen", "inserted", joined("errors")
    )


def run_ledger_by_day(spark, sf):
    """One run per day: what it saw, what was new, why rows were refused."""
    raw = fixtures.raw_counters(fixtures.tagged(spark, sf)).withColumn("url", F.lit(None).cast("string"))
    judged = collect.clean_posts(raw, fixtures.as_of(spark, sf)).withColumn("reason", filters.reject_reason())
    narrow = judged.select("post_id", "ts", "content_hash", "reason")
    first = dedupe.dedupe_by_hash(narrow.filter(F.col("reason").isNull()), ["post_id"])
    seen = narrow.select("ts", "reason", F.lit(1).alias("seen"), F.lit(0).alias("inserted"))
    new = first.select("ts", "reason", F.lit(0).alias("seen"), F.lit(1).alias("inserted"))
    runs = (
        seen.unionByName(new)
        .groupBy(F.to_date("ts").cast("string").alias("run_id"))
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("completed_at"),
            F.sum("seen").alias("seen"),
            F.sum("inserted").alias("inserted"),
            F.array_sort(F.collect_set("reason")).alias("errors"),
        )
        .withColumn("status", F.when(F.col("inserted") > 0, "completed").otherwise("failed"))
    )
    return run_ledger.newest_first(runs).select(
        "run_id", ntz("started_at"), ntz("completed_at"), "status", "seen", "inserted", joined("errors")
    )


# --- text and scalar projections --------------------------------------------


def clean_text(spark, sf):
    dirty = F.concat(
        F.lit("  "), F.col("content"), F.lit("\t\n "), F.lit("\x01"), F.lit(" end ")
    )
    return fixtures.posts(spark, sf).select("post_id", text.clean_text(dirty).alias("content"))


def clean_lists(spark, sf):
    extra = F.array(F.lit(""), F.lit(None).cast("string"), F.lit("  a\tb "), F.lit("ＢＵＹ"))
    lists = fixtures.tagged(spark, sf).select(
        "post_id", text.clean_list(F.concat(extra, "hashtags")).alias("hashtags")
    )
    return lists.select("post_id", joined("hashtags"), F.size("hashtags").cast("bigint").alias("n_tags"))


def content_hash(spark, sf):
    raw = text.content_hash(F.col("content"))
    clean = text.content_hash(text.clean_text(F.concat(F.lit(" "), F.col("content"))))
    return fixtures.posts(spark, sf).select("post_id", raw.alias("raw_hash"), clean.alias("clean_hash"))


def _exploded(spark, sf, column):
    lists = fixtures.tagged(spark, sf).select("post_id", F.posexplode_outer(column).alias("pos", "word"))
    return lists.filter(F.col("word").isNotNull()).select("post_id", F.col("pos").cast("bigint").alias("pos"), "word")


def extract_hashtags(spark, sf):
    return _exploded(spark, sf, "hashtags")


def extract_mentions(spark, sf):
    return _exploded(spark, sf, "mentions")


def normalize_ts(spark, sf):
    form = F.col("n_chars") % 6
    shown = lambda t, f: F.date_format(t, f)
    raw = (
        F.when(form == 0, shown(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            form == 1,
            shown(F.col("ts") + F.expr("interval '05:30' hour to minute"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'"),
        )
        .when(form == 2, shown(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 3, shown(F.col("ts"), "yyyyMMdd'T'HHmmss"))
        .when(form == 4, F.concat(F.lit("about "), F.col("ts").cast("string")))
    )
    parsed = values.normalize_timestamp(raw, fixtures.as_of(spark, sf))
    return fixtures.posts(spark, sf).select("post_id", parsed.cast("timestamp_ntz").alias("ts"))


def coerce_counts(spark, sf):
    raw = fixtures.raw_counters(fixtures.posts(spark, sf))
    return raw.select("post_id", *[values.coerce_count(F.col(c)).alias(c) for c in collect.COUNTERS])


def permalink(spark, sf):
    return fixtures.posts(spark, sf).select(
        "post_id",
        values.link_by_id(F.col("tweet_id")).alias("link_by_id"),
        values.link_by_user(F.col("username"), F.col("tweet_id")).alias("link_by_user"),
    )


def lexicon_hits(spark, sf):
    hits = scoring.with_sentiment(fixtures.posts(spark, sf))
    return hits.select("post_id", "bullish_hits", "bearish_hits")


def sentiment(spark, sf):
    hits = scoring.with_sentiment(fixtures.posts(spark, sf))
    return hits.select("post_id", r6("sentiment_score"), "sentiment_label")


def engagement(spark, sf):
    score = scoring.engagement_score(F.col("likes"), F.col("retweets"), F.col("replies"))
    return fixtures.posts(spark, sf).select("post_id", F.round(score, 6).alias("engagement_score"))


def custom_features(spark, sf):
    found = scoring.custom_features(
        F.col("content"), F.col("mentions"), F.col("hashtags"), ScoringConfig().market_tags, F.col("numbers")
    )
    tagged = fixtures.tagged(spark, sf).withColumn("numbers", text.numbers(F.col("content")))
    return tagged.select("post_id", found.alias("f")).select("post_id", "f.*")


def composite_signal(spark, sf):
    return fixtures.scored(spark, sf).select("post_id", r6("composite_signal"))


def analyze_posts(spark, sf):
    return fixtures.scored(spark, sf).select(
        "post_id", r6("sentiment_score"), "sentiment_label", r6("engagement_score"),
        "custom_features.*", r6("composite_signal"),
    )


def content_preview(spark, sf):
    return fixtures.posts(spark, sf).select("post_id", text.preview(F.col("content")).alias("preview"))


def plot_frame(spark, sf):
    holes = fixtures.signals(spark, sf).withColumns(
        {
            "sentiment_score": F.nullif(F.col("sentiment_score"), F.lit(1.0)),
            "sentiment_label": F.nullif(F.col("sentiment_label"), F.lit("positive")),
        }
    )
    return frames.plot_frame(holes, "post_id").select(
        "post_id", "ts", r6("composite_signal"), r6("sentiment_score"), "sentiment_label", r6("engagement_score")
    )


# --- text vectors -----------------------------------------------------------


def _word_digest(spark, sf, words):
    lists = fixtures.posts(spark, sf).select("post_id", words.alias("words"))
    return lists.select(
        "post_id", F.size("words").cast("bigint").alias("n_words"),
        F.md5(F.array_join("words", "|")).alias("digest"),
    )


def tokens(spark, sf):
    return _word_digest(spark, sf, textvec.token_list(F.col("content")))


def ngrams(spark, sf):
    return _word_digest(spark, sf, textvec.term_list(F.col("content")))


def doc_freq(spark, sf):
    posts = fixtures.posts(spark, sf)
    counts = textvec.term_counts(posts.select(textvec.term_list(F.col("content")).alias("terms")))
    return textvec.prune_terms(counts, posts.count(), textvec.VectorConfig()).select("term", "df", "ctf")


def vocabulary(spark, sf):
    words = textvec.stored_words(fixtures.posts(spark, sf), "content", textvec.VectorConfig())
    chosen = textvec.choose_terms(words, words.count(), textvec.VectorConfig())
    return spark.createDataFrame(chosen, "term string, ctf bigint, df bigint")


def idf(spark, sf):
    model = textvec.fit_vocabulary(fixtures.posts(spark, sf))
    rows = list(zip(model.terms, model.idf))
    return spark.createDataFrame(rows, "term string, idf double").select("term", r6("idf"))


def tfidf(spark, sf):
    posts = fixtures.posts(spark, sf).select("post_id", "content")
    model, weighed = textvec.fit_weigh(posts, ["post_id"])
    return textvec.weights_long(weighed, model, "post_id").select("post_id", "term", r6("weight"))


def svd_singular_values(spark, sf):
    model = textvec.fit(fixtures.posts(spark, sf))
    rows = [(i, float(v)) for i, v in enumerate(model.singular_values)]
    return spark.createDataFrame(rows, "component bigint, singular_value double").select(
        "component", r6("singular_value")
    )


def svd_project(spark, sf):
    posts = fixtures.posts(spark, sf).select("post_id", "content")
    model, scored = textvec.fit_transform(posts, ["post_id"], output="components")
    named = textvec.feature_map(F.col("components"), len(model.singular_values))
    cells = scored.select("post_id", F.explode_outer(named).alias("feature", "value"))
    return cells.filter(F.col("feature").isNotNull()).select(
        "post_id", "feature", r6("value")
    )


def svd_check(spark, sf):
    """Per component: its scores' length against its singular value, and how far loadings are from orthonormal."""
    posts = fixtures.posts(spark, sf).select("post_id", "content")
    model = textvec.fit(posts)
    scores = model.transform(posts, output="components").select(F.posexplode("components").alias("component", "v"))
    lengths = scores.groupBy("component").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    off = abs(model.loadings.T @ model.loadings - np.eye(len(model.singular_values))).max(axis=0)
    rows = [(i, float(s), round(float(o), 6) + 0.0) for i, (s, o) in enumerate(zip(model.singular_values, off))]
    known = spark.createDataFrame(rows, "component int, value double, overlap double")
    residual = F.round(F.col("length") - F.col("value"), 6) + F.lit(0.0)
    return lengths.join(known, "component").select(F.col("component").cast("bigint"), residual.alias("residual"), "overlap")


def gram_cells(spark, sf):
    """Every pair of terms that share a text: the sum of the products of their weights."""
    posts = fixtures.posts(spark, sf).select("post_id", "content")
    model = textvec.fit_vocabulary(posts)
    vectors = _stored(model.weigh(posts).select("tfidf"))
    sums = rangefinder.product(vectors, "tfidf", np.eye(len(model.terms)))
    cells = sums.select("i", F.posexplode("sums").alias("j", "w")).filter((F.col("i") <= F.col("j")) & (F.col("w") != 0))
    names = F.lit(model.terms)
    return cells.select(F.get(names, F.col("i")).alias("term"), F.get(names, F.col("j")).alias("other"), r6("w"))


def svd_randomised(spark, sf):
    """How far singular values by the range finder are from those of the Gram matrix."""
    posts = fixtures.posts(spark, sf).select("post_id", "content")
    model = textvec.fit_vocabulary(posts)
    vectors = _stored(model.weigh(posts).select("tfidf"))
    exact = textvec.fit_svd(model, vectors).singular_values
    _, found = rangefinder.components(vectors, "tfidf", len(model.terms), len(exact))
    rows = [(i, round(float(v - e), 6) + 0.0) for i, (v, e) in enumerate(zip(found, exact))]
    return spark.createDataFrame(rows, "component bigint, off double")


def stream_signal_vectors(spark, sf):
    """Vectors of a signal stream under a stored model, and how far they are from those of a batch."""
    posts = _clean(spark, sf).select("content", "content_hash")
    path = scratch_path(spark, "model")
    fitted, vectors = textvec.fit_transform(posts, ["content_hash"], output="expected")
    textvec.save(fitted, spark, path)
    signals = scratch_path(spark, "signals")
    _finish(
        streams.start_signals(
            _pages(spark, sf), scratch_path(spark, "unique"), signals, STREAM_TIME, scratch_path(spark, "state"),
            vectors=textvec.load(spark, path),
        )
    )
    # The vectors of the texts that were fitted: none is cleaned or split again.
    batch = vectors.dropDuplicates(["content_hash"])
    both = analyze.signal_store(spark, signals).read().join(batch, "content_hash")
    off = F.array_max(F.zip_with("tfidf", "expected", lambda a, b: F.abs(a - b)))
    return both.select("content_hash", F.size("tfidf").cast("bigint").alias("n_values"), F.round(off, 6).alias("off"))


# --- filters ----------------------------------------------------------------


def nonempty(spark, sf):
    blank = F.when(F.col("n_chars") % 9 == 0, F.lit(" \t  ")).otherwise(F.col("content"))
    cleaned = fixtures.posts(spark, sf).select("post_id", text.clean_text(blank).alias("content"))
    return filters.nonempty(cleaned).select("post_id", F.length("content").cast("bigint").alias("n_chars"))


def recent_posts(spark, sf):
    return _newer(fixtures.posts(spark, sf), spark, sf, 36).select("post_id", "ts")


def _lookback(spark, sf, hours):
    found = filters.lookback(fixtures.posts(spark, sf), hours, fixtures.as_of(spark, sf))
    return found.select("post_id", "ts")


def lookback_all(spark, sf):
    return _lookback(spark, sf, "all")


def lookback_24h(spark, sf):
    return _lookback(spark, sf, "24")


def rejects(spark, sf):
    raw = fixtures.raw_counters(fixtures.tagged(spark, sf)).withColumns(
        {
            "url": values.link_by_id(F.col("tweet_id")),
            "username": F.when(F.col("n_chars") % 29 == 0, F.repeat("username", 60)).otherwise(F.col("username")),
            "hashtags": F.when(F.col("n_chars") % 31 != 0, F.col("hashtags")),
        }
    )
    _, bad = collect.process_posts(raw, fixtures.as_of(spark, sf), ["post_id"])
    return bad.select("post_id", "reason")


def posts_with_signal(spark, sf):
    stored = _newer(fixtures.signals(spark, sf), spark, sf, 48)
    return linking.posts_with_signal(fixtures.posts(spark, sf), stored, "post_id").select("post_id", "ts")


SEARCH = "RALLY user_1"
SIGNAL_SEARCH = "'bullish but' RESISTANCE"


def search_posts(spark, sf):
    found = filters.search(fixtures.posts(spark, sf), SEARCH, ["username", "content"])
    return found.select("post_id", "username")


def search_signals(spark, sf):
    found = linking.search_signals(
        fixtures.signals(spark, sf), fixtures.posts(spark, sf), SIGNAL_SEARCH, "post_id"
    )
    return found.select("post_id", "sentiment_label", r6("composite_signal"))


def facet_dates(spark, sf):
    return filters.facet_dates(fixtures.posts(spark, sf), fixtures.as_of(spark, sf))


def facet_labels(spark, sf):
    return filters.facet_values(fixtures.signals(spark, sf), "sentiment_label")


# --- joins and de-duplication -----------------------------------------------


def posts_signals(spark, sf):
    both = linking.join_signals(fixtures.posts(spark, sf), fixtures.signals(spark, sf), "post_id")
    return both.select("post_id", "username", "ts", "sentiment_label", r6("composite_signal"))


def dedupe_posts(spark, sf):
    posts, _ = collect.process_posts(
        fixtures.tagged(spark, sf).withColumn("url", F.lit(None).cast("string")),
        fixtures.as_of(spark, sf), ["post_id"],
    )
    return posts.select("post_id", "username", "likes", joined("hashtags"), "content_hash")


def dedupe_raw(spark, sf):
    hashed = fixtures.posts(spark, sf).withColumn("content_hash", text.content_hash(F.col("content")))
    return dedupe.dedupe_by_hash(hashed, ["post_id"]).select("post_id", "content_hash")


def _topics(spark, sf):
    return ranking.with_topics(fixtures.tagged(spark, sf), fixtures.TOPICS)


def dedupe_topic(spark, sf):
    return dedupe.dedupe_by_content(_topics(spark, sf), ["post_id"], within=("topic",)).select("topic", "post_id")


def union_topics(spark, sf):
    hashed = _topics(spark, sf).withColumn("content_hash", text.content_hash(F.col("content")))
    return dedupe.dedupe_by_hash(hashed, ["post_id", "topic"]).select("post_id", "topic", "content_hash")


def topic_cap(spark, sf):
    order = [F.desc("ts"), F.asc("post_id")]
    narrow = _topics(spark, sf).select("topic", "post_id", "ts")
    return ranking.top_per_group(narrow, ["topic"], order, TOPIC_CAP)


def topic_select(spark, sf):
    recent = filters.since(fixtures.as_of(spark, sf), 48)
    chosen = ranking.select_topics(_topics(spark, sf).select("topic", "tier", "post_id", "ts"), recent)
    order = [F.desc("ts"), F.asc("post_id")]
    kept = ranking.top_per_group(chosen, ["topic"], order, TOPIC_CAP)
    return kept.select("topic", "post_id", "ts")


# --- aggregates -------------------------------------------------------------

_MEANS = (
    "mean_signal", "std_signal", "confidence_interval_lower", "confidence_interval_upper",
    "mean_sentiment", "mean_engagement",
)
_COUNTS = ("total_posts", "positive_posts", "negative_posts", "neutral_posts")


def _aggregated(df, *keys):
    return df.select(*keys, *[r6(c) for c in _MEANS], *_COUNTS)


def aggregate_signals(spark, sf):
    return _aggregated(summary.aggregate_signals(fixtures.scored(spark, sf)))


def aggregate_signals_by(spark, sf):
    return _aggregated(summary.aggregate_signals(fixtures.scored(spark, sf), group_by=["lang"]), "lang")


def hourly_signals(spark, sf):
    grouped = streams.hourly(fixtures.scored(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return _aggregated(grouped, ntz("hour"))


def stored_signal_summary(spark, sf):
    holes = fixtures.signals(spark, sf).withColumn(
        "composite_signal", F.when(F.col("sentiment_label") != "neutral", F.col("composite_signal"))
    )
    return _aggregated(summary.stored_signal_summary(holes))


def confidence_interval(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    found = summary.confidence_interval(items, "l_extendedprice", group_by=("l_returnflag", "l_linestatus"))
    return found.select("l_returnflag", "l_linestatus", "n", r6("lower_bound", 4), r6("upper_bound", 4))


def sentiment_distribution(spark, sf):
    return summary.label_counts(fixtures.signals(spark, sf))


def sentiment_share(spark, sf):
    return summary.label_shares(fixtures.signals(spark, sf))


def _stats(spark, sf):
    posts = fixtures.posts(spark, sf)
    stored = _newer(fixtures.signals(spark, sf), spark, sf, 48)
    return summary.corpus_stats(posts, stored, filters.since(fixtures.as_of(spark, sf), 24))


def corpus_stats(spark, sf):
    averages = ("avg_likes", "avg_retweets", "avg_signal", "avg_sentiment", "avg_engagement")
    return _stats(spark, sf).select(
        "total_posts", "total_signals", "recent_posts_24h", "max_likes", *[r6(c) for c in averages]
    )


def top_hashtags(spark, sf):
    return ranking.top_values(fixtures.tagged(spark, sf))


def volume_check(spark, sf):
    return summary.volume_check(fixtures.posts(spark, sf))


def report_document(spark, sf):
    """The statistics document, read back key by key."""
    tagged = fixtures.tagged(spark, sf)
    stored = _newer(fixtures.signals(spark, sf), spark, sf, 48)
    document = report.statistics(tagged, stored, fixtures.as_of(spark, sf))
    at = lambda path, kind: F.get_json_object("document", path).cast(kind)
    return document.select(
        at("$.total_tweets", "bigint").alias("total_posts"),
        at("$.total_signals", "bigint").alias("total_signals"),
        at("$.recent_tweets_24h", "bigint").alias("recent_posts_24h"),
        at("$.engagement_stats.max_likes", "bigint").alias("max_likes"),
        F.round(at("$.engagement_stats.avg_likes", "double"), 6).alias("avg_likes"),
        F.round(at("$.signal_stats.avg_signal", "double"), 6).alias("avg_signal"),
        at("$.top_hashtags.nifty50", "bigint").alias("nifty50"),
        at("$.top_hashtags.gold", "bigint").alias("gold"),
    )


def analysis_document(spark, sf):
    """The analysis answer, read back key by key."""
    document = summary.analysis_document(summary.aggregate_signals(fixtures.scored(spark, sf)))
    at = lambda path, kind: F.get_json_object("document", path).cast(kind)
    signals = "$.aggregated_signals"
    return document.select(
        at("$.status", "string").alias("status"),
        at("$.tweets_analyzed", "bigint").alias("total_posts"),
        F.round(at(f"{signals}.mean_signal", "double"), 6).alias("mean_signal"),
        F.round(at(f"{signals}.confidence_interval_upper", "double"), 6).alias("confidence_interval_upper"),
        *[at(f"{signals}.sentiment_distribution.{k}", "bigint").alias(f"{k}_posts") for k in summary.LABELS],
    )


def analysis_run(spark, sf):
    """A whole analysis: vectors fitted, stored posts scored, signals stored, their summary."""
    posts, signals = scratch_path(spark, "posts"), scratch_path(spark, "signals")
    raw = _numbered(fixtures.tagged(spark, sf)).withColumn("url", F.lit(None).cast("string"))
    unique, _ = collect.process_posts(raw, fixtures.as_of(spark, sf), ["post_id"])
    stored = post_files.to_posts(unique.select(*StructType.fromDDL(schema.POSTS).fieldNames()))
    post_store(spark, posts).insert(stored, ["ts"])
    return _aggregated(analyze.run_analysis(spark, posts, signals, STREAM_TIME, hours="all"))


# --- ordering, sampling, chart frames ---------------------------------------


def newest_n(spark, sf):
    posts = fixtures.posts(spark, sf).select("post_id", "username", "ts")
    return ranking.newest(posts, NEWEST, key="post_id")


def list_page(spark, sf):
    posts = fixtures.posts(spark, sf).select("post_id", "username", "ts")
    return ranking.page(posts, [F.desc("ts"), F.asc("post_id")], number=3, size=20)


def systematic_sample(spark, sf):
    indexed = sampling.global_index(fixtures.posts(spark, sf).select("ts", "post_id"), ["ts", "post_id"])
    return sampling.systematic_sample(indexed, MAX_POINTS).rows.select("idx", "ts", "post_id")


def random_sample(spark, sf):
    return sampling.random_sample(fixtures.posts(spark, sf).select("post_id", "ts"), SAMPLE, "post_id")


def rolling_mean(spark, sf):
    narrow = _stored(fixtures.signals(spark, sf).select("ts", "post_id", "composite_signal"))
    indexed = sampling.global_index(narrow, ["ts", "post_id"])
    window = sampling.rolling_window(indexed.count)
    found = sampling.rolling_mean(indexed, "composite_signal", window)
    return found.select("idx", "post_id", r6("rolling_mean"))


def rolling_mean_by(spark, sf):
    narrow = _stored(fixtures.scored(spark, sf).select("lang", "ts", "post_id", "composite_signal"))
    indexed = sampling.global_index(narrow, ["lang", "ts", "post_id"])
    found = sampling.rolling_mean(indexed, "composite_signal", 10, partition_by=("lang",))
    return found.select("lang", "post_id", r6("rolling_mean"))


def _frame(spark, sf):
    return frames.plot_frame(_stored(fixtures.signals(spark, sf)), "post_id")


def signal_over_time(spark, sf):
    found = frames.signal_over_time(_frame(spark, sf), "post_id", MAX_POINTS)
    return found.select("ts", "post_id", r6("composite_signal"), r6("rolling_mean"))


def engagement_vs_sentiment(spark, sf):
    found = frames.engagement_vs_sentiment(_frame(spark, sf), "post_id", MAX_POINTS)
    return found.select("post_id", r6("sentiment_score"), r6("engagement_score"))


def signal_summary_long(spark, sf):
    found = frames.signal_summary_long(summary.stored_signal_summary(fixtures.signals(spark, sf)))
    return found.select("panel", "metric", r6("value"))


# --- streams ----------------------------------------------------------------


def _arriving(spark, folder):
    """The pages of a filled folder as a stream of at most `BATCHES` batches, three files at least in each.

    A batch has a cost of its own, and what it finds stored grows with every one. So
    the batches grow with the folder, not their number.
    """
    files = len(spark.read.text(folder).inputFiles())
    return search_results.read_page_stream(spark, folder, files_per_batch=max(3, -(-files // BATCHES)))


def _pages(spark, sf):
    return streams.ingest(_arriving(spark, fixtures.search_page_folder(spark, sf)), STREAM_TIME)


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_ingest(spark, sf):
    path, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "state")
    _finish(streams.start_ingest(_pages(spark, sf), path, checkpoint))
    return spark.read.parquet(path).select("tweet_id", "username", ntz("ts"), "likes", "content_hash")


def stream_dedupe(spark, sf):
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "state")
    _finish(streams.start_store(_pages(spark, sf), path, None, checkpoint))
    stored = post_store(spark, path).read()
    return stored.select("content_hash", F.length("content").cast("bigint").alias("n_chars"))


def stream_signals(spark, sf):
    path, checkpoint = scratch_path(spark, "signals"), scratch_path(spark, "state")
    _finish(
        streams.start_signals(_pages(spark, sf), scratch_path(spark, "unique"), path, STREAM_TIME, checkpoint)
    )
    stored = analyze.signal_store(spark, path).read()
    return stored.select("content_hash", r6("sentiment_score"), "sentiment_label")


def _numbered(posts):
    """Posts under ids of their own."""
    return posts.withColumn("tweet_id", F.col("post_id").cast("string"))


def _collected(spark, sf, tagged=None):
    """Unique posts from before the last day, as an earlier run would store them."""
    tagged = _numbered(fixtures.tagged(spark, sf)) if tagged is None else tagged
    older = _older(tagged, spark, sf, 24).withColumn("url", F.lit(None).cast("string"))
    posts, _ = collect.process_posts(older, fixtures.as_of(spark, sf), ["post_id"])
    return post_files.to_posts(posts.select(*StructType.fromDDL(schema.POSTS).fieldNames()))


def stream_into_store(spark, sf):
    """A stream with a new checkpoint over a store that a run has filled."""
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "state")
    table = post_store(spark, path)
    table.insert(_collected(spark, sf).withColumn("url", F.lit("run")), ["ts"], "run")
    _finish(streams.start_store(_pages(spark, sf), path, None, checkpoint))
    return table.read().select("content_hash", F.coalesce(F.col("url") == "run", F.lit(False)).alias("from_run"))


def stream_signals_into_store(spark, sf):
    """A signal stream over stored signals: their first stamp stays, all else is new."""
    path, checkpoint = scratch_path(spark, "signals"), scratch_path(spark, "state")
    table = analyze.signal_store(spark, path)
    first = datetime(2023, 1, 1)
    table.upsert(analyze.build_signals(_collected(spark, sf), first), unique=True)
    _finish(
        streams.start_signals(_pages(spark, sf), scratch_path(spark, "unique"), path, STREAM_TIME, checkpoint)
    )
    return table.read().select(
        "content_hash", "sentiment_label", (F.col("processed_at") == values.as_column(first)).alias("from_run")
    )


def _stale_signals(spark, sf, posts, path):
    """The signal table of a store that a run has filled: its posts come from the store, where they lie cleaned."""
    kept, table = post_store(spark, posts), analyze.signal_store(spark, path)
    kept.insert(_collected(spark, sf), ["ts"], "run")
    stale = analyze.build_signals(kept.read(), STREAM_TIME).withColumn("sentiment_score", F.lit(-9.0))
    table.upsert(stale, unique=True)
    return table


def stream_reanalysis(spark, sf):
    """A stream that scores its whole window anew, over stored posts with stale signals."""
    posts, path, checkpoint = (scratch_path(spark, n) for n in ("posts", "signals", "state"))
    table = _stale_signals(spark, sf, posts, path)
    stream = streams.start_signals(_pages(spark, sf), posts, path, STREAM_TIME, checkpoint, lookback_hours=24 * 60)
    _finish(stream)
    return table.read().select("content_hash", r6("sentiment_score"), "sentiment_label")


def stream_reanalysis_window(spark, sf):
    """A stream that scores the posts of some days anew: stored ones from before the second day keep their stale signals."""
    posts, path, checkpoint = (scratch_path(spark, n) for n in ("posts", "signals", "state"))
    table = _stale_signals(spark, sf, posts, path)
    stream = streams.start_signals(_pages(spark, sf), posts, path, STREAM_TIME, checkpoint, lookback_hours=24 * 30)
    _finish(stream)
    return table.read().select("content_hash", r6("sentiment_score"), "sentiment_label")


def stream_signal_scores(spark, sf):
    """All scores of a signal stream that takes its pages in one batch."""
    path, checkpoint = scratch_path(spark, "signals"), scratch_path(spark, "state")
    pages = search_results.read_page_stream(spark, fixtures.search_page_folder(spark, sf))
    posts = scratch_path(spark, "unique")
    _finish(streams.start_signals(streams.examine(pages, STREAM_TIME), posts, path, STREAM_TIME, checkpoint))
    ids = post_store(spark, posts).read().select("content_hash", "tweet_id")
    features = ("text_length", "word_count", "hashtag_count", "mention_count", "number_count", "has_market_hashtag")
    return analyze.signal_store(spark, path).read().join(ids, "content_hash").select(
        "tweet_id", r6("sentiment_score"), "sentiment_label", r6("engagement_score"), r6("composite_signal"),
        *[F.col(f"custom_features.{c}").alias(c) for c in features],
    )


def chart_frames(spark, sf):
    """The four charts' data from stored posts and signals, as points of a series."""
    tagged = _numbered(fixtures.tagged(spark, sf)).withColumn("content_hash", F.col("post_id").cast("string"))
    made = report.chart_frames(
        tagged, fixtures.signals(spark, sf).withColumn("content_hash", F.col("post_id").cast("string")), max_points=MAX_POINTS
    )
    point = lambda frame, chart, name, value: frame.select(
        F.lit(chart).alias("chart"), F.col(name).cast("string").alias("point"), F.round(F.col(value).cast("double"), 6).alias("value")
    )
    over_time = made["signal_over_time"]
    return reduce(
        DataFrame.unionByName,
        [
            point(over_time, "signal", "content_hash", "composite_signal"),
            point(over_time, "mean", "content_hash", "rolling_mean"),
            point(made["sentiment_distribution"], "labels", "sentiment_label", "n"),
            point(made["engagement_vs_sentiment"], "engagement", "content_hash", "engagement_score"),
            point(made["signal_aggregation"].filter("panel <> 'labels'"), "summary", "metric", "value"),
        ],
    )


def stream_ledger(spark, sf):
    """What the ledger of a store stream adds up to."""
    path, ledger, checkpoint = (scratch_path(spark, n) for n in ("unique", "ledger", "state"))
    _finish(streams.start_store(_pages(spark, sf), path, ledger, checkpoint))
    runs = run_ledger.read_runs(spark, ledger)
    return runs.groupBy("status").agg(
        F.sum("inserted").alias("inserted"), F.count_if(F.col("seen") < F.col("inserted")).alias("short_runs")
    )


def _page_stream(spark, pages):
    """Judged posts of pages that are written as lines of text or as JSON rows."""
    folder = scratch_path(spark, "pages")
    writer = pages.write.option("maxRecordsPerFile", 4)
    (writer.text if pages.columns == ["value"] else writer.json)(folder)
    return streams.examine(_arriving(spark, folder), STREAM_TIME)


def stream_rejects(spark, sf):
    """What a stream of damaged pages refuses, by reason, and how many posts it stores."""
    path, bad, checkpoint = (scratch_path(spark, n) for n in ("unique", "refused", "state"))
    stream = _page_stream(spark, fixtures.damaged_pages(fixtures.posts(spark, sf)))
    _finish(streams.start_store(stream, path, None, checkpoint, refused_path=bad))
    refused = refused_store(spark, bad).read().select("reason")
    stored = post_store(spark, path).read().select(F.lit("stored").alias("reason"))
    return refused.unionByName(stored).groupBy("reason").agg(F.count("*").alias("n"))


def stream_id_guard(spark, sf):
    """A stream whose posts share ids, over a store that has taken some of them."""
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "state")
    table = post_store(spark, path)
    older = _collected(spark, sf, fixtures.tagged(spark, sf)).withColumn("url", F.lit("run"))
    table.insert(older, ["ts", "content_hash"], "run")
    pages = fixtures.search_pages(fixtures.posts(spark, sf), id=F.col("tweet_id"))
    _finish(streams.start_store(_page_stream(spark, pages), path, None, checkpoint))
    return table.read().select(
        "tweet_id", F.when(F.col("tweet_id").isNull(), F.col("content_hash")).alias("text_hash"),
        F.coalesce(F.col("url") == "run", F.lit(False)).alias("from_run"),
    )


def stream_signals_ledger(spark, sf):
    """What the ledger of a signal stream adds up to, refused posts included."""
    posts, path, ledger, checkpoint = (scratch_path(spark, n) for n in ("unique", "signals", "ledger", "state"))
    stream = _page_stream(spark, fixtures.damaged_pages(fixtures.posts(spark, sf)))
    _finish(streams.start_signals(stream, posts, path, STREAM_TIME, checkpoint, ledger_path=ledger))
    runs = run_ledger.read_runs(spark, ledger)
    notes = runs.select("inserted", F.explode_outer("errors").alias("note"))
    reason = F.regexp_extract("note", "^(.*): ", 1)
    by_reason = notes.filter("note is not null").groupBy(reason.alias("what")).agg(
        F.sum(F.regexp_extract("note", r"(\d+)$", 1).cast("bigint")).alias("n")
    )
    return by_reason.unionByName(runs.groupBy(F.col("status").alias("what")).agg(F.sum("inserted").alias("n")))


def stream_dedupe_within(spark, sf):
    """First posts by hash with bounded state; the delay is longer than the data, so the result is exact."""
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "state")
    _finish(streams.start_unique(_pages(spark, sf), path, checkpoint, "60 days"))
    return spark.read.parquet(path).select("content_hash", F.length("content").cast("bigint").alias("n_chars"))


def _windows(spark, sf):
    """A window stream that runs whenever a wave of pages has come; what came is one batch."""
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("arrived", "windows", "state"))
    for pages in fixtures.waves(spark, sf):
        pages.write.mode("append").json(folder)
        arrived = streams.ingest(search_results.read_page_stream(spark, folder), STREAM_TIME)
        _finish(windows.start_windows(scoring.analyze_posts(arrived), path, checkpoint))
    return windows.WindowFolder(spark, path)


def stream_windows(spark, sf):
    """Hours that a stream has closed, in append form."""
    return _aggregated(_windows(spark, sf).closed(), ntz("window_start"))


def stream_late(spark, sf):
    """Posts that came after their hour was closed."""
    late = _windows(spark, sf).late_rows()
    return late.select("content_hash", ntz("ts"), ntz("window_end"), ntz("watermark"), r6("composite_signal"))


def stored_summary_kept(spark, sf):
    """Stored signals, half of them replaced by a second write, summed up from the kept moments."""
    path, moments = scratch_path(spark, "signals"), scratch_path(spark, "moments")
    table, kept = analyze.signal_store(spark, path), analyze.signal_moments(spark, moments)
    posts = _clean(spark, sf).withColumn("content_hash", F.concat("content_hash", F.lit("-"), F.col("post_id").cast("string")))
    scored = analyze.build_signals(posts, STREAM_TIME)
    analyze.store_signals(table, scored.filter("post_id % 3 <> 0"), "first", kept)
    doubled = scored.withColumn("composite_signal", F.col("composite_signal") * 2)
    analyze.store_signals(table, doubled.filter("post_id % 3 <> 1"), "second", kept)
    return _aggregated(analyze.stored_summary(kept))


def stream_hourly(spark, sf):
    path, checkpoint = scratch_path(spark, "hourly"), scratch_path(spark, "state")
    grouped = streams.hourly(scoring.analyze_posts(_pages(spark, sf)))
    _finish(streams.start_summary(grouped, path, checkpoint, mode="complete"))
    return _aggregated(streams.last_summary(spark, path), ntz("hour"))


QUERIES = {
    f.__name__: f
    for f in (
        flatten_pages, author_lookup, normalize_alt, parquet_roundtrip, list_codec, insert_if_absent,
        upsert_signals, unique_id_guard, cascade_signals, clean_text, clean_lists,
        content_hash, extract_hashtags, extract_mentions, normalize_ts, coerce_counts, permalink,
        lexicon_hits, sentiment, engagement, custom_features, composite_signal, analyze_posts,
        content_preview, plot_frame, tokens, ngrams, doc_freq, vocabulary, idf, tfidf,
        svd_singular_values, svd_project, nonempty, recent_posts, lookback_all, lookback_24h, rejects,
        posts_with_signal, search_posts, search_signals, facet_dates, facet_labels, posts_signals,
        dedupe_posts, dedupe_raw, dedupe_topic, union_topics, topic_cap, topic_select,
        aggregate_signals, aggregate_signals_by, hourly_signals, stored_signal_summary,
        confidence_interval, sentiment_distribution, sentiment_share, corpus_stats, top_hashtags,
        volume_check, report_document, newest_n, list_page, systematic_sample, random_sample,
        rolling_mean, rolling_mean_by, signal_over_time, engagement_vs_sentiment,
        signal_summary_long, stream_ingest, stream_dedupe, stream_signals, stream_hourly,
        store_insert_twice, store_upsert, store_cascade, stream_into_store, stream_signals_into_store,
        stream_reanalysis, stream_ledger, stream_rejects, stream_id_guard, stream_signals_ledger, stream_dedupe_within,
        stream_windows, stream_late, stream_reanalysis_window, stream_signal_scores, chart_frames, stored_summary_kept, collection_run, analysis_document, analysis_run, svd_check, gram_cells, svd_randomised, stream_signal_vectors,
    )
} | {"run_ledger": run_ledger_by_day}
