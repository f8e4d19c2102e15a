"""The registered queries as SQL over the same tables, for checking results."""

from __future__ import annotations

from statistics import NormalDist

from ..functions.lexicon import BEARISH, BULLISH, MARKET_TAGS, STOP_WORDS
from .fixtures import CONTENT_SQL, LATE_WAVES, TOPICS, WAVE_HOURS, WAVES

MAX_POINTS, TOPIC_CAP, NEWEST, SAMPLE = 300, 50, 25, 100
MAX_FEATURES, MIN_DF, MAX_DF = 1000, 2, 0.95
# Fixed values, as in functions/text.py.
WORD = r"[\p{L}\p{N}_]"
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x{9f}]"
Z95 = NormalDist().inv_cdf(0.975)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{SPACE}+', ' ', 'g'), '{CONTROL}', '', 'g'))"


def _hits(words) -> str:
    return " + ".join(f"cast(contains(lower(content), '{w}') as bigint)" for w in words)


CTES = {
    "posts": f"""
        select doc_id as post_id, concat('user_', cast(user_id as varchar)) as username, ts, lang, n_chars,
               {CONTENT_SQL.format(text="varchar")} as content,
               cast(cast(json_extract_string(props, '$.k') as bigint) * (n_chars % 13) as bigint) as likes,
               cast(floor(value) as bigint) as retweets, cast(user_id % 20 as bigint) as replies,
               case when n_chars % 10 <> 0 then concat(lang, cast(n_chars as varchar)) end as tweet_id
        from documents join events on event_id = doc_id""",
    "now": "select max(ts) as as_of from posts",
    "tagged": f"""
        select *, regexp_extract_all(content, '#({WORD}+)', 1) as hashtags,
               regexp_extract_all(content, '@({WORD}+)', 1) as mentions,
               sha256(content) as raw_hash, sha256({_clean("content")}) as content_hash
        from posts""",
    "hits": f"select *, {_hits(BULLISH)} as bullish_hits, {_hits(BEARISH)} as bearish_hits from tagged",
    "scores": """
        select *, case when bullish_hits + bearish_hits = 0 then 0.0
                       else cast(bullish_hits - bearish_hits as double) / (bullish_hits + bearish_hits) end
                    as sentiment_score,
               case when likes + 2 * retweets + 1.5 * replies = 0 then 0.0
                    else least(1.0, ln(1.0 + likes + 2.0 * retweets + 1.5 * replies) / ln(100001.0)) end
                    as engagement_score
        from hits""",
    "features": f"""
        select *, case when sentiment_score > 0.2 then 'positive' when sentiment_score < -0.2 then 'negative'
                       else 'neutral' end as sentiment_label,
               length(content) as text_length,
               len(regexp_extract_all(content, '[^' || substr('{SPACE}', 2) || '+')) as word_count,
               len(hashtags) as hashtag_count,
               cast(len(list_filter(hashtags, lambda h: lower(h) in ({_quoted(MARKET_TAGS)}))) > 0 as bigint)
                    as has_market_hashtag,
               len(mentions) as mention_count,
               len(regexp_extract_all(content, '\\d+\\.?\\d*')) as number_count,
               cast(len(list_filter(regexp_extract_all(content, '\\d+\\.?\\d*'),
                                    lambda n: cast(n as double) > 1000)) > 0 as bigint) as has_large_number,
               length(content) - length(replace(content, '?', '')) as question_count,
               length(content) - length(replace(content, '!', '')) as exclamation_count
        from scores""",
    "scored": """
        select *, sentiment_score * 0.5 + engagement_score * 0.3
                  + (has_market_hashtag * 0.1 + least(mention_count / 5.0, 1.0) * 0.1) * 0.2 as composite_signal
        from features""",
    "unique_posts": """
        select * from tagged qualify row_number() over (partition by content_hash order by post_id) = 1""",
    "topics": f"""
        select t.topic, p.*,
               case when list_contains(list_transform(hashtags, lambda h: lower(h)), t.topic)
                    then case when lang = 'en' then 1 else 2 end
                    when contains(lower(content), '#' || t.topic) then 3 end as tier
        from tagged p, (values {", ".join(f"('{t}')" for t in TOPICS)}) t(topic)""",
    "matched": "select * from topics where tier is not null",
    "raw_counters": """
        select *, case when post_id % 17 = 0 then null when post_id % 19 = 0 then 0 else likes end as counted_likes
        from tagged""",
    "damaged": """
        select *, case when post_id % 31 = 0 then 'bad time'
                       when post_id % 17 = 0 and post_id % 23 <> 0 then 'bad likes'
                       when post_id % 37 = 0 and username not like '%0' then 'username too long'
                       when post_id % 29 = 0 then 'id too long' end as reason
        from tagged""",
    "docs": f"""
        select post_id,
               list_filter(regexp_extract_all(lower(content), '{WORD}{{2,}}'),
                           lambda w: w not in ({_quoted(STOP_WORDS)})) as words
        from posts""",
    "grams": """
        select post_id, words,
               list_concat(words, list_transform(range(1, len(words)),
                           lambda i: words[i] || ' ' || words[i + 1])) as terms
        from docs""",
    "doc_terms": """
        select post_id, term, count(*) as tf
        from (select post_id, unnest(terms) as term from grams) group by post_id, term""",
    "pruned": f"""
        select term, cast(sum(tf) as bigint) as ctf, count(*) as df
        from doc_terms group by term
        having count(*) >= {MIN_DF} and count(*) <= {MAX_DF} * (select count(*) from posts)""",
    "vocab": f"select * from pruned order by ctf desc, term limit {MAX_FEATURES}",
    "weights": """
        select term, ln((1.0 + (select count(*) from posts)) / (df + 1)) + 1 as idf from vocab""",
    "ordered": """
        select *, row_number() over (order by ts, post_id) - 1 as idx, count(*) over () as n from scored""",
    "sampled": f"""
        select *, idx // step as new_idx, (n + step - 1) // step as new_n
        from (select *, case when n > {MAX_POINTS} then n // {MAX_POINTS} else 1 end as step from ordered)
        where idx % step = 0""",
}

# Which other common tables each one reads.
NEEDS = {
    "damaged": ["tagged"],
    "now": ["posts"],
    "tagged": ["posts"],
    "hits": ["tagged"],
    "scores": ["hits"],
    "features": ["scores"],
    "scored": ["features"],
    "unique_posts": ["tagged"],
    "topics": ["tagged"],
    "matched": ["topics"],
    "raw_counters": ["tagged"],
    "docs": ["posts"],
    "grams": ["docs"],
    "doc_terms": ["grams"],
    "pruned": ["doc_terms"],
    "vocab": ["pruned"],
    "weights": ["vocab"],
    "ordered": ["scored"],
    "sampled": ["ordered"],
}


def _with(names: str, select: str) -> str:
    """The select with the common tables it names and all they need."""
    used: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in used:
            used.append(name)

    for name in names.split():
        add(name)
    tables = ", ".join(f"{n} as ({CTES[n]})" for n in used)
    return f"with {tables} {select}"


def _r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) as {name or expression}"


def _aggregates(null_as_zero: bool = False) -> str:
    zero = (lambda e: f"coalesce({e}, 0.0)") if null_as_zero else (lambda e: e)
    margin = f"{Z95!r} * stddev_pop(composite_signal) / sqrt(count(composite_signal))"
    return ", ".join(
        [
            _r(zero("avg(composite_signal)"), "mean_signal"),
            _r(zero("stddev_pop(composite_signal)"), "std_signal"),
            _r(f"coalesce(avg(composite_signal) - {margin}, 0.0)", "confidence_interval_lower"),
            _r(f"coalesce(avg(composite_signal) + {margin}, 0.0)", "confidence_interval_upper"),
            _r(zero("avg(sentiment_score)"), "mean_sentiment"),
            _r(zero("avg(engagement_score)"), "mean_engagement"),
            "count(*) as total_posts",
            *[
                f"count(*) filter (sentiment_label = '{v}') as {v}_posts"
                for v in ("positive", "negative", "neutral")
            ],
        ]
    )


# Posts as search pages show them.
_PAGED = """, paged as (select * replace (date_trunc('second', ts) as ts,
                      case when post_id % 23 = 0 then 0 else likes end as likes,
                      case when post_id % 23 = 0 then 0 else retweets end as retweets,
                      case when post_id % 23 = 0 then 0 else replies end as replies) from posts)"""
# The wave a post comes in, and the watermark that it meets: the newest time of all waves before.
_WAVES = f"""wave as (
      select *, least({WAVES - 1}, date_diff('hour', (select cast(min(cast(ts as date)) as timestamp) from paged), ts) // {WAVE_HOURS}
                      + case when post_id % 13 = 0 then {LATE_WAVES} else 0 end) as wave from scored
    ), waves as (
      select w.*, m.mark, coalesce(date_trunc('hour', ts) + interval 1 hour <= m.mark, false) as late
      from wave w join (select a.wave, max(b.ts) - interval 1 hour as mark
                        from (select distinct wave from wave) a left join wave b on b.wave < a.wave group by a.wave) m
        on m.wave = w.wave
    )"""
HOURS = "(select as_of from now) - interval {} hour"
LINK_ID = "concat('https://twitter.com/i/web/status/', {})"
LINK_USER = "'https://twitter.com/' || username || '/status/' || {}"
FEATURE_NAMES = (
    "text_length, word_count, hashtag_count, has_market_hashtag, mention_count, "
    "number_count, has_large_number, question_count, exclamation_count"
)
PAGE_COLUMNS = f"""
    cast(post_id as varchar) as tweet_id,
    case when username like '%0' then 'unknown' else username end as username,
    date_trunc('second', ts) as ts,
    case when post_id % 23 = 0 then 0 else likes end as likes,
    case when post_id % 23 = 0 then 0 else retweets end as retweets,
    case when post_id % 23 = 0 then 0 else replies end as replies,
    array_to_string(mentions, '|') as mentions, array_to_string(hashtags, '|') as hashtags,
    {LINK_ID.format("cast(post_id as varchar)")} as url"""


def statements() -> dict[str, str]:
    recent = lambda hours: f"ts >= {HOURS.format(hours)}"
    older = lambda hours: f"ts < {HOURS.format(hours)}"
    return {
        "flatten_pages": _with("tagged", f"select {PAGE_COLUMNS}, raw_hash as content_hash from tagged"),
        "author_lookup": _with(
            "posts",
            """select post_id, substr(username, 6) as author_id,
                      case when username like '%0' then 'unknown' else username end as username from posts""",
        ),
        "normalize_alt": _with(
            "tagged",
            f"""select {LINK_USER.format("cast(post_id as varchar)")} as url, username,
                       date_trunc('second', ts) as ts,
                       case when post_id % 15 = 0 then 0 else likes end as likes, retweets, replies,
                       array_to_string(mentions, '|') as mentions, array_to_string(hashtags, '|') as hashtags,
                       raw_hash as content_hash from tagged""",
        ),
        "parquet_roundtrip": _with(
            "tagged",
            """select post_id, ts, likes, tweet_id, array_to_string(mentions, '|') as mentions,
                      array_to_string(hashtags, '|') as hashtags, len(mentions) as n_mentions from tagged""",
        ),
        "list_codec": _with(
            "tagged",
            """select post_id, array_to_string(mentions, ',') as encoded,
                      case when len(mentions) = 0 then 0
                           else len(string_split(array_to_string(mentions, ','), ',')) end as n_items
               from tagged""",
        ),
        "insert_if_absent": _with(
            "tagged now",
            f"""select post_id, content_hash from tagged
                where content_hash not in (select content_hash from tagged where {older(24)})
                qualify row_number() over (partition by content_hash order by post_id) = 1""",
        ),
        "upsert_signals": _with(
            "scored now",
            f"""select post_id, sentiment_label, {_r("engagement_score")},
                       round(case when {recent(48)} then composite_signal + 1 else composite_signal end, 6)
                         as composite_signal,
                       case when {older(24)} then ts else (select as_of from now) end as processed_at
                from scored""",
        ),
        "unique_id_guard": _with(
            "posts now",
            f"""select post_id, tweet_id from posts p where {recent(24)}
                and not exists (select 1 from posts o where o.tweet_id = p.tweet_id and o.{older(24)})
                qualify tweet_id is null or row_number() over (partition by tweet_id order by post_id) = 1""",
        ),
        "cascade_signals": _with(
            "scored unique_posts",
            f"""select post_id, {_r("composite_signal")} from scored
                where post_id in (select post_id from unique_posts)""",
        ),
        "run_ledger": _with(
            "raw_counters",
            """, judged as (select *, case when counted_likes is null then 'bad likes' end as reason,
                      row_number() over (partition by content_hash, counted_likes is null order by post_id) as nth
                 from raw_counters)
               select cast(cast(ts as date) as varchar) as run_id, min(ts) as started_at, max(ts) as completed_at,
                      case when count(*) filter (reason is null and nth = 1) > 0 then 'completed'
                           else 'failed' end as status,
                      count(*) as seen, count(*) filter (reason is null and nth = 1) as inserted,
                      coalesce(string_agg(distinct reason, '|'), '') as errors
               from judged group by run_id order by started_at desc""",
        ),
        "clean_text": _with(
            "posts",
            f"""select post_id, {_clean("concat('  ', content, chr(9), chr(10), ' ', chr(1), ' end ')")} as content
                from posts""",
        ),
        "clean_lists": _with(
            "tagged",
            """select post_id, 'a b|BUY' || coalesce('|' || nullif(array_to_string(hashtags, '|'), ''), '') as hashtags,
                      2 + len(hashtags) as n_tags from tagged""",
        ),
        "content_hash": _with("tagged", "select post_id, raw_hash, content_hash as clean_hash from tagged"),
        "extract_hashtags": _with(
            "tagged",
            "select post_id, generate_subscripts(hashtags, 1) - 1 as pos, unnest(hashtags) as word from tagged",
        ),
        "extract_mentions": _with(
            "tagged",
            "select post_id, generate_subscripts(mentions, 1) - 1 as pos, unnest(mentions) as word from tagged",
        ),
        "normalize_ts": _with(
            "posts now",
            """select post_id, case when n_chars % 6 in (0, 1, 3) then date_trunc('second', ts)
                                    when n_chars % 6 = 2 then ts else (select as_of from now) end as ts
               from posts""",
        ),
        "coerce_counts": _with(
            "raw_counters", "select post_id, counted_likes as likes, retweets, replies from raw_counters"
        ),
        "permalink": _with(
            "posts",
            f"""select post_id, {LINK_ID.format("coalesce(tweet_id, 'None')")} as link_by_id,
                       {LINK_USER.format("tweet_id")} as link_by_user from posts""",
        ),
        "lexicon_hits": _with("hits", "select post_id, bullish_hits, bearish_hits from hits"),
        "sentiment": _with("features", f"select post_id, {_r('sentiment_score')}, sentiment_label from features"),
        "engagement": _with("scores", f"select post_id, {_r('engagement_score')} from scores"),
        "custom_features": _with("features", f"select post_id, {FEATURE_NAMES} from features"),
        "composite_signal": _with("scored", f"select post_id, {_r('composite_signal')} from scored"),
        "analyze_posts": _with(
            "scored",
            f"""select post_id, {_r("sentiment_score")}, sentiment_label, {_r("engagement_score")},
                       {FEATURE_NAMES}, {_r("composite_signal")} from scored""",
        ),
        "content_preview": _with(
            "posts",
            """select post_id, case when length(content) > 100 then substr(content, 1, 100) || '...'
                                    else content end as preview from posts""",
        ),
        "plot_frame": _with(
            "scored",
            f"""select post_id, ts, {_r("composite_signal")},
                       round(case when sentiment_score = 1 then 0.0 else sentiment_score end, 6) as sentiment_score,
                       case when sentiment_label = 'positive' then 'neutral' else sentiment_label end
                         as sentiment_label,
                       {_r("engagement_score")} from scored""",
        ),
        "tokens": _with(
            "docs",
            "select post_id, len(words) as n_words, md5(array_to_string(words, '|')) as digest from docs",
        ),
        "ngrams": _with(
            "grams",
            "select post_id, len(terms) as n_words, md5(array_to_string(terms, '|')) as digest from grams",
        ),
        "doc_freq": _with("pruned", "select term, df, ctf from pruned"),
        "vocabulary": _with("vocab", "select term, df, ctf from vocab"),
        "idf": _with("weights", f"select term, {_r('idf')} from weights"),
        "tfidf": _with(
            "weights",
            """, parts as (select post_id, term, tf * idf as w from doc_terms join weights using (term)),
                 norms as (select post_id, sqrt(sum(w * w)) as norm from parts group by post_id)
               select post_id, term, round(w / norm, 6) as weight from parts join norms using (post_id)""",
        ),
        "svd_randomised": "select range as component, cast(0 as double) as off from range(50)",
        "gram_cells": _with(
            "weights",
            """, parts as (select post_id, term, tf * idf as w from doc_terms join weights using (term)),
                 norms as (select post_id, sqrt(sum(w * w)) as norm from parts group by post_id),
                 unit as (select post_id, term, w / norm as w from parts join norms using (post_id))
               select a.term, b.term as other, round(sum(a.w * b.w), 6) as w
               from unit a join unit b on a.post_id = b.post_id and a.term <= b.term group by 1, 2""",
        ),
        "stream_signal_vectors": _with(
            "tagged",
            """select distinct content_hash, cast(50 as bigint) as n_values, cast(0 as double) as off from tagged""",
        ),
        "nonempty": _with(
            "posts", f"select post_id, length({_clean('content')}) as n_chars from posts where n_chars % 9 <> 0"
        ),
        "recent_posts": _with("posts now", f"select post_id, ts from posts where {recent(36)}"),
        "lookback_all": _with("posts", "select post_id, ts from posts"),
        "lookback_24h": _with("posts now", f"select post_id, ts from posts where {recent(24)}"),
        "rejects": _with(
            "raw_counters",
            """select post_id, case when counted_likes is null then 'bad likes'
                                    when n_chars % 31 = 0 then 'no list'
                                    when n_chars % 29 = 0 and length(username) * 60 > 255
                                    then 'username too long' end as reason
               from raw_counters where reason is not null""",
        ),
        "posts_with_signal": _with("posts now", f"select post_id, ts from posts where {recent(48)}"),
        "search_posts": _with(
            "posts",
            """select post_id, username from posts
               where (contains(lower(username), 'rally') or contains(lower(content), 'rally'))
                 and (contains(lower(username), 'user_1') or contains(lower(content), 'user_1'))""",
        ),
        "search_signals": _with(
            "scored",
            f"""select post_id, sentiment_label, {_r("composite_signal")} from scored
                where (contains(lower(username), 'bullish but') or contains(lower(content), 'bullish but'))
                  and (contains(lower(username), 'resistance') or contains(lower(content), 'resistance'))""",
        ),
        "facet_dates": _with(
            "posts now",
            """, b as (select date_trunc('day', as_of) as d, date_trunc('month', as_of) as m,
                              date_trunc('year', as_of) as y from now)
               select 'today' as facet, count(*) as n from posts, b where ts >= d and ts < d + interval 1 day
               union all select 'past_7_days', count(*) from posts, b
                 where ts >= d - interval 7 day and ts < d + interval 1 day
               union all select 'this_month', count(*) from posts, b where ts >= m and ts < m + interval 1 month
               union all select 'this_year', count(*) from posts, b where ts >= y and ts < y + interval 1 year""",
        ),
        "facet_labels": _with(
            "scored", "select sentiment_label, count(*) as n from scored group by sentiment_label"
        ),
        "posts_signals": _with(
            "scored", f"select post_id, username, ts, sentiment_label, {_r('composite_signal')} from scored"
        ),
        "dedupe_posts": _with(
            "unique_posts",
            """select post_id, username, likes, array_to_string(hashtags, '|') as hashtags, content_hash
               from unique_posts""",
        ),
        "dedupe_raw": _with(
            "tagged",
            """select post_id, raw_hash as content_hash from tagged
               qualify row_number() over (partition by raw_hash order by post_id) = 1""",
        ),
        "dedupe_topic": _with(
            "matched",
            """select topic, post_id from matched
               qualify row_number() over (partition by topic, content order by post_id) = 1""",
        ),
        "union_topics": _with(
            "matched",
            """select post_id, topic, raw_hash as content_hash from matched
               qualify row_number() over (partition by raw_hash order by post_id, topic) = 1""",
        ),
        "topic_cap": _with(
            "matched",
            f"""select topic, post_id, ts from matched
                qualify row_number() over (partition by topic order by ts desc, post_id) <= {TOPIC_CAP}""",
        ),
        "topic_select": _with(
            "matched now",
            f""", best as (select topic, min(tier) as tier from matched group by topic)
                select m.topic, post_id, ts from matched m join best b on b.topic = m.topic and m.tier <= b.tier
                where {recent(48)}
                qualify row_number() over (partition by m.topic order by ts desc, post_id) <= {TOPIC_CAP}""",
        ),
        "aggregate_signals": _with("scored", f"select {_aggregates()} from scored"),
        "aggregate_signals_by": _with("scored", f"select lang, {_aggregates()} from scored group by lang"),
        "hourly_signals": _with(
            "scored", f"select date_trunc('hour', ts) as hour, {_aggregates()} from scored group by 1"
        ),
        "stored_signal_summary": _with(
            "scored",
            f"""select {_aggregates(True)} from (select * replace (
                   case when sentiment_label <> 'neutral' then composite_signal end as composite_signal)
                 from scored)""",
        ),
        "confidence_interval": f"""
            select l_returnflag, l_linestatus, count(l_extendedprice) as n,
                   round(avg(l_extendedprice) - m, 4) as lower_bound, round(avg(l_extendedprice) + m, 4) as upper_bound
            from (select *, {Z95!r} * stddev_pop(l_extendedprice) over w / sqrt(count(l_extendedprice) over w) as m
                  from lineitem window w as (partition by l_returnflag, l_linestatus))
            group by l_returnflag, l_linestatus, m""",
        "sentiment_distribution": _with(
            "scored", "select sentiment_label, count(*) as n from scored group by sentiment_label"
        ),
        "sentiment_share": _with(
            "scored",
            """select sentiment_label, count(*) as n,
                      round(100.0::double * count(*) / (select count(*) from scored), 1) as percent
               from scored group by sentiment_label""",
        ),
        "corpus_stats": _with(
            "scored now",
            f"""select count(*) as total_posts, count(*) filter ({recent(48)}) as total_signals,
                       count(*) filter ({recent(24)}) as recent_posts_24h, max(likes) as max_likes,
                       {_r("avg(likes)", "avg_likes")}, {_r("avg(retweets)", "avg_retweets")},
                       {_r(f"avg(composite_signal) filter ({recent(48)})", "avg_signal")},
                       {_r(f"avg(sentiment_score) filter ({recent(48)})", "avg_sentiment")},
                       {_r(f"avg(engagement_score) filter ({recent(48)})", "avg_engagement")} from scored""",
        ),
        "top_hashtags": _with(
            "tagged",
            """select hashtag, count(*) as n from (select ts, unnest(hashtags) as hashtag from tagged)
               group by hashtag order by n desc, max(ts) desc, hashtag limit 10""",
        ),
        "volume_check": _with(
            "posts",
            """select count(*) as collected, cast(2000 as bigint) as minimum, count(*) < 2000 as below_minimum
               from posts""",
        ),
        "report_document": _with(
            "scored now",
            f"""select count(*) as total_posts, count(*) filter ({recent(48)}) as total_signals,
                       count(*) filter ({recent(24)}) as recent_posts_24h, max(likes) as max_likes,
                       {_r("avg(likes)", "avg_likes")},
                       {_r(f"avg(composite_signal) filter ({recent(48)})", "avg_signal")},
                       cast(sum(len(list_filter(hashtags, lambda h: h = 'nifty50'))) as bigint) as nifty50,
                       cast(sum(len(list_filter(hashtags, lambda h: h = 'gold'))) as bigint) as gold from scored""",
        ),
        "newest_n": _with(
            "posts", f"select post_id, username, ts from posts order by ts desc, post_id limit {NEWEST}"
        ),
        "list_page": _with(
            "posts", "select post_id, username, ts from posts order by ts desc, post_id limit 20 offset 40"
        ),
        "systematic_sample": _with("sampled", "select new_idx as idx, ts, post_id from sampled"),
        "random_sample": _with(
            "posts",
            f"""select post_id, ts from posts
                order by md5(cast(post_id as varchar) || ':42'), post_id limit {SAMPLE}""",
        ),
        "rolling_mean": _with(
            "ordered",
            """, w as (select *, case when n > 100 then least(100, n // 10) end as width from ordered)
               select idx, post_id,
                      round(case when idx >= width - 1 then (select avg(o.composite_signal) from ordered o
                              where o.idx between w.idx - w.width + 1 and w.idx) end, 6) as rolling_mean
               from w""",
        ),
        "rolling_mean_by": _with(
            "scored",
            """select lang, post_id, round(case when count(*) over w = 10
                                                then avg(composite_signal) over w end, 6) as rolling_mean
               from scored window w as (partition by lang order by ts, post_id rows between 9 preceding and current row)""",
        ),
        "signal_over_time": _with(
            "sampled",
            """, w as (select *, case when new_n > 100 then least(100, new_n // 10) end as width from sampled)
               select ts, post_id, round(composite_signal, 6) as composite_signal,
                      round(case when new_idx >= width - 1 then (select avg(o.composite_signal) from sampled o
                              where o.new_idx between w.new_idx - w.width + 1 and w.new_idx) end, 6) as rolling_mean
               from w""",
        ),
        "engagement_vs_sentiment": _with(
            "sampled", f"select post_id, {_r('sentiment_score')}, {_r('engagement_score')} from sampled"
        ),
        "signal_summary_long": _with(
            "scored",
            f""", s as (select avg(composite_signal) as m,
                        {Z95!r} * stddev_pop(composite_signal) / sqrt(count(*)) as e,
                        avg(sentiment_score) as ms, avg(engagement_score) as me, count(*) as n,
                        count(*) filter (sentiment_label = 'positive') as p,
                        count(*) filter (sentiment_label = 'negative') as g,
                        count(*) filter (sentiment_label = 'neutral') as u from scored)
               select panel, metric, round(cast(value as double), 6) as value from (
                 select 'interval' as panel, 'mean_signal' as metric, m as value from s
                 union all select 'interval', 'error_low', e from s
                 union all select 'interval', 'error_high', e from s
                 union all select 'labels', 'positive', p from s
                 union all select 'labels', 'negative', g from s
                 union all select 'labels', 'neutral', u from s
                 union all select 'means', 'mean_signal', m from s
                 union all select 'means', 'mean_sentiment', ms from s
                 union all select 'means', 'mean_engagement', me from s
                 union all select 'size', 'total_posts', n from s)""",
        ),
        "stream_ingest": _with(
            "tagged",
            """select cast(post_id as varchar) as tweet_id,
                      case when username like '%0' then 'unknown' else username end as username,
                      date_trunc('second', ts) as ts,
                      case when post_id % 23 = 0 then 0 else likes end as likes, content_hash from tagged""",
        ),
        "stream_dedupe": _with(
            "tagged",
            f"""select content_hash, max(length({_clean("content")})) as n_chars from tagged group by content_hash""",
        ),
        "stream_signals": _with(
            "scored",
            f"""select content_hash, max({"round(sentiment_score, 6)"}) as sentiment_score,
                       max(sentiment_label) as sentiment_label from scored group by content_hash""",
        ),
        "store_insert_twice": _with(
            "tagged now",
            f"""select post_id, content_hash from tagged
                qualify row_number() over (partition by content_hash order by not ({older(24)}), post_id) = 1""",
        ),
        "store_upsert": _with(
            "scored now",
            f"""select post_id, case when {recent(48)} then ts + interval 2 day else ts end as ts,
                       round(composite_signal + case when {recent(48)} then 1 else 5 end, 6) as composite_signal,
                       case when {older(24)} then ts else (select as_of from now) end as processed_at
                from scored""",
        ),
        "store_cascade": _with(
            "scored now",
            f"""select post_id, cast(ts as date) as day, {_r("composite_signal")} from scored
                where post_id % 4 = 0 or cast(ts as date) <> (select cast(as_of as date) from now)""",
        ),
        "collection_run": _with(
            "raw_counters",
            """, good as (select * from raw_counters where counted_likes is not null
                          qualify row_number() over (partition by content_hash order by post_id) = 1),
               kept as (select * from good
                        qualify tweet_id is null or row_number() over (partition by tweet_id order by post_id) = 1),
               bad as (select count(*) as n from raw_counters where counted_likes is null)
               select 'run' as run_id, timestamp '2024-02-01' as started_at, 'completed' as status,
                      (select count(*) from good) as seen, (select count(*) from kept) as inserted,
                      concat_ws('|', case when (select n from bad) > 0 then 'bad likes: ' || (select n from bad) end,
                                case when (select count(*) from good) < 2000
                                     then 'volume ' || (select count(*) from good) || ' below 2000' end) as errors""",
        ),
        "analysis_document": _with(
            "scored",
            f""", s as (select {_aggregates()} from scored)
                select 'success' as status, total_posts, mean_signal, confidence_interval_upper, positive_posts,
                       negative_posts, neutral_posts from s""",
        ),
        "stream_into_store": _with(
            "tagged now",
            f"""select content_hash, bool_or({older(24)}) as from_run from tagged group by content_hash""",
        ),
        "stream_signals_into_store": _with(
            "scored now",
            f"""select content_hash, max(sentiment_label) as sentiment_label, bool_or({older(24)}) as from_run
                from scored group by content_hash""",
        ),
        "stream_reanalysis": _with(
            "scored",
            f"""select content_hash, max({"round(sentiment_score, 6)"}) as sentiment_score,
                       max(sentiment_label) as sentiment_label from scored group by content_hash""",
        ),
        "stream_reanalysis_window": _with(
            "scored now",
            f""", stored as (select * from scored where {older(24)}
                           qualify row_number() over (partition by content_hash order by post_id) = 1),
                 fresh as (select content_hash, max(sentiment_score) as sentiment_score, max(sentiment_label) as sentiment_label
                           from scored where content_hash not in (select content_hash from stored) group by content_hash)
               select content_hash, sentiment_label,
                      round(case when ts >= timestamp '2024-02-01' - interval 30 day then sentiment_score else -9 end, 6)
                        as sentiment_score
               from stored union all select content_hash, sentiment_label, round(sentiment_score, 6) from fresh""",
        ),
        "stream_signal_scores": _with(
            "posts",
            f"""{_PAGED}, {_stack("tagged hits scores features scored", "paged")}
                select cast(post_id as varchar) as tweet_id, {_r("sentiment_score")}, sentiment_label,
                       {_r("engagement_score")}, {_r("composite_signal")}, length({_clean("content")}) as text_length,
                       word_count, hashtag_count, mention_count, number_count, has_market_hashtag
                from scored qualify row_number() over (
                  partition by content_hash order by ts, cast(post_id as varchar)) = 1""",
        ),
        "chart_frames": _with(
            "sampled",
            f""", w as (select *, case when new_n > 100 then least(100, new_n // 10) end as width from sampled),
                 s as (select avg(composite_signal) as m, {Z95!r} * stddev_pop(composite_signal) / sqrt(count(*)) as e,
                              avg(sentiment_score) as ms, avg(engagement_score) as me, count(*) as n from scored)
               select chart, point, round(cast(value as double), 6) as value from (
                 select 'signal' as chart, cast(post_id as varchar) as point, composite_signal as value from w
                 union all select 'mean', cast(post_id as varchar),
                   case when new_idx >= width - 1 then (select avg(o.composite_signal) from sampled o
                     where o.new_idx between w.new_idx - w.width + 1 and w.new_idx) end from w
                 union all select 'labels', sentiment_label, count(*) from scored group by sentiment_label
                 union all select 'engagement', cast(post_id as varchar), engagement_score from w
                 union all select 'summary', 'mean_signal', m from s union all select 'summary', 'error_low', e from s
                 union all select 'summary', 'error_high', e from s union all select 'summary', 'mean_signal', m from s
                 union all select 'summary', 'mean_sentiment', ms from s
                 union all select 'summary', 'mean_engagement', me from s
                 union all select 'summary', 'total_posts', n from s)""",
        ),
        "svd_check": """select range as component, cast(0 as double) as residual, cast(0 as double) as overlap
                        from range(50)""",
        "analysis_run": _with(
            "scored",
            f""", firsts as (select * from scored
                          qualify row_number() over (partition by content_hash order by post_id) = 1)
                select {_aggregates()} from firsts""",
        ),
        "stream_ledger": _with(
            "tagged",
            """select 'completed' as status, count(distinct content_hash) as inserted,
                      cast(0 as bigint) as short_runs from tagged""",
        ),
        "stream_rejects": _with(
            "tagged damaged",
            """, pages as (select distinct post_id // 100 as page from damaged)
               select reason, count(*) as n from damaged where reason is not null group by reason
               union all select 'unreadable page', count(*) from pages where page % 3 = 1 having count(*) > 0
               union all select 'stored', count(distinct content_hash) from damaged where reason is null""",
        ),
        "stream_id_guard": _with(
            "tagged now",
            f"""select tweet_id, case when tweet_id is null then content_hash end as text_hash,
                       bool_or({older(24)}) as from_run from tagged group by 1, 2""",
        ),
        "stream_signals_ledger": _with(
            "tagged damaged",
            """, pages as (select distinct post_id // 100 as page from damaged)
               select reason as what, count(*) as n from damaged where reason is not null group by reason
               union all select 'unreadable page', count(*) from pages where page % 3 = 1 having count(*) > 0
               union all select 'completed', count(distinct content_hash) from damaged where reason is null""",
        ),
        "stream_dedupe_within": _with(
            "tagged",
            f"""select content_hash, max(length({_clean("content")})) as n_chars from tagged group by content_hash""",
        ),
        "stream_windows": _with(
            "posts",
            f"""{_PAGED}, {_stack("tagged hits scores features scored", "paged")}, {_WAVES}
                select date_trunc('hour', ts) as window_start, {_aggregates()} from waves
                where not late and date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from waves)
                group by 1""",
        ),
        "stream_late": _with(
            "posts",
            f"""{_PAGED}, {_stack("tagged hits scores features scored", "paged")}, {_WAVES}
                select content_hash, ts, date_trunc('hour', ts) + interval 1 hour as window_end, mark as watermark,
                       {_r("composite_signal")} from waves where late""",
        ),
        "stored_summary_kept": _with(
            "scored",
            f""", last as (select * replace (composite_signal * case when post_id % 3 = 1 then 1 else 2 end
                                             as composite_signal) from scored)
                select {_aggregates()} from last""",
        ),
        "stream_hourly": _with(
            "posts",
            f"""{_PAGED}, {_stack("tagged hits scores features scored", "paged")}
                select date_trunc('hour', ts) as hour, {_aggregates()} from scored group by 1""",
        ),
    }


def _stack(names: str, source: str) -> str:
    """A chain of common tables whose first one reads `source` in place of posts."""
    tables = []
    for name in names.split():
        body = CTES[name].replace("from posts", f"from {source}")
        tables.append(f"{name} as ({body})")
    return ", ".join(tables)
