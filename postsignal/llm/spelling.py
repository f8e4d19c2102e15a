"""Spelling variants: words one code point apart, by a variable-length gram index.

The dictionary holds the frequent grams of a vocabulary: grams of two code points,
and longer ones where the gram one shorter is too common to tell words apart. A word
is cut into the longest dictionary grams that start at its positions, without those
inside an earlier one. For every word the most grams are counted that any one edit
can change; near words share all the others, so of a word's lists of the index only
the rarest need merging.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import map_batches, stored

#: Code points of the shortest and the longest gram.
SHORT, LONG = 2, 3
#: A gram is extended where more than this share of all words has it.
COMMON = 0.001
#: Most grams of the dictionary, the most frequent first; fewer make longer lists and change no result.
MOST_GRAMS = 50_000
#: Lists with more words are split.
LONG_LIST = 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Dictionary(NamedTuple):
    """Gram frequencies, the grams longer than `SHORT`, and what these start and end with."""

    counts: dict[str, int]
    grams: set[str]
    heads: set[str]
    tails: set[str]


def dictionary(counts: dict[str, int]) -> Dictionary:
    grams = {g for g in counts if len(g) > SHORT}
    heads = {g[:k] for g in grams for k in range(SHORT, len(g))}
    return Dictionary(counts, grams, heads, {g[-k:] for g in grams for k in range(SHORT, len(g))})


def decompose(word: str, known: Dictionary) -> list[tuple[int, int]]:
    """(start, end) of the word's grams, both ascending."""
    parts, reach, size = [], 0, len(word)
    for start in range(size - SHORT + 1):
        end = start + SHORT
        for longer in range(min(LONG, size - start), SHORT, -1):
            if word[start : start + longer] in known.grams:
                end = start + longer
                break
        if end > reach:
            parts.append((start, end))
            reach = end
    return parts


def most_changed(word: str, parts: list[tuple[int, int]], known: Dictionary) -> int:
    """The most grams that one inserted, deleted or replaced code point can change.

    These are the grams over the edit; those before it from the first place on
    whose rest could become a longer gram; and those behind it up to the last
    place that could become the end of a longer gram.
    """
    starts, ends, size, most = [p[0] for p in parts], [p[1] for p in parts], len(word), 0
    for at in range(size + 1):
        first = bisect_right(ends, at)
        for left in range(max(0, at - LONG + 1), at - SHORT + 1):
            if word[left:at] in known.heads:
                first = min(first, bisect_left(starts, left))
                break
        for after in (at, at + 1)[: 1 + (at < size)]:  # an insertion here, or a change of this code point
            last = bisect_left(starts, after)
            for right in range(min(LONG - 1, size - after), SHORT - 1, -1):
                if word[after : after + right] in known.tails:
                    last = max(last, bisect_right(ends, after + right))
                    break
            most = max(most, last - first)
    return most


def signature(word: str, known: Dictionary) -> list[int]:
    """Pairs of the word's rarest grams, as (start, end, start, end) one after the other.

    If near words share two grams or more, they share two of the rarest two more
    than an edit can change. A word of which an edit can leave fewer than two
    gives all its pairs and, as a pair without grams, all zeros.
    """
    parts = decompose(word, known)
    changed = most_changed(word, parts, known)
    rarest = sorted(parts, key=lambda p: (known.counts.get(word[p[0] : p[1]], 0), word[p[0] : p[1]], p[0]))
    loose = len(parts) - changed < 2
    chosen = sorted(rarest if loose else rarest[: changed + 2])
    found = [n for a, b in combinations(chosen, 2) for n in (*a, *b)]
    return found + [0, 0, 0, 0] if loose else found


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
    change=lambda id, word: word,
) -> DataFrame:
    """(word, n): maximal runs of Latin letters of whole texts, A-Z lower-cased, and how often they occur.

    `change(id, word)` may give an occurrence another spelling; the id is its text,
    empty if null. Words are then kept from `least_length` code points and `least_count`
    occurrences on. Null and empty texts have no words; other columns are ignored.
    """
    letters = "[A-Za-z\\u00C0-\\u00FF]{%d,}" % least_length
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    runs = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode_outer(F.regexp_extract_all(text, F.lit(letters), F.lit(0))).alias("run"),
    ).filter(F.col("run").isNotNull())
    lowered = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = lowered.select(change(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> Dictionary:
    """The frequency-pruned dictionary of stored words: at most `MOST_GRAMS` grams reach the driver."""
    of = lambda q: f"if(length(word) >= {q}, transform(sequence(1, length(word) - {q - 1}), i -> substring(word, i, {q})), array())"
    grams = ", ".join(of(q) for q in range(SHORT, LONG + 1))
    each = words.select(F.explode(F.expr(f"array_distinct(concat({grams}))")).alias("gram"))
    counted = stored(each.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    least = COMMON * words.count()
    kept = level = counted.filter(F.length("gram") == SHORT)
    for q in range(SHORT + 1, LONG + 1):
        common = level.filter(F.col("n") > least).select(F.col("gram").alias("head"))
        longer = counted.filter(F.length("gram") == q).withColumn("head", F.substring("gram", 1, q - 1))
        level = longer.join(common, "head", "left_semi").select("gram", "n")
        kept = kept.unionByName(level)
    most = kept.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS).collect()
    return dictionary({r.gram: r.n for r in most})


def _gram(at: int) -> Column:
    return F.substring(F.col("word"), F.col(f"s{at}") + 1, F.col(f"e{at}") - F.col(f"s{at}"))


def _place(first: int, second: int, longer: int) -> Column:
    """Key of the list of two grams, their places and the word's length, moved by these numbers."""
    return F.xxhash64(
        _gram(1), F.col("s1") + first, _gram(2), F.col("s2") + second, F.length("word") + longer
    )


def _without(at: Column) -> Column:
    return F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))


def near_words(words: DataFrame) -> DataFrame:
    """All pairs (a, b) of different words that are one inserted, deleted or replaced code point apart, once.

    `words` are stored and distinct, in a column of that name; null is no word.

    A list of the index holds the words of one length with two grams at their places.
    Words of equal length meet in a list as they are; a shorter word also looks
    into the lists of words one longer, as if the code point stood behind both
    grams, between them or before them. Every meeting is verified by edit distance.

    A list of more than `LONG_LIST` words is not compared in pairs: it is split by what
    is left of a word without one code point outside the two grams, so that only
    words one edit apart meet in a part. So no list, however common its grams,
    makes more meetings than its length times that bound, or than it has near words.
    """
    known = gram_dictionary(words)

    def rows(batch: pa.RecordBatch) -> dict:
        found = batch.column("word").to_pylist()
        return {"word": batch.column("word"), "spans": [signature(w, known) for w in found]}

    signed = stored(map_batches(words.filter("word is not null").select("word"), rows, "word string, spans array<int>"), "signatures")
    first = F.explode(F.expr("if(size(spans) = 0, array(), sequence(0, size(spans) - 4, 4))")).alias("i")
    spans = [F.get("spans", F.col("i") + k).alias(name) for k, name in enumerate(("s1", "e1", "s2", "e2"))]
    lists = signed.select("word", "spans", first).select("word", *spans)
    own = lists.withColumn("key", _place(0, 0, 0))
    # Kinds: the code point that the longer word has stands behind (0), between (1) or before (2) the grams.
    gap = F.col("s2") >= F.col("e1")
    grams = F.col("e2") > 0
    moved = F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("kind"), _place(0, 0, 1).alias("key")),
        F.struct(F.when(grams & gap, 1).alias("kind"), _place(0, 1, 1).alias("key")),
        F.struct(F.when(grams, 2).alias("kind"), _place(1, 1, 1).alias("key")),
    ), lambda m: m.kind.isNotNull())).alias("m")
    into = lists.select("word", "s1", "e1", "s2", "e2", moved).select("word", "s1", "e1", "s2", "e2", "m.kind", "m.key")
    long = stored(own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LONG_LIST).select("key"), "long-lists")

    short = own.select("key", "word").join(long, "key", "left_anti")
    found = _met(short, short).unionByName(_met(into.select("key", "word"), short))

    parted = own.join(long, "key", "left_semi")
    outside = F.expr("filter(sequence(0, length(word) - 1), i -> not (i >= s1 and i < e1) and not (i >= s2 and i < e2))")
    parts = parted.select("key", "word", F.explode(outside).alias("i"))
    parts = parts.select(F.xxhash64("key", "i", _without(F.col("i"))).alias("key"), "word")
    inserted = F.expr("""case kind when 0 then sequence(e2, length(word)) when 1 then sequence(e1, s2) else sequence(0, s1) end""")
    looked = into.join(long, "key", "left_semi").select("key", "word", F.explode(inserted).alias("i"))
    looked = looked.select(F.xxhash64("key", "i", "word").alias("key"), "word")
    found = found.unionByName(_met(parts, parts)).unionByName(_met(looked, parts))
    return found.distinct()


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verified pairs of words that meet at a key; of equal lengths in one order only."""
    a, b = left.select("key", F.col("word").alias("a")), right.select("key", F.col("word").alias("b"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return a.join(b, "key").filter(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Per word its number of near words, its form and its root; `words` as from `word_counts`.

    A word's form is its most frequent near word (ties: the smallest), if that is at least
    `times` as frequent as the word itself, else null. Its root is the end of the
    chain of forms, the word itself if it has none. Counts grow by `times` along a
    chain, so that chains end and are short. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = counted.groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near"))).alias("best")
    )
    joined = words.join(best, words.word == best.a, "left")
    large = F.col("best.less") * -1 >= F.col("n") * times
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"),
        ), "forms",
    )
    ways = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
