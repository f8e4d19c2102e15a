import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postsignal.functions import text
from postsignal.functions.lexicon import STOP_WORDS


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def apply(spark, values, function, kind="string"):
    rows = column(spark, values, kind).coalesce(1).select(function(F.col("c")).alias("r")).collect()
    return [r.r for r in rows]


def expected_clean(s):
    """Character by character: blanks end a piece, other control characters (category Cc) vanish."""
    pieces, blank = [[]], True
    for c in unicodedata.normalize("NFKC", s):
        if c.isspace():
            if not blank:
                pieces.append([])
            blank = True
        else:
            blank = False
            if unicodedata.category(c) != "Cc":
                pieces[-1].append(c)
    joined = " ".join("".join(p) for p in pieces)
    return joined[len(joined) - len(joined.lstrip(" ")) :].rstrip(" ")


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""), ("", ""), (" \t ", ""),
        ("a \x01 b", "a  b"), ("a  b", "a b"), ("x\x1cy", "x y"),
        ("ＢＵＹ①", "BUY1"), ("  é\n\nü ", "é ü"), ("é", "é"),
    ],
)
def test_clean_text_rows(spark, raw, clean):
    assert apply(spark, [raw], text.clean_text) == [clean]


def test_clean_text_on_every_code_point(spark):
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    raw = [f"a{c}b {c} d" for c in points]
    assert apply(spark, raw, text.clean_text) == [expected_clean(s) for s in raw]


def test_clean_list(spark):
    lists = [None, [], ["", None, " a\tb ", "ＢＵＹ"], ["é"], ["x", "y", "z"]]
    assert apply(spark, lists, text.clean_list, "array<string>") == [
        None, [], ["a b", "BUY"], ["é"], ["x", "y", "z"],
    ]


def test_clean_list_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(50).select("id", F.array_repeat(F.concat(F.lit(" t"), F.col("id").cast("string")), 2).alias("a"))
        rows = df.select("id", text.clean_list(F.col("a")).alias("a")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.a == [f"t{r.id}"] * 2 for r in rows)


def test_hashtags_and_marks(spark):
    tag = "#निफ्टी50 #Nifty50"
    assert apply(spark, [tag], text.hashtags) == [["न", "Nifty50"]]
    assert apply(spark, [tag], lambda c: text.hashtags(c, unicode_marks=True)) == [["निफ्टी50", "Nifty50"]]
    assert apply(spark, ["#a #b#a @c x@d.org", "none", None], text.hashtags) == [["a", "b", "a"], [], None]
    assert apply(spark, ["#a @c x@d.org"], text.mentions) == [["c", "d"]]


def test_words_and_numbers(spark):
    raw = ["1,200", "1001.", "१००१ x", "3.14.15", "no", "", " a  b\tc\x1cd e "]
    assert apply(spark, raw, text.word_count) == [1, 1, 2, 1, 1, 0, 5]
    assert apply(spark, raw, text.numbers) == [["1", "200"], ["1001."], ["१००१"], ["3.14", "15"], [], [], []]
    assert apply(spark, ["1001.", "१००१", "1,5", "7"], text.as_number) == [1001.0, 1001.0, None, 7.0]


def test_preview_and_occurrences(spark):
    assert apply(spark, ["x" * 100, "y" * 101], text.preview) == ["x" * 100, "y" * 100 + "..."]
    assert apply(spark, ["a??b?"], lambda c: text.occurrences(c, "?")) == [3]


def test_tokens_and_pairs(spark):
    raw = ["The Bull, a b_1 été 50", "one", ""]
    expected = [["the", "bull", "b_1", "été", "50"], ["one"], []]
    assert apply(spark, raw, text.tokens) == expected
    pairs = apply(spark, raw, lambda c: text.ngrams_1_2(text.tokens(c)))
    assert pairs == [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in expected]


def test_hash_is_of_utf8(spark):
    import hashlib

    assert apply(spark, ["é₹"], text.content_hash) == [hashlib.sha256("é₹".encode()).hexdigest()]


def test_stop_words_are_sparks_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert set(STOP_WORDS) == set(StopWordsRemover.loadDefaultStopWords("english"))


def test_a_batch_is_cleaned_in_runs_of_bounded_bytes(monkeypatch):
    texts = [None, "", " a  b ", "\ufb01n" * 50, "x" * 500, *[f" t\t{n} " for n in range(300)]]
    whole, seen, clean = text._clean_some(pa.array(texts)), [], text._clean_some
    monkeypatch.setattr(text, "CLEANED", 100)
    monkeypatch.setattr(text, "_clean_some", lambda some: seen.append(some.nbytes) or clean(some))
    assert text._clean_batch(pa.array(texts)).to_pylist() == whole.to_pylist()
    assert len(seen) > 10
    assert text._clean_batch(pa.array([], pa.string())).to_pylist() == []


def test_words_are_whole_runs_of_two_or_more(spark):
    """The run is taken in one step: no pattern that gives characters back."""
    column = text.tokens(F.col("t"))
    assert "{2,}+" in str(column)
    rows = spark.createDataFrame([("a ab a_b 1 12 किक été, x-yz",), ("",), (None,)], "t string")
    assert [r.w for r in rows.select(column.alias("w")).collect()] == [["ab", "a_b", "12", "été", "yz"], [], None]
