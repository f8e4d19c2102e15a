"""Spelling variants against all pairs, the bound on changed grams, long lists, chains, awkward rows."""

import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st

from postsignal.llm import spelling


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def near(words):
    letters, known = {c for w in words for c in w}, set(words)
    return {tuple(sorted((w, v), key=lambda x: (len(x), x))) for w in known for v in edits(w, letters) if v in known and v != w}


def table(spark, words):
    return spark.createDataFrame([(w, n) for w, n in dict(words).items()], "word string, n long")


def invented(rng, size):
    parts = ["tion", "ing", "the", "ció", "n", "es", "ou", "th", "e", "ß", "a"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        words.add(rng.choice(list(edits(w, "aeß"))))
    return words


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.integers(0, 12), st.sampled_from("abc"), st.sampled_from("dir"), st.sets(st.text("abc", min_size=3, max_size=3)))
def test_an_edit_changes_no_more_grams_than_counted(word, at, letter, kind, grams):
    known = spelling.dictionary(dict.fromkeys(grams, 1))
    at = min(at, len(word) - (kind != "i"))
    other = word[:at] + ("" if kind == "d" else letter) + word[at + (kind != "i") :]
    cut = {w: [w[s:e] for s, e in spelling.decompose(w, known)] for w in (word, other)}
    shared = sum((Counter(cut[word]) & Counter(cut[other])).values())
    for w in (word, other):
        parts = spelling.decompose(w, known)
        assert shared >= len(parts) - spelling.most_changed(w, parts, known)


def test_grams_by_hand():
    known = spelling.dictionary({"ing": 3, "in": 9})
    assert [("singing"[s:e]) for s, e in spelling.decompose("singing", known)] == ["si", "ing", "gi", "ing"]
    assert spelling.decompose("a", known) == []
    assert spelling.signature("", known) == [0, 0, 0, 0]


@pytest.mark.parametrize("long_list", [40, 1])
def test_near_words(spark, monkeypatch, long_list):
    monkeypatch.setattr(spelling, "LONG_LIST", long_list)
    words = invented(random.Random(long_list), 900) | {"a", "b", "ab", ""}
    got = [(r.a, r.b) for r in spelling.near_words(table(spark, {w: 2 for w in words})).collect()]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p, key=lambda x: (len(x), x))) for p in got} == near(words)


def test_a_list_with_most_words_is_split(spark):
    """All words hold the same grams; in pairs that would be 500,000 meetings."""
    rng = random.Random(3)
    words = {"sametop" + "".join(rng.choice("xyzuvw") for _ in range(4)) + "endings" for _ in range(1000)}
    got = {tuple(sorted((r.a, r.b))) for r in spelling.near_words(table(spark, {w: 2 for w in words})).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if sum(x != y for x, y in zip(*p)) == 1}


def test_forms_and_roots(spark):
    words = {"letters": 1000, "lettors": 100, "lettor": 9, "lottor": 2, "lettres": 40, "unrelated": 5, "litters": 1000}
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(table(spark, words)).collect()}
    assert got == {
        "letters": (None, "letters", 2, None), "litters": (None, "litters", 1, None),
        "lettors": ("letters", "letters", 2, 1000), "lettor": ("lettors", "letters", 2, 100),
        "lottor": (None, "lottor", 1, None), "lettres": (None, "lettres", 0, None), "unrelated": (None, "unrelated", 0, None),
    }
    tied = {r.word: r.form for r in spelling.variants(table(spark, {"xbcdefg": 50, "ybcdefg": 50, "bcdefg": 5})).collect()}
    assert tied["bcdefg"] == "xbcdefg"


def test_words_of_awkward_rows(spark, awkward):
    docs = awkward.select("doc_id", "text", "id")
    got = {r.word: r.n for r in spelling.word_counts(docs, least_length=5).collect()}
    assert got == {"three": 4, "seven": 4, "eight": 4, "eleven": 4, "twelve": 4, "thirteen": 4}
    assert {r.word: r.n for r in spelling.word_counts(docs, least_length=4, least_count=9).collect()} == {"word": 60_000}
    none = spelling.word_counts(docs.limit(0))
    assert spelling.variants(none).collect() == [] and spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_only_ascii_letters_are_lowered_and_ids_may_change_words(spark):
    docs = spark.createDataFrame([(1, "ÉCOLE École ÉCOLE3ab"), (None, "ÉCOLE")], "doc_id long, text string")
    count = lambda **more: {r.word: r.n for r in spelling.word_counts(docs, least_length=5, least_count=1, **more).collect()}
    assert count() == {"École": 4}
    from pyspark.sql import functions as F

    assert count(change=lambda id, word: F.concat(word, F.lit("#"), id)) == {"École#1": 3, "École#": 1}
