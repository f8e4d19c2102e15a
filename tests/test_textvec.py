import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.functions.lexicon import STOP_WORDS
from postsignal.operators import rangefinder, textvec
from postsignal.plans import fixtures

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.posts(spark, SF_DIR).select("post_id", "content")


def brute_force(texts, config):
    """Dense TF-IDF matrix and its terms, row by row in plain Python."""
    lists = []
    for t in texts:
        words = [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in STOP_WORDS]
        lists.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    total = Counter(w for terms in lists for w in terms)
    docs_with = Counter(w for terms in lists for w in set(terms))
    n = len(texts)
    kept = [t for t in total if config.min_df <= docs_with[t] <= config.max_df * n]
    terms = sorted(sorted(kept, key=lambda t: (-total[t], t))[: config.max_features])
    place = {t: i for i, t in enumerate(terms)}
    x = np.zeros((n, len(terms)))
    for row, words in enumerate(lists):
        for t, c in Counter(words).items():
            if t in place:
                x[row, place[t]] = c * (np.log((1 + n) / (1 + docs_with[t])) + 1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, x / np.where(norms == 0, 1, norms)


def test_vectors_and_components_match_numpy(spark, docs):
    config = textvec.VectorConfig(max_features=120, components=8)
    rows = docs.orderBy("post_id").collect()
    terms, x = brute_force([r.content for r in rows], config)
    model = textvec.fit(docs, config=config)
    assert model.terms == terms
    singular = np.linalg.svd(x, compute_uv=False)[:8]
    assert model.singular_values == pytest.approx(singular, rel=1e-9)
    got = np.array([r.tfidf for r in model.transform(docs).orderBy("post_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ model.loadings), atol=1e-9)
    assert np.allclose(np.linalg.norm(got, axis=0), singular, rtol=1e-9)
    strongest = np.abs(model.loadings).argmax(axis=0)
    assert (model.loadings[strongest, np.arange(8)] > 0).all()


def test_more_components_than_terms(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha gamma",), ("gamma delta",)], "content string")
    model = textvec.fit(df, config=textvec.VectorConfig(max_df=1.0))
    assert model.terms == ["alpha", "gamma"] and len(model.singular_values) == 2
    assert all(len(r.tfidf) == 2 for r in model.transform(df).collect())


def test_text_without_kept_terms_is_zero(spark):
    df = spark.createDataFrame([("alpha",), ("alpha gamma",), ("gamma",), ("zeta",)], "content string")
    model = textvec.fit(df)
    row = model.transform(df).filter("content = 'zeta'").first()
    assert row.tfidf == [0.0, 0.0]


def test_empty_vocabulary_gives_zero_vectors(spark):
    df = spark.createDataFrame([("alpha",), ("beta",)], "content string")
    model = textvec.fit(df)
    assert model.terms == []
    assert model.transform(df).first().tfidf == [0.0] * 50


def test_unfitted_gives_no_features(spark):
    df = spark.createDataFrame([("alpha",)], "content string")
    bare = textvec.TextVectors(textvec.VectorConfig(), 1, ["alpha"], [1.0])
    assert bare.transform(df).first().tfidf == []


def test_feature_map(spark):
    df = spark.createDataFrame([([0.5, 1.0],)], "c array<double>")
    named = df.select(textvec.feature_map(F.col("c"), 2).alias("m")).first().m
    assert named == {"tfidf_0": 0.5, "tfidf_1": 1.0}


def test_vocabulary_is_bounded():
    with pytest.raises(ValueError):
        textvec.VectorConfig(max_features=10_000)


@pytest.mark.parametrize("size, reach", [(5, 4), (60, 4), (300, 4), (1000, 4), (5000 // 2, 4), (60, 1)])
def test_chosen_terms_equal_counting_every_term(spark, docs, monkeypatch, size, reach):
    monkeypatch.setattr(textvec, "FREQUENT_WORDS", reach)
    config = textvec.VectorConfig(max_features=size)
    n = docs.count()
    chosen = textvec.choose_terms(textvec.stored_words(docs, "content", config), n, config)
    terms = docs.select(textvec.term_list(F.col("content")).alias("terms"))
    expected = textvec.top_terms(textvec.prune_terms(textvec.term_counts(terms), n, config), config).collect()
    assert [tuple(r) for r in chosen] == [tuple(r) for r in expected]


def test_randomised_solver_equals_the_gram_matrix(spark, docs):
    config = textvec.VectorConfig(max_features=400, components=20)
    model = textvec.fit_vocabulary(docs, config=config)
    vectors = model.weigh(docs).select("tfidf").cache()
    exact = textvec.fit_svd(model, vectors)
    values, loadings = exact.singular_values, exact.loadings
    found = textvec.fit_svd(replace(model, config=replace(config, solver="randomised")), vectors)
    assert found.singular_values == pytest.approx(values, rel=1e-8)
    apart = np.diff(values) < -1e-3  # components with a value of their own
    settled = np.flatnonzero(np.concatenate((apart, [False])) & np.concatenate(([True], apart)))
    assert len(settled) > 5 and np.allclose(found.loadings[:, settled], loadings[:, settled], atol=1e-5)
    assert np.allclose(found.loadings.T @ found.loadings, np.eye(20), atol=1e-9)


def test_randomised_solver_takes_more_terms_than_the_gram_matrix(spark):
    docs = fixtures.posts(spark, "/root/testdata/sf0.01").select("post_id", "content")
    config = textvec.VectorConfig(max_features=6000, components=10, solver="randomised")
    rows = docs.collect()
    terms, x = brute_force([r.content for r in rows], config)
    assert len(terms) > textvec.VOCABULARY_BOUND
    model = textvec.fit(docs, config=config)
    assert model.terms == terms
    assert model.singular_values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:10], rel=1e-7)


def test_randomised_solver_of_few_rows_and_terms(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha gamma",), ("gamma delta",), ("zeta",)], "content string")
    config = textvec.VectorConfig(max_df=1.0, solver="randomised")
    exact = textvec.fit(df, config=replace(config, solver="gram"))
    found = textvec.fit(df, config=config)
    assert found.singular_values == pytest.approx(exact.singular_values)
    assert np.allclose(np.abs(found.loadings), np.abs(exact.loadings))


def test_product_equals_numpy(spark, docs, monkeypatch):
    monkeypatch.setattr(rangefinder, "CELLS", 300)
    monkeypatch.setattr(rangefinder, "BLOCK", 16)
    config = textvec.VectorConfig(max_features=100)
    rows = docs.orderBy("post_id").collect()
    _, x = brute_force([r.content for r in rows], config)
    model = textvec.fit_vocabulary(docs, config=config)
    basis = np.random.default_rng(0).standard_normal((len(model.terms), 7))
    got = {r.i: r.sums for r in rangefinder.product(model.weigh(docs).repartition(5), "tfidf", basis).collect()}
    want = x.T @ (x @ basis)
    assert all(np.allclose(got.get(i, np.zeros(7)), want[i]) for i in range(len(want)))


@pytest.mark.parametrize("fitted", ["whole", "weights", "empty"])
def test_a_stored_model_is_the_same(spark, docs, tmp_path, fitted):
    config = textvec.VectorConfig(max_features=50, components=4, stop_words=("the",))
    if fitted == "empty":
        model = textvec.fit(spark.createDataFrame([("alpha",), ("beta",)], "content string"), config=config)
    else:
        model = (textvec.fit if fitted == "whole" else textvec.fit_vocabulary)(docs, config=config)
    textvec.save(model, spark, str(tmp_path / "m"))
    again = textvec.load(spark, str(tmp_path / "m"))
    assert (again.config, again.n_docs, again.terms, again.idf) == (model.config, model.n_docs, model.terms, model.idf)
    assert np.array_equal(again.singular_values, model.singular_values)
    rows = lambda m: [r.tfidf for r in m.transform(docs).orderBy("post_id").limit(20).collect()]
    assert rows(again) == rows(model)


def test_unknown_solver():
    with pytest.raises(ValueError):
        textvec.VectorConfig(solver="magic")


@pytest.mark.parametrize("tracked, proven", [(1 << 16, True), (4096, True), (64, False)])
def test_a_sketch_proves_its_terms_or_gives_none(spark, docs, monkeypatch, tracked, proven):
    monkeypatch.setattr(textvec, "TRACKED", tracked)
    config = textvec.VectorConfig(max_features=20, max_df=1.0)
    terms = docs.select(textvec.term_list(F.col("content")).alias("terms")).cache()
    n = terms.count()
    expected = textvec.top_terms(textvec.prune_terms(textvec.term_counts(terms), n, config), config).collect()
    heavy = textvec.heavy_terms(terms, n, config)
    assert (heavy is not None) == proven
    assert heavy is None or [tuple(r) for r in heavy] == [tuple(r) for r in expected]


def test_cells_taken_at_a_time_shrink_with_the_width():
    offsets = np.cumsum([0, *[150] * 1000, 0, 90_000, 3])
    for width in (50, 1000):
        steps = list(rangefinder.row_steps(offsets, width))
        assert [s for s, _ in steps] == [0, *[e for _, e in steps[:-1]]] and steps[-1][1] == len(offsets) - 1
        made = [(offsets[e] - offsets[s]) * width for s, e in steps if e - s > 1]
        assert max(made) <= rangefinder.NUMBERS
