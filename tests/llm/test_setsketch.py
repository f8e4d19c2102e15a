"""SetSketch near-duplicates against all pairs; sketches, estimates, buckets with several classes."""

import random

import numpy as np
import pytest

from postsignal.llm import setsketch


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def shingles(text):
    found = words(text)
    return {" ".join(p) for p in zip(found, found[1:])} if len(found) > 1 else set(found)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted(((name, len(sets[i]), least.get(root(i)), name == least.get(root(i))) for i, (name, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, setsketch.near_duplicates(df).collect()), key=repr)


def cloud(rng, copies, changes, vocabulary, length=60):
    """A text and copies of it, each with some words replaced."""
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(copies):
        text = list(base)
        for i in rng.sample(range(length), rng.choice(changes)):
            text[i] = rng.choice(vocabulary)
        yield " ".join(text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    made = [t for _ in range(12) for t in cloud(rng, 12, [0, 1, 2, 3, 4, 6], vocabulary)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    made += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(25)) for _ in range(80)]
    made += ["short", "Short", "two words", "TWO\twords", "", " \n"]
    rng.shuffle(made)
    return list(enumerate(made))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classes(spark, texts):
    assert found(table(spark, texts)) == brute(texts)


def test_classes_of_large_buckets(spark, texts, monkeypatch):
    """Bands of one register gather much that is not near; buckets are split from 20 members on, and blocks are small."""
    monkeypatch.setattr(setsketch, "ROWS", 1)
    monkeypatch.setattr(setsketch, "TURNS", 1)
    for name, value in (("FEW", 2), ("MANY", 20), ("OUTER", 8), ("INNER", 16)):
        monkeypatch.setattr(setsketch, name, value)
    assert found(table(spark, texts)) == brute(texts)


def test_a_cloud_around_the_limit(spark):
    """Hundreds of copies of one text of which about half are links of each other."""
    rng = random.Random(4)
    rows = list(enumerate(cloud(rng, 250, [3, 4, 5, 6, 7], [f"w{i}" for i in range(4000)], 90)))
    assert found(table(spark, rows)) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == brute(rows)
    assert found(awkward.limit(0)) == []


def test_sketches_merge_and_keep_to_sizes():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3000, 5000))
    whole = setsketch.registers(np.union1d(a, b))
    assert (whole == setsketch.merged(setsketch.registers(a), setsketch.registers(b))).all()
    assert (setsketch.registers(a[:1]) < setsketch.registers(a)).mean() > 0.99


@pytest.mark.parametrize("similarity", [0.1, 0.5, 0.8, 0.95])
def test_estimates(similarity):
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        n = 400
        both = round(2 * n * similarity / (1 + similarity))
        values = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = values[:n], values[n - both :]
        row = lambda h: setsketch.registers(h)[None, :]
        best, lead = setsketch.estimate(row(a), row(b), np.array([n]), np.array([n]))
        off.append(best[0] - similarity)
        assert similarity < 0.8 or best[0] >= 0.8 or 2 * lead[0] <= setsketch.SIGMAS**2
        assert similarity > 0.3 or 2 * lead[0] > setsketch.SIGMAS**2
    assert abs(np.mean(off)) < 0.015


def test_shingles_by_hand():
    assert len(setsketch.shingles("")) == len(setsketch.shingles(" \t")) == 0
    assert list(setsketch.shingles("A b")) == list(setsketch.shingles("a\nB"))
    assert len(setsketch.shingles("a a a a")) == 1 and len(setsketch.shingles("a")) == 1
