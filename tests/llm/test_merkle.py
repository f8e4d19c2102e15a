"""Merkle manifests against a plain tree, forged leaves, awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postsignal.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, per node the list of (stands left, sibling), or None where a node stands alone)."""
    ways, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 2, len(nodes))) for i in range(0, len(nodes), 2)]
        for run in runs:
            for i in run:
                other = [(j < i, nodes[j]) for j in run if j != i]
                for x in under[i]:
                    ways[x].append(other[0] if other else None)
        under = [sum((under[i] for i in run), []) for run in runs]
        nodes = [digest(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], ways


def brute(rows, forged=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row), leaf(forged(row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in groups[g]]) for g in order]
    root, tops = tree([t[0] for t in trees])
    found = []
    for g, (subroot, ways), top in zip(order, trees, tops):
        for (doc_id, own, now), way in zip(groups[g], ways):
            for s in way + top:
                now = digest(now) if s is None else digest(s[1], now) if s[0] else digest(now, s[1])
            proof = digest(*[s[1] for s in way + top if s])
            found.append((doc_id, own, subroot, root, proof, now, now == root))
    return sorted(found, key=repr)


def proven(df, **more):
    return sorted(map(tuple, merkle.proofs(merkle.climb(merkle.build(df, **more))).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [5, 3, 1], [256, 257, 700, 2]])
def test_groups_of_many_sizes(spark, sizes):
    rows = [(i * 7919 % 100003, f"t{i}", None if g == 1 else f"g{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    rows = [(i + 1000003 * g, *r[1:]) for g, (i, r) in enumerate((r[0], r) for r in rows)]
    assert proven(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_many_groups(spark):
    rows = [(i, "x", f"lang{i % 300}", None, i) for i in range(900)]
    assert proven(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_forged_leaves_prove_another_root(spark):
    rows = [(i, f"é{i}", "de" if i % 3 else "en", "a", i) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    forged = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_hash(changed={"n_chars": F.col("n_chars") + 1}))
    changed = lambda r: (*r[:4], r[4] + 1) if r[0] % 5 == 0 else r
    got = proven(df, forged=forged)
    assert got == brute(rows, changed)
    assert {r[0] for r in got if not r[-1]} == set(range(0, 40, 5))


def test_awkward_rows(spark, awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert proven(awkward) == brute(rows)
    assert proven(awkward.limit(0)) == []


def test_repeated_rows_and_the_order_of_partitions(spark):
    rows = [(1, "same", "en", None, 4)] * 300 + [(None, None, None, None, None)] * 5
    df = spark.createDataFrame(rows, COLUMNS)
    assert proven(df) == proven(df.repartition(7)) == brute(rows)


def test_row_limit_is_put_back(spark):
    spark.conf.set(merkle.ROW_LIMIT, "123")
    try:
        assert len(proven(spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(200)], COLUMNS))) == 200
        assert spark.conf.get(merkle.ROW_LIMIT) == "123"
    finally:
        spark.conf.unset(merkle.ROW_LIMIT)
