"""The pipeline, stage by stage, against brute force; the registered queries of this folder."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from postsignal.llm import quality, queries, simhash  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def good(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    rows = table.collect()
    return [tuple(r) for r in rows if model.score(*quality.features(r.text, (r.n_chars,))) >= 0.5]


def without_repeats(docs):
    first, lines = {}, []
    for d, text, _ in sorted(docs):
        for n, line in enumerate(text.split("\n")):
            words = tuple(line.lower().split())
            if words:
                first.setdefault(words, (d, n))
                lines.append((d, n, words))
    near = set()
    for words in first:
        forms = {words[:i] + ("",) + words[i + 1 :] for i in range(len(words))} if len(words) >= 5 else set()
        near.update((f, words) for f in forms)
    groups = defaultdict(list)
    for form, words in near:
        groups[form].append(words)
    gone = {w for g in groups.values() for w in g if first[w] > min(first[o] for o in g)}
    for words in first:
        for i in range(len(words) if len(words) > 5 else 0):
            shorter = words[:i] + words[i + 1 :]
            if shorter in first:
                gone.add(max(words, shorter, key=first.get))
    drop = {(d, n) for d, n, w in lines if w in gone or first[w] != (d, n)}
    out = []
    for d, text, _ in docs:
        kept = "\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in drop)
        out.append((d, kept, len(kept)))
    return out


def one_of_each(docs):
    prints = {d: simhash.fingerprint(t) for d, t, _ in docs}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return [d for d in docs if root[d[0]] == d[0]]


def uncontaminated(docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = defaultdict(set)
    for (text,) in duckdb.sql(f"select text from '{SF_DIR}/benchmark.parquet'").fetchall():
        own = words(text)
        n = min(13, len(own))
        grams[n].update(tuple(own[k : k + n]) for k in range(len(own) - n + 1) if own)
    out = []
    for doc in docs:
        own, hit = words(doc[1]), set()
        for n, held in grams.items():
            hit.update(i for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in held for i in range(k, k + n))
        if not hit or 20 * len(hit) < len(own):
            out.append(doc)
    return out


def test_stages_equal_brute_force(spark):
    sql = f"select doc_id, text, n_chars from '{SF_DIR}/documents.parquet'"
    want = duckdb.sql(sql).fetchall()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    steps = [lambda d: good(spark, d), without_repeats, one_of_each, uncontaminated]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs, want = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test"), step(want)
        assert docs.columns == columns, name
        got = [tuple(r) for r in docs.select("doc_id", "text", "n_chars").collect()]
        assert sorted(got) == sorted(want), name
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = [(d, library.encode(t, add_special_tokens=False).ids) for d, t, _ in want]
    last = [(d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, i in coded]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(last)


def test_stages_take_awkward_rows(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), SF_DIR).count() == 0, name
        out = stage(spark, awkward, SF_DIR)
        rows = out.collect()
        assert len(rows) <= awkward.count()
        if name != "bpe":
            assert out.columns == awkward.columns, name


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    import check_oracle

    equal, note = check_oracle.compare(spark, check_oracle.oracle_connection(SF_DIR), name, SF_DIR)
    assert equal, note


def test_queries_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


def test_query_columns(spark):
    wanted = {
        "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_vptree": "query_id rank vec_id score",
        "op3_quality": "doc_id held_out score predicted", "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op6_wavelet": "doc_id start n_tokens ids_crc32",
        "op8_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op10_simhash": "doc_id fingerprint component_id",
    }
    types = {"rank": "int", "score": "double", "predicted": "int", "held_out": "boolean", "contaminated": "boolean"}
    for name, columns in wanted.items():
        out = queries.QUERIES[name](spark, SF_DIR)
        assert out.columns == columns.split()
        for c, kind in out.dtypes:
            text = c in ("spans", "fingerprint", "payload_digest", "record_type") or c.endswith("sha256")
            assert kind == types.get(c, "string" if text else "bigint"), (name, c)
        assert out.count() > 0
