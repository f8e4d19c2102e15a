"""Personal data, quality, tokens and decontamination against brute force and the public library."""

import hashlib
import random
import re
import time

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postsignal.llm import bpe, decontaminate, pii, quality, queries
from postsignal.llm.wordbpe import load

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)

# --- personal data ----------------------------------------------------------


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_findings(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def random_texts():
    rng = random.Random(3)
    parts = (
        "1|2|9|0|4|.|@|+|-| |(|)|a|b.c|é|🙂|_|255|256.1|00|1.2.3.4|4111111111111111|a@b.c|+1 (743) 555-3824|\n|%|x@y|@@|"
        ".com|12 34-56 78|GB82 WEST 1234 5698 7654 32|tel 743-555-3824 |ssn: 123-45-6789"
    ).split("|")
    made = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1500)]
    return made + ["a" * 2000, "1" * 2000, "a@b.c" * 300, "1." * 1000, "+1 " + " " * 2000, "a." * 900 + "@", "x@" + "a." * 900, None, ""]


def test_base_findings_equal_brute_force(spark, monkeypatch):
    texts = random_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    for r in queries.op1_pii(spark, "").collect():
        want = base_findings(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(w.startswith(k) for w in want) for k in ("email:", "ip:", "card:", "phone:")
        ]


def test_added_findings(spark):
    texts = [
        "é cards 4111111111111111 4111111111111111 here", "iban GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32",
        "my ssn 123-45-6789", "part 123-45-6789", "call (743) 555-3824 now", "code (743) 555-3824 now", "4111 1111 1111 1112",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.s for r in pii.find(frame).select("id", pii.described("added").alias("s")).collect()}
    assert [got[n] for n in range(len(texts))] == [
        "card:8:24,card:25:41", "iban:5:32", "", "ssn:7:18", "", "phone:5:19", "", "",
    ]
    clean = {r.id: r.text for r in pii.redacted(frame).collect()}
    assert clean[0] == "é cards <card> <card> here" and clean[4] == texts[4]


def test_context_reaches_over_neighbouring_findings(spark):
    texts = [
        "call 743-555-3824 or 743-555-3825", "ssn 123-45-6789, 234-56-7890", "743-555-3824, 743-555-3825 phone",
        "call" + " 743-555-3824" * 4, "743-555-3824 743-555-3825 é phone",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.s for r in pii.find(frame).select("id", pii.described("added").alias("s")).collect()}
    assert [got[n] for n in range(len(texts))] == [
        "phone:5:17,phone:21:33", "ssn:4:15,ssn:17:28", "phone:0:12,phone:14:26",
        "phone:5:17,phone:18:30,phone:31:43",  # the fourth stands 44 characters behind the word
        "phone:13:25",  # 'phone' ends 21 characters behind the first
    ]
    clean = {r.id: r.text for r in pii.redacted(frame).collect()}
    assert clean[0] == "call <phone> or <phone>" and clean[1] == "ssn <ssn>, <ssn>"


def test_pii_work_grows_with_the_findings_of_a_text(spark):
    """One text with up to 64,000 addresses: offsets and context as in a short one, in time that doubles as they do."""
    seconds = {}
    for n in (100, 16_000, 64_000):
        text = " ".join(f"a{i}@b.c" for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        (found,) = pii.find(frame).select("base").first()
        seconds[n] = time.perf_counter() - begun
        want, at = [], 0
        for i in range(n):
            size = len(f"a{i}@b.c")
            want.append((at, at + size))
            at += size + 1
        assert [(x.start, x.stop) for x in found] == want
    assert seconds[64_000] < 8 * max(seconds[16_000], 1)


def test_pii_awkward_rows(spark, awkward):
    rows = pii.find(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.base or r.added for r in rows)
    assert pii.find(awkward.limit(0)).count() == 0


# --- quality ----------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, sf_dir).filter("held_out")
    known = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    right, n, kept = known.agg(
        F.count_if(F.col("predicted") == F.col("quality")), F.count("*"),
        F.count_if((F.col("quality") == 1) & (F.col("predicted") == 0)),
    ).first()
    assert n > 80 and right / n > 0.95 and kept / n < 0.02


def test_pair_term_is_the_sum_over_pairs():
    model = quality.FactorisationMachine(50)
    model.w[:] = range(50)
    slots, values = quality.np.array([3, 7, 20, 41]), quality.np.array([0.5, 1.0, 2.0, 0.25])
    pairs = sum(
        model.v[slots[i]] @ model.v[slots[j]] * values[i] * values[j] for i in range(4) for j in range(i)
    )
    assert model.raw(slots, values) == pytest.approx(model.w[slots] @ values + pairs)


def test_quality_awkward_rows(spark, awkward, labels):
    first, again = (
        sorted(map(str, quality.score_documents(awkward, labels).collect())) for _ in range(2)
    )
    assert first == again and len(first) == awkward.count()
    scores = [r.score for r in quality.score_documents(awkward, labels).collect()]
    assert all(0 <= s <= 1 for s in scores)
    untrained = quality.score_documents(awkward, labels.limit(0)).collect()
    assert {round(r.score, 1) for r in untrained} == {0.5}
    assert not any(r.held_out for r in untrained if r.id is None)
    assert quality.score_documents(awkward.limit(0), labels).count() == 0
    assert quality.keep_good(awkward, labels).columns == awkward.columns


# --- tokens -----------------------------------------------------------------


def tokens(texts):
    return load(PATH).encode_array(pa.array(texts, pa.string())).to_pylist()


def by_library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_every_character_encodes_as_the_library_does():
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x3100, 0x30000, 37))
    texts = [f"a{chr(c)}b{chr(c)}" for c in points if not 0xD800 <= c < 0xE000]
    assert tokens(texts) == by_library(texts)


def test_random_and_long_texts_encode_as_the_library_does():
    rng = random.Random(1)
    letters = "abcdefghijklmnop'srtvemld 0123!?<|endoftext|>éèßΣςſİıé́  \x1c\x85\n\t中文字ก🙂👍🏽"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 60))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 70)] + ["ab" * 3000, "x" * 9000, "<|endoftext|>" * 9, "a<|startoftext|>b", "", " "]
    assert tokens(texts) == by_library(texts)
    coder = load(PATH)
    ids = pa.array(tokens(texts), pa.list_(pa.int32()))
    assert coder.decode_array(ids).to_pylist() == [LIBRARY.decode(i, skip_special_tokens=False) for i in ids.to_pylist()]
    assert tokens([]) == []


def test_token_awkward_rows(spark, awkward):
    rows = bpe.encode_documents(awkward, PATH).collect()
    texts = [r.text or "" for r in awkward.collect()]
    assert sorted(list(r.ids) for r in rows) == sorted(by_library(texts))
    assert all(r.decoded == LIBRARY.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    assert bpe.encode_documents(awkward.limit(0), PATH).count() == 0
    columns = awkward.select(bpe.decode(bpe.encode(F.col("text"), PATH), PATH).alias("t"))
    assert sorted(r.t for r in columns.collect()) == sorted(r.decoded for r in rows)


# --- decontamination --------------------------------------------------------


def brute_hits(text, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, covered, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(own) - n + 1 if w else 0):
            if tuple(own[k : k + n]) in grams:
                covered |= set(range(k, k + n))
                found.add("" if item is None else str(item))
    return len(own), len(covered), sorted(found)


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_hits_equal_brute_force(spark, awkward, benchmark, block_bytes):
    rng = random.Random(4)
    words = ["ab", "c", "É", "d1", "x-y"]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for n in range(12)]
    docs = [(n, rng.choice([" ", "\n", "!"]).join(rng.choices(words + ["no"], k=rng.randint(0, 30)))) for n in range(150)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    got = decontaminate.contamination(*frames, size=4, block_bytes=block_bytes).collect()
    texts = dict(docs)
    assert len(got) == len(docs) and any(r.n_hit for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, list(r.items)) == brute_hits(texts[r.id], items, 4)
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    rows = decontaminate.contamination(awkward, benchmark, block_bytes=block_bytes).collect()
    own = [(r.item_id, r.text) for r in benchmark.collect()]
    want = sorted(str((r.doc_id, *brute_hits(r.text, own, 13))) for r in awkward.collect())
    assert sorted(str((r.id, r.n_words, r.n_hit, list(r.items))) for r in rows) == want


def test_repeated_and_long_items_stay_within_a_block(spark):
    rng = random.Random(6)
    items = [(1, "ab c d e")] * 400 + [(n, " ".join(rng.choices("abcde", k=rng.choice([3, 5, 9, 30])))) for n in range(2, 60)]
    items += [(60 + n, f"{n} " * 80) for n in range(6)]
    docs = [(n, " ".join(rng.choices(["ab", *"abcde123"], k=rng.randint(0, 30)))) for n in range(60)]
    table = spark.createDataFrame(items, "item string, text string")
    blocks = [b.select("item", "text").collect() for b in decontaminate._blocks(table, 200)]
    assert sorted(tuple(r) for b in blocks for r in b) == sorted({(str(i), t) for i, t in items})
    assert all(sum(len(r.text) for r in b) <= 200 or len(b) == 1 for b in blocks)
    assert any(len(b) > 3 for b in blocks)
    few = items[:430]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string")]
    for r in decontaminate.contamination(*frames, size=4, block_bytes=400).collect():
        assert (r.n_words, r.n_hit, list(r.items)) == brute_hits(dict(docs)[r.id], sorted(set(few)), 4)


def test_decontamination_edges(spark, awkward, benchmark):
    assert decontaminate.contamination(awkward.limit(0), benchmark).count() == 0
    assert not any(r.n_hit for r in decontaminate.contamination(awkward, benchmark.limit(0)).collect())
    clash = awkward.withColumn("_hits", F.lit("mine"))
    left = decontaminate.drop_contaminated(clash, benchmark)
    assert left.columns == clash.columns
    assert sorted((r.doc_id or 0, r._hits) for r in left.collect()) == [(n, "mine") for n in (0, 2, 3, 4, 5, 6, 8)]
