"""Archives, shards and neighbour search: round trips and brute force."""

import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postsignal.llm import files, vptree, warc, wavelet, wordbpe, zipfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a/", "same"), (3, "http://b/ü\r\nX: y", "same"), (9, None, "same"), (1, "u", "other"), (2, "u", ""), (4, "u", None),
        (None, "u", "same"), (None, "u", "alone"), (8, "u", "é" * 50_000), (7, "u", "twice"), (7, "u", "twice"),
    ]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, archive int")


@pytest.mark.parametrize("package_bytes,least", [(1 << 20, 0), (1, 0), (1 << 20, 5)])
def test_archives_round_trip(spark, pages, package_bytes, least):
    written = warc.write(pages, package_bytes=package_bytes, least_bytes=least)
    got = warc.read(written).collect()
    assert len(got) == pages.count()
    smallest = {"same": 3, "": 2, "twice": 7}
    want = []
    for r in pages.collect():
        payload = (r.html or "").encode()
        first = smallest.get(r.html or "") if len(payload) >= least else None
        other = first if first != r.page_id else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((r.page_id, len(payload), digest, "revisit" if other else "response", other))
    key = lambda t: str(t)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_packages_are_zip_files_of_warc_records(spark, pages):
    for row in warc.write(pages).collect():
        with files.open_at(row.archive) as file:
            package = zipfile.ZipFile(io.BytesIO(file.read()))
        assert package.testzip() is None
        names = [i.filename for i in package.infolist() if i.compress_type == zipfile.ZIP_STORED]
        assert names == [warc.RECORDS, warc.INDEX]
        data, count = package.read(warc.RECORDS), 0
        while data:
            unpacker = zlib.decompressobj(31)
            assert unpacker.decompress(data).startswith(b"WARC/1.1\r\n")
            data, count = unpacker.unused_data, count + 1
        assert count == row.records


@pytest.mark.parametrize("wide", [False, True])
def test_directories(wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("a.txt", b"x" * 50)
        package.writestr(zipfile.ZipInfo("ü/b"), b"hello there")
        package.writestr("packed", b"y" * 99, zipfile.ZIP_DEFLATED)
        package.comment = b"PK\x05\x06 not the end record"
    file = pa.BufferReader(out.getvalue())
    found = zipfiles.members(file)
    assert list(found) == ["a.txt", "ü/b", "packed"]
    at = zipfiles.data_offset(file, found["ü/b"])
    assert file.read_at(found["ü/b"].size, at) == b"hello there"
    with pytest.raises(ValueError):
        zipfiles.data_offset(file, found["packed"])
    with pytest.raises(ValueError):
        zipfiles.members(pa.BufferReader(b"no archive at all, " * 3))


@pytest.mark.parametrize("n", [0, 1, 70_000])
def test_shard_access_rank_select(n):
    ids = np.random.default_rng(1).integers(0, 700, n).astype(np.uint32)
    out = io.BytesIO()
    size = wavelet.build(ids, np.array([0, n]), [1], out)
    assert size == len(out.getvalue())
    shard = wavelet.Shard(pa.BufferReader(out.getvalue()))
    assert (shard.tokens() == ids).all() and shard.count(10**6) == 0
    rng = random.Random(2)
    for _ in range(40 if n else 0):
        place, stop = rng.randrange(n), rng.randrange(n + 1)
        token = int(ids[place])
        where = np.flatnonzero(ids == token)
        assert shard.access(place) == token
        assert shard.count(token, 0, stop) == int((ids[:stop] == token).sum())
        nth = rng.randrange(len(where))
        assert shard.select(token, nth) == where[nth]
    with pytest.raises(IndexError):
        shard.access(n)


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3])
def test_token_files_round_trip(spark, awkward, shard_tokens):
    library = Tokenizer.from_file(PATH)
    got = wavelet.read(wavelet.write(awkward, PATH, shard_tokens=shard_tokens)).collect()
    assert len(got) == awkward.count()
    got.sort(key=lambda r: r.start)
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    coded = {}
    for r in awkward.collect():
        tokens = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        coded.setdefault(r.doc_id, []).append((len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in coded[r.id]
        start += r.n_tokens
    assert wavelet.read(wavelet.write(awkward.limit(0), PATH)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 8))
    vectors[100:140] = vectors[0]  # ties
    vectors[5] = 0
    rows = [(n, v.tolist()) for n, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [None] + [1.0] * 7), (None, [1.0] * 8), (2003, [float("inf")] * 8)]
    frame = vptree.usable(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string"))
    assert frame.count() == 899
    asked = frame.filter("id % 20 = 0")
    ids = np.array([n for n in range(900) if n != 5])
    for shard_rows, query_rows in ((20_000, 8_192), (100, 17)):
        found = {}
        for r in vptree.search(vptree.build(frame, shard_rows), asked, 10, query_rows=query_rows).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in range(0, 900, 20):
            scores = vptree.inner_products(np.repeat(vectors[q : q + 1], len(ids), axis=0), vectors[ids])
            scores[ids == q] = -np.inf
            order = np.lexsort((ids, -scores))[:10]
            assert sorted(found[q]) == [(k + 1, int(ids[n]), scores[n]) for k, n in enumerate(order)]
    few = vptree.search(vptree.build(frame.filter("id < 3")), asked.filter("id = 0"), 10).collect()
    assert sorted((r["rank"], r.query_id) for r in few) == [(1, 0), (2, 0)]
    index = vptree.build(frame)
    assert vptree.search(vptree.build(frame.limit(0)), asked, 3).count() == vptree.search(index, asked.limit(0), 3).count() == 0
    assert vptree.build(frame.unionByName(frame)).count() == index.count()
    loose = vptree.search(index, asked, 10, factor=0.6).collect()
    exact = {(r.query_id, r.vec_id) for r in vptree.search(index, asked, 10).collect()}
    assert len(exact & {(r.query_id, r.vec_id) for r in loose}) >= 0.6 * len(exact)


def test_repeated_vectors_and_queries_count_by_row(spark):
    rng = np.random.default_rng(4)
    rows = [(int(n), rng.integers(-3, 4, 4).astype(float).tolist()) for n in rng.integers(0, 70, 160)]
    rows = [r for r in rows if any(r[1])]
    rows += [rows[0]] * 15 + [(20, [1.0, 2.0, 3.0, 1.0])] * 3 + [(20, [-1.0, 0.0, 2.0, 1.0]), (40, [1.0, 1.0, 1.0, 1.0])] * 2
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = frame.filter("id % 20 = 0")
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            want.setdefault(q, []).extend((-float(np.dot(v, w)), c) for c, w in rows if c != q)
    want = sorted((q, n + 1, c, -s) for q, pairs in want.items() for n, (s, c) in enumerate(sorted(pairs)[:12]))
    for shard_rows, query_rows in ((20_000, 8_192), (30, 3)):
        got = vptree.search(vptree.build(frame, shard_rows), asked, 12, query_rows=query_rows).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


@pytest.mark.parametrize("most", [0, 60, 10**6])
def test_a_run_of_an_earlier_block_is_not_encoded_again(monkeypatch, most):
    """Whatever is kept, and however often it is forgotten, the ids are the library's."""
    monkeypatch.setattr(wordbpe, "KNOWN_CHARS", most)
    coder, library, encoded = wordbpe.WordBPE(PATH), Tokenizer.from_file(PATH), []
    plain = coder._encode_runs
    monkeypatch.setattr(coder, "_encode_runs", lambda runs: encoded.extend(runs) or plain(runs))
    blocks = [
        ["The cat sat.", "the CAT, e\u0301 \u00c9"], ["sat. The cat", "", "<|endoftext|> The"],
        ["new words here, " * 5, "x" * 100], ["the CAT, The cat sat. \u03a3\u03a3"],
    ]
    for texts in blocks:
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert coder.encode_array(pa.array(texts)).to_pylist() == want
    runs = [set(" ".join(texts).split()) for texts in blocks]
    if most == 10**6:
        assert len(encoded) == len(set(encoded)) and set(encoded) - {""} == set().union(*runs)
    assert coder.held <= most and coder.held == sum(map(len, coder.known))
