"""Line and passage de-duplication against brute force."""

import random
import re
from collections import defaultdict

import pytest

from postsignal import session
from postsignal.llm import frames, linededup, passages

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(12)]
    docs = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                edit = rng.choice("sid")
                if edit == "i":
                    words.insert(at, rng.choice(WORDS))
                elif at < len(words):
                    words[at : at + 1] = [] if edit == "d" and len(words) > 1 else [rng.choice(WORDS).upper()]
            lines.append("  ".join(words) if rng.random() < 0.9 else "")
        docs.append((doc, "\n".join(lines)))
    rng.shuffle(docs)
    return docs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_equal_brute_force(spark):
    docs = corpus(3, 120)
    lines = [(d, n, tuple(line.lower().split())) for d, t in sorted(docs) for n, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    want = defaultdict(list)
    for k, (d, n, words) in enumerate(lines):
        for _, _, other in lines[:k]:
            if other == words or min(len(other), len(words)) >= linededup.LEAST_WORDS and edits(other, words) <= 1:
                want[d].append(n)
                break
    assert sum(map(len, want.values())) > 100
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(frame, removed="removed").collect()}
    assert {d: r.removed for d, r in got.items() if r.removed} == dict(want)
    for d, text in docs:
        kept = [line for n, line in enumerate(text.split("\n")) if n not in want[d]]
        assert got[d].text == "\n".join(kept)


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = rng.choices("ab", k=rng.randint(0, 6)), rng.choices("ab", k=rng.randint(0, 6))
        assert linededup.within_one_edit(a, b) == (edits(a, b) <= 1)


def test_awkward_rows(spark, awkward):
    out = linededup.drop_repeated_lines(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert len(rows) == awkward.count()
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    # A null id ranks first, so its line is the one that stays.
    assert sorted(texts[None], key=str) == [None, "one two three four five six seven eight nine ten eleven twelve thirteen"]
    assert texts[1] == [""] and texts[7] == ["", ""] and texts[2] == [None] and texts[3] == [""] and texts[4] == [" \t\n "]
    assert texts[5][0].startswith("word") and texts[6] == [""]
    assert linededup.drop_repeated_lines(awkward.limit(0)).count() == 0
    twice = awkward.filter("doc_id = 7")
    assert [bool(r.text) for r in linededup.drop_repeated_lines(twice).collect()] == [True, True]


def test_passages_equal_brute_force(spark):
    docs = corpus(8, 120)
    seen, want = set(), {}
    for d, text in sorted(docs):
        at, units = 0, []
        for line in text.split("\n"):
            words = tuple(line.lower().split())
            if words:
                units.append((at, at + len(line), len(words), words in seen))
                seen.add(words)
            at += len(line) + 1
        spans, run, size = [], None, 0
        for start, stop, n, repeated in [*units, (0, 0, 0, False)]:
            if repeated:
                run, size = (run[0] if run else start, stop), size + n
            else:
                if run and size >= 8:
                    spans.append(run)
                run, size = None, 0
        want[d] = spans
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = dict(docs)
    assert any(want.values())
    for r in passages.drop_repeated_passages(frame, least_words=8).collect():
        assert [(s.start, s.end) for s in r.removed] == want[r.doc_id]
        left = [w for w in r.text.split("\n") if w]
        cut = "".join(texts[r.doc_id][a:b] + "\n" for a, b in want[r.doc_id])
        assert sorted(left + [w for w in cut.split("\n") if w]) == sorted(w for w in texts[r.doc_id].split("\n") if w)
        if not want[r.doc_id]:
            assert r.text == texts[r.doc_id]


def test_passages_within_lines(spark):
    sentence = lambda k, n=12: " ".join(f"w{k}x{i}" for i in range(n)) + "."
    passage = " ".join(sentence(k) for k in range(5))
    three = f"{sentence(10, 20)}\n{sentence(11, 20)}\n{sentence(12, 20)}"
    own = lambda d: sentence(f"own{d}", 8)
    docs = [
        (1, f"{passage}\n{three}"),
        (2, f"{own(2)} {passage.upper()} {own(20)}"), (3, f"{own(3)}  {passage}\n{own(30)}"),
        (4, f"{own(4)}\n{three} {own(40)}"), (5, f"{passage} {own(5)}"),
        (6, f"{own(6)} " + " ".join(sentence(k) for k in range(4))),  # 48 words
        (7, "a! b! c! " * 20), (8, "b! a! c! " * 20),  # one-word sentences in another order
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in passages.drop_repeated_passages(frame).collect()}
    want = {
        1: docs[0][1], 2: f"{own(2)} {own(20)}", 3: f"{own(3)}  \n{own(30)}", 4: f"{own(4)}\n{own(40)}",
        5: own(5), 6: docs[5][1], 7: docs[6][1], 8: docs[7][1],
    }
    assert {d: r.text for d, r in rows.items()} == want
    (span,) = rows[2].removed
    assert docs[1][1][span.start : span.end] == passage.upper() + " "


def plain_units(text):
    """(start, end, words) of sentences of five words or more, within lines."""
    found, at = [], 0
    for line in text.split("\n"):
        pieces, start = re.split(r"(?<=[.!?])(\s+)", line), 0
        sentences = ["".join(pieces[i : i + 2]) for i in range(0, len(pieces), 2)]
        held = ""
        for n, sentence in enumerate(sentences):
            held += sentence
            if len(sentence.split()) >= 5 or n == len(sentences) - 1:
                if held.split():
                    found.append((at + start, at + start + len(held), held.lower().split()))
                start, held = start + len(held), ""
        at += len(line) + 1
    return found


def plain_passages(docs, least):
    """By document: spans of runs of repeated sentences, followed word by word into the sentences at their ends."""
    own = {d: plain_units(t) for d, t in docs}
    texts, first = dict(docs), {}
    for d in sorted(own):
        for n, u in enumerate(own[d]):
            first.setdefault(tuple(u[2]), (d, n))
    out = {}
    for d, units in own.items():
        late = [first[tuple(u[2])] != (d, n) for n, u in enumerate(units)]
        spans, n = [], 0
        while n < len(units):
            if not late[n]:
                n += 1
                continue
            last = n
            while last + 1 < len(units) and late[last + 1]:
                last += 1
            start, end, words = units[n][0], units[last][1], sum(len(u[2]) for u in units[n : last + 1])
            for side, edge in ((-1, n), (1, last)):
                o, (e, m) = edge + side, first[tuple(units[edge][2])]
                if not (0 <= o < len(units) and 0 <= m + side < len(own[e])):
                    continue
                border = units[edge][0] if side < 0 else units[o][0]
                if border == 0 or texts[d][border - 1] == "\n":
                    continue
                a, b = units[o][2][::side], own[e][m + side][2][::side]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                places = [w.span() for w in re.finditer(r"\S+", texts[d])]
                places = [p for p in places if units[o][0] <= p[0] < units[o][1]]
                if same and side < 0:
                    start = places[-same][0]
                elif same:
                    end = places[same - 1][1]
                    while end < len(texts[d]) and texts[d][end] == " ":
                        end += 1
                words += same
            if words >= least:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
            n = last + 1
        out[d] = spans
    return out


def test_passages_that_break_sentences_equal_brute_force(spark):
    """Passages cut anywhere and put anywhere: their first and last sentence are broken."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 14))) + rng.choice(".!?")
    text = lambda n: "".join(sentence() + rng.choice([" ", " ", "  ", "\n"]) for _ in range(n))
    sources = [text(30) for _ in range(6)]
    docs = []
    for d in range(90):
        body = text(8)
        for _ in range(rng.randint(0, 2)):
            stuff = rng.choice(sources)
            spots = [m.span() for m in re.finditer(r"\S+", stuff)]
            i = rng.randrange(len(spots) - 60)
            piece = stuff[spots[i][0] : spots[i + rng.randint(20, 59)][1]]
            at = rng.choice([m.start() for m in re.finditer(r"\S+", body)])
            body = body[:at] + piece + rng.choice([" ", "\n"]) + body[at:]
        docs.append((d, body))
    want = plain_passages(docs, 25)
    assert sum(map(bool, want.values())) > 20
    for r in passages.drop_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), least_words=25).collect():
        assert [(s.start, s.end) for s in r.removed] == want[r.doc_id]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_a_passage_of_fifty_words_is_found_wherever_it_stands(spark, monkeypatch, most):
    monkeypatch.setattr(frames, "MOST_BROADCAST", most)
    rng = random.Random(2)
    sentence = lambda n=11: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n)) + "."
    whole = " ".join(sentence() for _ in range(30))
    piece = " ".join(whole.split()[37:97])  # 60 words, four whole sentences of 44
    docs = [(1, whole)] + [(d, f"{sentence(7)} own{d} {piece} tail{d} {sentence(9)}") for d in range(2, 12)]
    rows = passages.drop_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    for r in rows:
        cut = " ".join(texts[r.doc_id][s.start : s.end] for s in r.removed).split()
        assert cut == ([] if r.doc_id == 1 else piece.split())


def test_passage_awkward_rows(spark, awkward):
    out = passages.drop_repeated_passages(awkward, least_words=10)
    assert out.columns == [*awkward.columns, "removed"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    assert sorted((r.doc_id or 0, len(r.removed)) for r in rows if r.removed) == [(1, 1), (6, 1), (7, 1), (7, 1)]
    assert {r.text for r in rows if r.doc_id == 2} == {None}
    assert passages.drop_repeated_passages(awkward.limit(0)).count() == 0
    assert "removed" not in passages.drop_repeated_passages(awkward, removed=None).columns


def test_batches_of_texts_are_bounded_in_any_session(spark, tmp_path):
    """Sessions built elsewhere bring Spark's default of 64 MB a batch; reading a table and storing rows bound it."""
    before = spark.conf.get(session.BATCH_BYTES)
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    rows = frames.table(spark, str(tmp_path), "numbers")
    uses = (
        lambda: frames.table(spark, str(tmp_path), "numbers"), lambda: frames.stored(rows, "bounded"),
        lambda: frames.map_batches(rows, lambda batch: {"id": batch.column("id")}, "id long"),
    )
    try:
        for use in uses:
            spark.conf.set(session.BATCH_BYTES, "67108864b")
            use()
            assert spark.conf.get(session.BATCH_BYTES) == str(session.BATCH)
    finally:
        spark.conf.set(session.BATCH_BYTES, before)
