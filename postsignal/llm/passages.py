"""Substring de-duplication by sentence hashing: passages that stand earlier anywhere are cut out."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_128_digest

from .frames import SLICE, beside, free_name, id_and_text, in_slices, map_batches, stored

#: Fewest words of a passage: a run of neighbouring repeated sentences. Shorter repeats stay.
LEAST_WORDS = 50
#: Fewest words of a sentence that ends a unit: runs of one-word sentences are no evidence of a passage.
LEAST_SENTENCE = 5
_WORD, _BLANKS = re.compile(r"\S+"), re.compile(r"[^\S\n]*")
_END = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])\s*(?=\S)")


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of the sentences that have words; offsets in code points.

    Lines are cut behind the sentences of LEAST_SENTENCE words or more in them; the
    blanks that follow belong to the sentence. Where a unit ends depends on its last
    sentence only, so a passage has the same units wherever it stands, but for the
    sentences that its ends break. Normalised: lower-cased, white space made single blanks.
    """
    found, start = [], 0
    for line in text.split("\n"):
        at = before = 0
        for stop in [*(m.end() for m in _END.finditer(line)), len(line)]:
            if stop == len(line) or len(line[before:stop].split()) >= LEAST_SENTENCE:
                words = line[at:stop].lower().split()
                if words:
                    found.append((start + at, start + stop, " ".join(words)))
                at = stop
            before = stop
        start += len(line) + 1
    return found


def _digests(docs: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        place, number, digest, size = [], [], [], []
        for n, text in enumerate(batch.column("text").to_pylist()):
            own = units(text)
            place += [n] * len(own)
            number += range(len(own))
            digest += [xxh3_128_digest(line) for _, _, line in own]
            size += [line.count(" ") + 1 for _, _, line in own]
        at = pa.array(place, pa.int64())
        return {
            "id": batch.column("id").take(at), "sig": batch.column("sig").take(at), "unit": number, "digest": digest,
            "n": size,
        }

    return map_batches(docs, rows, "id long, sig long, unit int, digest binary, n int", most=SLICE)


def repeated_units(docs: DataFrame) -> DataFrame:
    """(id, sig, unit, n, first): every sentence of a document that stands earlier, in any document or its own, and where.

    Earliest is the smallest id, then the smallest number. A very common one is
    counted before its shuffle; the join that follows reads stored tables, so
    that AQE can split it.
    """
    lines = stored(_digests(docs), "passage-lines")
    here = F.struct("id", "unit", "sig")
    first = lines.groupBy("digest").agg(F.min(here).alias("first"), F.count("*").alias("copies"))
    first = stored(first.filter("copies > 1").drop("copies"), "passage-first")
    late = lines.join(first, "digest").filter(~here.eqNullSafe(F.col("first")))
    return late.select("id", "sig", "unit", "n", "first").distinct()


def broken_ends(docs: DataFrame, late: DataFrame) -> DataFrame:
    """(id, sig, unit, side, common): words beyond the ends of runs of repeated sentences that are repeated too.

    The sentence before a run's first (side -1) or behind its last (side 1) is
    compared with the one that stands there where the run's end stands first:
    `common` is the number of words that both have in common on the run's side. Only the
    documents on either side of such a comparison are read again.
    """
    order = Window.partitionBy("id", "sig").orderBy("unit")
    near = late.withColumns({"before": F.lag("unit").over(order), "after": F.lead("unit").over(order)})
    step = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    ends = near.select("id", "sig", "unit", "first", "before", "after", step)
    inside = F.when(F.col("side") < 0, F.col("before")).otherwise(F.col("after")).eqNullSafe(F.col("unit") + F.col("side"))
    asked = ends.filter(~inside).select(
        "id", "sig", "unit", "side", (F.col("unit") + F.col("side")).alias("own"),
        F.col("first.id").alias("at_id"), F.col("first.sig").alias("at_sig"), (F.col("first.unit") + F.col("side")).alias("at"),
    )
    asked = stored(asked.filter("own >= 0 and at >= 0"), "passage-ends")
    wanted = asked.select("id", "sig", F.col("own").alias("unit")).unionByName(
        asked.select(F.col("at_id").alias("id"), F.col("at_sig").alias("sig"), F.col("at").alias("unit"))
    )
    wanted = wanted.distinct().groupBy("id", "sig").agg(F.collect_list("unit").alias("units"))
    wanted = stored(wanted, "passage-wanted")
    read = beside(docs.select("id", "sig", "text"), wanted, ["id", "sig"], "inner", F.size("units"))

    def rows(batch: pa.RecordBatch) -> dict:
        place, number, words = [], [], []
        for n, (text, chosen) in enumerate(zip(batch.column("text").to_pylist(), batch.column("units").to_pylist())):
            own = units(text)
            for unit in chosen:
                if unit < len(own):
                    place.append(n)
                    number.append(unit)
                    words.append(own[unit][2])
        at = pa.array(place, pa.int64())
        return {"id": batch.column("id").take(at), "sig": batch.column("sig").take(at), "unit": number, "words": words}

    known = stored(map_batches(read, rows, "id long, sig long, unit int, words string", most=SLICE).distinct(), "passage-words")
    side = lambda id, sig, unit, words: known.select(*[F.col(a).alias(b) for a, b in zip(("id", "sig", "unit", "words"), (id, sig, unit, words))])
    here, there = side("h_id", "h_sig", "h_unit", "h_words"), side("t_id", "t_sig", "t_unit", "t_words")
    same = lambda *pairs: reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])
    both = asked.join(here, same(("id", "h_id"), ("sig", "h_sig"), ("own", "h_unit")))
    both = both.join(there, same(("at_id", "t_id"), ("at_sig", "t_sig"), ("at", "t_unit")))
    common = F.expr("""
        aggregate(
          zip_with(if(side < 0, reverse(split(h_words, ' ')), split(h_words, ' ')),
                   if(side < 0, reverse(split(t_words, ' ')), split(t_words, ' ')), (x, y) -> x <=> y),
          named_struct('n', 0, 'open', true),
          (s, equal) -> if(s.open and equal, named_struct('n', s.n + 1, 'open', true), named_struct('n', s.n, 'open', false)),
          s -> s.n)""")
    return both.select("id", "sig", "unit", "side", common.alias("common")).filter("common > 0")


def runs(late: DataFrame, ends: DataFrame, least_words: int) -> DataFrame:
    """(id, sig, runs): per document its runs of neighbouring repeated sentences that may make a passage.

    A run is its first and last sentence and the words beyond either; those of fewer than
    `least_words` words, all these included, are none.
    """
    number = F.row_number().over(Window.partitionBy("id", "sig").orderBy("unit"))
    each = late.withColumn("run", F.col("unit") - number).groupBy("id", "sig", "run").agg(
        F.min("unit").alias("first"), F.max("unit").alias("last"), F.sum("n").alias("words")
    )
    for side, unit, name in ((-1, "first", "before"), (1, "last", "after")):
        here = ends.filter(F.col("side") == side).select(
            F.col("id").alias("e_id"), F.col("sig").alias("e_sig"), F.col("unit").alias("e_unit"), F.col("common").alias(name)
        )
        on = F.col("id").eqNullSafe(F.col("e_id")) & (F.col("sig") == F.col("e_sig")) & (F.col(unit) == F.col("e_unit"))
        each = each.join(here, on, "left").drop("e_id", "e_sig", "e_unit").withColumn(name, F.coalesce(name, F.lit(0)))
    long = each.filter(F.col("words") + F.col("before") + F.col("after") >= least_words)
    return long.groupBy("id", "sig").agg(F.collect_list(F.struct("first", "last", "before", "after")).alias("runs"))


def passages(
    text: str, repeated: set[int], least_words: int = LEAST_WORDS, beyond: dict[tuple[int, int], int] | None = None
) -> list[tuple[int, int]]:
    """[start, end) of the runs of neighbouring repeated sentences with `least_words` words or more.

    `beyond` has the words by (sentence, side) that a run goes on for in the sentence before or
    behind it; it counts within a line, where a run's end breaks a sentence.
    """
    spans, own, beyond = [], units(text), beyond or {}
    for number in sorted(repeated):
        if number - 1 in repeated:
            continue
        last = number
        while last + 1 in repeated:
            last += 1
        inline = lambda n: n < len(own) and own[n][0] > 0 and text[own[n][0] - 1] != "\n"
        before = beyond.get((number, -1), 0) if inline(number) else 0
        after = beyond.get((last, 1), 0) if inline(last + 1) else 0
        start, end = own[number][0], own[last][1]
        if before:
            start = _words(text, own[number - 1])[-before][0]
        if after:
            end = _words(text, own[last + 1])[after - 1][1]
            end += len(_BLANKS.match(text, end).group())
        if before + after + sum(u[2].count(" ") + 1 for u in own[number : last + 1]) >= least_words:
            start = max(start, spans[-1][1]) if spans else start
            if spans and start == spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def _words(text: str, unit: tuple[int, int, str]) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text, unit[0], unit[1])]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without its spans and the newline that ends each (or, at the end, the one before).

    A span that begins or ends within a line leaves that line's newline.
    """
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        whole = start == 0 or text[start - 1] == "\n"
        at = end + (whole and text[end : end + 1] == "\n")
    rest = "".join(kept) + text[at:]
    return rest[:-1] if spans and at >= len(text) and rest.endswith("\n") else rest


def drop_repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
    removed: str | None = "removed",
) -> DataFrame:
    """`df` with passages cut that stand earlier; `removed` lists their offsets in the original text.

    Sentences are the units: cut out of lines and normalised (see `units`), named by a
    128-bit digest and grouped over the whole table. All but the earliest of equal
    sentences are repeats, and a run of neighbouring repeats is followed word by word
    into the sentences that it breaks at its ends, compared with where its ends stand
    first; where a line ends, so does a run. A run with `least_words` words or more, these included, is a passage, also
    where it shares lines with other text; lines without words do not end a run. `removed`
    (null: no such column) holds structs of start and end, in code points of the original text.
    Very long texts are split into sentences like others, a text at a time.

    A null text stays null, an empty one empty. A null id ranks first. Rows that
    repeat both id and text are one document. Other columns stay as they are
    (one called as `removed` is replaced); an empty table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("sig", F.xxhash64("text"))
    late = stored(repeated_units(rows), "passage-late")
    names = dict(zip(("id", "sig"), (free_name(df, "_late_id"), free_name(df, "_late_sig"))))
    own = [free_name(df, c) for c in ("_late_runs", "_freed")]
    found = runs(late, broken_ends(rows, late), least_words).withColumnsRenamed({**names, "runs": own[0]})
    found = stored(found, "passage-documents")
    text = F.col(f"`{text_col}`").cast("string")
    made = "struct<text:string,removed:array<struct<start:int,end:int>>>"
    kind = pa.struct([
        ("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    ])

    @F.arrow_udf(made)
    def freed(texts: pa.Array, found: pa.Array) -> pa.Array:
        return in_slices(some_freed, texts, found)

    def some_freed(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, own_runs in zip(texts.to_pylist(), found.to_pylist()):
            spans = []
            if t and own_runs:
                repeated = {n for r in own_runs for n in range(r["first"], r["last"] + 1)}
                beyond = {(r["first"], -1): r["before"] for r in own_runs} | {(r["last"], 1): r["after"] for r in own_runs}
                spans = passages(t, repeated, least_words, beyond)
            out.append({"text": cut(t, spans) if spans else t, "removed": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(out, kind)

    keyed = df.withColumns({
        names["id"]: F.col(f"`{id_col}`").cast("long"), names["sig"]: F.xxhash64(F.coalesce(text, F.lit(""))),
    })
    joined = beside(keyed, found, list(names.values()), "left", F.size(own[0]) * 4)
    joined = joined.withColumn(own[1], freed(text, F.col(own[0])))
    kept = [
        F.col(f"{own[1]}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c != removed
    ]
    return joined.select(*kept, *([F.col(f"{own[1]}.removed").alias(removed)] if removed else []))
