"""Line de-duplication within one word edit, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from .frames import SLICE, beside, blocks, free_name, id_and_text, in_slices, map_batches, stored

#: Lines of fewer words count as equal only if all words are: one edit in five words is a similarity of 0.8.
LEAST_WORDS = 5
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
_SUBSTITUTED, _INSERTED = 1, 2
_SUB, _BASE, _LONGER = 0, 1, 2
LINE = "id long, sig long, line int, ha long, hb long, k0 long, k1 long, k2 long, k3 long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class LineHashes:
    """Hashes of parts of word sequences, many lines at once.

    A sequence's hash is the sum of its word hashes times powers of an odd base,
    modulo 2**64, so prefixes, suffixes and deletions follow from running sums.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.n = words, sizes
        self.start = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        longest = int(sizes.max()) if len(sizes) else 0
        place = np.arange(len(words)) - np.repeat(self.start, sizes)
        self.sums, self.shrink = [], []
        for base in _BASES:
            terms = words * _powers(base, longest)[place]
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))))
            self.shrink.append(_powers(pow(base, -1, 1 << 64), longest))

    def part(self, start: np.ndarray, stop: np.ndarray, rows=slice(None), kind: int = 0) -> np.ndarray:
        """Hash of the words from `start` to `stop` of each line, as if they stood alone."""
        at = self.start[rows]
        sums = self.sums[kind]
        return (sums[at + stop] - sums[at + start]) * self.shrink[kind][start]

    def without(self, row: int, places: np.ndarray) -> np.ndarray:
        """Hashes of one line without the word at each of the places."""
        sums, at, end = self.sums[0], self.start[row], self.start[row] + self.n[row]
        before = sums[at + places] - sums[at]
        return before + (sums[end] - sums[at + places + 1]) * self.shrink[0][1]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each whole line."""
        zero, n = np.zeros(len(self.n), np.int64), self.n.astype(np.uint64)
        return tuple(_mixed(self.part(zero, self.n, kind=k) + n).view(np.int64) for k in (0, 1))

    def half_keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, rows, keys): what is left of a line without its first or second half.

        Two lines one edit apart agree outside the half with the edit, halves being
        those of the shorter line (m words). A line takes part with m equal to its
        own length, and to one word less as the longer of two.
        """
        for longer in (0, 1):
            rows = np.flatnonzero(self.n - longer >= LEAST_WORDS)
            n, m = self.n[rows], self.n[rows] - longer
            for half, (start, stop) in enumerate(((n - (m - m // 2), n), (np.zeros_like(m), m // 2))):
                rest = self.part(start, stop, rows)
                yield 2 * longer + half, rows, _mixed(rest + (2 * m + half).astype(np.uint64) * np.uint64(_BASES[1]))


def _line_words(text: str) -> Iterator[tuple[int, list[str]]]:
    """(number, lower-cased words) of the lines that have words."""
    for number, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            yield number, words


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, LineHashes]]:
    """(document's place in the batch, line number, hashes) for blocks of a batch's texts."""
    done = 0
    for block in blocks(batch.column("text").to_pylist()):
        docs, lines, sizes, words = [], [], [], []
        for place, text in enumerate(block, done):
            for number, own in _line_words(text):
                docs.append(place)
                lines.append(number)
                sizes.append(len(own))
                words += own
        done += len(block)
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        yield np.array(docs, np.int64), np.array(lines, np.int32), LineHashes(hashes, np.array(sizes, np.int64))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a signature of their text, which tells apart rows that share an id."""
    return id_and_text(df, id_col, text_col).withColumn("sig", F.xxhash64("text"))


def _all_lines(docs: DataFrame) -> DataFrame:
    """Every line with words: its place, its name (ha, hb) and its half keys (k0 to k3; null where it takes no part)."""

    def rows(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("id", "sig", "line", "ha", "hb", "k0", "k1", "k2", "k3")}
        for place, number, hashes in _hashed(batch):
            ha, hb = hashes.names()
            for c, values in (("line", number), ("ha", ha), ("hb", hb)):
                out[c].append(pa.array(values))
            for k, at, keys in hashes.half_keys():
                values, absent = np.zeros(len(place), np.int64), np.ones(len(place), bool)
                values[at], absent[at] = keys.view(np.int64), False
                out[f"k{k}"].append(pa.array(values, mask=absent))
            for c in ("id", "sig"):
                out[c].append(batch.column(c).take(pa.array(place)))
        return {c: pa.concat_arrays(v) for c, v in out.items()}

    return map_batches(docs, rows, LINE, most=SLICE)


def _candidates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another: first place, word hashes, and which halves (bits)."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("key")) for k in range(4)])
    keyed = distinct.select("ha", "hb", F.explode(each).alias("e")).select("ha", "hb", "e.k", "e.key").filter("key is not null")
    names = keyed.groupBy("key").agg(F.min("ha").alias("low"), F.max("ha").alias("high"))
    shared = stored(names.filter("low != high").select("key"), "lines-shared")
    halves = keyed.join(shared, "key", "left_semi").groupBy("ha", "hb").agg(
        F.expr("bit_or(shiftleft(1, k))").alias("halves")
    )
    halves = stored(halves, "lines-halves")
    found = halves.join(distinct.select("ha", "hb", "first"), ["ha", "hb"])
    wanted = found.groupBy(F.col("first.id").alias("id"), F.col("first.sig").alias("sig")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "ha", "hb", "halves")).alias("chosen")
    )
    read = beside(docs, stored(wanted, "lines-wanted"), ["id", "sig"], "inner", F.size("chosen"))

    def rows(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("id", "sig", "line", "ha", "hb", "words", "halves")}
        for n, (text, chosen) in enumerate(zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist())):
            lines = dict(_line_words(text))
            for one in chosen:
                for c in ("line", "ha", "hb", "halves"):
                    out[c].append(one[c])
                words = lines[one["line"]]
                out["words"].append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64))
                out["id"].append(n)
        at = pa.array(out["id"], pa.int64())
        return {**out, "id": batch.column("id").take(at), "sig": batch.column("sig").take(at)}

    schema = "id long, sig long, line int, ha long, hb long, words array<long>, halves int"
    # Rows that repeat id and text give their lines once each.
    return map_batches(read, rows, schema, most=SLICE).groupBy("ha", "hb").agg(
        F.first(F.struct("id", "line", "sig")).alias("first"), F.first("words").alias("words"),
        F.first("halves").alias("halves"),
    )


def _variants(candidates: DataFrame) -> DataFrame:
    """Hashed deletion variants of the candidates, in the halves they share with others.

    Two lines of one length that differ in one word agree without it, at the same
    place; a line equals a longer one without the added word. So lines with one
    key are one edit apart, except two longer lines with the same shorter one.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        words = batch.column("words")
        sizes = np.diff(words.offsets.to_numpy())
        hashes = LineHashes(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes.astype(np.int64))
        whole = hashes.part(np.zeros(len(sizes), np.int64), hashes.n)
        keys, roles, owners = [], [], []

        def emit(row: int, kind: int, role: int, values: np.ndarray, place=None) -> None:
            tag = np.uint64(kind) if place is None else (place.astype(np.uint64) << np.uint64(3)) + np.uint64(kind)
            keys.append(_mixed(_mixed(values) + tag))
            roles.append(np.full(len(values), role, np.int32))
            owners.append(np.full(len(values), row, np.int64))

        for row, (n, halves) in enumerate(zip(sizes.tolist(), batch.column("halves").to_pylist())):
            for k in (k for k in range(4) if halves >> k & 1):
                longer, half = divmod(k, 2)
                m = n - longer
                start, stop = (m // 2, m) if half else (0, m // 2)
                place = np.arange(start, stop + longer)
                left = hashes.without(row, place)
                if longer:
                    emit(row, _INSERTED, _LONGER, left)
                else:
                    emit(row, _SUBSTITUTED, _SUB, left, place)
            if halves & 3:
                emit(row, _INSERTED, _BASE, whole[row : row + 1])
        owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
        first = batch.column("first")
        return {
            "key": (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64),
            "role": np.concatenate(roles) if roles else np.zeros(0, np.int32),
            "first": first.take(owner), "ha": batch.column("ha").take(owner), "hb": batch.column("hb").take(owner),
        }

    first = candidates.schema["first"].dataType.simpleString()
    return map_batches(candidates, rows, f"key long, role int, first {first}, ha long, hb long")


def within_one_edit(a, b) -> bool:
    """Whether two sequences are at most one substitution, insertion or deletion apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    return max(len(a), len(b)) - head - tail <= 1


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(ha, hb) of lines with an earlier line one edit away."""
    candidates = stored(_candidates(docs, distinct), "lines-candidates")
    variants = stored(_variants(candidates), "lines-variants")
    me = F.struct("first", "ha", "hb")
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("role") != _LONGER, me)).alias("shorter"),
        F.min(F.when(F.col("role") == _LONGER, me)).alias("longer"), F.count("*").alias("n"),
    )
    met = stored(met.filter("n > 1").drop("n"), "lines-met")
    partner = F.when(F.col("role") == _BASE, F.col("longer")).otherwise(F.col("shorter"))
    pairs = variants.join(met, "key").withColumn("other", partner).filter("other.first < first")
    pairs = pairs.select("ha", "hb", F.col("other.ha").alias("oa"), F.col("other.hb").alias("ob")).distinct()
    pairs = stored(pairs, "lines-pairs")
    other = candidates.select(F.col("ha").alias("oa"), F.col("hb").alias("ob"), F.col("words").alias("others"))
    both = pairs.join(candidates.select("ha", "hb", "words"), ["ha", "hb"]).join(other, ["oa", "ob"])

    @F.arrow_udf("boolean")
    def verified(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([within_one_edit(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return both.filter(verified("words", "others")).select("ha", "hb").distinct()


def repeated_lines(docs: DataFrame, near: bool = True) -> DataFrame:
    """(id, sig, lines): the numbers of the lines that go, per document that loses any.

    `docs` has id, text and sig (see `_rows`).
    """
    lines = stored(_all_lines(docs), "lines")
    first = F.min(F.struct("id", "line", "sig")).alias("first")
    halves = [F.first(f"k{k}").alias(f"k{k}") for k in range(4)] if near else []
    distinct = stored(lines.groupBy("ha", "hb").agg(first, F.count("*").alias("n"), *halves), "lines-distinct")
    gone = distinct.filter("n > 1").select("ha", "hb", "first")
    if near:
        late = stored(_near(docs, distinct), "lines-near").select("ha", "hb", F.lit(True).alias("all"))
        # A full outer join has one row per distinct line on either side: no key repeats.
        gone = gone.join(late, ["ha", "hb"], "full_outer")
    else:
        gone = gone.withColumn("all", F.lit(False))
    gone = stored(gone, "lines-gone")
    here = F.struct("id", "line", "sig")
    out = lines.join(gone, ["ha", "hb"]).filter(F.col("all").isNotNull() & F.col("all") | ~here.eqNullSafe(F.col("first")))
    return out.groupBy("id", "sig").agg(F.collect_set("line").alias("lines"))


def drop_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True, removed: str | None = None
) -> DataFrame:
    """`df` with its texts freed of lines that stand earlier, exactly or within one edit.

    Lines end at newlines and are compared by their lower-cased words; lines
    without words always stay. With `near`, lines of `LEAST_WORDS` words or more
    also match a line that differs by one word substituted, added or left out. Order
    is by id, then line number; a line goes if any earlier line matches it, whether
    that one stays or not. With `removed`, a column of that name lists the
    numbers of the lines that went (0 is the first).

    A null text stays null and an empty one empty; a null id ranks before all
    others. Rows that repeat both id and text are one document and keep the same
    lines. All other columns and their order stay (one called as `removed` is replaced);
    an empty table gives no rows. Texts, however long, are read and rewritten whole.
    """
    gone = stored(repeated_lines(_rows(df, id_col, text_col), near), "lines-by-document")
    own = [free_name(df, c) for c in ("_gone_id", "_gone_sig", "_gone_lines")]
    gone = gone.select(*[c.alias(n) for c, n in zip((F.col("id"), F.col("sig"), F.array_sort("lines")), own)])
    text = F.col(f"`{text_col}`").cast("string")
    keyed = df.withColumns(
        {own[0]: F.col(f"`{id_col}`").cast("long"), own[1]: F.xxhash64(F.coalesce(text, F.lit("")))}
    )

    @F.arrow_udf("string")
    def freed(texts: pa.Array, lines: pa.Array) -> pa.Array:
        return in_slices(some_freed, texts, lines)

    def some_freed(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, numbers in zip(texts.to_pylist(), lines.to_pylist()):
            if t is not None and numbers:
                without = set(numbers)
                t = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in without)
            out.append(t)
        return pa.array(out, pa.string())

    joined = beside(keyed, gone, own[:2], "left", F.size(own[2]))
    numbers = F.col(own[2])
    kept = [freed(text, numbers).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c != removed]
    if removed:
        kept.append(F.coalesce(numbers, F.array().cast("array<int>")).alias(removed))
    return joined.select(*kept)
