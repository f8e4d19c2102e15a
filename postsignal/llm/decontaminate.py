"""Benchmark decontamination: a broadcast set of test n-grams, scanned over training text."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .frames import free_name, stored

#: Bytes of words: A-Z become a-z, digits, a-z and all of non-ASCII stay, others separate.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HITS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def _hashes(columns, base: int) -> np.ndarray:
    """One wrapping 64-bit hash per window; `columns` are its word ids, word by word."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = (total + column.astype(np.uint64)) * np.uint64(base)
        total ^= total >> np.uint64(29)
    return total


class Windows:
    """The n-grams of one bounded block of benchmark items, as sorted hashes.

    Per window length: the hashes of the distinct windows in order, their word
    ids, and the numbers of the items that hold each. The hash multiplier is
    changed until no two windows share a hash, so a hash stands for one window.
    """

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items = sorted({item for item, _ in items})
        number = {item: n for n, item in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        runs: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                n = min(size, len(ids))
                own = np.lib.stride_tricks.sliding_window_view(np.array(ids, np.uint32), n)
                runs.setdefault(n, []).append(own)
                owners.setdefault(n, []).append(np.full(len(own), number[item], np.int32))
        self.tables = {n: self._table(np.concatenate(runs[n]), np.concatenate(owners[n])) for n in sorted(runs)}

    @staticmethod
    def _table(windows: np.ndarray, owners: np.ndarray) -> tuple:
        base = 0x9E3779B97F4A7C15
        while True:
            hashes = _hashes(windows.T, base)
            order = np.argsort(hashes, kind="stable")
            hashes, sorted_windows = hashes[order], windows[order]
            same = hashes[1:] == hashes[:-1]
            if (sorted_windows[1:][same] == sorted_windows[:-1][same]).all():
                break
            base = (base * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        return base, hashes[first], sorted_windows[first], np.append(first, len(order)), owners[order]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """How many hit windows cover each word (one extra place), and the items with hits."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, len(words))
        covered = np.zeros(len(words) + 1, np.int64)
        found: set[int] = set()
        foreign = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, (base, hashes, windows, first, owners) in self.tables.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(foreign[n:] == foreign[:-n])  # windows of known words only
            if not len(starts):
                continue
            own = np.stack([ids[starts + j] for j in range(n)], axis=1)
            keys = _hashes(own.T, base)
            place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            hit = (hashes[place] == keys) & (windows[place] == own).all(axis=1)
            np.add.at(covered, starts[hit], 1)
            np.add.at(covered, starts[hit] + n, -1)
            for p in np.unique(place[hit]).tolist():
                found.update(owners[first[p] : first[p + 1]].tolist())
        return np.cumsum(covered), {self.items[n] for n in found}


def add_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 13, block_bytes: int = 8_000_000, out: str = "_hits",
) -> DataFrame:
    """`docs` with a column `out`: struct of n_words, starts, ends and items per row.

    [start, end) are the runs of hit words. Items of fewer words than `size` are
    one window, items without words none; a null text has no words, a null item
    id is called '', and equal item ids are one item. An empty table gives no
    rows, an empty benchmark no hits; repeated document rows give repeated
    results. All other columns of `docs` stay; one already called `out` is replaced.

    What is broadcast comes from at most `block_bytes` of different items (or from
    one item, if it alone is longer), however they repeat or hash. A larger
    benchmark is cut into blocks of whole items (see `_blocks`), and each block is
    a pass of its own over the stored result of the last. A document stays one
    row, so no key is hot and no document is shuffled.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    blocks = _blocks(items.filter("text != ''"), block_bytes)
    rows = docs.withColumn(out, F.lit(None).cast(HITS))
    for n, block in enumerate(blocks):
        scan = _scanner(docs.sparkSession, Windows(sorted({(r.item, r.text) for r in block.collect()}), size))
        rows = rows.withColumn(out, scan(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(out)))
        if n + 1 < len(blocks):
            rows = stored(rows, "decontaminate")
    return rows


def _blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    """The different (item, text) rows in blocks of at most `limit` bytes of text, or of one longer item.

    Rows are dealt to groups by hash, and each group is cut where the running sum
    of its bytes passes a multiple of `step`. The item that stands there may reach
    beyond it by its own length, so `step` leaves room for the longest; items of
    over half the limit are blocks of their own instead.
    """
    size = F.octet_length("text")
    if (items.agg(F.sum(size)).first()[0] or 0) <= limit:
        return [items]
    items = stored(items.distinct().withColumn("size", size.cast("long")), "decontaminate-items")
    small = f"2 * size <= {limit}"
    total, longest = items.agg(F.sum("size"), F.max(F.expr(f"if({small}, size, 0)"))).first()
    if total <= limit:
        return [items]
    groups, step = -(-total // (16 * limit)), limit - longest
    order = "over (partition by part order by item, text"
    before = f"coalesce(sum(if({small}, size, 0)) {order} rows between unbounded preceding and 1 preceding), 0)"
    number = F.expr(f"if({small}, {before} div {step}, -row_number() {order}))")
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    dealt = stored(dealt.select("item", "text", "part", number.alias("number")), "decontaminate-blocks")
    names = sorted(tuple(r) for r in dealt.select("part", "number").distinct().collect())
    return [dealt.filter((F.col("part") == part) & (F.col("number") == n)) for part, n in names]


def _scanner(spark: SparkSession, windows: Windows):
    shared = spark.sparkContext.broadcast(windows)
    result = to_arrow_type(StructType.fromDDL(f"hits {HITS}")["hits"].dataType)

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        found = []
        for text, old in zip(texts.to_pylist(), before.to_pylist()):
            words = words_of(text)
            covered, items = shared.value.scan(words)
            if old is not None:  # what earlier blocks of items hit
                for start, end in zip(old["starts"], old["ends"]):
                    covered[start:end] += 1
                items.update(old["items"])
            edges = np.diff(np.concatenate(([0], covered > 0)).astype(np.int8))
            found.append({
                "n_words": len(words), "starts": np.flatnonzero(edges == 1).tolist(),
                "ends": np.flatnonzero(edges == -1).tolist(), "items": sorted(items),
            })
        return pa.array(found, result)

    return scan


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", one_in: int = 20, **options
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) per document row; see `add_hits`.

    Contaminated: at least one word in `one_in` lies in an occurrence of a window.
    """
    text_col = options.get("text_col", "text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = add_hits(rows, benchmark, **{**options, "text_col": "text", "out": "hits"})
    n_hit = F.expr("aggregate(zip_with(hits.starts, hits.ends, (s, e) -> e - s), 0L, (t, n) -> t + n)")
    found = found.select("id", "hits.n_words", n_hit.alias("n_hit"), "hits.items")
    return found.select(
        "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        is_contaminated(F.col("n_hit"), F.col("n_words"), one_in).alias("contaminated"),
    )


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, all their columns as they were."""
    out = free_name(docs, "_hits")
    found = add_hits(docs, benchmark, **options, out=out)
    n_hit = F.expr(f"aggregate(zip_with({out}.starts, {out}.ends, (s, e) -> e - s), 0L, (t, n) -> t + n)")
    return found.filter(~is_contaminated(n_hit, F.col(f"{out}.n_words"), one_in)).select(*[f"`{c}`" for c in docs.columns])
