"""Near-duplicate documents by SetSketch registers over word shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .components import components
from .frames import SLICE, beside, id_and_text, map_batches, stored

#: Bands of a sketch, and registers of a band: of two sets with a similarity of 0.8
#: none of the bands agrees with a chance of 1 in 70 million.
BANDS, ROWS = 56, 6
REGISTERS = BANDS * ROWS
#: Registers are steps of the logarithm to this base, from 0 to 255; the rate moves a set of one to the lower end.
BASE, RATE, TOP = 1.09, 20.0, 255
#: Links: 100 times the intersection is at least this times the union.
LEAST = 80
#: A pair is confirmed unless its registers are this many standard errors less likely at 0.8 than at their best.
SIGMAS = 6
#: Rounds of stars per level, and levels of bands.
TURNS, LEVELS = 2, 3
#: Members of a bucket up to which they are compared one by one, and in blocks.
FEW, MANY = 8, 16_384
#: Sets on the two sides of a block, and shingles of a side.
OUTER, INNER, WEIGHT = 256, 1024, 250_000

_FACTORS = np.random.default_rng(12).integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
_CHUNK = 512
#: Similarities at which a likelihood is looked at.
POINTS = 41


def shingles(text: str, words: int = 2) -> np.ndarray:
    """Sorted XXH64 values of a text's distinct word shingles; fewer words make one shingle, none make none.

    A-Z are lower-cased; words end at ASCII white space.
    """
    found = text.encode().lower().split()
    if len(found) < words:
        runs = {b" ".join(found)} if found else set()
    else:
        runs = {b" ".join(run) for run in zip(*(found[i:] for i in range(words)))}
    return np.unique(np.fromiter(map(xxh64_intdigest, runs), np.uint64, len(runs)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """A set's sketch: per register the truncated logarithm of the least of exponential variables, one per element.

    All elements' variables are one permutation's values, so the least of a
    union is the lesser of two: sketches merge by the greater register.
    """
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(values), _CHUNK):
        np.minimum(least, (values[start : start + _CHUNK, None] * _FACTORS).min(axis=0), out=least)
    exponential = -np.log1p(-(least + 1.0) / (2.0**32 + 1)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(above, below, size_a, size_b, similarity):
    """Log-likelihood of a similarity, given how many registers of a stand above and below those of b."""
    differing = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    share = size_a / (size_a + size_b)
    more = differing(share - (1 - share) * similarity)
    less = differing((1 - share) - share * similarity)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    return above * safe(more) + below * safe(less) + (REGISTERS - above - below) * safe(1 - more - less)


def estimate(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, log of how much likelier it is than 0.8) for rows of registers and set sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    size_a, size_b = sizes_a[:, None].astype(float), sizes_b[:, None].astype(float)
    highest = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    grid = np.linspace(0, 1, POINTS)[None, :] * highest
    each = _log_likelihood(above, below, size_a, size_b, grid)
    best = each.argmax(axis=1)
    limit = _log_likelihood(above, below, size_a, size_b, np.minimum(LEAST / 100, highest))[:, 0]
    rows = np.arange(len(best))
    return grid[rows, best], each[rows, best] - limit


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2) -> DataFrame:
    """Stored rows (row, id, n, digest, regs, text): a number of its own, set size, digest of the set, registers."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [shingles(t, words) for t in batch.column("text").to_pylist()]
        return {
            "id": batch.column("id"), "text": batch.column("text"), "n": [len(h) for h in found],
            "digest": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in found],
            "regs": [registers(h).tobytes() if len(h) else None for h in found],
        }

    schema = "id long, n long, digest binary, regs binary, text string"
    made = map_batches(id_and_text(df, id_col, text_col), rows, schema, most=SLICE)
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _fits(a: str, b: str) -> Column:
    """Sizes that a similarity of 0.8 allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


class _Confirmed:
    """Links between distinct sets: candidates go by likelihood, then over the full sets."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, words: int):
        self.nodes, self.words = nodes, words
        self.texts = docs.select(F.col("row").alias("node"), "text")
        self.roots: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """Keep those of the pairs (a, b) that are links."""
        pairs = stored(pairs, "sketch-pairs")
        met = stored(beside(self.nodes, _ends(pairs), ["node"], "inner"), "sketch-met")
        end = lambda c: met.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
        known = pairs.join(end("a"), "a").join(end("b"), "b")
        likely = stored(map_batches(known, _likely, "a long, b long"), "sketch-likely")
        sets = self._sets(_ends(likely))
        side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}"))
        both = likely.join(side("a"), "a").join(side("b"), "b")
        self._join(stored(map_batches(both, _verified, "a long, b long"), "sketch-links"))

    def add_blocks(self, members: DataFrame) -> None:
        """Compare the members of open buckets outside their largest class with all of that class, and with each other.

        The buckets of a class are taken together, so that copies that share many bands
        are compared once. Both sides are cut into blocks, and a task compares two blocks
        in arrays: by likelihood, then over the full sets. What it returns are links
        of different classes, one for a set and another class, never the pairs.
        """
        rows = members.select("main", "node", "root", (F.col("root") != F.col("main")).alias("out")).distinct()
        rows = stored(rows.join(self.nodes.select("node", "n"), "node"), "sketch-sides")
        size = lambda which, most: F.greatest(
            F.ceil(F.count_if(which) / most), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / WEIGHT), F.lit(1)
        ).cast("int")
        cuts = rows.groupBy("main").agg(size(F.col("out"), OUTER).alias("outer"), size(F.lit(True), INNER).alias("inner"))
        cut = rows.join(stored(cuts, "sketch-cuts"), "main")
        part = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
        every = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
        left = cut.filter("out").select("main", "node", "root", "out", F.lit(True).alias("query"), part("outer").alias("i"), F.explode(every("inner")).alias("j"))
        right = cut.select("main", "node", "root", "out", F.lit(False).alias("query"), F.explode(every("outer")).alias("i"), part("inner").alias("j"))
        these = stored(rows.select("node").distinct(), "sketch-ends")
        sets = self._sets(these).join(beside(self.nodes.select("node", "regs"), these, ["node"], "inner"), "node")
        dealt = left.unionByName(right).join(sets, "node")
        found = dealt.groupBy("main", "i", "j").applyInArrow(_block, "a long, b long")
        self._join(stored(found, "sketch-links"))

    def _sets(self, ends: DataFrame) -> DataFrame:
        """(node, hashes) of the full sets of these nodes, stored."""
        words = self.words

        def hashed(batch: pa.RecordBatch) -> dict:
            found = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            return {"node": batch.column("node"), "hashes": found}

        texts = beside(self.texts, ends, ["node"], "inner")
        return stored(map_batches(texts, hashed, "node long, hashes binary", most=SLICE), "sketch-sets")

    def _join(self, links: DataFrame) -> None:
        """Put classes together along new links; `roots` (node, root) has all linked nodes."""
        if self.roots is None:
            self.roots = stored(components(links), "sketch-roots")
            return
        for c in "ab":
            known = self.roots.select(F.col("node").alias(c), F.col("root").alias("top"))
            links = links.join(known, c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        moved = stored(components(links.filter("a != b")), "sketch-moved")
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = self.roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new = moved.join(self.roots.select("node"), "node", "left_anti").select("node", "root")
        self.roots = stored(old.unionByName(new), "sketch-roots")


def _ends(pairs: DataFrame) -> DataFrame:
    """The different nodes of pairs, stored."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return stored(both.distinct(), "sketch-ends")


def _likely(batch: pa.RecordBatch) -> dict:
    rows = lambda c: np.frombuffer(b"".join(batch.column(f"regs_{c}").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    size = lambda c: batch.column(f"n_{c}").to_numpy()
    best, lead = estimate(rows("a"), rows("b"), size("a"), size("b"))
    keep = pa.array((best * 100 >= LEAST) | (2 * lead <= SIGMAS**2))
    return {c: batch.column(c).filter(keep) for c in "ab"}


def _verified(batch: pa.RecordBatch) -> dict:
    keep = []
    for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        keep.append(100 * both >= LEAST * (len(a) + len(b) - both))
    return {c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"}


def _block(rows: pa.Table) -> pa.Table:
    """Links of the block's queries with its other rows of another class."""
    query = rows.column("query").to_numpy()
    number, root, out = (rows.column(c).to_numpy() for c in ("node", "root", "out"))
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
    size = np.array([len(h) for h in sets])
    one, other = np.flatnonzero(query), np.flatnonzero(~query)
    pairs = []
    for start in range(0, len(one), 16):
        rows_a = one[start : start + 16]
        a, b = np.repeat(rows_a, len(other)), np.tile(other, len(rows_a))
        # Two members outside the largest class meet twice.
        open_ = (root[a] != root[b]) & (~out[b] | (number[a] < number[b]))
        open_ &= 100 * np.minimum(size[a], size[b]) >= LEAST * np.maximum(size[a], size[b])
        a, b = a[open_], b[open_]
        if len(a):
            best, lead = estimate(regs[a], regs[b], size[a], size[b])
            near = (best * 100 >= LEAST) | (2 * lead <= SIGMAS**2)
            pairs.append((a[near], b[near]))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
    if len(a):
        both = _intersections(sets, one, other)[np.searchsorted(one, a), np.searchsorted(other, b)]
        link = 100 * both >= LEAST * (size[a] + size[b] - both)
        a, b = a[link], b[link]
        # One link for a set and another class is enough for the classes.
        _, kept = np.unique(np.stack([a, root[b]]), axis=1, return_index=True)
        a, b = a[kept], b[kept]
    return pa.table({"a": pa.array(number[a], pa.int64()), "b": pa.array(number[b], pa.int64())})


def _intersections(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray, columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of their incidence with some elements at a time."""
    known = np.unique(np.concatenate([sets[i] for i in one]))
    counts = np.zeros((len(one), len(other)), np.float64)
    for start in range(0, len(known), columns):
        part = known[start : start + columns]

        def incidence(which: np.ndarray) -> np.ndarray:
            out = np.zeros((len(which), len(part)), np.float32)
            for row, i in enumerate(which):
                own = sets[i]
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                at = np.searchsorted(part, own)
                out[row, at[part[at] == own]] = 1
            return out

        counts += incidence(one) @ incidence(other).T
    return counts.astype(np.int64)


def _shared(keys: DataFrame) -> DataFrame:
    """Rows whose key another row has too, stored."""
    twice = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    return stored(keys.join(twice, "key"), "sketch-members")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several classes, with their class, the bucket's largest class and its size."""
    if roots is None:
        named = members.withColumn("root", F.col("node"))
    else:
        named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "sketch-named")
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("m"))
    buckets = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("classes"), F.sum("m").alias("size")
    )
    return stored(named.join(buckets.filter("classes > 1").drop("classes"), "key"), "sketch-open")


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Every member with its bucket's hub: the first in an order drawn for the turn.

    The order is the same in all buckets, so that sets that share many buckets have few hubs.
    """
    drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "root", "n")).alias("hub")
    met = members.join(members.groupBy("key").agg(drawn), "key").filter(F.col("root") != F.col("hub.root"))
    return _pairs(met.filter(_fits("n", "hub.n")), "node", "hub.node")


def _crossed(members: DataFrame) -> DataFrame:
    """Every two members of different classes of a bucket: for buckets of `FEW` members at most."""
    side = lambda c: members.select("key", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "root")])
    met = side("x").join(side("y"), "key").filter((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")))
    return _pairs(met.filter(_fits("n_x", "n_y")), "node_x", "node_y")


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _keys(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the buckets dealt anew by every later band beside their own."""
    known = members.select("key", "band", "node", "n").join(nodes.select("node", "regs"), "node")
    each = known.select("key", "node", "n", "regs", F.explode(F.expr(f"filter(sequence(0, {BANDS - 1}), b -> b > band)")).alias("band"))
    return each.select(F.xxhash64("key", "band", _band()).alias("key"), "band", "node", "n")


def _band() -> Column:
    return F.substring(F.col("regs"), F.col("band") * ROWS + 1, F.lit(ROWS))


def _classes(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame | None:
    """(node, root) of all linked distinct sets; None if no two share a band.

    Sets meet in the buckets of equal bands. No bucket is compared in all pairs:
    first its members meet one hub, drawn anew in every turn, so that most copies are
    one class. Then only pairs of different classes are open. Buckets of
    few members compare these one by one, larger ones in blocks (see
    `_Confirmed.add_blocks`). A bucket of more than `MANY` is dealt anew by a second band that must
    agree as well: sets that share little but a common passage part there, near ones
    share many bands. On the last level blocks take all.
    """
    confirmed = _Confirmed(nodes, docs, words)
    each = nodes.select("node", "n", "regs", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    members = _shared(each.select(F.xxhash64("band", _band()).alias("key"), "band", "node", "n"))
    for level in range(1, LEVELS + 1):
        left = _open(members, confirmed.roots)
        for turn in range(TURNS):
            if left.isEmpty():
                break
            confirmed.add(_stars(left, turn))
            left = _open(members, confirmed.roots)
        if left.isEmpty():
            break
        most = MANY if level < LEVELS else F.col("size")
        confirmed.add(_crossed(left.filter(F.col("size") <= FEW)))
        confirmed.add_blocks(left.filter((F.col("size") > FEW) & (F.col("size") <= most)))
        many = left.filter((F.col("size") > FEW) & (F.col("size") > most))
        if many.isEmpty():
            break
        members = _shared(_keys(many, nodes))
    return confirmed.roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row.

    Rows are linked if their sets of word shingles have a similarity of 0.8 or
    more; component_id is the smallest id that can be reached over links, the row's
    own included, and kept says that it is the row's own. Rows without a word, null
    and empty texts, are linked with nothing. Rows without an id take part; they
    get the class's id (null if it has none) and are kept only in a class without
    ids. Repeated rows stay repeated, rows that share an id are judged by their
    own texts, other columns are ignored, and an empty table gives no rows. Equal sets
    are one node, however many rows have them. Very long texts are sketched
    in chunks; their whole sets are compared.
    """
    docs = sketches(df, id_col, text_col, words)
    distinct = docs.filter("n > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("id").alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs")
    )
    nodes = stored(distinct, "sketch-nodes")
    roots = _classes(nodes, docs, words)
    rooted = nodes.select("digest", "first", F.col("node").alias("root"))
    if roots is not None:
        named = nodes.select("digest", "first", "node").join(roots, "node", "left")
        rooted = named.select("digest", "first", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "sketch-rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("least")), "sketch-least")
    classes = stored(rooted.select("digest", "root").join(smallest, "root").select("digest", "least"), "sketch-classes")
    linked = docs.filter("n > 0").select("digest", "id", "n").join(classes, "digest").select("id", "n", "least")
    alone = docs.filter("n = 0").select("id", "n", F.col("id").alias("least"))
    return linked.unionByName(alone).select(
        "id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"),
    )
