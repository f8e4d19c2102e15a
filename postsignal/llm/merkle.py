"""A dataset manifest as a Merkle tree, with proofs by a recursive query."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sampling import global_index
from .frames import stored

#: Columns of a leaf, in the order they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Binary levels that one stored row spans: a row holds the siblings up to the next stored level.
STRIDE = 8
WIDTH = 1 << STRIDE
#: Rows above the leaves, of some 400 bytes each, that are broadcast.
MOST_BROADCAST = 100_000
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_STEPS = ", ".join(str(n) for n in range(STRIDE))
# The hashes of every level of a block, from hex text to hex text; the last node of an odd level is hashed alone.
_LEVELS = f"""
    aggregate(slice(array({_STEPS}), 1, height), array(transform(members, m -> lower(hex(m.hash)))),
      (done, l) -> concat(done, array(transform(
        sequence(0, (size(element_at(done, -1)) - 1) div 2),
        i -> sha2(concat(get(element_at(done, -1), 2 * i), coalesce(get(element_at(done, -1), 2 * i + 1), '')), 256)))))"""
_SIBLINGS = f"""
    transform(slice(array({_STEPS}), 1, height),
      l -> unhex(get(get(levels, l), shiftright(cast(m.pos % {WIDTH} as int), l) ^ 1)))"""


def _folded(start: str, row: str) -> str:
    """SQL: the hex hash `start` carried up over the siblings of `row`; bits of its position say on which side they stand."""
    sibling = f"lower(hex(get({row}.siblings, k)))"
    return f"""
    aggregate(slice(array({_STEPS}), 1, size({row}.siblings)), {start}, (now, k) -> case
      when get({row}.siblings, k) is null then sha2(now, 256)
      when (shiftright({row}.pos, k) & 1) = 1 then sha2(concat({sibling}, now), 256)
      else sha2(concat(now, {sibling}), 256) end)"""


def _appended(start: str, row: str) -> str:
    return f"concat({start}, aggregate({row}.siblings, X'', (all, s) -> concat(all, coalesce(s, X''))))"


class Manifest(NamedTuple):
    """Stored tree rows, each with node, parent, pos, siblings, hash and block's top: `leaves` also with id and forged."""

    leaves: DataFrame
    above: DataFrame


def leaf_hash(fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """Hex SHA-256 of a row: per field `-` if null, else its UTF-8 byte count, a colon and the value."""

    def part(name: str) -> Column:
        value = (changed or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def build(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
    forged: Column | None = None,
) -> Manifest:
    """The tree of all rows: one subtree per group, and one tree over the subtrees' roots.

    Leaves stand in the order of their ids (null first), rows of one id in the
    order of their hashes, so partitions do not change the tree; repeated rows are
    leaves of their own. Groups stand null first, then bytewise. `forged` is a
    leaf hash to be checked in place of the row's own; null means its own. Other
    columns are ignored. An empty table gives no leaves. Texts, however long,
    are read once, and only hashes move on.

    A stored level is 8 binary levels above the one before: nodes are dealt to
    blocks of 256 neighbours, and a row keeps the siblings on its way to its block's
    top, the row of the next stored level that it names as its parent. The
    number of shuffles grows with the logarithm to the base 256 of the largest
    group, and no task holds more than a block at a time.
    """
    hashed = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{group_col}`").cast("string").alias("grp"),
        F.unhex(leaf_hash(fields)).alias("hash"),
        F.unhex(F.lit(None).cast("string") if forged is None else forged).alias("forged"),
        # Tells equal rows apart, so that many of them make no single range.
        F.rand().alias("salt"),
    )
    indexed = global_index(stored(hashed, "merkle-leaves"), ["grp", "id", "hash", "salt"]).rows.drop("salt")
    groups = stored(indexed.groupBy("grp").agg(F.min("idx").alias("first"), F.count("*").alias("n")), "merkle-groups")
    numbered = global_index(groups, ["grp"])
    named = stored(numbered.rows.withColumnRenamed("grp", "name"), "merkle-named")
    level = indexed.join(named.withColumnRenamed("idx", "tree"), F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("tree").cast("string").alias("tree"), (F.col("idx") - F.col("first")).alias("pos"), "n", "hash", "id", "forged",
    )
    (leaves, *inner), subroots = _grown(level, F.concat(F.lit("-.0."), "tree"))
    level = subroots.select(
        F.lit("-").alias("tree"), F.col("tree").cast("long").alias("pos"),
        F.lit(numbered.count).cast("long").alias("n"), "hash",
    )
    outer, _ = _grown(level, F.lit(None).cast("string"))
    names = ["node", "parent", "pos", "siblings", "hash", "top"]
    above = outer[0].select(*names)
    for rows in (*outer[1:], *inner):
        above = above.unionByName(rows.select(*names))
    return Manifest(leaves, stored(above, "merkle-above"))


def _grown(level: DataFrame, above: Column) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels, finished trees' `tree` and `hash`) from rows of tree, pos, n (the tree's nodes here) and hash.

    `above` names the parent of a finished tree's top; it is null at the end of all.
    """
    levels, finished = [], None
    while True:
        rows = _rows(level, len(levels), above)
        levels.append(rows)
        tops = rows.filter(F.col("pos") % WIDTH == 0).select(
            "tree", F.expr(f"pos div {WIDTH}").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"),
            F.col("top").alias("hash"),
        )
        done = tops.filter("n = 1").select("tree", "hash")
        finished = done if finished is None else finished.unionByName(done)
        level = tops.filter("n > 1")
        if level.isEmpty():
            return levels, finished


def _rows(level: DataFrame, depth: int, above: Column) -> DataFrame:
    """One stored level: every node with its siblings up to its block's top, and the top's hash."""
    others = [c for c in level.columns if c not in ("tree", "n", "pos")]
    blocks = level.groupBy("tree", "n", F.expr(f"pos div {WIDTH}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *others))).alias("members")
    )
    # A block of a larger tree rises to the next stored level, that of a small one to its only node.
    height = F.when(F.col("n") > WIDTH, STRIDE).when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    built = blocks.withColumn("height", height.cast("int")).withColumn("levels", F.expr(_LEVELS))
    each = built.select("tree", "n", "block", "height", "levels", F.explode("members").alias("m"))
    own = lambda at, n: F.concat(F.col("tree"), F.lit(f".{at}."), F.col(n).cast("string"))
    parent = F.when(F.col("n") > WIDTH, own(depth + 1, "block")).otherwise(above)
    rows = each.withColumn("pos", F.col("m.pos")).select(
        own(depth, "pos").alias("node"), parent.alias("parent"), "tree", "n", "pos",
        *[F.col(f"m.{c}").alias(c) for c in others], F.expr(_SIBLINGS).alias("siblings"),
        F.unhex(F.get(F.element_at("levels", -1), F.lit(0))).alias("top"),
    )
    return stored(rows, "merkle-level")


def climb(manifest: Manifest) -> DataFrame:
    """Per leaf its way to the root: id, leaf, subroot, root, proof (all siblings, 32 bytes each) and folded.

    A recursive query takes all leaves from row to parent row at once, appends the
    row's siblings and folds the leaf (its forged hash, where it has one) with
    them. It ends at the root after as many steps as there are stored levels.
    Rows above the leaves are a 255th of them: up to `MOST_BROADCAST` rows, at most some 50 MB, are
    sent to all tasks, more are joined by their name, where AQE splits the rows that most
    leaves pass.
    """
    spark, above = manifest.leaves.sparkSession, manifest.above
    if above.count() <= MOST_BROADCAST:
        above = F.broadcast(above)
    steps = spark.sql(
        f"""
        with recursive climb (id, leaf, at, folded, proof, subroot, root) as (
          select l.id, l.hash, l.parent, {_folded("lower(hex(coalesce(l.forged, l.hash)))", "l")},
                 {_appended("X''", "l")}, cast(null as binary), cast(null as binary)
          from {{leaves}} l
          union all
          select c.id, c.leaf, u.parent, {_folded("c.folded", "u")}, {_appended("c.proof", "u")},
                 case when startswith(u.node, '-.0.') then u.hash else c.subroot end,
                 case when u.parent is null then u.top end
          from climb c join {{above}} u on u.node = c.at
        )
        select id, leaf, subroot, root, proof, folded from climb where at is null
        """,
        leaves=manifest.leaves, above=above,
    )
    with _unlimited(spark):
        return stored(steps, "merkle-climb")


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a number of rows by default; theirs grow with the table."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def proofs(climbed: DataFrame) -> DataFrame:
    """The climb in hex, the proof as the SHA-256 of its siblings' hex text, and whether the leaf proves the root."""
    text = lambda c: F.lower(F.hex(c))
    return climbed.select(
        "id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == text("root")).alias("verified"),
    )
