"""Stored tables on a shared file system, without a table format.

Each write is a folder of its own that is never changed afterwards, a
generation. It counts once Spark has committed it (its `_SUCCESS` file is
there), so lost executors, failed jobs and replays leave readers with whole data.
Inside it, rows may lie in a folder per day, and the values that must be unique
in a narrow table beside, split by a hash of the value.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions.values import utc
from ..operators import keyed

#: Kinds of generation: rows added to what is there, or the whole table anew.
ADDED, WHOLE = "added", "whole"
#: Parts that the unique values of a table are split into.
PARTS = 16
_NAME = re.compile(r"gen=(\d+)-(added|whole)-([^/]+)$")


class Generation(NamedTuple):
    number: int
    kind: str
    owner: str

    @property
    def folder(self) -> str:
        return f"gen={self.number:010d}-{self.kind}-{self.owner}"


class StoredTable:
    """A table of generations; with `key` an upsert table, with `unique` columns a table of unique values.

    Without a key the live rows are those of the newest `whole` generation and all
    later ones. With a key they are the newest row of each key in them, and
    `keep_old` columns keep the value of the key's oldest row: a write costs what its
    batch costs, wherever the batch's keys were stored before, and a read groups
    by key. `compact` folds the generations into one.

    With `unique`, `insert` adds only rows whose values of these columns are all
    new. It reads the stored values of the batch's parts, never a row. With `day`, a
    time column, rows lie in a folder per day and in its order, so that
    `read(since=…)` opens the days it needs.

    `owner` names a write: writing again under one's own name replaces that write
    (a replayed micro-batch, a repeated run), and nothing ever replaces another's.
    Numbers only grow. Inserts are unique if one writer inserts at a time.
    """

    def __init__(
        self, spark: SparkSession, path: str, ddl: str, key: str | None = None, keep_old: tuple[str, ...] = (),
        unique: tuple[str, ...] = (), day: str | None = None,
    ):
        self.spark, self.path, self.key, self.keep_old = spark, path.rstrip("/"), key, keep_old
        self.unique, self.day = unique, day
        self.schema = StructType.fromDDL(ddl)

    def _committed(self, folder: str) -> dict[str, int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        target = hadoop.Path(f"{folder}/gen=*/_SUCCESS")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(target) or []
        return {str(s.getPath().getParent().getName()): int(s.getModificationTime()) for s in found}

    def commits(self) -> dict[Generation, int]:
        """Committed generations in order, each with the time of its last write; a few bytes per write."""
        times = self._committed(self.path)
        if self.unique:
            valued = self._committed(f"{self.path}/values")
            times = {n: t for n, t in times.items() if n in valued}
        found = [(m, times[m.string]) for m in map(_NAME.match, times) if m]
        return dict(sorted((Generation(int(m[1]), m[2], m[3]), t) for m, t in found))

    def generations(self) -> list[Generation]:
        """Committed generations in order; one entry per write, a few bytes each."""
        return list(self.commits())

    def place(self, owner: str | None) -> tuple[int, str]:
        """(number, owner) of a write: its own number if it was committed before, else the next."""
        done = self.generations()
        owner = owner or uuid.uuid4().hex
        own = [g.number for g in done if g.owner == owner]
        return (own[0] if own else max((g.number for g in done), default=-1) + 1), owner

    def _live(self, before: int | None = None) -> list[Generation]:
        live = [g for g in self.generations() if before is None or g.number < before]
        wholes = [n for n, g in enumerate(live) if g.kind == WHOLE]
        return live[wholes[-1] :] if wholes else live

    def _rows(self, live: list[Generation]) -> DataFrame:
        reader = self.spark.read.schema(self._layout()).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{g.folder}" for g in live])

    def _layout(self) -> StructType:
        known = StructType(list(self.schema.fields))
        return (known.add("_day", "date") if self.day else known).add("gen", "string")

    def read(
        self, before: int | None = None, since: datetime | None = None, days: list | None = None,
        without: frozenset[Generation] = frozenset(),
    ) -> DataFrame:
        """Live rows; `before` hides generations from that number on, `since` rows older than that time.

        `days` are the dates to be read. In a table with a key, both take it for granted that the
        rows of a key are of one day. `without` leaves out what some writes stored.
        """
        names = self.schema.fieldNames()
        live = [g for g in self._live(before) if g not in without]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(live)
        if since is not None:
            rows = rows.filter((F.col("_day") >= F.lit(utc(since)).cast("date")) & (F.col(self.day) >= F.lit(utc(since))))
        if days is not None:
            rows = rows.filter(F.col("_day").isin(days))
        if self.key is None or len(live) == 1:
            return rows.select(*names)
        number = F.regexp_extract("gen", r"^(\d+)-", 1).cast("long")
        kept = [c for c in names if c != self.key]
        newest = rows.withColumn("_gen", number).groupBy(self.key).agg(
            F.max_by(F.struct(*kept), "_gen").alias("_row"),
            *[F.min_by(c, "_gen").alias(f"_old_{c}") for c in self.keep_old],
        )
        pick = {c: F.coalesce(f"_old_{c}", f"_row.{c}") if c in self.keep_old else F.col(f"_row.{c}") for c in kept}
        return newest.select(*[F.col(c) if c == self.key else pick[c].alias(c) for c in names])

    def generation(self, written: Generation) -> DataFrame:
        """What one write stored."""
        return self._rows([written]).select(*self.schema.fieldNames())

    def parts(self, batch: DataFrame, columns: tuple[str, ...] | None = None) -> dict[str, list[int]]:
        """The parts that the batch has values of unique columns in: numbers, at most `PARTS` a column."""
        named = [F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("value")) for c in columns or self.unique]
        values = batch.select(F.explode(F.array(*named)).alias("v")).select("v.*").filter("value is not null")
        found: dict[str, list[int]] = {}
        for row in values.select("of", _part("value")).distinct().collect():
            found.setdefault(row.of, []).append(row.part)
        return found

    def taken(
        self, column: str, batch: DataFrame, before: int | None = None, parts: dict[str, list[int]] | None = None
    ) -> DataFrame:
        """Those of the batch's values of a unique column that are stored, once each.

        Only the `parts` that the batch has values in are read; they are looked up if not given.
        """
        values = batch.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
        live = self._live(before)
        if live and parts is None:
            parts = self.parts(batch, (column,))
        parts = parts.get(column) if live else None
        if not parts:
            return self.spark.createDataFrame([], f"{column} string")
        reader = self.spark.read.schema("value string, gen string, of string, part int").option("basePath", f"{self.path}/values")
        stored = reader.parquet(*[f"{self.path}/values/{g.folder}" for g in live])
        stored = stored.filter((F.col("of") == column) & F.col("part").isin(parts)).select("value")
        return stored.join(values, "value", "left_semi").select(F.col("value").alias(column))

    def _write(self, df: DataFrame, number: int, kind: str, owner: str) -> Generation:
        made = Generation(number, kind, owner)
        rows = df.select(*self.schema.fieldNames())
        by = []
        if self.day:
            # AQE cuts a day with most of the rows into several files and joins small ones.
            rows = rows.withColumn("_day", F.to_date(self.day)).hint("rebalance", F.col("_day"))
            rows, by = rows.sortWithinPartitions("_day", self.day), ["_day"]
        out = rows.write.mode("overwrite").option("compression", "snappy")
        out.partitionBy(*by).parquet(f"{self.path}/{made.folder}")
        if self.unique:
            of = [
                self.generation(made).select(F.lit(c).alias("of"), F.col(c).cast("string").alias("value"))
                for c in self.unique
            ]
            values = reduce(DataFrame.unionByName, of).filter("value is not null").withColumn("part", _part("value"))
            values = values.hint("rebalance", F.col("of"), F.col("part")).sortWithinPartitions("of", "part", "value")
            values.write.mode("overwrite").partitionBy("of", "part").parquet(f"{self.path}/values/{made.folder}")
        return made

    def insert(
        self, batch: DataFrame, order_by: list, owner: str | None = None, among: DataFrame | None = None, watch=lambda df: df
    ) -> Generation:
        """Add the rows whose unique values are all new, to the store and to rows earlier in `order_by`.

        Columns are looked at one after the other: a row left out for its first
        value takes none of the others. Null values never clash. `among` may give the
        batch's values where the batch itself is costly or observed, and `watch` sees
        the rows that are written.
        """
        number, owner = self.place(owner)
        rows, first, among = batch, self.unique[0], batch if among is None else among
        parts = self.parts(among) if self._live(number) else {}
        for column in self.unique:
            new = rows.join(self.taken(column, among, number, parts), column, "left_anti")
            rows = keyed.unique_id_guard(new, column, first, order_by)
        return self._write(watch(rows.select(*self.schema.fieldNames())), number, ADDED, owner)

    def append(self, batch: DataFrame, owner: str | None = None) -> Generation:
        """Add all rows."""
        number, owner = self.place(owner)
        return self._write(batch, number, ADDED, owner)

    def insert_if_absent(self, batch: DataFrame, key: str, order_by: list, owner: str | None = None) -> Generation:
        """Add the rows (first per key) whose key is not stored yet."""
        number, owner = self.place(owner)
        return self._write(keyed.insert_if_absent(self.read(number), batch, key, order_by), number, ADDED, owner)

    def upsert(
        self, batch: DataFrame, order_by: list | None = None, owner: str | None = None, unique: bool = False
    ) -> Generation:
        """Insert or replace by the table's key; of a batch's rows of one key the last in order counts.

        `unique` says that the batch has one row per key already: nothing is shuffled to find the last.
        """
        number, owner = self.place(owner)
        rows = batch if unique else keyed.last_per_key(batch, self.key, order_by or [])
        return self._write(rows, number, ADDED, owner)

    def retain(self, parents: DataFrame, key: str, owner: str | None = None) -> Generation:
        """Keep only the rows whose key still has a parent; the rest is no longer read."""
        number, owner = self.place(owner)
        return self._write(keyed.cascade(self.read(number), parents, key), number, WHOLE, owner)

    def compact(self, owner: str | None = None) -> Generation:
        """Fold all live rows into one generation, so that later reads list and group less."""
        number, owner = self.place(owner)
        return self._write(self.read(number), number, WHOLE, owner)


def _part(value: str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int").alias("part")


def post_store(spark: SparkSession, path: str) -> StoredTable:
    """The stored posts: unique by hash and, where they have one, by post id; a folder per day."""
    return StoredTable(spark, path, schema.POSTS, unique=("content_hash", "tweet_id"), day="ts")


def refused_store(spark: SparkSession, path: str) -> StoredTable:
    """What was refused, with the reason: posts as JSON, pages as the line that was read."""
    return StoredTable(spark, path, schema.REFUSED)
