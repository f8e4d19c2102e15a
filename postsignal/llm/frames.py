"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ensure_small_batches, scratch_path

#: Texts that a task holds as Python objects at a time.
SLICE = 1000
#: Numbers about documents up to which a table of them is broadcast: some 100 MB at most.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only these two columns, as `id` (long) and `text` (string, null as empty).

    Dropping all others first keeps scans narrow and other columns' names out of the way.
    """
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, and a
    lost executor costs no more than the stage at hand."""
    spark = ensure_small_batches(df.sparkSession)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(docs: DataFrame, table: DataFrame, keys: list[str], how: str, weight: Column | None = None) -> DataFrame:
    """Join texts with a stored table of some documents by null-safe keys, which `docs` keeps.

    A table of at most `MOST_BROADCAST` rows (or sum of `weight`, where rows are lists) is sent to the
    texts, so that these are not shuffled; a larger one is joined by its keys.
    """
    size = table.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0
    names = [free_name(docs, f"_{k}_") for k in keys]
    named = table.withColumnsRenamed(dict(zip(keys, names)))
    on = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return docs.join(F.broadcast(named) if size <= MOST_BROADCAST else named, on, how).drop(*names)


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, most: int | None = None
) -> DataFrame:
    """`mapInArrow` with a function from a batch, or from at most `most` rows of one, to columns by name."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))
    ensure_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, most or max(1, whole.num_rows)):
                batch = whole.slice(start, most)
                columns = rows(batch)
                arrays = [
                    c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                    for f, c in ((f, columns[f.name]) for f in wanted)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return df.mapInArrow(run, schema)


def in_slices(one: Callable[..., pa.Array], *columns: pa.Array, most: int | None = None) -> pa.Array:
    """A function of arrays, called for at most `most` rows at a time: bounds what is held as Python objects."""
    most = most or SLICE
    parts = [one(*(c.slice(at, most) for c in columns)) for at in range(0, len(columns[0]), most)]
    return pa.concat_arrays(parts) if parts else one(*columns)


def blocks(texts: list[str], most: int = 2_000_000):
    """Consecutive runs of texts of about `most` characters, one text at least: what a task holds split at a time."""
    start, held = 0, 0
    for n, text in enumerate(texts):
        if held and held + len(text) > most:
            yield texts[start:n]
            start, held = n, 0
        held += len(text)
    if texts[start:]:
        yield texts[start:]
