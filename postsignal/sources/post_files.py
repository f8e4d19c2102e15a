"""Parquet source and sink for posts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import values

LIST_COLUMNS = ("mentions", "hashtags")

# Fixed value: default name of a written post file.
NAME_FORMAT = "tweets_%Y%m%d_%H%M%S.parquet"


def encode_lists(df: DataFrame) -> DataFrame:
    """Legacy layout: list columns as comma-joined text."""
    return df.withColumns({c: values.encode_list(F.col(c)) for c in LIST_COLUMNS})


def decode_lists(df: DataFrame) -> DataFrame:
    """List columns of the legacy layout as arrays; native arrays pass through."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: values.decode_list(F.col(c)) for c in LIST_COLUMNS if types.get(c) == "string"}
    )


def write_posts(
    df: DataFrame, folder: str, name: str | None = None, as_of: datetime | None = None,
    legacy_lists: bool = False,
) -> str:
    """Write posts as snappy Parquet and return the path, `""` for no posts.

    Dictionary encoding is Parquet's default. Whole partitions are written in
    parallel, so the named path is a folder of part files.
    """
    path = f"{folder.rstrip('/')}/{name or (as_of or datetime.now()).strftime(NAME_FORMAT)}"
    if df.isEmpty():
        return ""
    out = encode_lists(df) if legacy_lists else df
    out.write.option("compression", "snappy").parquet(path)
    return path


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return decode_lists(spark.read.parquet(path))


def to_posts(df: DataFrame) -> DataFrame:
    """Select and cast to the post schema; times become instants."""
    return schema.conform(df, schema.POSTS)
