"""Keep-first de-duplication. An arrival key decides what is first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_hash
from .ranking import first_per_group


def dedupe_by_hash(df: DataFrame, order_by: list, hash_column: str = "content_hash") -> DataFrame:
    """First row per content hash; rows without a hash are dropped."""
    hashed = df.filter(F.col(hash_column).isNotNull() & (F.col(hash_column) != ""))
    return first_per_group(hashed, [hash_column], order_by)


def dedupe_by_content(
    df: DataFrame, order_by: list, content: str = "content", within: tuple[str, ...] = ()
) -> DataFrame:
    """First row per text (and `within` columns), compared by SHA-256 of the text."""
    hashed = df.withColumn("_text_hash", content_hash(F.col(content)))
    return first_per_group(hashed, [*within, "_text_hash"], order_by).drop("_text_hash")
