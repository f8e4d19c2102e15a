"""Encoding and decoding text columns with a public BPE file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import SLICE, id_and_text, map_batches
from .wordbpe import load


def encode(texts: Column, path: str) -> Column:
    """Token ids (array<int>) of a text column; a null or empty text has none.

    `path` is a tokenizer file that every executor can open.
    """

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return load(path).encode_array(column)

    return ids(F.coalesce(texts.cast("string"), F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included; null ids decode to ''."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return load(path).decode_array(column).cast(pa.string())

    return text(F.coalesce(ids.cast("array<int>"), F.array().cast("array<int>")))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) per row.

    Only the two columns are used, so other columns and their names do not
    matter. Ids may be null or repeated; a null or empty text gives no tokens and
    ''. Very long texts are encoded whole. An empty table gives no rows. Nothing
    is shuffled.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        ids = load(path).encode_array(batch.column("text"))
        return {"id": batch.column("id"), "ids": ids, "decoded": load(path).decode_array(ids)}

    # One call makes both, since Spark would encode anew for each column that uses the ids.
    return map_batches(id_and_text(df, id_col, text_col), rows, "id long, ids array<int>, decoded string", most=SLICE)


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode_documents`."""
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
