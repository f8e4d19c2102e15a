"""Truncated SVD of sparse rows by a randomised range finder, for vocabularies whose Gram matrix is too large.

A few random directions are multiplied by XᵀX, which one pass over the rows does, made
orthonormal, and multiplied again. All directions so far span a space that soon holds
the leading components; there the problem is as small as the number of directions. The driver
holds matrices of terms × directions, never terms × terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Random directions beside the wanted components, most passes, and the relative change of singular values to stop at.
OVERSAMPLE, MOST_PASSES, TOLERANCE = 30, 16, 1e-9
#: Terms in one block of a product, lanes a block is first added up in, and cells multiplied at a time.
BLOCK, LANES, CELLS = 512, 16, 50_000
#: Numbers that these cells make with the rows of a matrix, at most: a wider one takes fewer cells.
NUMBERS = 1 << 21


def product(rows: DataFrame, vector: str, basis: np.ndarray) -> DataFrame:
    """XᵀX times `basis`, as (i, sums): one row per term that occurs. Sparse ml vectors, one pass, two aggregations.

    A task adds up its own rows before it sends anything, in blocks of terms; blocks are
    added up in lanes first, so that no task gets more than a lane's share of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis))
    width = basis.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            lists = batch.column("indices")
            offsets = lists.offsets.to_numpy()
            columns = lists.flatten().to_numpy()
            values = batch.column("values").flatten().to_numpy()
            offsets = offsets - offsets[0]
            sums = np.zeros(shared.value.shape) if sums is None else sums
            for start, end in row_steps(offsets, width):
                _add(sums, columns[offsets[start] : offsets[end]], values[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1]), shared.value)
        if sums is not None:
            lane = TaskContext.get().partitionId() % LANES
            for first in range(0, len(sums), BLOCK):
                if sums[first : first + BLOCK].any():
                    yield pa.RecordBatch.from_pydict(
                        {"block": [first // BLOCK], "lane": [lane], "cells": [sums[first : first + BLOCK].tobytes()]},
                        schema=pa.schema([("block", pa.int32()), ("lane", pa.int32()), ("cells", pa.binary())]),
                    )

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c) for c in pdf["cells"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "lane": pdf["lane"].iloc[:1], "cells": [total.tobytes()]})

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                matrix = np.frombuffer(cells).reshape(-1, width)
                used = np.flatnonzero(matrix.any(axis=1))
                flat = pa.array(matrix[used].ravel())
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array((used + block * BLOCK).astype(np.int32)), sums], ["i", "sums"])

    sparse = F.unwrap_udt(F.col(vector))
    cells = rows.select(sparse["indices"].alias("indices"), sparse["values"].alias("values"))
    schema = "block int, lane int, cells binary"
    laned = cells.mapInArrow(partial, schema).groupBy("block", "lane").applyInPandas(added, schema)
    whole = laned.groupBy("block").applyInPandas(added, schema)
    return whole.mapInArrow(rows_of, "i int, sums array<double>")


def row_steps(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, one row at least, whose cells make at most `NUMBERS` numbers with rows of `width`."""
    most, start = max(1, min(CELLS, NUMBERS // max(1, width))), 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def _add(sums: np.ndarray, columns: np.ndarray, values: np.ndarray, sizes: np.ndarray, basis: np.ndarray) -> None:
    """Add xᵀ(x·basis) of some sparse rows x to `sums`."""
    if not len(columns):
        return
    row = np.repeat(np.arange(len(sizes)), sizes)
    filled = np.flatnonzero(sizes)
    scores = np.zeros((len(sizes), basis.shape[1]))
    scores[filled] = np.add.reduceat(basis[columns] * values[:, None], np.concatenate(([0], np.cumsum(sizes)[:-1]))[filled])
    order = np.argsort(columns, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(columns[order]) != 0)))
    sums[columns[order][starts]] += np.add.reduceat(scores[row[order]] * values[order][:, None], starts)


def _product(rows: DataFrame, vector: str, basis: np.ndarray) -> np.ndarray:
    """The product on the driver: terms × directions, as many numbers as `basis` has."""
    out = np.zeros(basis.shape)
    found = product(rows, vector, basis).toArrow()
    for batch in found.to_batches():
        out[batch.column("i").to_numpy()] = batch.column("sums").flatten().to_numpy().reshape(-1, basis.shape[1])
    return out


def components(
    rows: DataFrame, vector: str, n_terms: int, k: int, seed: int = 42, oversample: int = OVERSAMPLE,
    most_passes: int = MOST_PASSES, tolerance: float = TOLERANCE,
) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, singular values) of the leading `k` components of stored sparse rows.

    Every pass multiplies a block of directions and adds it to the space; it ends
    when no singular value changes by more than `tolerance`, or when the space is
    whole, and then the result is exact.
    """
    width = min(n_terms, k + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    space, images = np.zeros((n_terms, 0)), np.zeros((n_terms, 0))
    last = np.zeros(0)
    for _ in range(most_passes):
        image = _product(rows, vector, block)
        space, images = np.hstack([space, block]), np.hstack([images, image])
        small = space.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:k]
        singular = np.sqrt(np.clip(values[top], 0.0, None))
        settled = len(last) == len(singular) and (np.abs(singular - last) <= tolerance * max(singular[0], 1e-300)).all()
        rest = min(width, n_terms - space.shape[1])
        if settled or not rest:
            break
        last, fresh = singular, image[:, :rest]
        for _ in range(2):  # twice, for rounding
            fresh = fresh - space @ (space.T @ fresh)
        fresh, upper = np.linalg.qr(fresh)
        strong = np.abs(np.diag(upper)) > 1e-12 * max(singular[0] ** 2, 1e-300)
        if not strong.any():
            break
        block = fresh[:, strong]
        block = np.linalg.qr(block - space @ (space.T @ block))[0]
    return space @ turns[:, top], singular
