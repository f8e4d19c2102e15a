"""Token ids in wavelet-matrix shards: one compressed file each, with access, rank and select."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .files import create, new_folder, open_at
from .frames import id_and_text, stored
from .wordbpe import load

MAGIC = b"WVMX1\0"
#: Bits of a plane per compressed block; a rank needs one block and one running count.
BLOCK_BITS = 1 << 16
#: Tokens after which a shard is closed and the next begun.
SHARD_TOKENS = 4_000_000


def build(ids: np.ndarray, starts: np.ndarray, docs: list, out) -> int:
    """Write a shard of ids (unsigned 32-bit) to a stream; returns its bytes.

    Plane by plane from the highest bit, the ids are split into those with a 0 and
    those with a 1, order kept. The file has the planes in compressed blocks, then
    a footer (block offsets, ones before each block, zeros of each plane,
    document starts), then its length.
    """
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    written = out.write(MAGIC)
    packer = zstandard.ZstdCompressor(level=3)
    offsets, ones, zeros = [], [], []
    order = ids.astype(np.uint32)
    for bit in reversed(range(bits)):
        plane = (order >> np.uint32(bit)) & np.uint32(1) == 1
        counted = 0
        for at in range(0, len(plane), BLOCK_BITS):
            piece = plane[at : at + BLOCK_BITS]
            ones.append(counted)
            offsets.append(written)
            written += out.write(packer.compress(np.packbits(piece).tobytes()))
            counted += int(np.count_nonzero(piece))
        zeros.append(len(plane) - counted)
        order = np.concatenate((order[~plane], order[plane]))
    arrays = [np.array(offsets + [written], "<u8"), np.array(ones, "<u8"), np.array(zeros, "<u8"), starts.astype("<u8")]
    head = json.dumps({"n": len(ids), "bits": bits, "sizes": [len(a) for a in arrays], "docs": docs}).encode()
    footer = packer.compress(struct.pack("<Q", len(head)) + head + b"".join(a.tobytes() for a in arrays))
    written += out.write(footer)
    return written + out.write(struct.pack("<Q", len(footer)) + MAGIC)


class Shard:
    """Reads a shard file: single tokens, counts and places of a token, documents, or everything.

    Only the footer is held; blocks are read when a query needs them.
    """

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = bytes(file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC)))
        if tail[8:] != MAGIC:
            raise ValueError("not a shard file")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = zstandard.decompress(bytes(file.read_at(length, size - 8 - len(MAGIC) - length)))
        held = struct.unpack("<Q", footer[:8])[0]
        head, at = json.loads(footer[8 : 8 + held]), 8 + held
        self.n, self.bits, self.docs = head["n"], head["bits"], head["docs"]
        self.per_plane = -(-self.n // BLOCK_BITS)
        arrays = []
        for count in head["sizes"]:
            arrays.append(np.frombuffer(footer, "<u8", count, at).astype(np.int64))
            at += 8 * count
        self.offsets, self.ones, self.zeros, self.starts = arrays
        self.recent: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint8))

    def _block(self, plane: int, number: int) -> np.ndarray:
        at = plane * self.per_plane + number
        if self.recent[0] != at:
            raw = self.file.read_at(int(self.offsets[at + 1] - self.offsets[at]), int(self.offsets[at]))
            bits = np.frombuffer(zstandard.decompress(bytes(raw)), np.uint8)
            self.recent = (at, np.unpackbits(bits, count=min(BLOCK_BITS, self.n - number * BLOCK_BITS)))
        return self.recent[1]

    def _ones_before(self, plane: int, place: int) -> int:
        """Ones of a plane before a place, 0 to n."""
        if place >= self.n:
            return self.n - int(self.zeros[plane])
        number, rest = divmod(place, BLOCK_BITS)
        return int(self.ones[plane * self.per_plane + number]) + int(np.count_nonzero(self._block(plane, number)[:rest]))

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        token = 0
        for plane in range(self.bits):
            number, rest = divmod(place, BLOCK_BITS)
            bit, before = int(self._block(plane, number)[rest]), self._ones_before(plane, place)
            token = 2 * token + bit
            place = int(self.zeros[plane]) + before if bit else place - before
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones_before(plane, start), self._ones_before(plane, stop)
            if token >> (self.bits - 1 - plane) & 1:
                start, stop = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token stands in [start, stop)."""
        first, last = self._range(token, start, self.n if stop is None else stop)
        return last - first

    def select(self, token: int, nth: int) -> int:
        """The place of a token's nth occurrence, from 0."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= nth < last - first:
            raise IndexError(nth)
        place = first + nth
        for plane in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - plane) & 1
            place = self._nth(plane, bit, place - int(self.zeros[plane]) if bit else place)
        return place

    def _nth(self, plane: int, bit: int, nth: int) -> int:
        """The place of the nth 0 or 1 of a plane: the block by its running count, then within it."""
        ones = self.ones[plane * self.per_plane : (plane + 1) * self.per_plane]
        before = ones if bit else np.arange(self.per_plane) * BLOCK_BITS - ones
        number = int(np.searchsorted(before, nth, side="right")) - 1
        return number * BLOCK_BITS + int(np.flatnonzero(self._block(plane, number) == bit)[nth - int(before[number])])

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        values = np.zeros(self.n, np.uint32)
        for plane in reversed(range(self.bits)):
            parts = [self._block(plane, k) for k in range(self.per_plane)]
            bit = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
            zeros, back = int(self.zeros[plane]), np.empty_like(values)
            back[~bit] = values[:zeros]
            back[bit] = values[zeros:] | np.uint32(1 << (self.bits - 1 - plane))
            values = back
        return values


def write(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode texts and write shards in ascending id order; returns the stored list of shards.

    The list has archive (address), part and number (which order the shards) and
    tokens. Each document's ids end with `end_id`. A null text is empty; null ids
    come first; rows of one id are ordered by their text's hash, then text, and are
    documents of their own. Other columns are ignored; an empty table gives no
    shards. A document is never split, so a shard holds `shard_tokens` ids or
    the one document that goes beyond them.

    Rows are range-partitioned by id once, as text, so that the sampling of
    bounds reads but does not encode, and texts are sorted within partitions only. A
    shard counts once its task is committed in the returned list.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("sig", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "sig").sortWithinPartitions("id", "sig", "text").select("id", "text")
    folder = new_folder(df.sparkSession, "tokens")
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = load(path), TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            address, out = create(folder, ".wvm")
            with out:
                build(np.concatenate(parts), np.array([0, *accumulate(sizes)]), docs, out)
            return pa.RecordBatch.from_pylist([{"archive": address, "part": part, "number": number, "tokens": held}])

        for batch in batches:
            names, coded = batch.column("id").to_pylist(), coder.encode_array(batch.column("text"))
            ends, ids = coded.offsets.to_numpy(), coded.values.to_numpy().astype(np.uint32)
            for name, start, stop in zip(names, ends[:-1].tolist(), ends[1:].tolist()):
                if docs and held + stop - start + len(tail) > shard_tokens:
                    yield close()
                    docs, sizes, parts, held, number = [], [], [], 0, number + 1
                docs.append(name)
                parts += [ids[start:stop], tail]
                sizes.append(stop - start + len(tail))
                held += sizes[-1]
        if docs:
            yield close()

    schema = "archive string, part long, number long, tokens long"
    return stored(ordered.mapInArrow(shards, schema), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from the files of a list of shards.

    `start` is the number of ids in all documents before. The totals of shards are
    added up within their part, and the parts' totals over the parts, of which there are as
    many as range partitions; the driver gets no more than the number of shards, and the ids
    never leave the tasks that read them. Shards are dealt out one by one.
    """
    before = lambda window: F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("above"))
    own = shards.select("archive", "part", "number", before(Window.partitionBy("part").orderBy("number")).alias("first"))
    placed = own.join(parts, "part").select("archive", (F.col("above") + F.col("first")).alias("first"), "part", "number")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                with open_at(one["archive"]) as file:
                    shard = Shard(file)
                    ids = shard.tokens().astype("<u4")
                first = one["first"]
                spans = list(zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.docs, pa.int64()), pa.array([first + a for a, _ in spans], pa.int64()),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array([crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                    ],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "id long, start long, n_tokens long, ids_crc32 long"
    return placed.repartition(max(1, shards.count())).mapInArrow(rows, schema)
