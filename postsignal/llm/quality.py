"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import in_slices, stored

#: Hashed words; structure statistics and metadata follow as groups of one-hot bins.
WORD_SLOTS = 1 << 15
BINS = 16
RATIO_EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.9])
#: Weight of each one-hot bin beside the words of a text, which share a length of one.
BIN_VALUE = 0.5
#: Most labelled rows that a fit takes, smallest hash of the id first; bounds what reaches the driver.
TRAIN_ROWS = 4000
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 64, 0.1, 1e-4, 7


def structure(text: str, words: list[str]) -> list[int]:
    """Bin numbers of what a text is built like, one per statistic."""
    if not words:
        return [0] * 14
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, chars = len(words), max(1, int(raw.sum()))
    lines = [line for line in text.split("\n") if line.strip()]
    often = Counter(words)
    letters = int(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum())
    digits, spaces = int(raw[48:58].sum()), int(raw[[9, 10, 13, 32]].sum())
    ratios = (
        sum(map(str.isupper, words)) / n,
        digits / chars,
        (chars - letters - digits - spaces) / chars,
        int(raw[ord(".")] + raw[ord(",")]) / chars,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(len(w) > 1 and not (w[-1].isalnum() or w[-2].isalnum()) for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n,
        len(often) / n,
        often.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(line.rstrip()[-1] in ".?!" for line in lines) / max(1, len(lines)),
    )
    bins = np.searchsorted(RATIO_EDGES, ratios, side="left").tolist()
    return [*bins, min(BINS - 1, n.bit_length()), min(BINS - 1, chars // n)]


def features(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one text: its distinct hashed words, its structure, its metadata.

    Metadata are numbers, binned by size; a missing one has a bin of its own.
    """
    words = (text or "").split()
    slots = list({crc32(w.lower().encode()) % WORD_SLOTS for w in set(words)})
    groups = structure(text or "", words)
    groups += [BINS - 1 if m is None else min(BINS - 2, int(abs(m)).bit_length() // 2) for m in metadata]
    bins = [WORD_SLOTS + BINS * g + b for g, b in enumerate(groups)]
    values = np.full(len(slots) + len(bins), BIN_VALUE)
    values[: len(slots)] = 1 / np.sqrt(max(1, len(slots)))
    return np.array(slots + bins, np.int64), values


class FactorisationMachine:
    """bias + sum of w x + sum over pairs of <v, v'> x x', squashed to a probability."""

    def __init__(self, slots: int, factors: int = FACTORS, seed: int = SEED):
        self.bias, self.w = 0.0, np.zeros(slots)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (slots, factors))

    def raw(self, slots: np.ndarray, values: np.ndarray) -> float:
        """Linear time: the pairs of a factor are half of (squared sum - sum of squares)."""
        scaled = self.v[slots] * values[:, None]
        pairs = (scaled.sum(axis=0) ** 2 - (scaled**2).sum(axis=0)).sum() / 2
        return float(self.bias + self.w[slots] @ values + pairs)

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(slots, values), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> None:
        """Mini-batches with step sizes that shrink per weight; the result depends on the rows' order and the seed only."""
        order = np.random.default_rng(seed)
        past_w, past_v, past_b = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            for start in range(0, len(rows), BATCH):
                pick = order.integers(0, len(rows), min(BATCH, len(rows)))
                slots = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick])
                at = np.cumsum([0] + [len(rows[i][0]) for i in pick])[:-1]
                owner = np.repeat(np.arange(len(pick)), np.diff(np.append(at, len(x))))
                scaled = self.v[slots] * x[:, None]
                sums = np.add.reduceat(scaled, at)
                pairs = (sums**2 - np.add.reduceat(scaled**2, at)).sum(axis=1) / 2
                raw = self.bias + np.add.reduceat(self.w[slots] * x, at) + pairs
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick])[owner] / len(pick)
                used, where = np.unique(slots, return_inverse=True)
                slope_w = np.bincount(where, error * x) + DECAY * self.w[used]
                each = (error * x)[:, None] * (sums[owner] - scaled)
                slope_v = np.stack([np.bincount(where, each[:, f]) for f in range(each.shape[1])], axis=1)
                slope_v += DECAY * self.v[used]
                slope_b = float(error[at].sum())
                past_w[used] += slope_w**2
                past_v[used] += slope_v**2
                past_b += slope_b**2
                self.w[used] -= RATE * slope_w / np.sqrt(past_w[used])
                self.v[used] -= RATE * slope_v / np.sqrt(past_v[used])
                self.bias -= RATE * slope_b / past_b**0.5


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a third, by the id's checksum. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata: tuple[str, ...] = ("n_chars",), train_rows: int = TRAIN_ROWS,
) -> FactorisationMachine:
    """Learn label 1 against 0 from at most `train_rows` labelled documents that are not held out.

    Rows without an id, a label of 0 or 1, or a document are ignored; equal rows
    count once. Without usable rows the model
    scores 0.5 for every text. The sample is fixed by the ids; features are made
    where the texts are, and only they come to the driver: at most `train_rows`
    rows of at most one slot per distinct hashed word.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    # The limit is the documented bound of the sample.
    sample = stored(known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows), "quality-sample")
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{c}`").cast("double").alias(f"m{n}") for n, c in enumerate(metadata)],
    )
    joined = texts.join(F.broadcast(sample), "id")  # at most train_rows rows of two numbers

    def rows(batches):
        for batch in batches:
            meta = zip(*(batch.column(f"m{n}").to_pylist() for n in range(len(metadata)))) if metadata else iter(lambda: (), None)
            made = [features(t, m) for t, m in zip(batch.column("text").to_pylist(), meta)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("y"),
                    pa.array([s.astype(np.int32) for s, _ in made], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32())),
                ],
                names=["id", "y", "slots", "values"],
            )

    made = joined.mapInArrow(rows, "id long, y int, slots array<int>, values array<float>")
    # One row per sampled label, however often its document is repeated.
    made = made.groupBy("id", "y").agg(F.min(F.struct("slots", "values")).alias("f")).select("id", "y", "f.*").collect()
    made.sort(key=lambda r: (r.id, r.y, r.slots))
    model = FactorisationMachine(WORD_SLOTS + BINS * (14 + len(metadata)))
    if made:
        model.fit(
            [(np.array(r["slots"]), np.array(r["values"], np.float64)) for r in made],
            np.array([r.y for r in made], np.float64),
        )
    return model


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> Column:
    """The score of a text column (double, 0 to 1); null and empty texts are scored by their lack of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        return in_slices(some, texts, *numbers)

    def some(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        meta = zip(*(n.to_pylist() for n in numbers)) if numbers else iter(lambda: (), None)
        return pa.array([shared.value.score(*features(t, m)) for t, m in zip(texts.to_pylist(), meta)], pa.float64())

    return scores(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`").cast("double") for c in metadata])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) per row, from a model fitted on `labels`.

    Every row gets a score, those with null or empty texts, null ids and null
    metadata too; repeated rows repeat. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, **options)
    metadata = options.get("metadata", ("n_chars",))
    made = docs.select(F.col(f"`{id_col}`").alias("id"), score(docs, model, text_col, metadata).alias("score"))
    return made.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, with their columns as they were."""
    model = fit(docs, labels, id_col, text_col, **options)
    metadata = options.get("metadata", ("n_chars",))
    return docs.filter(score(docs, model, text_col, metadata) >= 0.5)
