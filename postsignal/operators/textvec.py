"""TF-IDF over words and word pairs, and a truncated SVD of it.

Counting terms is one aggregation by term. Vectors are then made row by row in
the JVM from a vocabulary of bounded size, so a document is never exploded over
the cluster and put together again.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.lexicon import STOP_WORDS
from ..session import scratch_path
from . import rangefinder

# Bounds on the vocabulary: the Gram matrix on the driver has its square as size, the
# randomised decomposition some hundred numbers per term.
VOCABULARY_BOUND, RANDOMISED_BOUND = 4096, 1 << 18
# How many times the vocabulary's size of frequent words is looked at.
FREQUENT_WORDS = 4
# Terms that a sketch of frequent terms tracks; a term it has lost is at most this share of
# all terms, which is what Spark's sketch of that size guarantees.
TRACKED = 1 << 16


@dataclass(frozen=True)
class VectorConfig:
    max_features: int = 1000
    components: int = 50
    min_df: int = 2
    max_df: float = 0.95
    stop_words: tuple[str, ...] = STOP_WORDS
    # `gram` decomposes the Gram matrix, `randomised` looks for the range of the vectors.
    solver: str = "gram"

    def __post_init__(self):
        bounds = {"gram": VOCABULARY_BOUND, "randomised": RANDOMISED_BOUND}
        if self.solver not in bounds:
            raise ValueError(f"unknown solver: {self.solver}")
        if not 0 < self.max_features <= bounds[self.solver]:
            raise ValueError(f"max_features must be between 1 and {bounds[self.solver]}")


def token_list(content: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of a text without stop words."""
    return F.filter(text.tokens(content), lambda t: ~t.isin(*stop_words))


def term_list(content: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words and adjacent word pairs of a text, stop words taken out first."""
    return text.ngrams_1_2(token_list(content, stop_words))


def term_counts(terms: DataFrame, column: str = "terms", among: DataFrame | None = None) -> DataFrame:
    """Per term its total count `ctf` and document count `df`; of all terms, or of a bounded table `among`.

    Each document contributes its terms and, after them, its distinct terms, so
    both counts come from one aggregation by term and no (document, term) shuffle.
    """
    seen = F.concat(column, F.array_distinct(column))
    # The outer form does not compute the term list twice to test its size.
    each = terms.select(F.size(column).alias("_n"), F.posexplode_outer(seen).alias("_pos", "term"))
    each = each.filter(F.col("term").isNotNull())
    if among is not None:
        each = each.join(F.broadcast(among), "term", "left_semi")
    return (
        each.groupBy("term")
        .agg(
            F.count_if(F.col("_pos") < F.col("_n")).alias("ctf"),
            F.count_if(F.col("_pos") >= F.col("_n")).alias("df"),
        )
    )


def prune_terms(counts: DataFrame, n_docs: int, config: VectorConfig) -> DataFrame:
    return counts.filter((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * n_docs))


def top_terms(pruned: DataFrame, config: VectorConfig) -> DataFrame:
    """The most frequent terms; ties go to the smaller term."""
    return pruned.orderBy(F.desc("ctf"), "term").limit(config.max_features)


@dataclass
class TextVectors:
    """A fitted vocabulary with its weights and, after `fit_svd`, its components."""

    config: VectorConfig
    n_docs: int
    terms: list[str]
    idf: list[float]
    loadings: np.ndarray | None = None
    singular_values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weigh(
        self, df: DataFrame, content: str = "content", output: str = "tfidf", words: str | None = None
    ) -> DataFrame:
        """Add the L2-normalised TF-IDF vector (sparse) of a text, or of its listed words. Row by row, no shuffle."""
        if not self.terms:
            raise ValueError("no term survived pruning")
        counted = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_tf")
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted"
        )
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
        terms = text.ngrams_1_2(F.col(words)) if words else term_list(F.col(content), self.config.stop_words)
        out = df.withColumn("_terms", terms)
        for step in (counted, scaled, unit):
            out = step.transform(out)
        return out.drop("_terms", "_tf", "_weighted")

    def project(self, weighed: DataFrame, vector: str = "tfidf", output: str = "components") -> DataFrame:
        """Add the component scores X·V as an array, a batch of rows per product."""
        loadings = self.loadings

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scores(indices: pa.Array, values: pa.Array) -> pa.Array:
            sizes = np.diff(indices.offsets.to_numpy())
            columns, weights = indices.flatten().to_numpy(), values.flatten().to_numpy()
            sums = np.zeros((len(sizes), loadings.shape[1]))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for start, end in rangefinder.row_steps(ends, loadings.shape[1]):
                cells = slice(ends[start], ends[end])
                parts = loadings[columns[cells]] * weights[cells, None]
                filled = start + np.flatnonzero(sizes[start:end])
                if len(filled):
                    sums[filled] = np.add.reduceat(parts, ends[filled] - ends[start])
            offsets = np.arange(len(sizes) + 1, dtype=np.int32) * loadings.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums.ravel()))

        # Only the non-zero cells go to Python.
        sparse = F.unwrap_udt(F.col(vector))
        return weighed.withColumn(output, scores(sparse["indices"], sparse["values"]))

    def transform(self, df: DataFrame, content: str = "content", output: str = "tfidf") -> DataFrame:
        """Add the component scores of each text; without a fit, an empty array."""
        if self.loadings is None or not self.terms:
            k = self.config.components if self.loadings is not None else 0
            return df.withColumn(output, F.array_repeat(F.lit(0.0), k))
        weighed = self.weigh(df, content, "_vector")
        return self.project(weighed, "_vector", output).drop("_vector")


def stored_words(df: DataFrame, content: str, config: VectorConfig, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The word lists (`words`) of all texts, written once: every later step of a fit reads them.

    `keep` columns go with them, so that texts need not be split again for their vectors.
    """
    path = scratch_path(df.sparkSession, "words")
    made = df.select(*keep, token_list(F.col(content), config.stop_words).alias("words"))
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def choose_terms(words: DataFrame, n_docs: int, config: VectorConfig) -> list[Row]:
    """The `top_terms` of all word lists as (term, ctf, df) rows, at most `max_features`.

    Distinct word pairs outnumber everything else in a large corpus, so they are
    not all counted. A pair is never more frequent than its words: once the
    single words alone fill the vocabulary, only pairs of two words as frequent
    as its last entry can enter, and the others are dropped before counting.
    Without such a bound, a sketch finds the frequent terms (see `heavy_terms`), and
    only where that cannot prove its result every term is counted.
    """
    words = words.select(F.col("words").alias("terms"))
    # A bounded number of rows, from the most frequent word down.
    reach = FREQUENT_WORDS * config.max_features
    frequent = term_counts(words).orderBy(F.desc("ctf"), "term").limit(reach).collect()
    singles = [
        r for r in frequent if r.df >= config.min_df and r.df <= config.max_df * n_docs
    ][: config.max_features]
    full = len(singles) == config.max_features
    if not full or (len(frequent) == reach and frequent[-1].ctf == singles[-1].ctf):
        terms = words.select(text.ngrams_1_2(F.col("terms")).alias("terms"))
        heavy = heavy_terms(terms, n_docs, config)
        return heavy if heavy is not None else top_terms(prune_terms(term_counts(terms), n_docs, config), config).collect()
    allowed = [r.term for r in frequent if r.ctf >= singles[-1].ctf]
    pairs = words.select(frequent_pairs(F.col("terms"), allowed).alias("terms"))
    chosen = singles + top_terms(prune_terms(term_counts(pairs), n_docs, config), config).collect()
    return sorted(chosen, key=lambda r: (-r.ctf, r.term))[: config.max_features]


def heavy_terms(terms: DataFrame, n_docs: int, config: VectorConfig) -> list[Row] | None:
    """The `top_terms` of all term lists by a sketch of frequent items; None where it cannot prove them.

    Every task keeps the counts of at most `TRACKED` terms, and the sketches merge, so the
    distinct terms, which outnumber all else, are not shuffled. A term that the merged sketch
    does not hold is no more frequent than its error bound. The terms that it holds
    are counted exactly; if the last one chosen is above the bound, no other belongs among them.
    """
    each = terms.select(F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull())
    # At most TRACKED terms and their counts reach the driver.
    found = each.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(term, {TRACKED}, {TRACKED})").alias("top")).first()
    held = terms.sparkSession.createDataFrame([(item.item,) for item in found.top or []], "term string")
    counted = sorted(term_counts(terms, among=held).collect(), key=lambda r: (-r.ctf, r.term))
    chosen = [r for r in counted if r.df >= config.min_df and r.df <= config.max_df * n_docs][: config.max_features]
    slots = 1 << math.ceil(math.log2(TRACKED / 0.75))
    above = len(chosen) == config.max_features and chosen[-1].ctf > 3.5 * found.n / slots
    # Or the sketch has lost nothing.
    return chosen if above or sum(r.ctf for r in counted) == found.n else None


def frequent_pairs(words: Column, allowed: list[str]) -> Column:
    """Adjacent pairs whose two words are both allowed."""
    known = F.transform(words, lambda w: F.when(w.isin(*allowed), w))
    return F.filter(text.adjacent_pairs(known), lambda pair: pair.isNotNull())


def fit_vocabulary(df: DataFrame, content: str = "content", config: VectorConfig | None = None) -> TextVectors:
    """Choose the vocabulary over all texts of `df`."""
    cfg = config or VectorConfig()
    return _fit_words(stored_words(df, content, cfg), cfg)


def _fit_words(words: DataFrame, cfg: VectorConfig) -> TextVectors:
    n_docs = words.count()
    rows = sorted(choose_terms(words, n_docs, cfg), key=lambda r: r.term)
    idf = [math.log((1 + n_docs) / (1 + r.df)) + 1 for r in rows]
    return TextVectors(cfg, n_docs, [r.term for r in rows], idf)


def fit_svd(model: TextVectors, weighed: DataFrame, vector: str = "tfidf") -> TextVectors:
    """Truncated SVD, exact through the Gram matrix of the term columns, or by the randomised range finder.

    The Gram matrix (terms × terms, bounded) is added up in the cluster; only
    that small matrix is decomposed on the driver. The randomised solver holds terms ×
    directions instead and reads the stored vectors once per pass. The largest
    loading of each component is made positive, the first one on ties.
    """
    k = min(model.config.components, len(model.terms))
    if model.config.solver == "randomised":
        return _settle(model, *rangefinder.components(weighed, vector, len(model.terms), k))
    rows = MLUtils.convertVectorColumnsFromML(weighed.select(vector), vector)
    gram = RowMatrix(rows, numCols=len(model.terms)).computeGramianMatrix().toArray()
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][:k]
    return _settle(model, vectors[:, top], np.sqrt(np.clip(values[top], 0.0, None)))


def _settle(model: TextVectors, loadings: np.ndarray, singular_values: np.ndarray) -> TextVectors:
    strongest = np.abs(loadings).round(12).argmax(axis=0)
    signs = np.sign(loadings[strongest, np.arange(loadings.shape[1])])
    model.loadings = loadings * np.where(signs == 0, 1.0, signs)
    model.singular_values = singular_values
    return model


_TERMS = "position int, term string, idf double, loadings array<double>"
_META = "n_docs bigint, config string, singular_values array<double>, fitted boolean"


def save(model: TextVectors, spark: SparkSession, path: str) -> None:
    """Store a model below a new path: a table of terms with weights and loadings, and one row about the fit."""
    fitted = model.loadings is not None
    loadings = model.loadings if fitted and model.terms else np.zeros((len(model.terms), 0))
    rows = [(n, t, float(w), [float(x) for x in loadings[n]]) for n, (t, w) in enumerate(zip(model.terms, model.idf))]
    spark.createDataFrame(rows, _TERMS).write.parquet(f"{path}/terms")
    about = (model.n_docs, json.dumps(asdict(model.config)), [float(v) for v in model.singular_values], fitted)
    spark.createDataFrame([about], _META).coalesce(1).write.parquet(f"{path}/fit")


def load(spark: SparkSession, path: str) -> TextVectors:
    """A stored model; it reads as many rows as its vocabulary has."""
    rows = spark.read.schema(_TERMS).parquet(f"{path}/terms").orderBy("position").collect()
    about = spark.read.schema(_META).parquet(f"{path}/fit").first()
    config = json.loads(about.config)
    config = VectorConfig(**{**config, "stop_words": tuple(config["stop_words"])})
    model = TextVectors(config, about.n_docs, [r.term for r in rows], [r.idf for r in rows])
    if about.fitted:
        model.loadings = np.array([r.loadings for r in rows]) if rows else np.zeros((0, 0))
    model.singular_values = np.array(about.singular_values)
    return model


def fit(df: DataFrame, content: str = "content", config: VectorConfig | None = None) -> TextVectors:
    """Vocabulary and components over all texts.

    Word lists and sparse vectors are written once to the shared scratch folder:
    texts are split into words a single time, and adding up the Gram matrix reads
    only the vectors.
    """
    return fit_transform(df, [], content, config)[0]


def fit_weigh(
    df: DataFrame, keep: list[str], content: str = "content", config: VectorConfig | None = None, output: str = "tfidf"
) -> tuple[TextVectors, DataFrame]:
    """A fitted vocabulary and the sparse vectors (with the `keep` columns) of the same texts, split into words once."""
    cfg = config or VectorConfig()
    words = stored_words(df, content, cfg, keep)
    model = _fit_words(words, cfg)
    return model, model.weigh(words, output=output, words="words").select(*keep, output) if model.terms else words.select(*keep)


def fit_transform(
    df: DataFrame, keep: list[str], content: str = "content", config: VectorConfig | None = None, output: str = "tfidf"
) -> tuple[TextVectors, DataFrame]:
    """A fitted model and the component scores (with the `keep` columns) of the same texts, from their stored vectors."""
    model, weighed = fit_weigh(df, keep, content, config, "_vector")
    if not model.terms:
        model.loadings = np.zeros((0, 0))
        return model, model.transform(weighed, output=output)
    path = scratch_path(df.sparkSession, "vectors")
    weighed.write.parquet(path)
    vectors = df.sparkSession.read.schema(weighed.schema).parquet(path)
    fit_svd(model, vectors, "_vector")
    return model, model.project(vectors, "_vector", output).drop("_vector")


def feature_map(components: Column, count: int) -> Column:
    """Component scores as a map `tfidf_0` … to value."""
    names = F.array(*[F.lit(f"tfidf_{i}") for i in range(count)])
    return F.map_from_arrays(names, components)


def weights_long(weighed: DataFrame, model: TextVectors, key: str, vector: str = "tfidf") -> DataFrame:
    """Non-zero weights as (key, term, weight) rows."""
    sparse = F.unwrap_udt(F.col(vector))
    cells = F.arrays_zip(sparse["indices"].alias("i"), sparse["values"].alias("weight"))
    kept = weighed.select(key, F.inline_outer(cells).alias("i", "weight"))
    names = F.array(*[F.lit(t) for t in model.terms])
    kept = kept.filter(F.col("i").isNotNull() & (F.col("weight") != 0))
    return kept.select(key, F.get(names, F.col("i")).alias("term"), "weight")
