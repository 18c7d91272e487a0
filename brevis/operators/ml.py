"""The boundary to models: small interfaces with deterministic defaults.

Neural tokenizers, embedders, scorers and generators plug in as functions of
columns (pandas or Arrow UDFs that load a model once a worker)."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.types import VECTORS
from brevis.operators.similarity import unit

Tokenizer = Callable[[Column], Column]  # string -> array<string>
Scorer = Callable[[DataFrame], DataFrame]  # adds ``score``
Generator = Callable[[Column], Column]  # source -> hypothesis

DIMENSIONS = 64
MOST_TOKENS = 512
#: Tokens whose unit vectors a worker keeps, in 256 bytes each.
KNOWN_TOKENS = 1 << 18


def word_tokens(x: Column, most: int = MOST_TOKENS) -> Column:
    return F.slice(T.rouge_tokens(x, unicode=True), 1, most)


def hashed_vector(token: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed pseudo-random vector for each token."""
    return np.random.default_rng(zlib.crc32(token.encode())).standard_normal(dimensions).astype(np.float32)


class Units:
    """Hashed vectors of tokens at unit length, each made once; after ``most`` tokens the
    table is begun anew."""

    def __init__(self, most: int = KNOWN_TOKENS):
        self.most, self.place, self.rows = most, {}, np.empty((1 << 10, DIMENSIONS), np.float32)

    def of(self, tokens: list[str]) -> np.ndarray:
        """A row a token; one row of zeros for none."""
        if not tokens:
            return np.zeros((1, DIMENSIONS), np.float32)
        if len(self.place) >= self.most:
            self.place.clear()
        new = [t for t in dict.fromkeys(tokens) if t not in self.place]
        if new:
            at, end = len(self.place), len(self.place) + len(new)
            if end > len(self.rows):
                grown = np.empty((max(end, 2 * len(self.rows)), DIMENSIONS), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at:end] = unit(np.stack([hashed_vector(t) for t in new]))
            self.place.update(zip(new, range(at, end)))
        return self.rows[[self.place[t] for t in tokens]]


@functools.cache
def known_units() -> Units:
    """The worker's table."""
    return Units()


@F.pandas_udf(VECTORS)
def hashed_embeddings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The default embedder: array<string> -> a vector a token, kept by a worker."""
    known: dict[str, np.ndarray] = {}

    def vector(token: str) -> np.ndarray:
        if token not in known:
            known[token] = hashed_vector(token)
        return known[token]

    for column in batches:
        if len(known) > 200_000:
            known.clear()
        yield pd.Series([[vector(t) for t in (tokens if tokens is not None else ())] for tokens in column])


def lead(source: Column, sentences: int = 3) -> Column:
    """The default generator: the first sentences."""
    return F.array_join(F.slice(T.sentences(source), 1, sentences), " ")


def set_overlap(sentence: Column, summary: Column) -> Column:
    """The default scorer: F of a sentence's distinct words against the summary's."""
    x, y = F.array_distinct(T.rouge_tokens(sentence)), F.array_distinct(T.rouge_tokens(summary))
    return F.round(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0)), 6)


def scored_sentences(pairs: DataFrame, least: int = 50, scorer: Callable[[Column, Column], Column] = set_overlap) -> DataFrame:
    """doc_id, sent_ord, sentence, score for text sentences of ``least`` code points;
    rows of empty lists go by that length (see explode_segments)."""
    rows = pairs.select("doc_id", "summary", F.posexplode_outer("sents").alias("sent_ord", "sentence")).where(F.length("sentence") >= least)
    return rows.select("doc_id", "sent_ord", "sentence", scorer(F.col("sentence"), F.array_join("summary", " ")).alias("score"))


def train_regressor(rows: DataFrame, text: str = "input_text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    """The default regressor of a sentence's label: hashed words, IDF, ridge regression."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}0-9]+")
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    # the steps of the fit read their rows several times: made and hashed once for all
    given = hashed.transform(words.transform(rows)).select(label, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf = IDF(inputCol="_tf", outputCol="_features").fit(given)
        line = LinearRegression(featuresCol="_features", labelCol=label, predictionCol="score", regParam=0.1).fit(idf.transform(given))
    finally:
        given.unpersist()
    return PipelineModel([words, hashed, idf, line])


def regressor_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("_words", "_tf", "_features")


def length_figures(df: DataFrame, tokens: Column) -> DataFrame:
    """Longest and mean number of tokens that are not padding."""
    n = F.size(F.filter(tokens, lambda t: t != ""))
    return df.agg(F.max(n).alias("max_len"), F.round(F.avg(n), 4).alias("gen_len"))
