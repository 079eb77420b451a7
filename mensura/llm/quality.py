"""Quality classifier (5): Naive Bayes support vectors.

n-gram indicators are scaled by the log-count ratio of their class shares; a linear
hinge-loss model over them is fitted by dual coordinate descent. Margins of models
that did not see a row calibrate the score, so that it is a probability.

The fit uses at most ``most_rows`` labelled documents (a parameter, 8,000 by default).
Null and empty texts get the score of the bias alone. Without labels, or with one class,
every score is that class's share (1/2 without any). Repeated rows are scored each. An
empty table gives an empty result. Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import doc_columns, each_piece, read, ship_package
from mensura.llm.linear import BITS, Features, Rows, crc_of_id, distinct, hinge_by_dual_coordinates, labelled_sample, log_count_ratios, logistic, margins, sigmoid, word_and_form_features


class NaiveBayesSupportVectors:
    def __init__(self, features: Features = word_and_form_features, cost: float = 1.0, folds: int = 3):
        self.features, self.cost, self.folds = features, cost, folds
        self.square = self.weight = np.zeros(1 << BITS, np.float32)
        self.bias, self.slope, self.shift = 0.0, 0.0, 0.0

    def fit(self, rows: Rows, y: np.ndarray) -> NaiveBayesSupportVectors:
        share = float(y.mean()) if len(y) else 0.5
        if not 0 < share < 1:
            self.shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
            return self
        scale, w, bias = self._one(rows, y)
        fold, out = np.arange(len(y)) % self.folds, np.zeros(len(y))
        for k in range(self.folds):
            inside, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(held) and 0 < y[inside].mean() < 1:
                out[held] = margins(rows.take(held), *self._one(rows.take(inside), y[inside]))
        line, _ = logistic(np.stack([np.ones(len(y)), out], 1), None, np.zeros(0), y, rounds=600)
        self.shift, self.slope, self.bias = float(line[0]), float(max(line[1], 1e-3)), bias
        self.weight, self.square = (scale * w).astype(np.float32), (scale**2).astype(np.float32)
        return self

    def _one(self, rows: Rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        scale = log_count_ratios(rows, y)
        return scale, *hinge_by_dual_coordinates(rows, scale, np.where(y > 0, 1.0, -1.0), self.cost)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, bucket = self.features(data, off)
        has = self.square[bucket] > 0
        row, bucket = distinct(row[has], bucket[has])
        n = len(off) - 1
        norm = np.sqrt(np.bincount(row, self.square[bucket], n))
        margin = np.bincount(row, self.weight[bucket], n) / np.where(norm > 0, norm, 1) + self.bias
        return sigmoid(self.slope * margin + self.shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, most_rows: int = 8000) -> NaiveBayesSupportVectors:
    rows, y = labelled_sample(docs, labels, [label], most_rows, word_and_form_features, where)
    return NaiveBayesSupportVectors().fit(rows, y[0])


def scored(docs: DataFrame, model: NaiveBayesSupportVectors, score: str = "score") -> DataFrame:
    """(doc_id, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in each_piece(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(data, off), pa.float64())], names=["doc_id", score])

    return doc_columns(docs).mapInArrow(run, f"doc_id long, {score} double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = fit(docs, read(spark, sf_dir, "labels"), where=~held_out)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
