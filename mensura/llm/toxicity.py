"""Toxicity (4): a classifier chain over toxicity categories.

The categories are predicted in order; each later linear (logistic) model also sees the
probabilities of the earlier ones. In training those are out-of-fold predictions, as
unseen documents give, not fitted ones. The categories derived from the labels here are
toxic text of poor quality, toxic text that reads well, and any toxic text, which decides.

The fit uses at most ``most_rows`` labelled documents (a parameter, 12,000 by default).
Null and empty texts are scored by the biases alone and so follow the labels' base rate.
A category without two classes has its share as constant probability. Repeated rows are
scored each. An empty table gives an empty result. Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from mensura.llm.common import beside, each_piece, lean, read, ship_package
from mensura.llm.linear import BITS, Features, Rows, distinct, labelled_sample, log_count_ratios, logistic, sigmoid, word_and_stem_features

#: Category names in the chain's order; the last decides.
CATEGORIES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "toxic_poor": lambda toxic, quality: toxic * (1 - quality),
    "toxic_fluent": lambda toxic, quality: toxic * quality,
    "toxic": lambda toxic, quality: toxic,
}


class ClassifierChain:
    def __init__(self, names: list[str], features: Features = word_and_stem_features, folds: int = 3, least_ratio: float = 1.0):
        self.names, self.features, self.folds, self.least_ratio = names, features, folds, least_ratio
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def fit(self, rows: Rows, y: np.ndarray) -> ClassifierChain:
        """y: a line of 0 and 1 for each category."""
        n = len(rows)
        earlier = np.ones((n, 1))
        fold = np.arange(n) % self.folds
        for target in y:
            self.links.append(self._link(rows, earlier, target))
            out = np.zeros(n)
            for k in range(self.folds):
                inside, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                dense, weight = self._link(rows.take(inside), earlier[inside], target[inside])
                out[held] = sigmoid(earlier[held] @ dense + rows.take(held).dot(weight))
            earlier = np.column_stack([earlier, out])
        # A feature counts if any link weighs it.
        return self

    def _link(self, rows: Rows, earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            dense = np.zeros(earlier.shape[1])
            dense[0] = 20.0 if share == 1 else -20.0
            return dense, np.zeros(1 << BITS)
        scale = log_count_ratios(rows, y, least_rows=5, least_ratio=self.least_ratio)
        dense, w = logistic(earlier, rows.limited(scale != 0), scale, y)
        return dense, scale * w

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A line for each category."""
        n = len(off) - 1
        row, bucket = self.features(data, off)
        used = self._used()
        has = used[bucket]
        row, bucket = distinct(row[has], bucket[has])
        earlier = np.ones((n, 1))
        for dense, weight in self.links:
            earlier = np.column_stack([earlier, sigmoid(earlier @ dense + np.bincount(row, weight[bucket], n))])
        return earlier[:, 1:].T

    def _used(self) -> np.ndarray:
        if not hasattr(self, "used"):
            self.used = np.zeros(1 << BITS, bool)
            for _, weight in self.links:
                self.used |= weight != 0
        return self.used


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, most_rows: int = 12_000) -> ClassifierChain:
    rows, (toxic, quality) = labelled_sample(docs, labels, ["toxic", "quality"], most_rows, word_and_stem_features, where)
    chain = ClassifierChain(list(CATEGORIES)).fit(rows, np.array([f(toxic, quality) for f in CATEGORIES.values()]))
    chain.links = [(d, w.astype(np.float32)) for d, w in chain.links]
    return chain


def with_probabilities(docs: DataFrame, chain: ClassifierChain) -> DataFrame:
    """The documents' rows with a probability for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [c for c in docs.columns if c not in chain.names]
    docs = docs.select("text", *[c for c in names if c != "text"])
    at, added = names.index("text"), list(chain.names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in each_piece(batches, 0):
            columns = rows.columns[1:]
            columns.insert(at, rows.columns[0])
            found = shared.value.probabilities(data, off)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(p, pa.float64()) for p in found)], names=[*names, *added])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{c} double" for c in added)]))


@beside("doc_id", "text")
def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with their columns, that the chain's last category doesn't reject."""
    ship_package(docs.sparkSession)
    return with_probabilities(docs, fit(docs, labels)).where(f"toxic < {threshold}").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_probabilities(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.selectExpr("doc_id", *CATEGORIES, "cast(toxic >= 0.5 as int) as rejected")
