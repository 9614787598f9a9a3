"""Regression trees as arrays, walked over Arrow batches: what the ranking booster grows and what explanations read.

A row goes left where its value is at most the threshold. Leaves have feature -1. `cover` is the weight of training rows that
reached a node.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def leaf(self, value: float, cover: float) -> int:
        self.feature.append(-1), self.threshold.append(0.0), self.left.append(-1), self.right.append(-1)
        self.value.append(value), self.cover.append(cover)
        return len(self.value) - 1

    def split(self, node: int, feature: int, threshold: float, left: tuple[float, float], right: tuple[float, float]) -> tuple[int, int]:
        """Makes a leaf an inner node with two leaves of (value, cover)."""
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = self.leaf(*left), self.leaf(*right)
        return self.left[node], self.right[node]

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            rows = np.flatnonzero(feature[at] >= 0)
            if not len(rows):
                return at
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= threshold[here], left[here], right[here])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.reached(x)]


def matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns first..first+n of doubles as a matrix."""
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(first, first + n)]) if n else np.zeros((batch.num_rows, 0))


def scored(trees: list[Tree], panel: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """panel with the sum of the trees' values; rows that lack a feature are left out."""
    whole = panel.dropna(subset=features)
    made = [F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - len(features)
            x = matrix(batch, kept, len(features))
            total = np.zeros(batch.num_rows)
            for tree in trees:
                total += tree.predict(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(total)], [*batch.schema.names[:kept], name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return whole.select(*[F.col(f"`{c}`") for c in panel.columns], *made).mapInArrow(run, f"{schema}, `{name}` double")


def from_boosted(spark: SparkSession, model: GBTRegressionModel, folder: str) -> list[Tree]:
    """The trees of an MLlib model, values times their weights; read from the model's own files under the shared folder."""
    path = f"{folder.rstrip('/')}/model-{uuid.uuid4().hex}"
    model.save(path)
    weights = list(model.treeWeights)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # a row a node
    out: list[Tree] = [Tree() for _ in weights]
    for r in rows:
        t, inner = out[r.treeID], r.leftChild >= 0
        t.feature.append(r.split.featureIndex if inner else -1)
        t.threshold.append(float(r.split.leftCategoriesOrThreshold[0]) if inner else 0.0)
        t.left.append(r.leftChild), t.right.append(r.rightChild)
        t.value.append(r.prediction * weights[r.treeID])
        t.cover.append(float(r.impurityStats[0]))
    return out
