"""Exact additive attributions of tree sums: each feature's Shapley value where absent features follow the trees' own covers.

For one leaf, the features on its path are players. A player that is present lets a row through if the row meets all its conditions on
the path, one that is absent lets through the share of training weight that its splits sent this way. The weights of all subset sizes
are carried down the path as a polynomial, one factor a feature; a feature's value is what the other factors' polynomial gives with the weights of
their subset sizes. Rows that meet the same conditions of a path share its values, so each pattern is worked out once: for all batches where a path has at
most ALL features, once a batch where it has more. With d
features on a path that costs d ** 2 a feature, never 2 ** d.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from panelspark.operators.trees import Tree, matrix


ALL = 8


@dataclass
class Path:
    """A leaf and, for each feature on the way to it, the bounds low < x <= high that lead there and the share of weight that took them."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    table: np.ndarray | None = None  # attributions of each pattern, by its bits


def paths(tree: Tree) -> list[Path]:
    out: list[Path] = []

    def down(node: int, held: dict[int, tuple[float, float, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            path = Path(tree.value[node], list(held), *([v[k] for v in held.values()] for k in range(3)))
            if 0 < len(held) <= ALL:
                path.table = path.value * pattern_values((np.arange(1 << len(held))[:, None] >> np.arange(len(held)) & 1).astype(float), np.array(path.share))
            out.append(path)
            return
        low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
        at = tree.threshold[node]
        for child, bounds in ((tree.left[node], (low, min(high, at))), (tree.right[node], (max(low, at), high))):
            taken = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.5
            down(child, held | {f: (*bounds, share * taken)})

    down(0, {})
    return out


def base_value(trees: list[Tree]) -> float:
    """What the trees give when no feature is known."""
    return float(sum(p.value * np.prod(p.share) for tree in trees for p in paths(tree)))


def pattern_values(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Attributions for a leaf of value 1. met: patterns by features, 0 or 1; share: of each feature."""
    n, d = met.shape
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.empty((n, d))
    for j in range(d):
        sizes = np.zeros((n, d))  # products over the other features, by the number of them that are present
        sizes[:, 0] = 1.0
        for k in range(d):
            if k != j:
                sizes[:, 1:] = sizes[:, 1:] * share[k] + sizes[:, :-1] * met[:, k : k + 1]
                sizes[:, 0] *= share[k]
        out[:, j] = (met[:, j] - share[j]) * (sizes @ weight)
    return out


def attributions(trees: list[list[Path]], x: np.ndarray) -> np.ndarray:
    """Rows by features."""
    columns, added = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
    for leaves in trees:
        for leaf in leaves:
            if not leaf.features:
                continue
            if leaf.table is not None:
                bits = np.zeros(len(x), np.int64)
                for k, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                    bits |= ((columns[f] > low) & (columns[f] <= high)).astype(np.int64) << k
                for k, f in enumerate(leaf.features):
                    added[f] += leaf.table[bits, k]
                continue
            own = x[:, leaf.features]
            met = (own > leaf.low) & (own <= leaf.high)
            patterns, inverse = np.unique(met, axis=0, return_inverse=True)
            added[leaf.features] += (leaf.value * pattern_values(patterns.astype(float), np.array(leaf.share))[inverse.reshape(-1)]).T
    return added.T


def explained(trees: list[Tree], panel: DataFrame, features: list[str], prefix: str = "shap_") -> DataFrame:
    """panel with base_value, prediction, and an attribution for each feature; base_value and attributions add up to the prediction.

    Rows that lack a feature are left out, as in scoring.
    """
    whole = panel.dropna(subset=features)
    made = [F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    ways, base = [paths(t) for t in trees], base_value(trees)
    names = ["base_value", "prediction", *(f"{prefix}{f}" for f in features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - len(features)
            x = matrix(batch, kept, len(features))
            values = attributions(ways, x)
            total = np.zeros(batch.num_rows)
            for tree in trees:
                total += tree.predict(x)
            added = [np.full(batch.num_rows, base), total, *values.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(np.ascontiguousarray(a)) for a in added)], [*batch.schema.names[:kept], *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields] + [f"`{n}` double" for n in names])
    return whole.select(*[F.col(f"`{c}`") for c in panel.columns], *made).mapInArrow(run, schema)


def summary(details: DataFrame, features: list[str], prefix: str = "shap_") -> DataFrame:
    """(rank, feature, mean_abs_shap, mean_shap, std_shap), the largest mean size first; std over all rows (ddof 0)."""
    own = [F.struct(F.avg(F.abs(c)).alias("mean_abs_shap"), F.avg(c).alias("mean_shap"), F.stddev_pop(c).alias("std_shap")).alias(f"_{i}") for i, c in enumerate(F.col(f"`{prefix}{f}`") for f in features)]
    found: Row = details.agg(*own).first()
    rows = sorted(((f, *found[i]) for i, f in enumerate(features)), key=lambda r: (-(r[1] or 0.0), r[0]))
    schema = "rank int, feature string, mean_abs_shap double, mean_shap double, std_shap double"
    return details.sparkSession.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], schema)
