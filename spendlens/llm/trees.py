"""Boosted trees fitted by Spark and read back as plain nodes, for use as column expressions or on arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf has feature -1; others go left when the feature is at most the threshold."""

    feature: int
    threshold: float
    value: float
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Boosted:
    trees: tuple[tuple[float, Node], ...]
    names: tuple[str, ...]

    def column(self, feature: Callable[[str], Column]) -> Column:
        """Probability of the positive class as a column expression."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            at_most = feature(self.names[node.feature]) <= F.lit(node.threshold)
            return F.when(at_most, walk(node.left)).otherwise(walk(node.right))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(weight) * walk(root)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log odds for an array of feature rows."""
        out = np.zeros(len(rows))

        def walk(node: Node, at: np.ndarray, weight: float) -> None:
            if node.feature < 0 or not len(at):
                out[at] += weight * node.value
                return
            low = rows[at, node.feature] <= node.threshold
            walk(node.left, at[low], weight)
            walk(node.right, at[~low], weight)

        for weight, root in self.trees:
            walk(root, np.arange(len(rows)), weight)
        return 2 * out


def _read(node) -> Node:
    if node.getClass().getSimpleName() == "LeafNode":
        return Node(-1, 0.0, float(node.prediction()))
    split = node.split()
    return Node(int(split.featureIndex()), float(split.threshold()), 0.0, _read(node.leftChild()), _read(node.rightChild()))


def fit(
    rows: DataFrame, names: list[str], label: str = "label", rounds: int = 20, depth: int = 3, weight: str | None = None
) -> Boosted:
    """Gradient boosted trees on numeric feature columns; `rows` must hold both labels.

    `weight` names a column that says how many equal rows a row stands for.
    """
    numeric = [F.col(n).cast("double").alias(n) for n in names]
    times = F.lit(1) if weight is None else F.col(weight)
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(
        rows.select(*numeric, F.col(label).cast("double").alias("label"), times.cast("double").alias("weight"))
    )
    learner = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32)
    if weight is not None:
        learner = learner.setWeightCol("weight")
    model = learner.fit(packed.select("features", "label", *(["weight"] if weight else [])))
    trees = [_read(t._java_obj.rootNode()) for t in model.trees]
    return Boosted(tuple(zip(map(float, model.treeWeights), trees)), tuple(names))
