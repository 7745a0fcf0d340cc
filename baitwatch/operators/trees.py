"""Fitted trees as a table, and scoring from that table.

A row is a node. Scoring turns the nodes into one SQL expression, so a scored table is a
plain projection: columns are pruned and filters on kept columns reach the scan, neither
of which holds behind a feature vector."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import closed

SCHEMA = "tree int, node int, weight double, feature string, threshold double, left int, right int, value double"


class Node(NamedTuple):
    """``feature <= threshold`` leads left, all else (NaN and null too) right; a leaf has
    a ``value`` and no feature. Node 0 is the root of its tree."""

    tree: int
    node: int
    weight: float
    feature: str | None
    threshold: float | None
    left: int | None
    right: int | None
    value: float | None


def model_nodes(model: PipelineModel) -> list[Node]:
    """All nodes of the boosted trees of a fitted mail model. Their number is bounded by
    stages and depth."""
    assembler, boosted = model.stages[0], model.stages[-1]
    columns, out = list(assembler.getInputCols()), []
    for t, (tree, weight) in enumerate(zip(boosted.trees, boosted.treeWeights, strict=True)):
        queue = [tree._java_obj.rootNode()]
        for k, node in enumerate(queue):  # grows while it is read
            if hasattr(node, "split") and node.subtreeDepth() > 0:
                left = len(queue)
                queue += [node.leftChild(), node.rightChild()]
                out.append(Node(t, k, weight, columns[node.split().featureIndex()], node.split().threshold(), left, left + 1, None))
            else:
                out.append(Node(t, k, weight, None, None, None, None, node.prediction()))
    return out


def node_table(spark: SparkSession, nodes: Iterable[Node]) -> DataFrame:
    return spark.createDataFrame(list(nodes), SCHEMA)


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str) -> list[Node]:
    """The nodes of a saved table; a model's, so few enough for the driver."""
    rows = spark.read.schema(SCHEMA).parquet(path).orderBy("tree", "node").collect()
    return [Node(*r) for r in rows]


def _number(x: float) -> str:
    return f"{x!r}D"


def _complete(nodes: Iterable[Node], names: list[str]) -> tuple[int, list[str]]:
    """Depth of the deepest tree, and every tree as text of a struct: weight, and in the
    order of a complete binary tree of that depth the features and thresholds of its
    splits and the values of its leaves. A leaf higher up stands for all leaves below."""
    trees: dict[int, dict[int, Node]] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n

    def depth(tree: dict[int, Node], k: int) -> int:
        n = tree[k]
        return 0 if n.feature is None else 1 + max(depth(tree, n.left), depth(tree, n.right))

    most, place, texts = max((depth(t, 0) for t in trees.values()), default=0), {c: i for i, c in enumerate(names)}, []
    for _, tree in sorted(trees.items()):
        level, features, thresholds = [0], [], []
        for _ in range(most):
            below = []
            for k in level:
                n = tree[k]
                features.append(str(place.get(n.feature, 0)))
                thresholds.append(_number(n.threshold if n.feature is not None else 0.0))
                below += [k, k] if n.feature is None else [n.left, n.right]
            level = below
        values = ", ".join(_number(tree[k].value) for k in level)
        texts.append(f"named_struct('w', {_number(tree[0].weight)}, 'f', array({', '.join(features) or '0'}), "
                     f"'t', array({', '.join(thresholds) or '0D'}), 'v', array({values}))")
    return most, texts


def margin(nodes: Iterable[Node]) -> Column:
    """Weighted sum over the trees. All trees are one constant array, walked level by
    level inside the row: the plan is of one size for any number of trees, where one
    generated branch per split would outgrow what the JVM compiles."""
    nodes = list(nodes)
    names = used_columns(nodes)
    most, trees = _complete(nodes, names)
    if not trees:
        return F.lit(0.0)
    row = ", ".join(f"cast(`{c}` as double)" for c in names) or "0D"
    leaf = f"aggregate(sequence(1, {most}), 0, (k, i) -> 2 * k + if(x[t.f[k]] <= t.t[k], 1, 2)) - {2 ** most - 1}" if most else "0"
    return F.expr(f"transform(array(array({row})), x -> aggregate(array({', '.join(trees)}), 0D, (s, t) -> s + t.w * t.v[{leaf}]))[0]")


def probability(nodes: Iterable[Node]) -> Column:
    """Probability of class 1 of boosted trees fitted to the logistic loss."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin(nodes)))


def used_columns(nodes: Iterable[Node]) -> list[str]:
    return sorted({n.feature for n in nodes if n.feature is not None})


def with_probability(features: DataFrame, nodes: Iterable[Node], out: str) -> DataFrame:
    """``features`` with the probability in ``out``. Columns that the trees use and the
    table lacks count as 0, as ``features.align`` has it."""
    nodes = list(nodes)
    lacking = [c for c in used_columns(nodes) if c not in features.columns]
    scored = closed(features.withColumns({c: F.lit(0) for c in lacking}), {out: probability(nodes)})
    return scored.drop(*lacking)
