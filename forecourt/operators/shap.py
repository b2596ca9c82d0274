"""Shapley values of tree models: how much each input moves a prediction away from the mean.

A leaf is reached through intervals of a few inputs. If a row is inside some of them, the leaf's share of the row's
Shapley values depends on which ones alone, since the inputs left out follow the training rows' shares down the tree. So
each leaf gets a table of shares for all patterns of inside and outside, made once per task, and a batch of rows needs
one comparison per leaf and input, and one look-up. Trees are read from the saved model; they are the only thing that is
sent to the tasks, and their size is set by their number and depth.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.operators.joins import known_size
from forecourt.operators.pricing import Inputs, usable
from forecourt.operators.scoring import Trees, trees_of
from forecourt.session import checkpoint_dir

_ROWS = 4096


@dataclass
class Leaf:
    """Value times the tree's weight, and per input on its path: number, interval (low, high], share of rows kept."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    kept: list[float]

    @property
    def mean(self) -> float:
        return self.value * math.prod(self.kept)

    def shares(self) -> np.ndarray:
        """Row per pattern (bit j: inside the interval of input j), column per input: its part of the leaf's value."""
        m = len(self.features)
        inside = (np.arange(2 ** m)[:, None] >> np.arange(m) & 1).astype(float)
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        out = np.empty((2 ** m, m))
        for j in range(m):
            # coefficient k: sum over the sets of k other inputs of the product of what each input lets through
            poly = np.zeros((2 ** m, m))
            poly[:, 0] = 1.0
            for i in range(m):
                if i != j:
                    poly[:, 1:] = poly[:, 1:] * self.kept[i] + poly[:, :-1] * inside[:, i, None]
                    poly[:, 0] *= self.kept[i]
            out[:, j] = (poly @ np.array(weight)) * (inside[:, j] - self.kept[j]) * self.value
        return out


def leaves(model: PipelineModel, spark: SparkSession) -> list[Leaf]:
    """Leaves of the model's boosted or random trees."""
    path = f"{checkpoint_dir(spark)}/forecourt/trees-{uuid.uuid4().hex}"
    fitted = model.stages[-1]
    fitted.save(path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()}
    weights = list(fitted.treeWeights)
    if type(fitted).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    out = []

    def walk(tree: int, number: int, bounds: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[tree, number]
        if node["leftChild"] < 0:
            spots = sorted(bounds.items())
            out.append(Leaf(node["prediction"] * weights[tree], [f for f, _ in spots], [b[0] for _, b in spots], [b[1] for _, b in spots], [b[2] for _, b in spots]))
            return
        split = node["split"]
        if split["numCategories"] != -1:
            raise ValueError("splits on categories are not read; hand codes over as plain numbers")
        f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, kept = bounds.get(f, (-np.inf, np.inf, 1.0))
        whole = node["impurityStats"][0]
        for child, span in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
            walk(tree, child, bounds | {f: (*span, kept * nodes[tree, child]["impurityStats"][0] / whole)})

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, {})
    return out


def contributions(found: list[Leaf], x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Shapley value of each row and input. ``tables`` are the leaves' shares, made if none are given."""
    total = np.zeros(x.shape)
    for number, leaf in enumerate(found):
        if leaf.features:
            table = tables[number] if tables else leaf.shares()
            for at in range(0, len(x), _ROWS):
                part = x[at:at + _ROWS, leaf.features]
                inside = (part > leaf.low) & (part <= leaf.high)
                total[at:at + _ROWS, leaf.features] += table[inside @ (1 << np.arange(len(leaf.features)))]
    return total


def shap_values(model: PipelineModel, df: DataFrame, inputs: Inputs = Inputs()) -> DataFrame:
    """Columns of ``df`` with ``prediction``, ``base`` (the mean over the training rows) and ``shap``, one value per input.

    The values of a row sum to its prediction less the base. Inputs are encoded as one number each; nulls of the inputs are
    treated as in training, and an empty table gives no rows.
    """
    found = leaves(model, df.sparkSession)
    base = sum(leaf.mean for leaf in found)
    kept = [c for c in df.columns if c not in ("prediction", "base", "shap")]
    scored = model.transform(inputs.prepare(df)).select(*kept, "prediction", vector_to_array("features").alias("_x"))
    count = len(inputs.categorical) + len(inputs.numeric)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or [leaf.shares() for leaf in found]
            values = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, count)
            shares = contributions(found, values, tables)
            ends = pa.array(np.arange(0, count * len(values) + 1, count), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(shares.reshape(-1)))], [*batch.schema.names[:-1], "shap"])

    kind = ", ".join(f"`{c}` {t}" for c, t in scored.dtypes[:-1])
    return scored.mapInArrow(explain, f"{kind}, shap array<double>").withColumn("base", F.lit(float(base)))


def mean_shap(model: PipelineModel, df: DataFrame, inputs: Inputs = Inputs()) -> DataFrame:
    """``feature, importance``: mean absolute Shapley value of each input over all rows.

    Rows between the same cuts of every input have the same values, so those of boosted trees are worked out once per such cell.
    """
    trees = trees_of(model, df.sparkSession)
    if trees is not None and trees.cells < 2**62:
        return _mean_by_cell(model, trees, df, inputs)
    rows = shap_values(model, usable(df, inputs).select(*inputs.categorical, *inputs.numeric), inputs)
    means = rows.agg(*[F.avg(F.abs(F.get("shap", F.lit(i)))).alias(c) for i, c in enumerate((*inputs.categorical, *inputs.numeric))])
    return means.unpivot([], means.columns, "feature", "importance")


def _mean_by_cell(model: PipelineModel, trees: Trees, df: DataFrame, inputs: Inputs) -> DataFrame:
    spark, found, names = df.sparkSession, leaves(model, df.sparkSession), [*inputs.categorical, *inputs.numeric]

    def numbered(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(trees.cell(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, trees.width)))

    encoded = PipelineModel(stages=model.stages[:-1]).transform(usable(df.select(*names, inputs.target), inputs))
    cells = known_size(encoded.select(F.arrow_udf(numbered, "long")(vector_to_array("features")).alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_n")))
    # few rows, much work
    cells = cells.repartition(spark.sparkContext.defaultParallelism, "_cell")

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or [leaf.shares() for leaf in found]
            moved = np.abs(contributions(found, trees.rows_of(batch.column(0).to_numpy()), tables)) * batch.column(1).to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, moved.T)], ["n", *[f"s{i}" for i in range(trees.width)]])

    sums = cells.mapInArrow(explain, f"n long, {', '.join(f's{i} double' for i in range(trees.width))}")
    means = sums.agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(c) for i, c in enumerate(names)])
    return means.unpivot([], means.columns, "feature", "importance")
