"""Decoder inference: linear layers and a final softplus over node embeddings.

The structure between the linear layers of a trained model is not part of its weights, so the activation is a
parameter. Layers are rows (layer, kind = weight | bias, position, values); a weight row holds the numbers of one
output. A layer is a blocked matrix product: output rows are cut into blocks of a bounded count of numbers, vectors are dealt
into groups of a bounded number of rows, and every pair of blocks is one task that multiplies them. Weights are never
collected, so models and vector tables of any size go through the same plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize

BLOCK_NUMBERS = 4_000_000  # weights of one task
BLOCK_ROWS = 20_000  # vectors of one task

ACTIVATIONS = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0.0), "tanh": np.tanh}


def layer_widths(layers: DataFrame) -> list[tuple[int, int, int]]:
    """(layer, inputs, outputs) in order; layers that do not fit together are refused."""
    weight = F.col("kind") == "weight"
    rows = layers.groupBy("layer").agg(
        F.min(F.when(weight, F.size("values"))).alias("low"), F.max(F.when(weight, F.size("values"))).alias("high"),
        F.count_if(weight).alias("outputs"), F.count_if(~weight).alias("biases"), F.max(F.when(~weight, F.size("values"))).alias("bias"),
        F.countDistinct(F.when(weight, F.col("position"))).alias("places"), F.min(F.when(weight, F.col("position"))).alias("first"),
        F.max(F.when(weight, F.col("position"))).alias("last")).orderBy("layer").collect()
    if not rows:
        raise ContractError("the decoder has no layers")
    for r in rows:
        if not r.outputs or r.low != r.high or r.low < 1 or r.biases > 1 or (r.biases and r.bias != r.outputs) \
                or (r.places, r["first"], r["last"]) != (r.outputs, 0, r.outputs - 1):
            raise ContractError(f"layer {r.layer} is not a whole matrix")
    for before, after in zip(rows, rows[1:]):
        if after.low != before.outputs:
            raise ContractError("decoder layers do not fit together")
    return [(r.layer, r.low, r.outputs) for r in rows]


def _weight_blocks(layers: DataFrame, layer: int, inputs: int, block_numbers: int) -> tuple[DataFrame, int]:
    """(block, position, values, bias) of one layer, and the outputs of a block."""
    per = max(1, block_numbers // inputs)
    mine = layers.where(F.col("layer") == layer)
    bias = mine.where("kind = 'bias'").select(F.posexplode("values").alias("position", "bias"))
    rows = mine.where("kind = 'weight'").select(F.col("position").cast("int").alias("position"), F.col("values").cast("array<double>").alias("values"))
    return rows.join(bias, "position", "left").select(
        F.expr(f"position div {per}").cast("int").alias("block"), "position", "values", F.coalesce("bias", F.lit(0.0)).cast("double").alias("bias")), per


def _product(act):
    """One group of vectors times one block of output rows."""
    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"id": [], "block": [], "y": []})
        right = right.sort_values("position")
        y = act(np.stack(left["x"]) @ np.stack(right["values"]).T + right["bias"].to_numpy())
        if not np.isfinite(y).all():
            raise ValueError("decoded values must be finite")
        return pd.DataFrame({"id": left["id"], "block": right["block"].iat[0], "y": list(y)})

    return multiply


def decode(nodes: DataFrame, layers: DataFrame, activation: str = "relu", column: str = "embedding", key: str = "node_id",
           block_numbers: int = BLOCK_NUMBERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, decoded): softplus of the decoder output for every vector; keys are whole numbers without repeats."""
    layers = materialize(layers)
    widths = layer_widths(layers)
    vectors = materialize(nodes.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")))
    if not vectors.where(F.size("x") != widths[0][1]).isEmpty():
        raise ContractError("vectors and the first layer differ in width")
    groups = max(1, -(-vectors._written_rows // block_rows))
    for layer, inputs, outputs in widths:
        last = layer == widths[-1][0]
        act = (lambda x: np.logaddexp(0.0, x)) if last else ACTIVATIONS[activation]
        weights, per = _weight_blocks(layers, layer, inputs, block_numbers)
        blocks = -(-outputs // per)

        dealt = vectors.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("deal"),
                               F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        spread = weights.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        parts = dealt.groupBy("block", "deal").cogroup(spread.groupBy("block", "deal")).applyInPandas(
            _product(act), "id long, block int, y array<double>")
        if blocks == 1:
            vectors = parts.select("id", F.col("y").alias("x"))
        else:
            vectors = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("block", "y"))).alias("b")).select(
                "id", F.flatten("b.y").alias("x"))
        vectors = materialize(vectors)
    return vectors.select(F.col("id").alias(key), F.col("x").alias("decoded"))


def named_expression(decoded: DataFrame, genes: DataFrame, key: str = "node_id") -> DataFrame:
    """Long table (key, gene, value); genes: position, gene."""
    long = decoded.select(key, F.posexplode("decoded").alias("position", "value"))
    return long.join(genes, "position").select(key, "gene", "value")
