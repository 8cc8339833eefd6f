"""Potential-distance coordinates: points that diffuse to the same places lie close together.

The neighbour kernel, the transitions of points to landmarks and the final interpolation are joins over
all points. Only the landmark-to-landmark operator, whose size is fixed by `landmarks`, is powered and
embedded in one task. A set of no more points than landmarks uses every point as its own landmark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize
from arbora.operators.neighbors import best_columns, nearest, unit_rows, within
from arbora.operators.sampling import simple_sample

# Kernel weights below this are dropped; added before the logarithm of a probability.
LEAST_WEIGHT, LOG_FLOOR = 1e-4, 1e-7
LANDMARKS = 2000


def decay_graph(points: DataFrame, knn: int = 5, decay: float = 40.0) -> DataFrame:
    """Symmetric kernel (a, b, w), both directions and loops.

    The width of a point is the distance to its knn-th neighbour. A second search then returns just the
    others that are near enough to matter, however many a point has.
    """
    n = points.count()
    flat = points.select("id", F.lit("all").alias("lineage"), "embedding")
    order = min(knn, n - 1)
    last = nearest(flat, order).where(F.col("rank") == order)
    widths = materialize(last.select("id", F.greatest(F.lit(0.0), 1 - F.col("similarity"), F.lit(1e-12)).alias("width")))
    reach = (-math.log(LEAST_WEIGHT)) ** (1 / decay) * (1 + 1e-9)
    found = within(flat.join(widths, "id").withColumn("reach", F.col("width") * F.lit(reach)), "reach")
    rated = materialize(found.select("id", "other", "width", F.greatest(F.lit(0.0), 1 - F.col("similarity")).alias("d")))
    rated = rated.withColumn("w", F.exp(-F.pow(F.col("d") / F.col("width"), F.lit(float(decay)))))
    kept = rated.where(F.col("w") > LEAST_WEIGHT).select(F.col("id").alias("a"), F.col("other").alias("b"), "w")
    turned = kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    half = kept.unionByName(turned).groupBy("a", "b").agg((F.sum("w") / 2).alias("w"))
    loops = points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))
    return half.unionByName(loops)


def entropy_knee(operator: np.ndarray, longest: int = 100) -> int:
    """Diffusion time at the bend of the spectral entropy (best two-line fit)."""
    values = np.linalg.svd(operator, compute_uv=False)
    entropy, power = [], np.ones_like(values)
    for _ in range(longest):
        power = power * values
        p = power / power.sum()
        entropy.append(float(-(p * np.log(p + 1e-300)).sum()))
    y, x = np.array(entropy), np.arange(longest)

    def misfit(part):
        line = np.polyfit(x[part], y[part], 1)
        return float(np.abs(np.polyval(line, x[part]) - y[part]).sum())

    return int(min(range(2, longest - 2), key=lambda c: misfit(slice(0, c + 1)) + misfit(slice(c, longest)))) + 1


def metric_coordinates(distance: np.ndarray, dims: int, rounds: int = 100) -> np.ndarray:
    """Multidimensional scaling: classical start, then stress majorisation."""
    n = len(distance)
    centred = distance ** 2
    centred = -.5 * (centred - centred.mean(axis=0) - centred.mean(axis=1, keepdims=True) + centred.mean())
    values, vectors = np.linalg.eigh(centred)
    keep = np.argsort(-values)[:dims]
    y = vectors[:, keep] * np.sqrt(np.maximum(values[keep], 0.0))
    y *= np.sign(y[np.abs(y).argmax(axis=0), np.arange(dims)])
    for _ in range(rounds):
        now = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=-1))
        ratio = np.divide(distance, now, out=np.zeros_like(now), where=now > 1e-12)
        y = (ratio.sum(axis=1)[:, None] * y - ratio @ y) / n
    return y


def potential_coordinates(operator: np.ndarray, dims: int, t: int | None) -> np.ndarray:
    powered = np.linalg.matrix_power(operator, t or entropy_knee(operator))
    u = -np.log(powered + LOG_FLOOR)
    square = (u ** 2).sum(axis=1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * u @ u.T, 0.0))
    np.fill_diagonal(distance, 0.0)
    return metric_coordinates(distance, dims)


def nearest_landmark(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """id -> most similar landmark. The landmark vectors (a fixed number) travel with the tasks."""
    rows = landmarks.orderBy("id").collect()
    names, units = np.array([r["id"] for r in rows]), unit_rows([r["embedding"] for r in rows])

    def run(batches):
        for pdf in batches:
            _, best = best_columns(unit_rows(pdf["embedding"]) @ units.T, 1)
            yield pd.DataFrame({"id": pdf["id"], "mark": names[best]})

    return points.select("id", "embedding").mapInPandas(run, "id long, mark long")


def potential_layout(points: DataFrame, dims: int = 2, knn: int = 5, decay: float = 40.0, t: int | None = None,
                     landmarks: int = LANDMARKS, seed: int = 42) -> DataFrame:
    """Coordinates (id, component, value) of points (id, embedding)."""
    n = points.count()
    if n < 3 or dims < 1 or not 2 < landmarks <= 10_000:
        raise ContractError("needs three points, one dimension and at most 10000 landmarks")
    graph = materialize(decay_graph(points, knn, decay))
    sums = graph.groupBy("a").agg(F.sum("w").alias("q"))
    moves = graph.join(sums, "a").select("a", "b", (F.col("w") / F.col("q")).alias("p"))
    if n <= landmarks:
        operator = moves
    else:
        marks = materialize(nearest_landmark(points, simple_sample(points, landmarks, "id", seed)))
        to_mark = marks.select(F.col("id").alias("b"), "mark")
        seen = materialize(graph.join(to_mark, "b").groupBy("a", "mark").agg(F.sum("w").alias("w")))
        out = seen.groupBy("a").agg(F.sum("w").alias("q"))
        forth = materialize(seen.join(out, "a").select("a", "mark", (F.col("w") / F.col("q")).alias("p")))
        into = seen.groupBy("mark").agg(F.sum("w").alias("q"))
        back = seen.join(into, "mark").select(F.col("mark").alias("from"), "a", (F.col("w") / F.col("q")).alias("r"))
        operator = back.join(forth, "a").groupBy(F.col("from").alias("a"), F.col("mark").alias("b")).agg(
            F.sum(F.col("r") * F.col("p")).alias("p"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.r_[pdf["a"], pdf["b"]], return_inverse=True)
        full = np.zeros((len(names), len(names)))
        full[at[:len(pdf)], at[len(pdf):]] = pdf["p"]
        y = potential_coordinates(full, dims, t)
        return pd.DataFrame({"id": np.repeat(names, dims), "component": np.tile(np.arange(dims), len(names)),
                             "value": y.ravel()})

    solved = materialize(operator.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        solve, "id long, component int, value double"))
    if n <= landmarks:
        return solved
    placed = solved.withColumnRenamed("id", "mark")
    return forth.join(F.broadcast(placed), "mark").groupBy(F.col("a").alias("id"), "component").agg(
        F.sum(F.col("p") * F.col("value")).alias("value"))
