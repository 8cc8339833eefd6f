"""Exact cosine neighbours inside hard groups.

A group of n vectors is cut into ceil(n / block_rows) hash blocks and every block pair is one task, so
a hot group becomes many equal tasks; there are more partitions than block pairs, so none takes a share of them
that grows with the input. A task multiplies two blocks and returns at most k rows per vector (`nearest`) or those
in reach (`within`); the pairs themselves never leave it. Partial lists are then merged to the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import empty_frame

# Smallest block; a lineage of more than 64 blocks uses larger ones, up to eight times this.
BLOCK_ROWS = 8192
MANY_BLOCKS = 64
MOST_PARTS = 20_000
# Similarities held at once by a task.
CHUNK_CELLS = 8_000_000
# Columns folded into one maximum; more than two steps of the settled similarities.
FOLD, MARGIN = 16, 3e-12


def unit_rows(vectors) -> np.ndarray:
    """Stack array cells to a float64 matrix with rows of length one (zero rows stay zero)."""
    z = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def best_columns(scores: np.ndarray, k: int):
    """(row, column) pairs of the k largest entries per row; ties go to the lower column."""
    k = min(k, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, cols = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def similarity_chunks(left: np.ndarray, right: np.ndarray, left_ids, right_ids):
    """Raw similarities of row chunks, a vector's match with itself masked out."""
    step = max(16, CHUNK_CELLS // max(1, len(right)))
    order = np.argsort(right_ids, kind="stable")
    ascending = right_ids[order]
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        scores = left[part] @ right.T
        low, high = (np.searchsorted(ascending, left_ids[part], side) for side in ("left", "right"))
        for row in np.flatnonzero(high > low):
            scores[row, order[low[row]:high[row]]] = -np.inf
        yield part, scores


def settled(scores):
    """Similarities as they are compared and returned."""
    return np.round(np.clip(scores, -1.0, 1.0), 12)


def best_matches(scores: np.ndarray, k: int, ids=None):
    """(row, column, similarity) of `best_columns` on the settled scores, which are settled for candidates only.

    Ties go to the lower of the columns' `ids`, if given.
    """
    rows, columns = scores.shape
    k = min(k, columns)
    wide = columns // FOLD
    if wide >= 4 * k:  # the k-th largest of the folded maxima is no larger than the k-th largest score
        folded = scores[:, :wide * FOLD].reshape(rows, FOLD, wide).max(axis=1)
        cut = np.partition(folded, wide - k, axis=1)[:, wide - k]
        r, c = np.nonzero(~(folded < (cut - MARGIN)[:, None]))  # only folds that may hold a candidate are opened
        rest = np.arange(wide * FOLD, columns)
        c = np.r_[(c[:, None] + wide * np.arange(FOLD)).ravel(), np.tile(rest, rows)]
        r = np.r_[np.repeat(r, FOLD), np.repeat(np.arange(rows), len(rest))]
    else:
        cut = np.partition(scores, columns - k, axis=1)[:, columns - k]
        r, c = np.nonzero(scores >= (cut - MARGIN)[:, None])
    value = scores[r, c]
    kept = (value >= (cut - MARGIN)[r]) & np.isfinite(value)
    r, c, value = r[kept], c[kept], settled(value[kept])
    order = np.lexsort((c if ids is None else ids[c], -value, r))
    r, c, value = r[order], c[order], value[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r] < k
    return r[keep], c[keep], value[keep]


def best_of_first(scores: np.ndarray, ends, ids):
    """(row, column, similarity) of the best of the first `ends[row]` columns of each row; ties go to the lower id."""
    r, c = [], []
    for row, end in enumerate(ends):
        if end:
            part = scores[row, :end]
            near = np.flatnonzero(part >= part.max() - MARGIN)
            if len(near) > 1:
                near = near[np.lexsort((ids[near], -settled(part[near])))][:1]
            r += [row] * len(near)
            c += near.tolist()
    r, c = np.array(r, dtype=np.int64), np.array(c, dtype=np.int64)
    value = scores[r, c]
    kept = np.isfinite(value)
    return r[kept], c[kept], settled(value[kept])


def block_pairs(vectors: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One copy of each row per block pair it belongs to: columns `_own`, `_low`, `_high`; dealt by block pair."""
    n = F.count("*")
    rows = F.greatest(F.lit(block_rows), F.least(F.lit(8 * block_rows), F.ceil(n / F.lit(MANY_BLOCKS))))
    sizes = vectors.groupBy(group).agg(F.ceil(n / rows).alias("_blocks"))
    pairs = sizes.agg(F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2)).first()[0] or 1
    parts = min(MOST_PARTS, 4 * int(pairs))
    return (vectors.join(sizes, group)
            .withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("_low", F.least("_own", "_other"))
            .withColumn("_high", F.greatest("_own", "_other"))
            .drop("_other", "_blocks").repartition(parts, group, "_low", "_high"))


def _sides(pdf: pd.DataFrame, *carry):
    """(ids, unit vectors, carried columns) of the blocks of a pair that look for each other."""
    pdf = pdf.sort_values("id")
    low, high = pdf["_low"].iat[0], pdf["_high"].iat[0]
    packed = [(s["id"].to_numpy(), unit_rows(s["embedding"]), *[s[c].to_numpy() for c in carry])
              for s in (pdf[pdf["_own"] == b] for b in dict.fromkeys((low, high))) if len(s)]
    for here in packed:
        for there in packed:
            if low == high or here is not there:
                yield here, there


def nearest(vectors: DataFrame, k: int, group: str = "lineage", earlier: bool = False,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest neighbours of every vector in its group.

    Input: id, `group`, embedding and, with `earlier`, stage. Output rows: `group`, id, other,
    similarity, rank (1 = closest; similarity descending, then id) and, with `earlier`, also stage and
    other_stage plus one row of rank 0 naming the most similar vector of strictly smaller stage.
    """
    carry = ["stage"] if earlier else []
    rows = vectors.select("id", group, "embedding", *carry)

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for here, there in _sides(pdf, *carry):
            if earlier:  # what is earlier than a row comes first
                order = np.lexsort((there[0], there[2]))
                there = tuple(x[order] for x in there)
            for part, scores in similarity_chunks(here[1], there[1], here[0], there[0]):
                hits = [(*best_matches(scores, k, there[0]), 1)]
                if earlier:
                    ends = np.searchsorted(there[2], here[2][part])
                    ends[here[2][part] != here[2][part]] = 0
                    hits.append((*best_of_first(scores, ends, there[0]), 0))
                for r, c, value, kind in hits:
                    item = {"id": here[0][part][r], "other": there[0][c], "similarity": value, "kind": kind}
                    if earlier:
                        item["stage"] = here[2][part][r]
                        item["other_stage"] = there[2][c]
                    found.append(pd.DataFrame(item))
        out = pd.concat(found, ignore_index=True) if found else pd.DataFrame()
        if not len(out):
            return empty_frame(schema)
        out[group] = pdf[group].iat[0]
        return out[columns]

    columns = [group, "id", "other", "similarity", "kind"] + (["stage", "other_stage"] if earlier else [])
    schema = f"{group} string, id long, other long, similarity double, kind int"
    if earlier:
        schema += ", stage double, other_stage double"
    partial = (block_pairs(rows, group, block_rows)
               .groupBy(group, "_low", "_high").applyInPandas(pair, schema))
    closest = Window.partitionBy("id", "kind").orderBy(F.desc("similarity"), "other")
    return (partial.withColumn("rank", F.row_number().over(closest))
            .where(F.col("rank") <= F.when(F.col("kind") == 1, k).otherwise(1))
            .withColumn("rank", F.when(F.col("kind") == 1, F.col("rank")).otherwise(0))
            .drop("kind"))


def within(vectors: DataFrame, reach: str, group: str = "lineage", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All others of its group no farther from a vector (id, `group`, embedding) than its own `reach`.

    Output rows: `group`, id, other, similarity, and the columns of `vectors` beyond these and the embedding.
    """
    extra = [f for f in vectors.schema if f.name not in ("id", group, "embedding")]

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for here, there in _sides(pdf, *[f.name for f in extra]):
            own = dict(zip([f.name for f in extra], here[2:]))
            for part, scores in similarity_chunks(here[1], there[1], here[0], there[0]):
                r, c = np.nonzero(scores >= (1 - own[reach][part] - MARGIN)[:, None])
                value = scores[r, c]
                r, c, value = (x[np.isfinite(value)] for x in (r, c, value))
                value = settled(value)
                near = np.maximum(0.0, 1 - value) <= own[reach][part][r]
                found.append(pd.DataFrame({"id": here[0][part][r[near]], "other": there[0][c[near]], "similarity": value[near],
                                           **{name: x[part][r[near]] for name, x in own.items()}}))
        out = pd.concat(found, ignore_index=True) if found else pd.DataFrame()
        if not len(out):
            return empty_frame(schema)
        out[group] = pdf[group].iat[0]
        return out[[c.split()[0] for c in schema.split(", ")]]

    schema = ", ".join([f"{group} string, id long, other long, similarity double"]
                       + [f"{f.name} {f.dataType.simpleString()}" for f in extra])
    return block_pairs(vectors, group, block_rows).groupBy(group, "_low", "_high").applyInPandas(pair, schema)


def undirected(neighbours: DataFrame, group: str = "lineage") -> DataFrame:
    """Neighbour lists as unordered pairs with the number of lists (1 or 2) that name each."""
    return (neighbours.where("rank > 0")
            .groupBy(group, F.least("id", "other").alias("left_id"),
                     F.greatest("id", "other").alias("right_id"))
            .agg(F.count("*").cast("int").alias("knn_memberships"),
                 F.max("similarity").alias("cosine_similarity")))


def local_scales(neighbours: DataFrame, group: str = "lineage") -> DataFrame:
    """Median of each vector's five nearest distances, at least 1e-6 (lists hold at most k rows)."""
    close = neighbours.where("rank between 1 and 5")
    distance = F.greatest(F.lit(0.0), 1 - F.col("similarity"))
    return close.groupBy(group, "id").agg(
        F.greatest(F.percentile(distance, F.lit(0.5)), F.lit(1e-6)).alias("local_scale"))


def bounded_adjacency(neighbours: DataFrame, radius_factor: float = 2.0, mutual: bool = False,
                      group: str = "lineage") -> DataFrame:
    """Unordered neighbour pairs no farther apart than radius_factor x the smaller local scale."""
    scales = local_scales(neighbours, group).select("id", "local_scale")
    pairs = undirected(neighbours, group)
    if mutual:
        pairs = pairs.where("knn_memberships = 2")
    left = scales.select(F.col("id").alias("left_id"), F.col("local_scale").alias("left_scale"))
    right = scales.select(F.col("id").alias("right_id"), F.col("local_scale").alias("right_scale"))
    distance = F.greatest(F.lit(0.0), 1 - F.col("cosine_similarity"))
    return (pairs.join(left, "left_id").join(right, "right_id")
            .withColumn("cosine_distance", distance)
            .where(F.col("cosine_distance") <= radius_factor * F.least("left_scale", "right_scale"))
            .select(group, "left_id", "right_id", "cosine_distance", "left_scale", "right_scale"))
