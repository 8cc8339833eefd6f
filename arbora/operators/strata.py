"""Strata: fixed-width stage bins inside a lineage, and what is known about each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, join_on, materialize, require_zero
from arbora.functions.scalars import interval_label, ratio, stage_bin
from arbora.functions.vectors import cosine_distance, dimension, group_means
from arbora.operators.ordering import quantiles

INT_MIN, INT_MAX = -2**31, 2**31 - 1


def with_stage_bins(cells: DataFrame, width: float = 1.0, origin: float = 0.0) -> DataFrame:
    """Add stage_bin_id."""
    if not 0 < width < float("inf"):
        raise ContractError("bin width must be positive and finite")
    return cells.withColumn("stage_bin_id", stage_bin(F.col("stage"), width, origin).cast("long"))


def check_stage_bins(binned: DataFrame) -> None:
    """Stages are finite and bins fit 32 bits."""
    stage, b = F.col("stage"), F.col("stage_bin_id")
    require_zero(binned,
                 stage_not_finite=stage.isNull() | F.isnan(stage) | (F.abs(stage) == float("inf")),
                 bin_out_of_range=(b < INT_MIN) | (b > INT_MAX))


def bin_edges(df: DataFrame, width: float = 1.0, origin: float = 0.0) -> DataFrame:
    """Add left and right edge, midpoint and label of stage_bin_id."""
    left = F.lit(float(origin)) + F.col("stage_bin_id") * F.lit(float(width))
    return (df.withColumn("stage_bin_left", left)
            .withColumn("stage_bin_right", F.col("stage_bin_left") + F.lit(float(width)))
            .withColumn("constraint_stage", (F.col("stage_bin_left") + F.col("stage_bin_right")) / 2)
            .withColumn("stage_bin_label",
                        interval_label(F.col("stage_bin_left"), F.col("stage_bin_right"))))


def strata(cells: DataFrame, width: float = 1.0, origin: float = 0.0) -> DataFrame:
    """One row per nonempty (lineage, stage bin)."""
    counted = (with_stage_bins(cells, width, origin).groupBy("lineage", "stage_bin_id")
               .agg(F.count("*").alias("n_cells")))
    return bin_edges(counted, width, origin)


def stage_statistics(cells: DataFrame, group: str = "microcell_id") -> DataFrame:
    """Size, mean, population deviation and range of stage per group."""
    return cells.groupBy(group).agg(
        F.count("*").alias("n_cells"), F.avg("stage").alias("mean_stage"),
        F.stddev_pop("stage").alias("stage_std"), F.min("stage").alias("min_stage"),
        F.max("stage").alias("max_stage"))


def compactness(cells: DataFrame, group: str = "microcell_id") -> DataFrame:
    """Mean and 95th percentile of the members' cosine distance to their mean vector."""
    width = dimension(cells, "embedding")
    centers = group_means(cells, [group], "embedding", width).withColumnRenamed("embedding", "_center")
    spread = materialize(join_on(cells.select(group, "embedding"), centers, [group]).select(
        group, cosine_distance("embedding", "_center").alias("_distance")))
    tails = quantiles(spread, [group], "_distance", {"p95_cosine_distance": 0.95})
    means = spread.groupBy(group).agg(F.avg("_distance").alias("mean_cosine_distance"))
    return join_on(means, tails, [group])


def group_centroids(members: DataFrame, group: str) -> DataFrame:
    """Plain mean of the members' vectors, scaled to length one."""
    return group_means(members, [group], "embedding", unit=True)


def weighted_coordinates(points: DataFrame, group: str, axes, weight: str = "n_cells") -> DataFrame:
    """Weighted mean position per group."""
    total = F.sum(weight)
    return points.groupBy(group).agg(*[(F.sum(F.col(a) * F.col(weight)) / total).alias(a) for a in axes])


def grouping_summary(groups: DataFrame, min_size: int = 200) -> DataFrame:
    """One row about the sizes of all groups (n_cells)."""
    groups = materialize(groups.select("n_cells"))
    n, small = F.col("n_cells"), F.col("n_cells") < min_size
    one = groups.agg(
        F.count("*").alias("n_microcells"), F.sum(n).alias("total_cells"),
        F.min(n).alias("min_size"), F.max(n).alias("max_size"),
        F.count_if(n == 1).alias("singleton_groups"),
        F.count_if(small).alias("below_min_size_groups"),
        ratio(F.coalesce(F.sum(F.when(small, n)), F.lit(0)), F.sum(n)).alias("below_min_size_cell_fraction"))
    return one.crossJoin(quantiles(groups, [], "n_cells", {"median_size": 0.5}))


def summarize_groups(assignment: DataFrame, group: str) -> DataFrame:
    """Per state or node: lineage, size, plain and cell-weighted mean stage, range."""
    extra = ["state_id"] if group != "state_id" else []
    return assignment.groupBy(group).agg(
        F.min("lineage").alias("lineage"),
        F.min("state_within_lineage").alias("state_within_lineage"),
        *[F.min(e).alias(e) for e in extra],
        F.count("*").alias("n_metacells"), F.sum("n_cells").alias("n_cells"),
        F.avg("mean_stage").alias("mean_stage"), F.min("mean_stage").alias("min_stage"),
        F.max("mean_stage").alias("max_stage"),
        (F.sum(F.col("mean_stage") * F.col("n_cells")) / F.sum("n_cells"))
        .alias("cell_weighted_mean_stage"))
