"""Tables about finished trees: edge gaps, terminals, node sizes, summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.core import shuffled
from arbora.functions.scalars import ratio
from arbora.operators.ordering import quantiles
from arbora.operators.tree import REAL

# The five probabilities every quantile set reports.
FIVE = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}


def edge_gaps(nodes: DataFrame, edges: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Real edges with signed and absolute stage gap and whether the gap is below the threshold."""
    stage = nodes.where(F.col("node_type") == REAL).select("node_id", "cell_weighted_mean_stage")
    up = stage.select(F.col("node_id").alias("parent_id"),
                      F.col("cell_weighted_mean_stage").alias("parent_stage"))
    down = stage.select(F.col("node_id").alias("child_id"),
                        F.col("cell_weighted_mean_stage").alias("child_stage"))
    return (edges.select("parent_id", "child_id", "lineage")
            .join(shuffled(up), "parent_id").join(shuffled(down), "child_id")
            .withColumn("signed_stage_delta", F.col("child_stage") - F.col("parent_stage"))
            .withColumn("stage_gap", F.abs("signed_stage_delta"))
            .withColumn("below_threshold", F.col("stage_gap") < threshold))


def terminals(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """Real nodes that are nobody's parent."""
    real = nodes.where(F.col("node_type") == REAL)
    keep = [c for c in ("dominant_celltype", "celltype_purity") if c in nodes.columns]
    parents = gaps.select(F.col("parent_id").alias("node_id")).distinct()
    return real.join(shuffled(parents), "node_id", "left_anti").select(
        "node_id", "lineage", F.col("cell_weighted_mean_stage").alias("terminal_stage"), "n_cells", *keep)


def node_sizes(nodes: DataFrame) -> DataFrame:
    real = nodes.where(F.col("node_type") == REAL)
    keep = [c for c in ("n_metacells", "n_source_nodes", "dominant_celltype", "celltype_purity")
            if c in nodes.columns]
    return real.select("node_id", "lineage", F.col("cell_weighted_mean_stage").alias("node_stage"),
                       "n_cells", *keep)


def quantile_table(**columns: tuple[DataFrame, str]) -> DataFrame:
    """One row of five quantiles per named (table, column)."""
    rows = [quantiles(df, [], c, FIVE).select(F.lit(name).alias("measure"), *FIVE)
            for name, (df, c) in columns.items()]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


def tree_summary(nodes: DataFrame, edges: DataFrame, gaps: DataFrame, ends: DataFrame) -> DataFrame:
    """One row of counts about a tree. Edges of negative gap count as not forward, equal stages do not."""
    real = F.col("node_type") == REAL
    n = nodes.agg(F.count("*").alias("n_nodes_including_virtual"),
                  F.count_if(real).alias("n_temporal_nodes"),
                  F.sum(F.when(real, F.col("n_cells"))).alias("total_cells_across_nodes"),
                  F.min(F.when(real, F.col("n_cells"))).alias("min_node_cells"),
                  F.max(F.when(real, F.col("n_cells"))).alias("max_node_cells"))
    e = edges.agg(F.count("*").alias("n_edges_including_virtual"))
    g = gaps.agg(F.count("*").alias("n_real_edges"),
                 F.count_if("below_threshold").alias("n_edges_below_threshold"),
                 ratio(F.count_if("below_threshold"), F.count("*")).alias("fraction_edges_below_threshold"),
                 F.count_if(F.col("signed_stage_delta") < 0).alias("n_nonforward_real_edges"))
    t = ends.agg(F.count("*").alias("n_terminal_nodes"))
    return n.crossJoin(e).crossJoin(g).crossJoin(t)


def lineage_table(nodes: DataFrame, gaps: DataFrame, ends: DataFrame) -> DataFrame:
    """Counts and medians of a tree per lineage."""
    real = nodes.where(F.col("node_type") == REAL)
    n = real.groupBy("lineage").agg(F.count("*").alias("n_nodes"), F.sum("n_cells").alias("total_node_cells"))
    e = gaps.groupBy("lineage").agg(F.count("*").alias("n_edges"),
                                    F.count_if("below_threshold").alias("n_edges_below_threshold"))
    t = ends.groupBy("lineage").agg(F.count("*").alias("n_terminal_nodes"))
    for other in (e, t, quantiles(ends, ["lineage"], "terminal_stage", {"median_terminal_stage": 0.5}),
                  quantiles(real, ["lineage"], "n_cells", {"median_node_cells": 0.5})):
        n = n.join(other, "lineage", "left")
    n = n.fillna(0, ["n_edges", "n_edges_below_threshold", "n_terminal_nodes"])
    return n.withColumn("fraction_edges_below_threshold",
                        ratio(F.col("n_edges_below_threshold"), F.col("n_edges")))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None,
              weight: str | None = None, scale: str = "linear") -> DataFrame:
    """Counts (or weight totals) in equal bins of a linear or logarithmic axis; empty bins included.

    Bins are closed on the left; the last one is closed on both sides. Open ends come from the data.
    """
    v = F.col(value).cast("double")
    source = df.select(v.alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    ends = source.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low_column = F.col("_min") if low is None else F.lit(float(low))
    high_column = F.col("_max") if high is None else F.lit(float(high))
    ends = ends.select(low_column.alias("_low"), high_column.alias("_high"))

    def axis(x: Column) -> Column:
        return F.ln(x) if scale == "log" else x

    step = (axis(F.col("_high")) - axis(F.col("_low"))) / F.lit(float(bins))
    place = F.floor(F.try_divide(axis(F.col("_v")) - axis(F.col("_low")), step))
    counted = (source.crossJoin(F.broadcast(ends)).where("_v >= _low and _v <= _high")
               .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
               .groupBy("bin").agg(F.sum("_w").alias("_total")))
    empty = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    at = axis(F.col("_low")) + F.col("bin") * step
    to = axis(F.col("_low")) + (F.col("bin") + 1) * step
    edges = (F.exp(at), F.exp(to)) if scale == "log" else (at, to)
    return (empty.join(counted, "bin", "left").crossJoin(F.broadcast(ends))
            .select("bin", edges[0].alias("bin_left"), edges[1].alias("bin_right"),
                    F.coalesce("_total", F.lit(0)).alias("total")))
