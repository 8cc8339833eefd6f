"""Cells of contracted nodes: cell -> microcell -> source node -> contracted node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, require_unique, require_zero


def microcell_mapping(assignments: DataFrame, sources: DataFrame) -> DataFrame:
    """microcell_id, source_node_id, contracted_node_id; -1 where a microcell belongs to no node."""
    nodes = assignments.select("microcell_id", F.col("node_id").alias("source_node_id"))
    return nodes.join(sources.select("source_node_id", "contracted_node_id"), "source_node_id", "left").select(
        "microcell_id", "source_node_id",
        F.coalesce("contracted_node_id", F.lit(-1).cast("long")).alias("contracted_node_id"))


def check_mapping(assignments: DataFrame, sources: DataFrame) -> None:
    require_unique(sources, ["source_node_id"], "source mapping")
    require_unique(assignments, ["microcell_id"], "assignments")
    require_zero(sources, negative_ids=(F.col("source_node_id") < 0) | (F.col("contracted_node_id") < 0))


def node_cells(cells: DataFrame, mapping: DataFrame, node_ids=None) -> DataFrame:
    """Member cells of all contracted nodes, or of `node_ids`."""
    names = [c for c in ("cell_id",) if c in cells.columns]  # grouped cells may carry no names
    chosen = mapping.where("contracted_node_id >= 0")
    if node_ids is not None:
        wanted = chosen.sparkSession.createDataFrame([(int(i),) for i in node_ids], "contracted_node_id long")
        unknown = wanted.join(chosen, "contracted_node_id", "left_anti").limit(1)
        if not unknown.isEmpty():
            raise ContractError(f"unknown contracted node {unknown.first()[0]}")
        chosen = chosen.join(wanted, "contracted_node_id", "left_semi")
    return cells.select("cell_index", *names, "microcell_id").join(chosen, "microcell_id").select(
        "cell_index", *names, "microcell_id", "source_node_id", "contracted_node_id")


def export_counts(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """How many cells the export holds and how many it leaves out."""
    j = cells.select("microcell_id").join(mapping, "microcell_id", "left")
    kept = F.coalesce("contracted_node_id", F.lit(-1)) >= 0
    return j.agg(F.count_if(kept).alias("exported_cells"), F.count_if(~kept).alias("excluded_cells"))
