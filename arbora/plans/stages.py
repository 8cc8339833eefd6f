"""The four stages from cells to a contracted tree. Each returns its tables by name.

Tables that several later steps read are written once; everything else stays a lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, join_on, materialize, require_columns, require_zero
from arbora.functions.vectors import require_vectors
from arbora.operators import composition as comp
from arbora.operators import contract, markov, siblings, states, strata, temporal, tree
from arbora.operators.grouping import GroupingOptions, microcells

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class StateOptions:
    k: int = 30
    resolution: float = 0.5
    iterations: int = 2
    seed: int = 42
    split: str = "fixed"
    bin_width: float = 2.0
    bandwidth: float = 0.5
    min_peak_distance: float = 1.0
    valley_ratio: float = 0.6
    max_span: float = 3.0
    min_cells: int = 50

    def check(self) -> None:
        if self.split not in ("fixed", "kde"):
            raise ContractError("split must be fixed or kde")
        if self.k < 1 or self.resolution <= 0 or self.iterations == 0 or self.min_cells < 1:
            raise ContractError("k, resolution, iterations and min_cells must be positive")
        if min(self.bin_width, self.bandwidth, self.min_peak_distance) <= 0 or self.max_span < 0:
            raise ContractError("widths and distances must be positive")
        if not 0 < self.valley_ratio <= 1:
            raise ContractError("valley ratio must lie in (0, 1]")


@dataclass(frozen=True)
class TreeOptions:
    k: int = 10
    root_window: float = 0.5
    mutual_bonus: float = 1.5
    temperature: float = 0.0
    fate_threshold: float = 1e-4

    def check(self) -> None:
        if self.k < 1 or not 0 <= self.root_window < float("inf"):
            raise ContractError("k must be positive and the root window finite and not negative")
        if not 0 < self.mutual_bonus < float("inf") or not 0 <= self.temperature < float("inf"):
            raise ContractError("the mutual bonus is positive, the temperature not negative, both finite")
        if not 0 <= self.fate_threshold <= 1:
            raise ContractError("the fate threshold lies in [0, 1]")


@dataclass(frozen=True)
class ContractOptions:
    max_distance: float = 0.08
    max_span: float = 6.0
    merge_siblings: bool = False
    sibling_distance: float = 0.2
    sibling_gap: float = 1.0

    def check(self) -> None:
        if not 0 <= self.max_distance <= 2 or self.max_span < 0:
            raise ContractError("distance must lie in [0, 2] and span must not be negative")
        if not 0 <= self.sibling_distance <= 2 or self.sibling_gap < 0:
            raise ContractError("sibling distance must lie in [0, 2] and gap must not be negative")


def group_cells(cells: DataFrame, annotations: DataFrame | None = None,
                options: GroupingOptions = GroupingOptions(), stage_source: str = "predicted_stage") -> Tables:
    """Cells (cell_index, [cell_id,] lineage, stage, embedding) to microcells."""
    require_columns(cells, {"cell_index", "lineage", "stage", "embedding"}, "cells")
    width = require_vectors(cells, "embedding")
    strata.check_stage_bins(strata.with_stage_bins(cells, options.bin_width, options.bin_origin))
    assigned = materialize(microcells(cells, options))
    members = cells.join(assigned.select("cell_index", "microcell_id"), "cell_index")
    vectors = strata.group_means(members, ["microcell_id"], "embedding", width)
    place = assigned.groupBy("microcell_id").agg(F.min("lineage").alias("lineage"),
                                                 F.min("stage_bin_id").alias("stage_bin_id"))
    table = strata.bin_edges(place, options.bin_width, options.bin_origin)
    table = (table.join(strata.stage_statistics(members), "microcell_id")
             .join(strata.compactness(members), "microcell_id").join(vectors, "microcell_id")
             .withColumn("stage_source", F.lit(stage_source))
             .withColumn("below_min_size", F.col("n_cells") < options.min_size))
    result = {"cell_to_microcell": assigned}
    if annotations is not None:
        labels = materialize(comp.annotate(members, annotations))
        table = join_on(table, comp.dominant(labels, "microcell_id"), ["microcell_id"], "left").fillna(
            {"dominant_celltype": "Unknown", "dominant_celltype_count": 0, "celltype_types": 0,
             "celltype_matched_cells": 0})
        result["microcell_celltype_composition"] = labels
    result["microcells"] = materialize(table)
    result["grouping_summary"] = strata.grouping_summary(result["microcells"], options.min_size)
    return result


def check_microcells(table: DataFrame) -> None:
    require_columns(table, {"microcell_id", "n_cells", "mean_stage", "stage_source", "lineage",
                            "embedding"}, "microcells")
    stage = F.col("mean_stage")
    require_zero(table, other_stage_source=F.col("stage_source") != "predicted_stage",
                 stage_not_finite=stage.isNull() | F.isnan(stage) | (F.abs(stage) == float("inf")),
                 no_cells=~(F.col("n_cells") > 0), no_lineage=F.coalesce(F.trim("lineage"), F.lit("")) == "")
    require_vectors(table, "embedding")


def find_nodes(table: DataFrame, labels: DataFrame | None = None,
               options: StateOptions = StateOptions()) -> Tables:
    """Microcells to states and temporal nodes. `labels`: microcell_id, celltype, cell_count."""
    options.check()
    check_microcells(table)
    members = table.withColumnRenamed("microcell_id", "id")
    graph = materialize(states.fuzzy_graph(members, options.k))
    found = materialize(states.number_states(
        states.communities(members, graph, options.resolution, options.iterations, options.seed)))
    placed = materialize(table.join(found.drop("lineage"), "microcell_id"))
    result = {"lineage_knn_summary": states.graph_summary(members, graph)}
    if options.split == "fixed":
        placed = temporal.fixed_nodes(placed, options.bin_width)
    else:
        placed, result["temporal_split_diagnostics"] = temporal.density_nodes(
            placed, options.bandwidth, options.min_peak_distance, options.valley_ratio,
            options.max_span, options.min_cells)
    placed = materialize(placed)
    raw = materialize(strata.summarize_groups(placed, "node_id"))
    filtered = materialize(temporal.support_filter(raw, options.min_cells))
    temporal.require_retained(filtered)
    assigned = materialize(temporal.apply_filter(placed, filtered))
    kept = filtered.where("passes_support_filter")
    centroids = strata.group_centroids(assigned.where("node_id >= 0"), "node_id")
    nodes = kept.join(centroids, "node_id").drop("filter_reason")
    state_table = strata.summarize_groups(placed, "state_id")
    if labels is not None:
        node_labels = materialize(comp.regroup(labels, assigned.where("node_id >= 0"), "microcell_id", "node_id"))
        state_labels = materialize(comp.regroup(labels, placed, "microcell_id", "state_id"))

        def top(table, key):
            return comp.dominant(table, key).select(
                key, "dominant_celltype", F.col("dominant_celltype_count").alias("dominant_celltype_cells"),
                "celltype_purity")

        nodes = nodes.join(top(node_labels, "node_id"), "node_id", "left")
        state_table = state_table.join(top(state_labels, "state_id"), "state_id", "left")
        result |= {"node_celltype_composition": node_labels, "state_celltype_composition": state_labels}
    result |= {"microcell_node_assignments": assigned.drop("embedding"), "states": state_table,
               "nodes": materialize(nodes), "filtered_small_nodes": filtered.where("not passes_support_filter")}
    return result


def build_tree(nodes: DataFrame, options: TreeOptions = TreeOptions(),
               stage_column: str = "cell_weighted_mean_stage") -> Tables:
    """Nodes (node_id, lineage, n_cells, n_metacells, `stage_column`, embedding) to the rooted tree."""
    options.check()
    require_columns(nodes, {"node_id", "lineage", "n_cells", stage_column, "embedding"}, "nodes")
    if stage_column != "stage":
        nodes = nodes.withColumn("stage", F.col(stage_column))
    graph = markov.candidate_graph(nodes, options.k, options.root_window, options.mutual_bonus,
                                   options.temperature)
    if not markov.orphans(nodes, graph, options.root_window).limit(1).isEmpty():
        raise ContractError("a later node has no earlier candidate parent")
    flow = markov.node_flow(markov.early_roots(nodes, options.root_window), graph)
    markov.require_conserved_flow(nodes, graph, flow)
    edges = materialize(tree.mark_selected(markov.edge_flow(graph, flow)))
    fate = materialize(markov.fates(nodes, edges))
    ends = markov.sinks(nodes, edges).select("node_id", F.lit(True).alias("is_terminal"))
    annotated = (nodes.join(markov.node_fates(fate), "node_id", "left").join(ends, "node_id", "left")
                 .fillna(False, ["is_terminal"]))
    annotated = materialize(annotated)
    virtual = materialize(tree.virtual_nodes(annotated, options.root_window))
    all_nodes = materialize(tree.tree_nodes(annotated, virtual))
    all_edges = materialize(tree.tree_edges(annotated, edges, virtual, options.root_window))
    tree.require_tree(all_nodes, all_edges)
    segments = materialize(tree.branch_segments(all_nodes, all_edges))
    return {"candidate_markov_edges": edges,
            "node_fate_probabilities": markov.retained_fates(fate, nodes, options.fate_threshold),
            "tree_nodes": materialize(tree.stage_layout(all_nodes, all_edges)), "tree_edges": all_edges,
            "branch_segments": segments,
            "lineage_tree_summary": tree.lineage_summary(annotated, edges, all_edges, segments)}



def contract_tree(tree_nodes: DataFrame, tree_edges: DataFrame, labels: DataFrame | None = None,
                  options: ContractOptions = ContractOptions()) -> Tables:
    """Contracted tree of a built tree. `labels`: node_id, celltype, cell_count."""
    options.check()
    real = materialize(tree_nodes.where(F.col("node_type") == tree.REAL).drop("tree_x", "tree_y"))
    edges = materialize(tree.real_edges(tree_nodes, tree_edges))
    contract.require_single_parents(edges)
    first = contract.path_groups(real, edges, options.max_distance, options.max_span)
    merged, final, history = first, first, None
    if options.merge_siblings:
        merged, history = siblings.merge_siblings(real, first, edges, options.sibling_distance,
                                                  options.sibling_gap)
        final = contract.second_path_pass(real, merged, edges, options.max_distance, options.max_span)
    mapping = materialize(contract.source_mapping(real, final, edges))
    contracted = materialize(contract.contracted_nodes(real, mapping, labels))
    nodes, new_edges = contract.rebuilt_tree(contracted, tree_nodes, tree_edges, mapping)
    nodes, new_edges = materialize(nodes), materialize(new_edges)
    contract.require_conserved(tree_nodes, tree_edges, nodes, new_edges, options.merge_siblings)
    result = {"tree_nodes": materialize(tree.tidy_layout(nodes, new_edges)), "tree_edges": new_edges,
              "source_to_contracted_nodes": mapping,
              "contraction_summary": contract.contraction_summary(real, first, merged, final, mapping)}
    if history is not None:
        result["sibling_merge_history"] = history
        result["sibling_merge_members"] = materialize(siblings.merge_members(first, history))
    if labels is not None:
        result["node_celltype_composition"] = comp.regroup(
            labels, mapping.withColumnRenamed("source_node_id", "node_id"), "node_id", "contracted_node_id"
        ).withColumnRenamed("contracted_node_id", "node_id")
    return result
