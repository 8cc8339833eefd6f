"""The registered queries: every operator run over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.core import join_on, materialize, ship, shuffled
from arbora.functions import scalars
from arbora.functions.vectors import dimension, group_means, subset_dimensions, weighted_dimensions
from arbora.operators import (composition, contract, correlation, decoder, diagnostics, diffusion, display,
                              export, grouping, layout, markov, neighbors, potential, sampling, siblings, states, strata,
                              temporal, tree)
from arbora.operators.ordering import number_rows
from arbora.plans.shape import shaped
from arbora.sources import readers
from arbora.sources import standins as views

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}
SHAPES: dict[str, str] = {}

# Stage tables that several queries read, written once per (application, folder).
_stage_tables: dict[tuple, DataFrame] = {}


def forget_stage_tables() -> None:
    _stage_tables.clear()


def stage_table(function):
    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, function.__name__)
        if key not in _stage_tables:
            _stage_tables[key] = materialize(function(spark, folder))
        return _stage_tables[key]
    return get


def query(shape: str):
    def register(function):
        name = function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return shaped(function(spark, folder), shape)

        run.__name__, run.__doc__ = name, function.__doc__
        REGISTRY[name], SHAPES[name] = run, shape
        return run
    return register


def exploded(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("dimension", "value"))


# ---- strata, bins and group statistics -------------------------------------------------------------

@query("lineage:s stage_bin_id:i n_cells:i stage_bin_left:d stage_bin_right:d constraint_stage:d stage_bin_label:s")
def stage_strata(spark, folder):
    return strata.strata(views.cells_from_events(spark, folder), 2.5, 0.5)


@query("lineage:s stage_bin_id:i n_cells:i stage_bin_left:d stage_bin_right:d constraint_stage:d stage_bin_label:s")
def stage_strata_wide_groups(spark, folder):
    return strata.strata(views.cells_from_lineitem(spark, folder), 3.0)


@query("microcell_id:i n_cells:i mean_stage:d stage_std:d min_stage:d max_stage:d")
def stage_statistics(spark, folder):
    return strata.stage_statistics(views.cells_from_lineitem(spark, folder))


@query("microcell_id:i mean_cosine_distance:d p95_cosine_distance:d")
def compactness(spark, folder):
    cells = views.cells_from_embeddings(spark, folder).withColumn(
        "microcell_id", F.floor(F.col("stage")) * 10 + F.substring("celltype", 3, 1).cast("int") % 3)
    return strata.compactness(cells)


@query("state_id:i dimension:i value:d")
def group_centroids(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder).withColumn("state_id", F.floor(F.col("stage") / 2))
    return exploded(strata.group_centroids(nodes, "state_id"), "state_id")


@query("celltype:s dimension:i value:d")
def weighted_centroids(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    return exploded(group_means(nodes, ["celltype"], "embedding", weight="n_cells"), "celltype")


@query("state_id:i x:d y:d")
def weighted_node_positions(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder).select(
        F.floor(F.col("stage") / 2).alias("state_id"), "n_cells", F.col("embedding")[0].alias("x"),
        F.col("embedding")[1].alias("y"))
    return strata.weighted_coordinates(nodes, "state_id", ["x", "y"])


@query("n_microcells:i total_cells:i min_size:i max_size:i singleton_groups:i below_min_size_groups:i "
       "below_min_size_cell_fraction:d median_size:d")
def grouping_summary(spark, folder):
    sizes = views.cells_from_lineitem(spark, folder).groupBy("microcell_id").agg(F.count("*").alias("n_cells"))
    return strata.grouping_summary(sizes, 25)


@query("stage_not_finite:i bin_out_of_range:i")
def stage_bin_violations(spark, folder):
    binned = strata.with_stage_bins(views.cells_from_lineitem(spark, folder).withColumn("stage", F.col("price")),
                                    1e-5)
    stage, b = F.col("stage"), F.col("stage_bin_id")
    return binned.agg(F.count_if(stage.isNull() | F.isnan(stage)).alias("stage_not_finite"),
                      F.count_if((b < strata.INT_MIN) | (b > strata.INT_MAX)).alias("bin_out_of_range"))


# ---- composition and purity ------------------------------------------------------------------------

@stage_table
def event_composition(spark, folder):
    return composition.composition(views.cells_from_events(spark, folder), "microcell_id")


UNKNOWN = ("Error", " unassigned ")


@stage_table
def event_purity(spark, folder):
    # Cells have a label if there is an order of twice their number, so matched counts stay below group sizes.
    cells = views.cells_from_events(spark, folder)
    groups = cells.groupBy("microcell_id", "lineage").agg(F.count("*").alias("n_cells"))
    noted = views.table(spark, folder, "orders").select((F.col("o_orderkey")).alias("_order"))
    labelled = cells.join(noted, F.col("cell_index") * 2 == F.col("_order"), "left_semi")
    comp = composition.composition(labelled, "microcell_id")
    return composition.evaluate_purity(groups, comp, unknown=UNKNOWN)


@query("microcell_id:i celltype:s cell_count:i fraction:d rank:i")
def microcell_composition(spark, folder):
    return event_composition(spark, folder)


@query("microcell_id:i celltype:s cell_count:i fraction:d rank:i")
def line_composition(spark, folder):
    return composition.composition(views.cells_from_lineitem(spark, folder), "microcell_id")


@query("microcell_id:i dominant_celltype:s celltype_purity:d dominant_celltype_count:i celltype_types:i "
       "celltype_matched_cells:i")
def microcell_dominant_label(spark, folder):
    return composition.dominant(event_composition(spark, folder), "microcell_id")


@query("microcell_id:i celltype:s cell_count:i fraction:d rank:i")
def annotated_composition(spark, folder):
    events = views.table(spark, folder, "events")
    notes = events.select(F.concat(F.lit("cell"), (F.col("event_id") * 2).cast("string")).alias("cell"),
                          F.when(F.col("event_type") != "error", F.col("event_type")).alias("celltype"))
    return composition.annotate(views.cells_from_events(spark, folder), notes)


@query("state_id:i celltype:s cell_count:i fraction:d rank:i")
def state_composition(spark, folder):
    return composition.regroup(event_composition(spark, folder), views.microcells_from_events(spark, folder),
                               "microcell_id", "state_id")


@query("weighted_purity:d")
def state_weighted_purity(spark, folder):
    return composition.weighted_purity(composition.regroup(
        event_composition(spark, folder), views.microcells_from_events(spark, folder), "microcell_id", "state_id"))


@query("microcell_id:i n_cells:i lineage:s matched_cells:i known_cells:i unknown_cells:i unmatched_cells:i "
       "known_fraction:d purity_including_unknown:d dominant_known_celltype:s dominant_known_cells:i purity:d "
       "known_celltype_count:i celltype_entropy:d dominant_fraction_all_cells:d")
def microcell_purity(spark, folder):
    return event_purity(spark, folder)


PURITY = ("n_groups:i total_cells:i evaluable_groups:i all_matched_cells:i all_known_cells:i "
          "all_unknown_cells:i all_unmatched_cells:i matched_fraction:d known_fraction:d mean_purity:d "
          "known_cell_weighted_purity:d dominant_fraction_all_cells:d mean_entropy:d singleton_fraction:d "
          "small_group_fraction:d small_group_cell_fraction:d purity_ge_0_9_group_fraction:d "
          "purity_ge_0_9_all_cell_coverage:d purity_ge_0_9_known_cell_coverage:d purity_ge_0_95_group_fraction:d "
          "purity_ge_0_95_all_cell_coverage:d purity_ge_0_95_known_cell_coverage:d median_group_size:d "
          "median_purity:d p10_purity:d")


@query(PURITY)
def purity_summary(spark, folder):
    return composition.purity_summary(event_purity(spark, folder), small_size=60)


@query("lineage:s " + PURITY)
def purity_by_lineage(spark, folder):
    return composition.purity_summary(event_purity(spark, folder), "lineage", 60)


@query("dominant_known_celltype:s " + PURITY)
def purity_by_dominant_label(spark, folder):
    return composition.purity_summary(event_purity(spark, folder), "dominant_known_celltype", 60)


@query("step:i threshold:d coverage:d conservative_coverage:d")
def purity_coverage(spark, folder):
    return composition.purity_coverage(event_purity(spark, folder))


@query("lineage:s position:i page:i")
def purity_pages(spark, folder):
    return composition.purity_pages(
        composition.purity_summary(event_purity(spark, folder), "lineage", 60), 3)


@query("bin:i bin_left:d bin_right:d total:d")
def purity_histogram(spark, folder):
    return diagnostics.histogram(event_purity(spark, folder), "purity", 30, 0.0, 1.0, weight="known_cells")


@query("size_bin:i purity_bin:i n_groups:i")
def size_purity_grid(spark, folder):
    return display.size_purity_grid(event_purity(spark, folder))


# ---- temporal nodes --------------------------------------------------------------------------------

@stage_table
def fixed_assignment(spark, folder):
    return temporal.fixed_nodes(views.microcells_from_events(spark, folder), 4.0)


@stage_table
def filtered_nodes(spark, folder):
    return temporal.support_filter(strata.summarize_groups(fixed_assignment(spark, folder), "node_id"), 100)


@query("microcell_id:i state_id:i predicted_stage_bin:i stage_bin_left:d stage_bin_right:d node_id:i")
def fixed_temporal_nodes(spark, folder):
    return fixed_assignment(spark, folder)


GROUP = ("lineage:s state_within_lineage:i n_metacells:i n_cells:i mean_stage:d min_stage:d max_stage:d "
         "cell_weighted_mean_stage:d")


@query("node_id:i state_id:i " + GROUP)
def node_summary(spark, folder):
    return strata.summarize_groups(fixed_assignment(spark, folder), "node_id")


@query("state_id:i " + GROUP)
def state_summary(spark, folder):
    return strata.summarize_groups(fixed_assignment(spark, folder), "state_id")


@query("raw_node_id:i node_id:i n_cells:i passes_support_filter:b filter_reason:s")
def support_filter(spark, folder):
    return filtered_nodes(spark, folder)


@query("microcell_id:i raw_node_id:i node_id:i passes_support_filter:b")
def filtered_assignment(spark, folder):
    return temporal.apply_filter(fixed_assignment(spark, folder), filtered_nodes(spark, folder))


@query("microcell_id:i state_id:i temporal_segment_within_state:i temporal_interval_left:d "
       "temporal_interval_right:d node_id:i")
def density_temporal_nodes(spark, folder):
    return temporal.density_nodes(views.microcells_from_events(spark, folder), 1.0, 2.0, 0.6, 6.0, 150)[0]


@query("state_id:i stage_span:d n_unique_stage_values:i n_kde_peaks:i n_accepted_valleys:i "
       "accepted_valley_stages:s n_segments_before_small_merge:i n_small_segment_merges:i "
       "n_weighted_median_splits:i n_segments_final:i n_metacells:i n_cells:i")
def density_split_diagnostics(spark, folder):
    return temporal.density_nodes(views.microcells_from_events(spark, folder), 1.0, 2.0, 0.6, 6.0, 150)[1]


@query("lineage:s temporal_segment_within_state:i n_cells:i temporal_interval_left:d temporal_interval_right:d")
def density_segments_of_lines(spark, folder):
    lines = views.cells_from_lineitem(spark, folder).select(
        F.col("microcell_id"), "lineage", F.col("stage").alias("mean_stage"), F.lit(1).alias("n_cells"),
        F.ascii("lineage").cast("long").alias("state_id"))
    placed, _ = temporal.density_nodes(lines, 2.0, 4.0, 0.9, 12.0, 500)
    return placed.groupBy("lineage", "temporal_segment_within_state").agg(
        F.sum("n_cells").alias("n_cells"), F.min("temporal_interval_left").alias("temporal_interval_left"),
        F.max("temporal_interval_right").alias("temporal_interval_right"))


# ---- neighbours ------------------------------------------------------------------------------------

K = 10


@stage_table
def node_neighbours(spark, folder):
    return markov.node_neighbours(views.nodes_from_embeddings(spark, folder), K)


@query("lineage:s id:i other:i rank:i similarity:d")
def lineage_neighbours(spark, folder):
    return node_neighbours(spark, folder).where("rank > 0")


@query("lineage:s left_id:i right_id:i knn_memberships:i cosine_similarity:d")
def neighbour_pairs(spark, folder):
    return neighbors.undirected(node_neighbours(spark, folder))


@query("lineage:s id:i local_scale:d")
def local_scales(spark, folder):
    return neighbors.local_scales(node_neighbours(spark, folder))


ADJACENT = "lineage:s left_id:i right_id:i cosine_distance:d left_scale:d right_scale:d"


@query(ADJACENT)
def bounded_adjacency(spark, folder):
    return neighbors.bounded_adjacency(node_neighbours(spark, folder), 1.05)


@query(ADJACENT)
def mutual_bounded_adjacency(spark, folder):
    return neighbors.bounded_adjacency(node_neighbours(spark, folder), 1.2, mutual=True)


@query("node:i part:i")
def adjacency_components(spark, folder):
    near = materialize(neighbors.bounded_adjacency(node_neighbours(spark, folder), 1.0))
    return states.components(views.nodes_from_embeddings(spark, folder).select(F.col("node_id").alias("node")), near)


@query("lineage:s n_metacells:i n_components:i n_isolated:i largest_component:i n_undirected_fuzzy_edges:i")
def adjacency_summary(spark, folder):
    near = materialize(neighbors.bounded_adjacency(node_neighbours(spark, folder), 1.0))
    return states.graph_summary(
        views.nodes_from_embeddings(spark, folder).withColumnRenamed("node_id", "id"), near)


@query("vec_id:i dimension:i value:d")
def dimension_subset(spark, folder):
    raw = views.table(spark, folder, "embeddings")
    return exploded(raw.select("vec_id", subset_dimensions("embedding", [3, 1, 8, 21]).alias("embedding")), "vec_id")


@query("weight_label:s vec_id:i dimension:i value:d")
def dimension_weight_sweep(spark, folder):
    raw = views.table(spark, folder, "embeddings")
    width = dimension(raw, "embedding")
    parts = [raw.select(scalars.weight_label(F.lit(w)).alias("weight_label"), "vec_id",
                        weighted_dimensions("embedding", [0, 5, 7], w, width).alias("embedding"))
             for w in (0.25, 1.5)]
    return exploded(parts[0].unionByName(parts[1]), "weight_label", "vec_id")


# ---- Markov graph ----------------------------------------------------------------------------------

@stage_table
def candidate_graph(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    edges = materialize(markov.candidate_edges(nodes, node_neighbours(spark, folder)))
    return markov.weighted_edges(edges)


@stage_table
def node_flow_table(spark, folder):
    return markov.node_flow(markov.early_roots(views.nodes_from_embeddings(spark, folder)),
                            candidate_graph(spark, folder))


@stage_table
def flowing_edges(spark, folder):
    return markov.edge_flow(candidate_graph(spark, folder), node_flow_table(spark, folder))


@stage_table
def fate_table(spark, folder):
    return markov.fates(views.nodes_from_embeddings(spark, folder), candidate_graph(spark, folder))


@query("node_id:i lineage:s stage:d root_share:d")
def lineage_roots(spark, folder):
    return markov.early_roots(views.nodes_from_embeddings(spark, folder))


@query("source_id:i target_id:i lineage:s cosine_similarity:d")
def fallback_edges(spark, folder):
    return candidate_graph(spark, folder).where("fallback_edge")


@query("source_id:i target_id:i lineage:s knn_memberships:i mutual_knn:b fallback_edge:b source_stage:d "
       "target_stage:d stage_delta:d cosine_distance:d distance_temperature:d raw_weight:d "
       "transition_probability:d")
def candidate_edges(spark, folder):
    return candidate_graph(spark, folder)


@query("source_id:i target_id:i transition_probability:d")
def fixed_temperature_edges(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    edges = markov.candidate_edges(nodes, node_neighbours(spark, folder))
    return markov.weighted_edges(edges, mutual_bonus=2.0, temperature=0.25)


@query("node_id:i flow:d")
def node_flow(spark, folder):
    return node_flow_table(spark, folder)


@query("source_id:i target_id:i markov_flow:d")
def markov_flow(spark, folder):
    return flowing_edges(spark, folder)


@query("node_id:i lineage:s")
def absorbing_nodes(spark, folder):
    return markov.sinks(views.nodes_from_embeddings(spark, folder), candidate_graph(spark, folder))


@query("node_id:i terminal_node_id:i fate_probability:d")
def fate_probabilities(spark, folder):
    return fate_table(spark, folder)


@query("node_id:i most_likely_terminal_probability:d fate_entropy:d")
def node_fates(spark, folder):
    return markov.node_fates(fate_table(spark, folder))


@query("node_id:i terminal_node_id:i fate_probability:d retained_probability_mass:d lineage:s")
def retained_fates(spark, folder):
    return markov.retained_fates(fate_table(spark, folder), views.nodes_from_embeddings(spark, folder), 0.05)


@query("source_id:i target_id:i lineage:s transition_probability:d cosine_distance:d")
def best_parents(spark, folder):
    return markov.best_parents(candidate_graph(spark, folder))


@query("source_id:i target_id:i selected_tree_edge:b")
def selected_edges(spark, folder):
    return tree.mark_selected(candidate_graph(spark, folder))


@query("n_orphans:i")
def orphan_nodes(spark, folder):
    return markov.orphans(views.nodes_from_embeddings(spark, folder), candidate_graph(spark, folder)).agg(
        F.count("*").alias("n_orphans"))


# ---- tree ------------------------------------------------------------------------------------------

@stage_table
def virtual_table(spark, folder):
    return tree.virtual_nodes(views.nodes_from_embeddings(spark, folder))


@stage_table
def tree_node_table(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    ends = markov.sinks(nodes, candidate_graph(spark, folder)).select("node_id", F.lit(True).alias("is_terminal"))
    full = nodes.join(shuffled(ends), "node_id", "left").fillna(False, ["is_terminal"]).withColumn(
        "celltype_purity", (F.col("n_cells") % 11) / F.lit(10.0)).withColumn(
        "cell_weighted_mean_stage", F.col("stage"))
    return tree.tree_nodes(full, virtual_table(spark, folder))


@stage_table
def tree_edge_table(spark, folder):
    return tree.tree_edges(views.nodes_from_embeddings(spark, folder), flowing_edges(spark, folder),
                           virtual_table(spark, folder))


@stage_table
def branch_path_table(spark, folder):
    return tree.branch_paths(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@stage_table
def branch_table(spark, folder):
    return tree.branch_segments(tree_node_table(spark, folder), tree_edge_table(spark, folder),
                                branch_path_table(spark, folder))


@query("node_id:i lineage:s node_type:s tree_stage:d n_cells:i n_metacells:i")
def tree_nodes(spark, folder):
    return tree_node_table(spark, folder)


@query("parent_id:i child_id:i lineage:s edge_kind:s virtual_edge:b cosine_distance:d "
       "transition_probability:d markov_flow:d parent_stage:d child_stage:d stage_delta:d mutual_knn:b "
       "fallback_edge:b")
def tree_edges(spark, folder):
    return tree_edge_table(spark, folder)


@query("extra_edges:i wrong_indegree:i not_forward:i")
def tree_check(spark, folder):
    return tree.check_tree(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@query("node_id:i in_degree:i out_degree:i")
def node_degrees(spark, folder):
    return tree.degrees(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@query("n_nodes:i n_roots:i n_branch_nodes:i n_terminals:i")
def topology_counts(spark, folder):
    return tree.topology_counts(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@query("segment_id:i step:i parent_id:i child_id:i start_node_id:i")
def branch_paths(spark, folder):
    return branch_path_table(spark, folder)


@query("segment_id:i start_node_id:i end_node_id:i n_edges:i n_real_nodes:i lineage:s start_stage:d end_stage:d "
       "stage_span:d n_metacells:i n_cells:i cell_weighted_celltype_purity:d")
def branch_segments(spark, folder):
    return branch_table(spark, folder)


@query("lineage:s n_nodes:i n_terminal_nodes:i n_candidate_edges:i n_mutual_knn_edges:i "
       "n_fallback_candidate_edges:i n_tree_edges:i n_fallback_tree_edges:i max_tree_cosine_distance:d "
       "max_tree_stage_delta:d median_tree_cosine_distance:d median_tree_stage_delta:d n_branch_segments:i")
def lineage_tree_summary(spark, folder):
    real = tree_node_table(spark, folder).where("node_type = 'temporal_node'")
    return tree.lineage_summary(real, candidate_graph(spark, folder), tree_edge_table(spark, folder),
                                branch_table(spark, folder))


@query("node_id:i tree_x:d tree_y:d")
def stage_layout(spark, folder):
    return tree.stage_layout(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@query("node_id:i tree_x:d tree_y:d")
def tidy_layout(spark, folder):
    return tree.tidy_layout(tree_node_table(spark, folder), tree_edge_table(spark, folder))


# ---- diagnostics -----------------------------------------------------------------------------------

@stage_table
def gap_table(spark, folder):
    return diagnostics.edge_gaps(tree_node_table(spark, folder), tree_edge_table(spark, folder), 2.0)


@stage_table
def end_table(spark, folder):
    return diagnostics.terminals(tree_node_table(spark, folder), gap_table(spark, folder))


@query("parent_id:i child_id:i lineage:s parent_stage:d child_stage:d signed_stage_delta:d stage_gap:d "
       "below_threshold:b")
def edge_stage_gaps(spark, folder):
    return gap_table(spark, folder)


@query("node_id:i lineage:s terminal_stage:d n_cells:i celltype_purity:d")
def terminal_nodes(spark, folder):
    return end_table(spark, folder)


@query("node_id:i lineage:s node_stage:d n_cells:i n_metacells:i")
def node_sizes(spark, folder):
    return diagnostics.node_sizes(tree_node_table(spark, folder))


@query("n_nodes_including_virtual:i n_temporal_nodes:i total_cells_across_nodes:i min_node_cells:i "
       "max_node_cells:i n_edges_including_virtual:i n_real_edges:i n_edges_below_threshold:i "
       "fraction_edges_below_threshold:d n_nonforward_real_edges:i n_terminal_nodes:i")
def tree_summary(spark, folder):
    return diagnostics.tree_summary(tree_node_table(spark, folder), tree_edge_table(spark, folder),
                                    gap_table(spark, folder), end_table(spark, folder))


@query("lineage:s n_nodes:i total_node_cells:i n_edges:i n_edges_below_threshold:i n_terminal_nodes:i "
       "median_terminal_stage:d median_node_cells:d fraction_edges_below_threshold:d")
def tree_lineage_table(spark, folder):
    return diagnostics.lineage_table(tree_node_table(spark, folder), gap_table(spark, folder),
                                     end_table(spark, folder))


@query("measure:s q10:d q25:d median:d q75:d q90:d")
def tree_quantiles(spark, folder):
    real = tree_node_table(spark, folder).where("node_type = 'temporal_node'")
    return diagnostics.quantile_table(edge_stage_gap=(gap_table(spark, folder), "stage_gap"),
                                      terminal_stage=(end_table(spark, folder), "terminal_stage"),
                                      node_cell_count=(real, "n_cells"))


@query("bin:i bin_left:d bin_right:d total:i")
def stage_gap_histogram(spark, folder):
    return diagnostics.histogram(gap_table(spark, folder), "stage_gap", 36, 0.0, 25.0)


@query("bin:i bin_left:d bin_right:d total:i")
def node_size_histogram(spark, folder):
    real = tree_node_table(spark, folder).where("node_type = 'temporal_node'")
    return diagnostics.histogram(real.withColumn("size", F.col("n_cells") + 0.5), "size", 32, 1.0, 100.0, scale="log")


@query("bin:i bin_left:d bin_right:d total:i")
def line_price_histogram(spark, folder):
    lines = views.cells_from_lineitem(spark, folder).withColumn("cents", F.round(F.col("price") * 100).cast("long"))
    return diagnostics.histogram(lines, "stage", 24, weight="cents")


# ---- contraction -----------------------------------------------------------------------------------

PATH, SPAN, NEAR, GAP = 0.85, 6.0, 0.85, 3.0


@stage_table
def real_edge_table(spark, folder):
    return tree.real_edges(tree_node_table(spark, folder), tree_edge_table(spark, folder))


@stage_table
def first_groups(spark, folder):
    return contract.path_groups(views.nodes_from_embeddings(spark, folder), real_edge_table(spark, folder),
                                PATH, SPAN)


def _sibling_pass(spark, folder):
    key = (spark.sparkContext.applicationId, folder, "_sibling_pass")
    if key not in _stage_tables:
        merged, history = siblings.merge_siblings(views.nodes_from_embeddings(spark, folder), first_groups(spark, folder),
                                                  real_edge_table(spark, folder), NEAR, GAP)
        _stage_tables[key] = materialize(merged), materialize(history)
    return _stage_tables[key]


@stage_table
def sibling_groups(spark, folder):
    return _sibling_pass(spark, folder)[0]


@stage_table
def final_groups(spark, folder):
    return contract.second_path_pass(views.nodes_from_embeddings(spark, folder), sibling_groups(spark, folder),
                                     real_edge_table(spark, folder), PATH, SPAN)


@stage_table
def mapping_table(spark, folder):
    return contract.source_mapping(views.nodes_from_embeddings(spark, folder), final_groups(spark, folder),
                                   real_edge_table(spark, folder))


@stage_table
def contracted_table(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    labels = nodes.select("node_id", "celltype", F.col("n_cells").alias("cell_count"))
    return contract.contracted_nodes(nodes, mapping_table(spark, folder), labels)


def _rebuilt(spark, folder):
    return contract.rebuilt_tree(contracted_table(spark, folder), tree_node_table(spark, folder),
                                 tree_edge_table(spark, folder), mapping_table(spark, folder))


@query("node_id:i chain_id:i place:i is_anchor:b")
def degree_two_chains(spark, folder):
    return contract.chains(views.nodes_from_embeddings(spark, folder).select("node_id"), real_edge_table(spark, folder))


@query("node_id:i")
def anchor_nodes(spark, folder):
    return contract.anchors(views.nodes_from_embeddings(spark, folder), real_edge_table(spark, folder))


@query("node_id:i head_id:i")
def path_groups(spark, folder):
    return first_groups(spark, folder)


@stage_table
def path_mapping_table(spark, folder):
    return contract.source_mapping(views.nodes_from_embeddings(spark, folder), first_groups(spark, folder),
                                   real_edge_table(spark, folder))


@stage_table
def path_contracted_table(spark, folder):
    return contract.contracted_nodes(views.nodes_from_embeddings(spark, folder), path_mapping_table(spark, folder))


@query("source_node_id:i contracted_node_id:i position_within_contracted_node:i source_was_anchor:b")
def path_source_mapping(spark, folder):
    return path_mapping_table(spark, folder)


@query("node_id:i lineage:s n_source_nodes:i n_metacells:i n_cells:i mean_stage:d cell_weighted_mean_stage:d "
       "min_stage:d max_stage:d")
def path_contracted_nodes(spark, folder):
    return path_contracted_table(spark, folder)


@query("node_id:i dimension:i value:d")
def path_contracted_vectors(spark, folder):
    return exploded(path_contracted_table(spark, folder), "node_id")


@query("parent_id:i child_id:i lineage:s edge_kind:s virtual_edge:b parent_stage:d child_stage:d stage_delta:d")
def path_contracted_edges(spark, folder):
    return contract.rebuilt_tree(path_contracted_table(spark, folder), tree_node_table(spark, folder),
                                 tree_edge_table(spark, folder), path_mapping_table(spark, folder))[1]


@query("head_id:i lineage:s n_cells:i stage:d min_source:i n_sources:i")
def path_group_statistics(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    # Groups of equal label inside a lineage stand in for a partition that SQL can restate.
    heads = nodes.groupBy("lineage", "celltype").agg(F.min("node_id").alias("head_id"))
    groups = nodes.join(heads, ["lineage", "celltype"]).select("node_id", "head_id")
    return contract.group_nodes(nodes, groups)


@query("merge_order:i parent_head:i left_head:i right_head:i depth:i cosine_distance:d "
       "mean_stage_gap:d merged_mean_stage:d left_was_leaf:b right_was_leaf:b")
def sibling_merge_history(spark, folder):
    return _sibling_pass(spark, folder)[1]


@query("merge_order:i side:s node_id:i")
def sibling_merge_members(spark, folder):
    """The nodes of both groups and of their parent at every merge."""
    return siblings.merge_members(first_groups(spark, folder), _sibling_pass(spark, folder)[1])


@query("source_node_id:i contracted_node_id:i position_within_contracted_node:i source_was_anchor:b")
def source_to_contracted_nodes(spark, folder):
    return mapping_table(spark, folder)


@query("node_id:i lineage:s n_source_nodes:i n_metacells:i n_cells:i mean_stage:d cell_weighted_mean_stage:d "
       "min_stage:d max_stage:d dominant_celltype:s dominant_celltype_cells:i celltype_purity:d")
def contracted_nodes(spark, folder):
    return contracted_table(spark, folder)


@query("node_id:i lineage:s node_type:s tree_stage:d n_cells:i n_source_nodes:i")
def contracted_tree_nodes(spark, folder):
    return _rebuilt(spark, folder)[0]


@query("parent_id:i child_id:i lineage:s edge_kind:s virtual_edge:b source_parent_id:i source_child_id:i "
       "parent_stage:d child_stage:d stage_delta:d")
def contracted_tree_edges(spark, folder):
    return _rebuilt(spark, folder)[1]


@query("n_source_nodes:i n_contracted_nodes:i removed_by_paths:i removed_by_siblings:i "
       "removed_by_second_paths:i max_sources:i merged_groups:i merged_anchors:i")
def contraction_summary(spark, folder):
    return contract.contraction_summary(
        views.nodes_from_embeddings(spark, folder), first_groups(spark, folder), sibling_groups(spark, folder),
        final_groups(spark, folder), mapping_table(spark, folder))


@query("parent_id:i child_id:i lineage:s edge_kind:s virtual_edge:b stage_delta:d")
def label_contracted_edges(spark, folder):
    """Rebuilt edges when every celltype and stage decade of a lineage becomes one node."""
    nodes = views.nodes_from_embeddings(spark, folder)
    mapping = _decades(nodes)
    contracted = materialize(contract.contracted_nodes(nodes, mapping))
    return contract.rebuilt_tree(contracted, tree_node_table(spark, folder), tree_edge_table(spark, folder),
                                 mapping)[1]


def _decades(nodes: DataFrame) -> DataFrame:
    keyed = nodes.withColumn("decade", F.floor(F.col("stage") / 5))
    groups = keyed.select("lineage", "celltype", "decade").distinct()
    numbered = number_rows(groups, [], ["lineage", "celltype", "decade"], "contracted_node_id")
    return materialize(keyed.join(numbered, ["lineage", "celltype", "decade"]).select(
        F.col("node_id").alias("source_node_id"), "contracted_node_id"))


@query("node_id:i lineage:s n_source_nodes:i n_metacells:i n_cells:i mean_stage:d cell_weighted_mean_stage:d "
       "min_stage:d max_stage:d dominant_celltype:s dominant_celltype_cells:i celltype_purity:d")
def label_contracted_nodes(spark, folder):
    nodes = views.nodes_from_embeddings(spark, folder)
    labels = nodes.select("node_id", F.concat(F.lit("g"), (F.col("n_cells") % 3).cast("string")).alias("celltype"),
                          F.col("n_cells").alias("cell_count"))
    return contract.contracted_nodes(nodes, _decades(nodes), labels)


# ---- grouping and states ---------------------------------------------------------------------------

@stage_table
def cohesive_assignment(spark, folder):
    options = grouping.GroupingOptions(target_size=8, min_size=4, max_size=16, k=10, pile_size=200, bin_width=5.5)
    return grouping.microcells(views.cells_from_embeddings(spark, folder), options)


@query("cell_index:i lineage:s stage_bin_id:i microcell_id:i")
def cohesive_microcells(spark, folder):
    return cohesive_assignment(spark, folder)


@query("cell_index:i lineage:s stage_bin_id:i microcell_id:i")
def balanced_microcells(spark, folder):
    options = grouping.GroupingOptions(method="balanced", target_size=8, k=10, pile_size=200, bin_width=5.5)
    return grouping.microcells(views.cells_from_embeddings(spark, folder), options)


@stage_table
def fuzzy_edges(spark, folder):
    return states.fuzzy_graph(views.nodes_from_embeddings(spark, folder).withColumnRenamed("node_id", "id"), 15)


@stage_table
def community_table(spark, folder):
    return states.communities(views.nodes_from_embeddings(spark, folder).withColumnRenamed("node_id", "id"),
                              fuzzy_edges(spark, folder), 1.0)


@query("lineage:s left_id:i right_id:i weight:d")
def fuzzy_graph(spark, folder):
    return fuzzy_edges(spark, folder)


@query("lineage:s n_metacells:i n_components:i n_isolated:i largest_component:i n_undirected_fuzzy_edges:i")
def lineage_graph_summary(spark, folder):
    return states.graph_summary(views.nodes_from_embeddings(spark, folder).withColumnRenamed("node_id", "id"),
                                fuzzy_edges(spark, folder))


@query("microcell_id:i lineage:s state_within_lineage:i state_id:i")
def embedding_states(spark, folder):
    return states.number_states(community_table(spark, folder))


@query("lineage:s modularity:d")
def state_modularity(spark, folder):
    return states.modularity(community_table(spark, folder), fuzzy_edges(spark, folder))


@query("lineage:s n_members:i n_unsettled:i n_disconnected:i")
def state_optimality(spark, folder):
    """No single move raises modularity and no state falls apart."""
    return states.settled_check(community_table(spark, folder), fuzzy_edges(spark, folder), 1.0)


@query("lineage:s modularity:d")
def label_modularity(spark, folder):
    pairs = neighbors.undirected(node_neighbours(spark, folder)).withColumnRenamed("cosine_similarity", "weight")
    found = views.nodes_from_embeddings(spark, folder).select(
        F.col("node_id").alias("node"), "lineage", F.floor(F.col("stage") / 4).alias("community"))
    return states.modularity(found, pairs, 0.5)


# ---- correlations and maps -------------------------------------------------------------------------

def _staged_vectors(spark, folder):
    return views.nodes_from_embeddings(spark, folder).select(
        F.col("node_id").alias("id"), "lineage", "stage", "embedding")


@stage_table
def correlation_table(spark, folder):
    return correlation.dimension_correlations(_staged_vectors(spark, folder))


@query("dimension:i global_pearson:d global_spearman:d within_lineage_spearman:d lineage_median_abs_spearman:d "
       "lineage_positive_fraction:d lineage_negative_fraction:d lineage_same_sign_fraction:d "
       "abs_within_lineage_spearman:d")
def dimension_correlations(spark, folder):
    return correlation_table(spark, folder)


@query("lineage:s dimension:i spearman:d")
def lineage_spearman(spark, folder):
    return correlation.lineage_spearman(_staged_vectors(spark, folder))


@query("dimension:i place:i")
def top_stage_dimensions(spark, folder):
    return correlation.top_dimensions(correlation_table(spark, folder), 5)


@query("a:i b:i w:d")
def gaussian_graph(spark, folder):
    return diffusion.gaussian_graph(_staged_vectors(spark, folder), 15)


@query("a:i b:i t:d")
def transition_matrix(spark, folder):
    return diffusion.transition_matrix(diffusion.gaussian_graph(_staged_vectors(spark, folder), 15))


@stage_table
def diffusion_matrix(spark, folder):
    return diffusion.transition_matrix(diffusion.gaussian_graph(_staged_vectors(spark, folder), 15))


def _diffused(spark, folder):
    return diffusion.diffusion_map(_staged_vectors(spark, folder), 8, 15, matrix=diffusion_matrix(spark, folder))


@stage_table
def diffusion_coordinates(spark, folder):
    points, values = _diffused(spark, folder)
    return points.join(F.broadcast(values), "component")


@query("id:i component:i value:d")
def diffusion_map(spark, folder):
    return diffusion_coordinates(spark, folder).drop("eigenvalue")


@query("component:i n_points:i is_unit:i is_eigenvector:i is_orthogonal:i")
def diffusion_residuals(spark, folder):
    """Every component is a unit vector, an eigenvector and orthogonal to the others."""
    found = diffusion_coordinates(spark, folder)
    values = found.groupBy("component").agg(F.first("eigenvalue").alias("eigenvalue"))
    checked = diffusion.residual_check(diffusion_matrix(spark, folder), found.drop("eigenvalue"), values)
    yes = lambda c: c.cast("int")
    return checked.select("component", "n_points", yes(F.abs(F.col("size") - 1) < 1e-9).alias("is_unit"),
                          yes(F.col("residual") < 1e-5).alias("is_eigenvector"), yes(F.col("overlap") < 1e-8).alias("is_orthogonal"))


@query("component:s component_index:i eigenvalue_order:i stage_pearson:d stage_spearman:d abs_stage_pearson:d "
       "abs_stage_spearman:d")
def diffusion_stage_correlations(spark, folder):
    points = diffusion_coordinates(spark, folder)
    wide = points.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("component", "value"))).alias("c"))
    staged = _staged_vectors(spark, folder).select("id", "stage")
    return correlation.component_correlations(
        wide.select("id", F.col("c.value").alias("embedding")).join(staged, "id"))


@query("id:i component:i value:d")
def display_layout_2d(spark, folder):
    return layout.display_layout(_staged_vectors(spark, folder), 2, 15)


@query("id:i component:i value:d")
def display_layout_3d(spark, folder):
    return layout.display_layout(_staged_vectors(spark, folder), 3, 15)


@query("a:i b:i w:d")
def decay_graph(spark, folder):
    return potential.decay_graph(_staged_vectors(spark, folder), 5, 40.0)


@query("id:i component:i value:d")
def potential_layout(spark, folder):
    return potential.potential_layout(_staged_vectors(spark, folder), 2, 5, 40.0, landmarks=400)


@query("node_id:i position:i value:d")
def decoded_nodes(spark, folder):
    """Two layers whose weights are the mean vectors of the labels and of the stage decades."""
    nodes = views.nodes_from_embeddings(spark, folder)
    by_label = group_means(nodes, ["celltype"], "embedding")
    first = number_rows(by_label, [], ["celltype"], "position").select(
        F.lit(0).alias("layer"), F.lit("weight").alias("kind"), "position", F.col("embedding").alias("values"))
    # The hidden layer has one place per label that there is, in the order of the labels.
    cells = nodes.groupBy(F.floor(F.col("stage") / 5).alias("decade"), "celltype").agg((F.avg("stage") / 10).alias("w"))
    grid = nodes.select(F.floor(F.col("stage") / 5).alias("decade")).distinct().crossJoin(F.broadcast(by_label.select("celltype")))
    profile = join_on(grid, cells, ["decade", "celltype"], "left").groupBy("decade").agg(F.sort_array(F.collect_list(
        F.struct("celltype", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("v"))
    second = number_rows(profile, [], ["decade"], "position").select(
        F.lit(1).alias("layer"), F.lit("weight").alias("kind"), "position", F.col("v.w").alias("values"))
    done = decoder.decode(nodes.select("node_id", "embedding"), first.unionByName(second))
    return done.select("node_id", F.posexplode("decoded").alias("position", "value"))


# ---- sampling, export, checks, display -------------------------------------------------------------

@query("cell_index:i microcell_id:i celltype:s")
def sampled_cells(spark, folder):
    return sampling.capped_sample(views.cells_from_events(spark, folder), 20, "microcell_id")


@query("key:i microcell_id:i lineage:s price:d")
def sampled_lines_per_lineage(spark, folder):
    lines = views.cells_from_lineitem(spark, folder).withColumn("key", F.col("order_id") * 10 + F.col("line"))
    return sampling.capped_sample(lines, 50, "lineage", "key")


@query("cell_index:i")
def simple_sample(spark, folder):
    return sampling.simple_sample(views.cells_from_events(spark, folder), 500, "cell_index")


def _node_mapping(spark, folder):
    assigned = temporal.apply_filter(fixed_assignment(spark, folder), filtered_nodes(spark, folder))
    sources = filtered_nodes(spark, folder).where("node_id >= 0").select(
        F.col("node_id").alias("source_node_id"), F.floor(F.col("node_id") / 3).alias("contracted_node_id"))
    return export.microcell_mapping(assigned, sources)


@query("cell_index:i cell_id:s microcell_id:i source_node_id:i contracted_node_id:i")
def node_cells_export(spark, folder):
    return export.node_cells(views.cells_from_events(spark, folder), _node_mapping(spark, folder))


@query("exported_cells:i excluded_cells:i")
def export_counts(spark, folder):
    return export.export_counts(views.cells_from_events(spark, folder), _node_mapping(spark, folder))


@query("idx_out_of_range:i duplicate_idx:i cell_id_mismatch:i not_finite:i missing_cells:i")
def predicted_stage_violations(spark, folder):
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), F.concat(F.lit("cell"), F.col("o_custkey").cast("string")).alias("cell_id"),
        F.col("o_totalprice").alias("predicted_stage"))
    return readers.stage_violations(orders, views.cells_from_events(spark, folder))


@query("microcell_id:i mean_true_stage:d")
def true_stage_means(spark, folder):
    cells = views.cells_from_events(spark, folder)
    stages = cells.select(F.col("cell_index").alias("idx"), (F.col("stage") * 2 + 1).alias("true_stage"))
    sizes = cells.groupBy("microcell_id").agg(F.count("*").alias("n_cells"))
    return readers.true_stage(cells, stages, sizes)


@query("c_custkey:i nation:s")
def dictionary_decode(spark, folder):
    nations = views.table(spark, folder, "nation").select(F.col("n_nationkey").alias("code"),
                                                          F.col("n_name").alias("value"))
    return readers.decode_dictionary(views.table(spark, folder, "customer"), "c_nationkey",
                                     nations, "nation")


@query("repeated_ids:i gaps_in_ids:i cells_not_accounted:i assignment_span_error:i")
def run_table_check(spark, folder):
    cells = views.cells_from_events(spark, folder)
    lines = views.cells_from_lineitem(spark, folder).groupBy("microcell_id").agg(F.count("*").alias("n_cells"))
    return readers.check_run_tables(lines, cells)


@query("unmatched_rows:i n_cells_differs:i mean_stage_differs:i")
def saved_coordinate_check(spark, folder):
    micro = views.microcells_from_events(spark, folder)
    cells = views.cells_from_events(spark, folder)
    saved = cells.groupBy("microcell_id").agg(F.count("*").alias("n_cells"), F.max("stage").alias("mean_stage"))
    return readers.coordinate_mismatches(saved, micro.withColumn("mean_stage", F.round("mean_stage", 1)))


@query("celltype:s total:i position:i")
def label_weights(spark, folder):
    return display.label_weights(views.nodes_from_embeddings(spark, folder), "celltype")


@query("label:s total:i position:i color:s")
def label_colors(spark, folder):
    groups = contracted_table(spark, folder).withColumn(
        "label", scalars.display_label(F.col("dominant_celltype"), F.col("celltype_purity"), 0.6))
    return display.label_colors(groups, "label")


@query("microcell_id:i lineage:s lineage_code:i")
def category_codes(spark, folder):
    return display.category_codes(views.microcells_from_events(spark, folder), "lineage")


@query("node_id:i marker_size:d")
def marker_sizes(spark, folder):
    return display.marker_sizes(views.nodes_from_embeddings(spark, folder))


@query("microcell_id:i label:s")
def mixed_labels(spark, folder):
    top = composition.dominant(event_composition(spark, folder), "microcell_id")
    return top.select("microcell_id", scalars.display_label(
        F.col("dominant_celltype"), F.col("celltype_purity"), 0.35).alias("label"))


@query("microcell_id:i clipped_stage:d")
def clipped_stages(spark, folder):
    return views.microcells_from_events(spark, folder).select(
        "microcell_id", scalars.clipped(F.col("mean_stage"), 40.0, 60.0).alias("clipped_stage"))


@query("p_partkey:i p_name:s stem:s")
def file_stems(spark, folder):
    return views.table(spark, folder, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" / "), "p_brand", F.lit("#"), "p_type").alias("p_name")).select(
        "p_partkey", "p_name", scalars.file_stem(F.col("p_name")).alias("stem"))
