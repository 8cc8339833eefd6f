"""The rooted tree: assembly with virtual roots, checks, branch segments, layouts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize, shuffled
from arbora.functions.scalars import ratio
from arbora.operators.markov import best_parents, early_roots
from arbora.operators.ordering import number_rows, quantiles, running_sum
from arbora.operators.propagate import follow_parents, spread

REAL = "temporal_node"


def virtual_nodes(nodes: DataFrame, window: float = 0.5) -> DataFrame:
    """Lineage roots (ids after the real nodes, by lineage name) and the global root after them.

    One row per lineage plus one; stages lie one virtual step before what they precede.
    """
    whole = nodes.agg(F.count("*").alias("_n"), F.min("stage").alias("_low"),
                      F.max("stage").alias("_high"), F.countDistinct("lineage").alias("_lineages"))
    step = F.greatest(F.lit(0.1), (F.col("_high") - F.col("_low")) * F.lit(0.01))
    starts = materialize(nodes.groupBy("lineage").agg(F.min("stage").alias("_start")))
    roots = (number_rows(starts, [], ["lineage"], "_place").crossJoin(whole).select(
        (F.col("_n") + F.col("_place")).alias("node_id"), "lineage",
        F.lit("lineage_root").alias("node_type"), (F.col("_start") - step).alias("tree_stage")))
    top = whole.select(
        (F.col("_n") + F.col("_lineages")).alias("node_id"), F.lit("Global").alias("lineage"),
        F.lit("global_root").alias("node_type"), (F.col("_low") - step - step).alias("tree_stage"))
    return roots.unionByName(top)


def virtual_edges(nodes: DataFrame, virtual: DataFrame, window: float = 0.5) -> DataFrame:
    """Edges global root -> lineage roots -> early nodes, shared by cells and evenly by lineage."""
    top = virtual.where("node_type = 'global_root'").select(
        F.col("node_id").alias("parent_id"), F.col("tree_stage").alias("parent_stage"))
    lineages = virtual.where("node_type = 'lineage_root'")
    count = lineages.agg(F.count("*").alias("_lineages"))
    share = 1 / F.col("_lineages").cast("double")
    upper = lineages.crossJoin(top).crossJoin(count).select(
        "parent_id", F.col("node_id").alias("child_id"), "lineage",
        F.lit("global_root").alias("edge_kind"), share.alias("transition_probability"),
        "parent_stage", F.col("tree_stage").alias("child_stage"))
    lower = early_roots(nodes, window).join(
        lineages.select("lineage", F.col("node_id").alias("parent_id"),
                        F.col("tree_stage").alias("parent_stage")), "lineage").select(
        "parent_id", F.col("node_id").alias("child_id"), "lineage",
        F.lit("lineage_root").alias("edge_kind"), F.col("root_share").alias("transition_probability"),
        "parent_stage", F.col("stage").alias("child_stage"))
    return upper.unionByName(lower).select(
        "*", F.lit(True).alias("virtual_edge"), F.lit(None).cast("double").alias("cosine_distance"),
        F.col("transition_probability").alias("markov_flow"),
        (F.col("child_stage") - F.col("parent_stage")).alias("stage_delta"),
        F.lit(False).alias("mutual_knn"), F.lit(False).alias("fallback_edge"))


def tree_edges(nodes: DataFrame, edges: DataFrame, virtual: DataFrame, window: float = 0.5) -> DataFrame:
    """All edges of the tree. `edges` carry markov_flow."""
    real = best_parents(edges).select(
        F.col("source_id").alias("parent_id"), F.col("target_id").alias("child_id"), "lineage",
        F.lit("node_knn").alias("edge_kind"), F.lit(False).alias("virtual_edge"), "cosine_distance",
        "transition_probability", "markov_flow", F.col("source_stage").alias("parent_stage"),
        F.col("target_stage").alias("child_stage"), "stage_delta", "mutual_knn", "fallback_edge")
    return real.unionByName(virtual_edges(nodes, virtual, window))


def tree_nodes(nodes: DataFrame, virtual: DataFrame) -> DataFrame:
    """Real nodes plus virtual ones; columns a virtual node lacks are null, its counts are zero."""
    real = nodes.withColumn("node_type", F.lit(REAL)).withColumn("tree_stage", F.col("stage"))
    empty = virtual.withColumn("n_cells", F.lit(0).cast("long")).withColumn(
        "n_metacells", F.lit(0).cast("long"))
    return real.unionByName(empty, allowMissingColumns=True).select(*real.columns)


def mark_selected(edges: DataFrame) -> DataFrame:
    """Add selected_tree_edge to the candidate edges."""
    kept = best_parents(edges).select("source_id", "target_id", F.lit(True).alias("_kept"))
    return (edges.join(shuffled(kept), ["source_id", "target_id"], "left")
            .withColumn("selected_tree_edge", F.coalesce("_kept", F.lit(False))).drop("_kept"))


def check_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations in one row; all are zero for a tree.

    One parent for all nodes but the global root, together with real edges that only point forward in
    stage and virtual ones above them, rules out cycles and unreachable nodes.
    """
    incoming = edges.groupBy(F.col("child_id").alias("node_id")).agg(F.count("*").alias("_in"))
    expected = F.when(F.col("node_type") == "global_root", 0).otherwise(1)
    degrees = nodes.join(shuffled(incoming), "node_id", "left").agg(
        F.count_if(F.coalesce("_in", F.lit(0)) != expected).alias("wrong_indegree"),
        F.count("*").alias("n_nodes"))
    shape = edges.agg(F.count("*").alias("n_edges"),
                      F.count_if(~F.col("virtual_edge") & ~(F.col("stage_delta") > 0))
                      .alias("not_forward"))
    return degrees.crossJoin(shape).select(
        (F.col("n_edges") - F.col("n_nodes") + 1).alias("extra_edges"), "wrong_indegree", "not_forward")


def require_tree(nodes: DataFrame, edges: DataFrame) -> None:
    row = check_tree(nodes, edges).first()
    if row["extra_edges"] or row["wrong_indegree"] or row["not_forward"]:
        raise ContractError(f"not a tree: {row.asDict()}")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree and out_degree of every node, zero included."""
    ins = edges.groupBy(F.col("child_id").alias("node_id")).agg(F.count("*").alias("_in"))
    outs = edges.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_out"))
    return (nodes.join(shuffled(ins), "node_id", "left").join(shuffled(outs), "node_id", "left")
            .withColumn("in_degree", F.coalesce("_in", F.lit(0)))
            .withColumn("out_degree", F.coalesce("_out", F.lit(0))).drop("_in", "_out"))


def topology_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots, branch nodes and terminals among real nodes joined by real edges."""
    ids = nodes.where(F.col("node_type") == REAL).select("node_id")
    d = degrees(ids, real_edges(nodes, edges))
    return d.agg(F.count("*").alias("n_nodes"),
                 F.count_if(F.col("in_degree") == 0).alias("n_roots"),
                 F.count_if(F.col("out_degree") > 1).alias("n_branch_nodes"),
                 F.count_if(F.col("out_degree") == 0).alias("n_terminals"))


def real_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between real nodes."""
    ids = shuffled(nodes.where(F.col("node_type") == REAL).select("node_id"))
    return (edges.join(ids.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi")
            .join(ids.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi"))


def branch_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with the branch segment it lies on: segment_id, step (1 = first edge), parent, child.

    Segments run between key nodes (virtual, or not exactly one edge in and one out) and are numbered
    by start node, then first child. Pointer doubling finds the first edge of each segment.
    """
    d = materialize(degrees(nodes.select("node_id", "node_type"), edges).select(
        "node_id", ((F.col("node_type") != REAL) | (F.col("in_degree") != 1) | (F.col("out_degree") != 1))
        .alias("_key")))
    # An edge is identified by its child; it continues the edge above it unless its parent is a key node.
    links = edges.join(shuffled(d.withColumnRenamed("node_id", "parent_id")), "parent_id").select(
        F.col("child_id").alias("node"), F.when(~F.col("_key"), F.col("parent_id")).alias("parent"))
    heads = follow_parents(links)
    placed = edges.select("parent_id", "child_id").join(
        shuffled(heads.select(F.col("node").alias("child_id"), F.col("root").alias("first_child"),
                              (F.col("depth") + 1).alias("step"))), "child_id")
    starts = placed.where("step = 1").select(F.col("parent_id").alias("start_node_id"), "first_child")
    numbered = number_rows(materialize(starts), [], ["start_node_id", "first_child"], "segment_id")
    return placed.join(shuffled(numbered), "first_child").select(
        "segment_id", "step", "parent_id", "child_id", "start_node_id")


def branch_segments(nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One row per branch segment with its ends, span and what its real nodes hold."""
    paths = materialize(branch_paths(nodes, edges)) if paths is None else paths
    start = paths.where("step = 1").select("segment_id", F.col("start_node_id").alias("node_id"),
                                           F.lit(0).cast("long").alias("step"))
    members = start.unionByName(paths.select("segment_id", F.col("child_id").alias("node_id"), "step"))
    optional = "celltype_purity" if "celltype_purity" in nodes.columns else None
    info = nodes.select("node_id", "node_type", "lineage", "tree_stage", "n_cells", "n_metacells",
                        (F.col(optional) if optional else F.lit(None).cast("double")).alias("_purity"))
    j = members.join(shuffled(info), "node_id")
    real, n, p = F.col("node_type") == REAL, F.col("n_cells"), F.col("_purity")
    named = F.when(F.col("lineage") != "Global", F.col("lineage"))
    rated = real & p.isNotNull()
    return j.groupBy("segment_id").agg(
        F.min_by("node_id", "step").alias("start_node_id"), F.max_by("node_id", "step").alias("end_node_id"),
        (F.count("*") - 1).alias("n_edges"), F.count_if(real).alias("n_real_nodes"),
        F.when(F.min(named) == F.max(named), F.min(named)).otherwise("Global").alias("lineage"),
        F.min_by("tree_stage", "step").alias("start_stage"), F.max_by("tree_stage", "step").alias("end_stage"),
        (F.max_by("tree_stage", "step") - F.min_by("tree_stage", "step")).alias("stage_span"),
        F.sum(F.when(real, F.col("n_metacells")).otherwise(0)).alias("n_metacells"),
        F.sum(F.when(real, n).otherwise(0)).alias("n_cells"),
        ratio(F.sum(F.when(rated, n * p)), F.sum(F.when(rated, n))).alias("cell_weighted_celltype_purity"))


def lineage_summary(nodes: DataFrame, candidates: DataFrame, edges: DataFrame,
                    segments: DataFrame) -> DataFrame:
    """Per lineage: counts of nodes, edges and segments, medians and maxima of tree edges.

    `nodes` holds real nodes with is_terminal.
    """
    count = F.count("*")
    n = nodes.groupBy("lineage").agg(count.alias("n_nodes"),
                                     F.count_if("is_terminal").alias("n_terminal_nodes"))
    c = candidates.groupBy("lineage").agg(
        count.alias("n_candidate_edges"), F.count_if("mutual_knn").alias("n_mutual_knn_edges"),
        F.count_if("fallback_edge").alias("n_fallback_candidate_edges"))
    real = edges.where(~F.col("virtual_edge"))
    t = real.groupBy("lineage").agg(
        count.alias("n_tree_edges"), F.count_if("fallback_edge").alias("n_fallback_tree_edges"),
        F.max("cosine_distance").alias("max_tree_cosine_distance"),
        F.max("stage_delta").alias("max_tree_stage_delta"))
    far = quantiles(real, ["lineage"], "cosine_distance", {"median_tree_cosine_distance": 0.5})
    late = quantiles(real, ["lineage"], "stage_delta", {"median_tree_stage_delta": 0.5})
    s = segments.groupBy("lineage").agg(count.alias("n_branch_segments"))
    for other in (c, t, far, late, s):
        n = n.join(other, "lineage", "left")
    counts = [x for x in n.columns if x.startswith("n_")]
    return n.fillna(0, subset=counts)


def _upward(edges: DataFrame, share) -> DataFrame:
    """Links from child to parent; with the stages of both, if known, as the numbers `spread` cuts into bands."""
    held = {"parent_stage", "child_stage"} <= set(edges.columns)
    numbers = [(-F.col(c).cast("double")).alias(n) for n, c in (("at", "child_stage"), ("to", "parent_stage"))] if held else []
    return edges.select(F.lit(0).alias("piece"), F.col("child_id").alias("source"),
                        F.col("parent_id").alias("target"), share.alias("share"), *numbers)


def _at(links: DataFrame) -> list:
    return [(-F.col("tree_stage").cast("double")).alias("at")] if "at" in links.columns else []


def _leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = edges.select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(shuffled(parents), "node_id", "left_anti")


def _bands(nodes: DataFrame) -> DataFrame:
    return number_rows(nodes.where("node_type = 'lineage_root'").select("lineage"), [], ["lineage"], "band")


def _place_leaves(ordered: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaf x inside the band of its lineage: evenly from .05 to .95, or the middle for one leaf."""
    totals = ordered.groupBy("lineage").agg(F.count("*").alias("_leaves"))
    spaced = F.lit(0.05) + F.lit(0.9) * ratio(F.col("_place"), F.col("_leaves") - 1)
    return (ordered.join(totals, "lineage").join(_bands(nodes), "lineage")
            .select("node_id", "tree_stage", (F.col("band") + F.when(F.col("_leaves") == 1, F.lit(0.5)).otherwise(spaced))
                    .alias("tree_x")))


def _with_x(nodes: DataFrame, edges: DataFrame, leaf_x: DataFrame, **how) -> DataFrame:
    """Inner nodes sit at the mean of their children.

    A leaf contributes to an ancestor with one over the product of the child counts on the way up.
    """
    fan = edges.groupBy("parent_id").agg(F.count("*").alias("_fan"))
    up = _upward(edges.join(shuffled(fan), "parent_id"), 1 / F.col("_fan").cast("double"))
    seeds = leaf_x.select(F.lit(0).alias("piece"), F.col("node_id").alias("node"),
                          F.col("tree_x").alias("mass"), *_at(up))
    x = spread(seeds, up, **how).select(F.col("node").alias("node_id"), F.col("mass").alias("tree_x"))
    return nodes.join(shuffled(x), "node_id", "left").withColumn("tree_y", F.col("tree_stage"))


def stage_layout(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Add tree_x and tree_y; leaves stand in order of (stage, id) inside their lineage's band."""
    leaves = materialize(_leaves(nodes, edges).select("node_id", "lineage", "tree_stage"))
    ordered = number_rows(leaves, ["lineage"], ["tree_stage", "node_id"], "_place")
    return _with_x(nodes, edges, _place_leaves(ordered, nodes), **how)


def tidy_layout(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Add tree_x and tree_y; every subtree keeps its leaves together.

    Children stand in order of (stage, earliest leaf, mean leaf stage, id). The place of a leaf is the
    number of leaves left of its path to the root: running leaf counts among siblings, summed along
    the parent links.
    """
    leaves = materialize(_leaves(nodes, edges).select("node_id", "lineage", "tree_stage"))
    up = _upward(edges, F.lit(1.0))
    seeds = leaves.select(F.lit(0).alias("piece"), F.col("node_id").alias("node"), F.lit(1.0).alias("count"),
                          F.col("tree_stage").alias("stages"), F.col("tree_stage").alias("earliest"), *_at(up))
    held = spread(seeds, up, sums=("count", "stages"), mins=("earliest",), **how)
    held = held.select(F.col("node").alias("child_id"), "count", "earliest",
                       (F.col("stages") / F.col("count")).alias("mean_leaf"))
    down = edges.join(shuffled(nodes.where("node_type <> 'global_root'").select(
        F.col("node_id").alias("child_id"), "tree_stage")), "child_id").join(shuffled(held), "child_id")
    down = down.select("parent_id", "child_id", "tree_stage", "earliest", "mean_leaf", "count")
    lined = running_sum(materialize(down), ["parent_id"],
                        ["tree_stage", "earliest", "mean_leaf", "child_id"], "count", "_upto")
    above = nodes.select(F.col("node_id").alias("parent_id"), "node_type")
    links = lined.join(shuffled(above), "parent_id").select(
        F.col("child_id").alias("node"),
        F.when(F.col("node_type") != "global_root", F.col("parent_id")).alias("parent"),
        (F.col("_upto") - F.col("count")).alias("left_of"))
    places = follow_parents(links, F.col("left_of"))
    ordered = leaves.join(shuffled(places.select(F.col("node").alias("node_id"), F.col("total").alias("_place"))),
                          "node_id")
    return _with_x(nodes, edges, _place_leaves(ordered, nodes), **how)
