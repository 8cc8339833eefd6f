"""Topology-aware contraction of a tree: paths, siblings, paths again, and the rebuilt tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize, shuffled
from arbora.functions.vectors import dimension, mean_vector
from arbora.operators.composition import dominant, regroup
from arbora.operators.ordering import number_rows
from arbora.operators.propagate import follow_parents
from arbora.operators.tree import REAL, degrees, topology_counts

CHAIN_ROWS = 50_000
# Nodes of short chains that go to one task, on average.
TASK_ROWS = 5_000


def require_single_parents(edges: DataFrame) -> None:
    if not edges.groupBy("child_id").count().where("count > 1").limit(1).isEmpty():
        raise ContractError("a node has more than one real parent")


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Real nodes whose real in- or out-degree is not one."""
    return degrees(nodes.select("node_id"), edges).where("in_degree <> 1 or out_degree <> 1").select("node_id")


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Maximal runs of nodes with one edge in and one out, each with its downstream anchor.

    Result: node_id, chain_id (first node), place (0 = first), is_anchor. Upstream anchors stay out.
    """
    d = materialize(degrees(nodes.select("node_id"), edges).join(
        shuffled(edges.select(F.col("child_id").alias("node_id"), "parent_id")), "node_id", "left").withColumn(
        "inner", (F.col("in_degree") == 1) & (F.col("out_degree") == 1)))
    above = d.select(F.col("node_id").alias("parent_id"), F.col("inner").alias("parent_inner"))
    # A node takes part if it is inner, or if it is the anchor right below an inner node.
    part = d.join(shuffled(above), "parent_id", "left").where(
        F.col("inner") | F.coalesce("parent_inner", F.lit(False)))
    links = part.select(F.col("node_id").alias("node"),
                        F.when(F.col("parent_inner"), F.col("parent_id")).alias("parent"))
    heads = follow_parents(links)
    return heads.join(shuffled(part.select(F.col("node_id").alias("node"), "inner")), "node").select(
        F.col("node").alias("node_id"), F.col("root").alias("chain_id"), F.col("depth").alias("place"),
        (~F.col("inner")).alias("is_anchor"))


def partition_chains(placed: DataFrame, nodes: DataFrame, max_distance: float, max_span: float,
                     chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """Greedy runs along each chain; result: node_id, head_id (first node of its run).

    A node joins the open run while its cosine distance to the run's cell-weighted sum and the run's
    stage span stay within the limits. Chains are independent and dealt to as many tasks as their nodes
    need. One round sees at most `chain_rows` nodes of a chain; a longer chain continues in the next round
    from the start of its last, still open run.
    """
    rows = materialize(placed.select("node_id", "chain_id", "place").join(
        shuffled(nodes.select("node_id", "stage", "n_cells", "embedding")), "node_id"))
    lengths = rows.groupBy("chain_id").agg(F.count("*").alias("length"))
    starts = lengths.withColumn("start", F.lit(0).cast("long"))
    tasks = 1 + rows.count() // TASK_ROWS

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chain_id", "place"])
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
        units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        weighted = vectors * pdf["n_cells"].to_numpy(dtype=np.float64)[:, None]
        stage = pdf["stage"].to_numpy(dtype=np.float64)
        chain, place = pdf["chain_id"].to_numpy(), pdf["place"].to_numpy()
        begins = np.r_[True, chain[1:] != chain[:-1]]
        head = np.zeros(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            if not begins[i]:
                gap = max(0.0, 1.0 - float(total @ units[i]) / max(float(np.linalg.norm(total)), 1e-12))
                new_low, new_high = min(low, stage[i]), max(high, stage[i])
                if gap <= max_distance and new_high - new_low <= max_span:
                    head[i] = head[i - 1]
                    total, low, high = total + weighted[i], new_low, new_high
                    continue
            head[i] = i
            total, low, high = weighted[i].copy(), stage[i], stage[i]
        ends = np.flatnonzero(np.r_[begins[1:], True])
        end = np.repeat(ends, np.diff(np.r_[-1, ends]))
        whole = place[end] == pdf["length"].to_numpy()[end] - 1
        ids = pdf["node_id"].to_numpy()
        return pd.DataFrame({"node_id": ids, "head_id": ids[head], "chain_id": chain, "place": place,
                             "closed": whole | (head != head[end])})

    parts = []
    while True:
        window = rows.join(shuffled(starts), "chain_id").where(
            (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + chain_rows))
        dealt = window.withColumn("_task", F.pmod(F.xxhash64("chain_id"), F.lit(tasks))).repartition(tasks, "_task")
        found = materialize(dealt.groupBy("_task").applyInPandas(
            runs, "node_id long, head_id long, chain_id long, place long, closed boolean"))
        parts.append(found.where("closed").select("node_id", "head_id"))
        unfinished = found.where("not closed")
        if unfinished.isEmpty():
            break
        rest = unfinished.groupBy("chain_id").agg(F.min("place").alias("start"))
        starts = materialize(rest.join(shuffled(lengths), "chain_id"))
        if found.where("closed").isEmpty():
            chain_rows *= 4  # one run fills the whole window: look farther ahead
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def path_groups(nodes: DataFrame, edges: DataFrame, max_distance: float, max_span: float,
                chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """Partition of all nodes by one pass of path contraction: node_id, head_id."""
    runs = partition_chains(chains(nodes, edges), nodes, max_distance, max_span, chain_rows)
    alone = nodes.select("node_id").join(shuffled(runs), "node_id", "left")
    return materialize(alone.select("node_id", F.coalesce("head_id", "node_id").alias("head_id")))


def group_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Cell-weighted stage, vector and size of each group, keyed by its head.

    The vector is the plain weighted mean, not scaled to length one.
    """
    width = dimension(nodes, "embedding")
    return nodes.join(shuffled(groups), "node_id").groupBy("head_id").agg(
        F.min("lineage").alias("lineage"), F.sum("n_cells").alias("n_cells"),
        (F.sum(F.col("stage") * F.col("n_cells")) / F.sum("n_cells")).alias("stage"),
        F.min("node_id").alias("min_source"), F.count("*").alias("n_sources"),
        mean_vector("embedding", width, "n_cells").alias("embedding"))


def group_edges(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different groups, once each (parent_id, child_id are heads)."""
    up = groups.select(F.col("node_id").alias("parent_id"), F.col("head_id").alias("_p"))
    down = groups.select(F.col("node_id").alias("child_id"), F.col("head_id").alias("_c"))
    return (edges.select("parent_id", "child_id").join(shuffled(up), "parent_id").join(shuffled(down), "child_id")
            .where("_p <> _c").select(F.col("_p").alias("parent_id"), F.col("_c").alias("child_id"))
            .distinct())


def second_path_pass(nodes: DataFrame, groups: DataFrame, edges: DataFrame, max_distance: float,
                     max_span: float) -> DataFrame:
    """Path contraction of the groups themselves; result refers to the source nodes."""
    pseudo = materialize(group_nodes(nodes, groups).withColumnRenamed("head_id", "node_id"))
    again = path_groups(pseudo, materialize(group_edges(groups, edges)), max_distance, max_span)
    outer = again.select(F.col("node_id").alias("head_id"), F.col("head_id").alias("outer"))
    return materialize(groups.join(shuffled(outer), "head_id").select("node_id", F.col("outer").alias("head_id")))


def number_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Final ids by (lineage, earliest member stage, lowest member id): head_id, contracted_node_id."""
    keyed = nodes.join(shuffled(groups), "node_id").groupBy("head_id").agg(
        F.min("lineage").alias("lineage"), F.min("stage").alias("first_stage"),
        F.min("node_id").alias("first_id"))
    return number_rows(materialize(keyed), [], ["lineage", "first_stage", "first_id"],
                       "contracted_node_id").select("head_id", "contracted_node_id")


def source_mapping(nodes: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """source_node_id, contracted_node_id, position inside it by (stage, id), and whether the source
    was an anchor of the original tree."""
    numbered = groups.join(shuffled(number_groups(nodes, groups)), "head_id").join(
        shuffled(nodes.select("node_id", "stage")), "node_id")
    placed = number_rows(materialize(numbered), ["contracted_node_id"], ["stage", "node_id"],
                         "position_within_contracted_node")
    marked = anchors(nodes, edges).withColumn("_anchor", F.lit(True))
    return placed.join(shuffled(marked), "node_id", "left").select(
        F.col("node_id").alias("source_node_id"), "contracted_node_id",
        "position_within_contracted_node", F.coalesce("_anchor", F.lit(False)).alias("source_was_anchor"))


def contracted_nodes(nodes: DataFrame, mapping: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """One row per contracted node; `comp` (node_id, celltype, cell_count) adds its dominant label."""
    width = dimension(nodes, "embedding")
    m = mapping.select(F.col("source_node_id").alias("node_id"), "contracted_node_id")
    plain = "mean_stage" if "mean_stage" in nodes.columns else "stage"
    low = "min_stage" if "min_stage" in nodes.columns else "stage"
    high = "max_stage" if "max_stage" in nodes.columns else "stage"
    weighted = F.sum(F.col("stage") * F.col("n_cells")) / F.sum("n_cells")
    rows = nodes.join(shuffled(m), "node_id").groupBy(F.col("contracted_node_id")).agg(
        F.min("lineage").alias("lineage"), F.count("*").alias("n_source_nodes"),
        F.sum("n_metacells").alias("total_metacells"), F.sum("n_cells").alias("total_cells"),
        (F.sum(F.col(plain) * F.col("n_metacells")) / F.sum("n_metacells")).alias("mean_stage"),
        weighted.alias("cell_weighted_mean_stage"), F.min(low).alias("min_stage"),
        F.max(high).alias("max_stage"), mean_vector("embedding", width, "n_cells").alias("embedding"))
    rows = rows.select(
        F.col("contracted_node_id").alias("node_id"), "lineage", "n_source_nodes",
        F.col("total_metacells").alias("n_metacells"), F.col("total_cells").alias("n_cells"),
        "mean_stage", "cell_weighted_mean_stage", "min_stage", "max_stage",
        F.lit(REAL).alias("node_type"), F.col("cell_weighted_mean_stage").alias("tree_stage"), "embedding")
    if comp is None:
        return rows
    top = dominant(regroup(comp, m, "node_id", "contracted_node_id"), "contracted_node_id").select(
        F.col("contracted_node_id").alias("node_id"), "dominant_celltype",
        F.col("dominant_celltype_count").alias("dominant_celltype_cells"), "celltype_purity")
    return rows.join(shuffled(top), "node_id", "left")


def rebuilt_tree(contracted: DataFrame, old_nodes: DataFrame, old_edges: DataFrame,
                 mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the contracted tree.

    Virtual nodes follow the real ones in order of (type, lineage, id). Edges inside a group vanish and
    parallel edges keep the first in (parent stage, parent id, child id) order.
    """
    old_virtual = old_nodes.where(F.col("node_type") != REAL).select(
        F.col("node_id").alias("old_id"), "lineage", "node_type", "tree_stage")
    count = contracted.agg(F.count("*").alias("_n"))
    virtual = number_rows(old_virtual, [], ["node_type", "lineage", "old_id"], "_place").crossJoin(count)
    virtual = materialize(virtual.withColumn("node_id", F.col("_n") + F.col("_place")))
    ids = mapping.select(F.col("source_node_id").alias("old_id"),
                         F.col("contracted_node_id").alias("new_id")).unionByName(
        virtual.select("old_id", F.col("node_id").alias("new_id")))
    zero = F.lit(0).cast("long")
    nodes = contracted.unionByName(
        virtual.select("node_id", "lineage", "node_type", "tree_stage", zero.alias("n_cells"),
                       zero.alias("n_metacells"), zero.alias("n_source_nodes")), allowMissingColumns=True)
    up = ids.select(F.col("old_id").alias("source_parent_id"), F.col("new_id").alias("parent_id"))
    down = ids.select(F.col("old_id").alias("source_child_id"), F.col("new_id").alias("child_id"))
    moved = (old_edges.select(F.col("parent_id").alias("source_parent_id"),
                              F.col("child_id").alias("source_child_id"), "lineage", "edge_kind",
                              "virtual_edge", F.col("parent_stage").alias("_old_stage"))
             .join(shuffled(up), "source_parent_id").join(shuffled(down), "source_child_id").where("parent_id <> child_id"))
    first = F.struct("_old_stage", "source_parent_id", "source_child_id", "lineage", "edge_kind",
                     "virtual_edge")
    kept = moved.groupBy("parent_id", "child_id").agg(F.min(first).alias("_first")).select(
        "parent_id", "child_id", "_first.lineage",
        F.when(F.col("_first.virtual_edge"), F.col("_first.edge_kind")).otherwise("contracted_tree")
        .alias("edge_kind"), "_first.virtual_edge", "_first.source_parent_id", "_first.source_child_id")
    stage = nodes.select("node_id", "tree_stage")
    edges = (kept.join(shuffled(stage.select(F.col("node_id").alias("parent_id"),
                                             F.col("tree_stage").alias("parent_stage"))), "parent_id")
             .join(shuffled(stage.select(F.col("node_id").alias("child_id"),
                                         F.col("tree_stage").alias("child_stage"))), "child_id")
             .withColumn("stage_delta", F.col("child_stage") - F.col("parent_stage")))
    return nodes, edges


def require_conserved(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame,
                      new_edges: DataFrame, siblings: bool) -> None:
    """Cells, metacells and roots are kept; without sibling merges branches and terminals are too."""
    if not new_edges.where("stage_delta <= 0").limit(1).isEmpty():
        raise ContractError("contraction made an edge that does not point forward")

    def totals(nodes):
        return nodes.where(F.col("node_type") == REAL).agg(
            F.sum("n_cells"), F.sum("n_metacells")).first()

    if tuple(totals(old_nodes)) != tuple(totals(new_nodes)):
        raise ContractError("contraction changed the number of cells or metacells")
    before, after = (topology_counts(n, e).first() for n, e in ((old_nodes, old_edges),
                                                               (new_nodes, new_edges)))
    kept = ["n_roots"] if siblings else ["n_roots", "n_branch_nodes", "n_terminals"]
    grown = ["n_branch_nodes", "n_terminals"] if siblings else []
    if any(before[c] != after[c] for c in kept) or any(after[c] > before[c] for c in grown):
        raise ContractError("contraction changed the topology beyond what its passes may do")


def contraction_summary(nodes: DataFrame, first: DataFrame, siblings: DataFrame,
                        final: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes before and after each pass and how many sources the groups hold."""
    def heads(groups, name):
        return groups.agg(F.countDistinct("head_id").alias(name))

    sizes = mapping.groupBy("contracted_node_id").agg(F.count("*").alias("_size"))
    shape = sizes.agg(F.max("_size").alias("max_sources"), F.count_if(F.col("_size") > 1).alias("merged_groups"))
    # Anchors are counted in the groups of the first path pass; sibling merges do not add to them.
    anchors = mapping.select(F.col("source_node_id").alias("node_id"), "source_was_anchor")
    met = first.join(anchors, "node_id").groupBy("head_id").agg(
        F.count("*").alias("_size"), F.count_if("source_was_anchor").alias("_anchors"))
    met = met.agg(F.coalesce(F.sum(F.when(F.col("_size") > 1, F.col("_anchors"))), F.lit(0)).alias("merged_anchors"))
    row = (nodes.agg(F.count("*").alias("n_source_nodes")).crossJoin(heads(first, "_first"))
           .crossJoin(heads(siblings, "_siblings")).crossJoin(heads(final, "n_contracted_nodes"))
           .crossJoin(shape).crossJoin(met))
    return row.select(
        "n_source_nodes", "n_contracted_nodes",
        (F.col("n_source_nodes") - F.col("_first")).alias("removed_by_paths"),
        (F.col("_first") - F.col("_siblings")).alias("removed_by_siblings"),
        (F.col("_siblings") - F.col("n_contracted_nodes")).alias("removed_by_second_paths"),
        "max_sources", "merged_groups", "merged_anchors")
