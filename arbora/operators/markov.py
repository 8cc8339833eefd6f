"""Stage-directed candidate graph, transition probabilities, flow and terminal fate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize, shuffled
from arbora.operators.neighbors import BLOCK_ROWS, nearest
from arbora.operators.ordering import quantiles
from arbora.operators.propagate import spread


def lineage_starts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("lineage").agg(F.min("stage").alias("first_stage"))


def early_roots(nodes: DataFrame, window: float = 0.5) -> DataFrame:
    """Nodes inside the early window of their lineage, with their share of its root cells."""
    roots = (nodes.join(lineage_starts(nodes), "lineage")
             .where(F.col("stage") <= F.col("first_stage") + window))
    totals = roots.groupBy("lineage").agg(F.sum("n_cells").alias("root_cells"))
    return roots.join(totals, "lineage").select(
        "node_id", "lineage", "stage", "n_cells",
        (F.col("n_cells") / F.col("root_cells")).alias("root_share"))


def node_neighbours(nodes: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written neighbour table of the nodes, with the nearest earlier node of each."""
    return materialize(nearest(nodes.withColumnRenamed("node_id", "id"), k, earlier=True,
                               block_rows=block_rows))


def candidate_edges(nodes: DataFrame, neighbours: DataFrame, window: float = 0.5) -> DataFrame:
    """Neighbour pairs turned from the earlier to the later node, plus fallback parents.

    Pairs of equal stage and edges into early roots are left out. A later node that got no edge takes
    its most similar earlier node, however far away in stage.
    """
    starts = lineage_starts(nodes)
    turned = (neighbours.where("rank > 0 and stage <> other_stage")
              .withColumn("forward", F.col("stage") < F.col("other_stage"))
              .groupBy("lineage",
                       F.when(F.col("forward"), F.col("id")).otherwise(F.col("other")).alias("source_id"),
                       F.when(F.col("forward"), F.col("other")).otherwise(F.col("id")).alias("target_id"))
              .agg(F.max("similarity").alias("cosine_similarity"),
                   F.count("*").cast("int").alias("knn_memberships"),
                   F.min(F.least("stage", "other_stage")).alias("source_stage"),
                   F.max(F.greatest("stage", "other_stage")).alias("target_stage"))
              .withColumn("mutual_knn", F.col("knn_memberships") == 2)
              .withColumn("fallback_edge", F.lit(False)))
    late = F.col("target_stage") > F.col("first_stage") + window
    edges = turned.join(starts, "lineage").where(late).drop("first_stage")
    reached = edges.select("target_id").distinct()
    fallback = (neighbours.where("rank = 0")
                .select("lineage", F.col("other").alias("source_id"), F.col("id").alias("target_id"),
                        F.col("similarity").alias("cosine_similarity"),
                        F.lit(0).alias("knn_memberships"),
                        F.col("other_stage").alias("source_stage"), F.col("stage").alias("target_stage"),
                        F.lit(False).alias("mutual_knn"), F.lit(True).alias("fallback_edge"))
                .join(starts, "lineage").where(late).drop("first_stage")
                .join(shuffled(reached), "target_id", "left_anti"))
    return edges.unionByName(fallback).select(
        "source_id", "target_id", "cosine_similarity", "knn_memberships", "mutual_knn",
        "fallback_edge", "lineage", "source_stage", "target_stage",
        (F.col("target_stage") - F.col("source_stage")).alias("stage_delta"),
        F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.col("cosine_similarity")))
        .alias("cosine_distance"))


def weighted_edges(edges: DataFrame, mutual_bonus: float = 1.5, temperature: float = 0.0) -> DataFrame:
    """Distance kernel weights and the probabilities they give each node's outgoing edges.

    Without a fixed temperature, each lineage uses the median of its positive distances.
    """
    if mutual_bonus < 1 or temperature < 0:
        raise ContractError("mutual bonus must be at least 1 and temperature not negative")
    if temperature > 0:
        warmed = edges.withColumn("distance_temperature", F.greatest(F.lit(temperature), F.lit(1e-6)))
    else:
        medians = quantiles(edges.where("cosine_distance > 1e-8"), ["lineage"], "cosine_distance",
                            {"_median": 0.5})
        warmed = (edges.join(medians, "lineage", "left")
                  .withColumn("distance_temperature",
                              F.greatest(F.coalesce("_median", F.lit(0.05)), F.lit(1e-6)))
                  .drop("_median"))
    heat = F.exp(F.greatest(F.lit(-80.0), -F.col("cosine_distance") / F.col("distance_temperature")))
    weighted = warmed.withColumn(
        "raw_weight", F.when(F.col("mutual_knn"), heat * mutual_bonus).otherwise(heat))
    totals = weighted.groupBy("source_id").agg(F.sum("raw_weight").alias("_out"))
    return (weighted.join(shuffled(totals), "source_id")
            .withColumn("transition_probability", F.col("raw_weight") / F.col("_out"))
            .drop("_out"))


def candidate_graph(nodes: DataFrame, k: int = 10, window: float = 0.5, mutual_bonus: float = 1.5,
                    temperature: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The whole weighted candidate graph of `nodes` (node_id, lineage, stage, n_cells, embedding)."""
    if k < 1 or not 0 <= window < float("inf"):
        raise ContractError("k must be positive and the root window finite and not negative")
    edges = materialize(candidate_edges(nodes, node_neighbours(nodes, k, block_rows), window))
    return materialize(weighted_edges(edges, mutual_bonus, temperature))


def _stages(edges: DataFrame, sign: int = 1, **names) -> list:
    """Stages as the numbers that `spread` cuts into bands; none where the edges do not hold them."""
    held = {"source_stage", "target_stage"} <= set(edges.columns)
    return [(sign * F.col(c).cast("double")).alias(n) for n, c in names.items()] if held else []


def node_flow(roots: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Share of its lineage's mass that passes through each node (node_id, flow)."""
    seeds = roots.select(F.col("lineage").alias("piece"), F.col("node_id").alias("node"),
                         F.col("root_share").alias("mass"), *_stages(edges, at="stage"))
    links = edges.select(F.col("lineage").alias("piece"), F.col("source_id").alias("source"),
                         F.col("target_id").alias("target"),
                         F.col("transition_probability").alias("share"),
                         *_stages(edges, at="source_stage", to="target_stage"))
    return spread(seeds, links, **how).select(F.col("node").alias("node_id"), F.col("mass").alias("flow"))


def edge_flow(edges: DataFrame, flow: DataFrame) -> DataFrame:
    """Add markov_flow = flow of the source x transition probability."""
    at_source = flow.select(F.col("node_id").alias("source_id"), F.col("flow").alias("_flow"))
    return (edges.join(shuffled(at_source), "source_id", "left")
            .withColumn("markov_flow", F.coalesce("_flow", F.lit(0.0)) * F.col("transition_probability"))
            .drop("_flow"))


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    leaving = edges.select(F.col("source_id").alias("node_id")).distinct()
    return nodes.join(shuffled(leaving), "node_id", "left_anti")


def require_conserved_flow(nodes: DataFrame, edges: DataFrame, flow: DataFrame) -> None:
    """What arrives at the sinks of a lineage must add up to one."""
    bad = (sinks(nodes, edges).join(flow, "node_id").groupBy("lineage")
           .agg(F.sum("flow").alias("total")).where("abs(total - 1) > 1e-5").limit(1).count())
    if bad:
        raise ContractError("terminal flow of a lineage differs from one")


def fates(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """Probability of ending in each reachable sink (node_id, terminal_node_id, fate_probability)."""
    ends = sinks(nodes, edges)
    seeds = ends.select(F.col("lineage").alias("piece"), F.col("node_id").alias("node"),
                        F.col("node_id").alias("terminal"), F.lit(1.0).alias("mass"), *_stages(edges, -1, at="stage"))
    back = edges.select(F.col("lineage").alias("piece"), F.col("target_id").alias("source"), F.col("source_id").alias("target"),
                        F.col("transition_probability").alias("share"),
                        *_stages(edges, -1, at="target_stage", to="source_stage"))

    def shares(raw: DataFrame) -> DataFrame:
        totals = raw.groupBy("node").agg(F.sum("mass").alias("_total"))
        return raw.join(totals, "node").select(
            F.col("node").alias("node_id"), F.col("terminal").alias("terminal_node_id"),
            (F.col("mass") / F.col("_total")).alias("fate_probability"))

    return spread(seeds, back, tags=["terminal"], finish=shares, **how)


def node_fates(fate: DataFrame) -> DataFrame:
    """Per node: most likely sink (lowest id on a tie), its probability and the entropy in nats."""
    best = F.max(F.struct(F.col("fate_probability"), -F.col("terminal_node_id")))
    p = F.col("fate_probability")
    return fate.groupBy("node_id").agg(
        best.alias("_best"),
        F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("fate_entropy")).select(
        "node_id", (-F.col("_best.col2")).alias("most_likely_terminal_id"),
        F.col("_best.fate_probability").alias("most_likely_terminal_probability"), "fate_entropy")


def retained_fates(fate: DataFrame, nodes: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """Fates of at least `threshold`, or the best one where none is, with the mass kept.

    Fates are scanned; only the best of each node and task is shuffled, unless an id stands for nodes of two lineages.
    """
    low = node_fates(fate).where(F.col("most_likely_terminal_probability") < threshold)
    columns = ["node_id", "terminal_node_id", "fate_probability"]
    twice = nodes.groupBy("node_id").agg(F.min("lineage").alias("a"), F.max("lineage").alias("b")).where("a < b")
    if twice.isEmpty():
        rest = low.select("node_id", F.col("most_likely_terminal_id").alias("terminal_node_id"),
                          F.col("most_likely_terminal_probability").alias("fate_probability"))
    else:
        best = low.select(F.col("node_id").alias("_node"), F.col("most_likely_terminal_id").alias("_best"))
        rest = fate.join(best, (F.col("node_id") == F.col("_node")) & (F.col("terminal_node_id") == F.col("_best")))
    kept = materialize(fate.where(F.col("fate_probability") >= threshold).select(*columns).unionByName(rest.select(*columns)))
    mass = kept.groupBy("node_id").agg(F.sum("fate_probability").alias("retained_probability_mass"))
    return kept.join(mass, "node_id").join(nodes.select("node_id", "lineage"), "node_id")


def best_parents(edges: DataFrame) -> DataFrame:
    """The one incoming edge each node keeps: highest probability, then weight, then closeness, then id.

    Edges always point forward in stage, so these choices together are the heaviest arborescence.
    """
    order = F.struct(F.col("transition_probability"), F.col("raw_weight"),
                     -F.col("cosine_distance"), -F.col("source_id"))
    rest = F.struct(*[F.col(c) for c in edges.columns])
    return (edges.groupBy(F.col("target_id").alias("_target"))
            .agg(F.max_by(rest, order).alias("_edge")).select("_edge.*"))


def orphans(nodes: DataFrame, edges: DataFrame, window: float = 0.5) -> DataFrame:
    """Later nodes without a candidate parent; a valid graph has none."""
    roots = early_roots(nodes, window).select("node_id")
    reached = edges.select(F.col("target_id").alias("node_id")).distinct()
    return nodes.join(shuffled(roots), "node_id", "left_anti").join(shuffled(reached), "node_id", "left_anti")


